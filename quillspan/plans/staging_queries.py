"""Queries of text evidence, labels, merging, selection and checks of tasks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import resolution as V
from quillspan.operators import staging as S
from quillspan.operators.sampling import carve, first_by_hash
from quillspan.plans.registry import query
from quillspan.session import materialize, read_table


def table(spark, d, name):
    return read_table(spark, d, name)


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) AS folded FROM documents WHERE length(text) < 2000")
def b04_fold_ascii(spark, d):
    """Texts of ordinary length in the alphabet that titles are compared in."""
    return table(spark, d, "documents").where("length(text) < 2000").select("doc_id", T.fold_ascii(F.col("text")).alias("folded"))


@query("SELECT item_id, CASE WHEN item_id % 4 = 0 THEN trim(text) ELSE rtrim(trim('Item ' || item_id || '.'), '.') || '. ' || trim(text) END AS doc FROM benchmark")
def b16_document_text(spark, d):
    title = F.when(F.col("item_id") % 4 == 0, F.col("text")).otherwise(F.concat(F.lit("Item "), F.col("item_id").cast("string"), F.lit(".")))
    return table(spark, d, "benchmark").select("item_id", T.document_text(title, F.when(F.col("item_id") % 4 != 0, F.col("text"))).alias("doc"))


@query("SELECT a.conv_id, a.turn, trim(trim(a.text) || coalesce(' ' || trim(b.text), '')) AS question FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user'")
def b17_question_text(spark, d):
    """A question and what stands behind it."""
    c = table(spark, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("background"))
    return c.where("role = 'user'").join(nxt, ["conv_id", "turn"], "left").select("conv_id", "turn", T.question_text(F.col("text"), F.col("background")).alias("question"))


@query("WITH n AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL), p AS (SELECT o_custkey, max(n)::DOUBLE / sum(n) AS purity FROM n GROUP BY o_custkey) SELECT c_custkey, CASE WHEN purity IS NULL THEN NULL WHEN purity >= 2.0 / 3 THEN 'clear' ELSE 'ambiguous' END AS confidence FROM customer LEFT JOIN p ON c_custkey = o_custkey")
def b20_confidence(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    p = n.groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.max("n") / F.sum("n")).alias("purity"))
    return table(spark, d, "customer").join(p, "c_custkey", "left").select("c_custkey", T.confidence(F.col("purity")).alias("confidence"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN trim(text) ELSE trim(text) END AS answer FROM conversations")
def b26_answers(spark, d):
    """What stands behind "Answer:" in a reply; all of a reply without the mark."""
    t = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("Thought: none. Answer: "), "text")).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.answer_after(t).alias("answer"))


REFERENCE = "'Smith, J., ' || s_name || ' and Green, B. (' || (1990 + s_suppkey % 30) || ') On parts of nation ' || s_nationkey || '. Annual Review of Supply ' || s_suppkey || ', 345-350 (' || (1990 + s_suppkey % 30) || ')'"


@query(f"""WITH r AS (SELECT s_suppkey, {REFERENCE} AS raw, 'on parts of nation' AS title FROM supplier) SELECT s_suppkey, array_to_string(list_distinct(regexp_extract_all(raw, '\\b((?:19|20)[0-9]{{2}})\\b', 1)), ',') AS years,
  len(list_distinct(regexp_extract_all(raw, '([A-Z][a-z]+),', 1))) AS n_surnames, len(list_filter(list_distinct(regexp_extract_all(lower(raw), '[a-z]{{4,}}')), lambda x: NOT list_contains(regexp_extract_all(title, '[a-z]{{4,}}'), x))) AS n_venue_words FROM r""")
def b29_reference_evidence(spark, d):
    """Of two years, DuckDB's list_distinct names the later found first."""
    r = table(spark, d, "supplier").select("s_suppkey", F.expr(REFERENCE).alias("raw"), F.lit("on parts of nation").alias("title"))
    e = T.reference_evidence(F.col("raw"), F.col("title"))
    return r.select("s_suppkey", F.array_join(F.reverse(e["years"]), ",").alias("years"), F.size(e["surnames"]).cast("long").alias("n_surnames"), F.size(e["venue_words"]).cast("long").alias("n_venue_words"))


@query("WITH r AS (SELECT p_partkey, p_brand || ' ' || p_size || ', ' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '-' || (p_partkey + 9) END || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ' (' || (1990 + p_size % 30) || ')' END AS raw FROM part) SELECT p_partkey, "
  + ", ".join(f"regexp_extract(raw, '^(.*) ([0-9]+), ([0-9]+)(?:-[0-9]+)? \\(([0-9]{{4}})\\)$', {i}) AS {name}" for i, name in enumerate(("head", "volume", "page", "year"), 1)) + " FROM r")
def b32_locators(spark, d):
    raw = "p_brand || ' ' || p_size || ', ' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '-' || (p_partkey + 9) END || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ' (' || (1990 + p_size % 30) || ')' END"
    r = table(spark, d, "part").select("p_partkey", F.expr(raw).alias("raw"))
    return r.select("p_partkey", *(c.alias(name) for name, c in T.locator(F.col("raw")).items()))


BLOCK = "'Mechanism: ' || event_type || chr(10) || CASE event_id % 3 WHEN 0 THEN 'evidence : of user ' || user_id WHEN 1 THEN 'Evidence:' ELSE 'none' END || chr(10) || 'the background says this  much'"


@query(f"WITH b AS (SELECT event_id, {BLOCK} AS block FROM events) SELECT event_id, array_to_string(list_filter(['mechanism', 'evidence', 'scope'], lambda x: NOT regexp_matches(lower(block), '(^|\\n)\\s*' || x || '[ \\t]*:[ \\t]*[^ \\t\\n]')), ',') AS missing, event_id % 2 = 0 AS echo FROM b")
def b37_delta_blocks(spark, d):
    """Levels that a block lacks, and whether it repeats the background."""
    background = F.when(F.col("event_id") % 2 == 0, "As known, THE background says   this much, and more").otherwise("other words")
    b = table(spark, d, "events").select("event_id", F.expr(BLOCK).alias("block"), background.alias("background"))
    return b.select("event_id", F.array_join(T.missing_levels(F.col("block"), ["mechanism", "evidence", "scope"]), ",").alias("missing"), T.echoes(F.col("block"), F.col("background")).alias("echo"))


WORDS = "list_distinct(string_split(trim(regexp_replace(lower({0}), '\\s+', ' ', 'g')), ' '))"


@query(f"""WITH t AS (SELECT a.item_id, a.text AS x, array_to_string(list_slice(string_split(a.text, ' '), 1, 4 + (a.item_id % 9)::INT), ' ') AS y FROM benchmark a), w AS (SELECT *, {WORDS.format('x')} AS a, {WORDS.format('y')} AS b FROM t)
  SELECT item_id, trim(regexp_replace(lower(x), '\\s+', ' ', 'g')) = trim(regexp_replace(lower(y), '\\s+', ' ', 'g')) OR (least(len(a), len(b)) >= 3 AND len(list_intersect(a, b)) >= 0.75 * least(len(a), len(b))) AS same FROM w""")
def b39_same_title(spark, d):
    y = F.array_join(F.slice(F.split("text", " "), F.lit(1), (4 + F.col("item_id") % 9).cast("int")), " ")
    return table(spark, d, "benchmark").select("item_id", T.same_title(T.norm_space(F.col("text")), T.norm_space(y)).alias("same"))


@query("""WITH g AS (SELECT l_orderkey AS o_orderkey, list_sort(list(l_linenumber::BIGINT - 1)) = range(count(*)) AND bool_and(l_quantity < 48) AS ok FROM lineitem GROUP BY l_orderkey)
  SELECT o_orderkey, coalesce(ok, false) AND o_orderstatus <> 'P' AND o_totalprice > 1000 AND o_orderkey % 2 = 0 AS pass FROM orders LEFT JOIN g USING (o_orderkey)""")
def b40_gates(spark, d):
    """All members judged and necessary, and three more verdicts."""
    judged = F.struct((F.col("l_linenumber") - 1).alias("index"), (F.col("l_quantity") < 48).alias("necessary"))
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(judged).alias("necessity"), F.count("*").alias("n"))
    verdict = S.gates_pass(F.col("necessity"), F.col("n"), F.col("o_orderstatus") != "P", F.col("o_totalprice") > 1000, F.col("o_orderkey") % 2 == 0)
    return table(spark, d, "orders").join(g, "o_orderkey", "left").select("o_orderkey", F.coalesce(verdict, F.lit(False)).alias("pass"))


@query("""WITH t AS (SELECT item_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS i FROM benchmark), s AS (SELECT *, length(w) <= 3 AS short, i - row_number() OVER (PARTITION BY item_id, length(w) <= 3 ORDER BY i) AS island FROM t),
  r AS (SELECT item_id, island, count(*) AS n FROM s WHERE short GROUP BY ALL) SELECT b.item_id, coalesce(max(n), 0) AS longest FROM benchmark b LEFT JOIN r ON r.item_id = b.item_id GROUP BY b.item_id""")
def f08_longest_runs(spark, d):
    """The longest run of abbreviations, words of up to three letters, in a text."""
    w = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("i", "w")).withColumn("short", F.length("w") <= 3)
    island = F.col("i") - F.row_number().over(Window.partitionBy("item_id", "short").orderBy("i"))
    runs = w.withColumn("island", island).where("short").groupBy("item_id", "island").agg(F.count("*").alias("n")).groupBy("item_id").agg(F.max("n").alias("longest"))
    return table(spark, d, "benchmark").select("item_id").join(runs, "item_id", "left").select("item_id", F.coalesce("longest", F.lit(0)).alias("longest"))


@query("SELECT event_type, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS q{int(100 * q)}" for q in (0.1, 0.5, 0.9)) + " FROM events GROUP BY event_type")
def d08_describe(spark, d):
    """Exact extremes, moments and interpolated quantiles."""
    q = [F.round(F.percentile("value", q), 6).alias(f"q{int(100 * q)}") for q in (0.1, 0.5, 0.9)]
    return table(spark, d, "events").groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("deviation"), *q)


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (w ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS place, row_number() OVER (w ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS sorted, round(sum(l_extendedprice) OVER w, 4) AS total FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)")
def d18_segments(spark, d):
    """Segment index, order and sum in long form, where the reference has packed arrays."""
    w = Window.partitionBy("l_orderkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_extendedprice")) - 1).alias("place"),
        F.row_number().over(w.orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey")).alias("sorted"), F.round(F.sum("l_extendedprice").over(w), 4).alias("total"))


@query("SELECT l_suppkey, round(avg(l_discount) FILTER (l_quantity > 25), 6) AS masked, round(avg(CASE WHEN l_tax > 0.01 THEN l_tax END), 6) AS nan_mean FROM lineitem GROUP BY l_suppkey")
def d19_masked_means(spark, d):
    tax = F.when(F.col("l_tax") > 0.01, F.col("l_tax")).otherwise(F.lit(float("nan")))
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg(F.when(F.col("l_quantity") > 25, F.col("l_discount"))), 6).alias("masked"), F.round(F.avg(F.nanvl(tax, F.lit(None).cast("double"))), 6).alias("nan_mean"))


@query("WITH n AS (SELECT user_id AS query_id, event_type AS member, count(*) AS n FROM events GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, member) AS nth FROM n")
def d21_closure(spark, d):
    return S.closure(table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("member")))


TOPICS = """WITH n AS (SELECT o_custkey AS c, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL), t AS (SELECT c, list_distinct(list(p)) AS topics, arg_max(p, n * 10 - ascii(p) % 10) AS first FROM n GROUP BY c),
k AS (SELECT c_custkey AS c, coalesce(topics, []) AS topics, first, n_regionkey AS region FROM customer LEFT JOIN t ON t.c = c_custkey JOIN nation ON n_nationkey = c_nationkey),
e AS (SELECT a.c, len(list_intersect(a.topics, b.topics)) AS n_shared, a.first = b.first AS primary_equal, len(a.topics) > 0 AND len(b.topics) > 0 AS labelled, a.region = b.region AS near FROM k a JOIN k b ON b.c = a.c + 1)"""


def evidence(spark, d):
    """(c, n_shared, primary_equal, labelled, near) of each customer and the next: their order priorities as topics."""
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n"))
    t = n.groupBy("c").agg(F.collect_set("p").alias("topics"), F.max_by("p", F.col("n") * 10 - F.ascii("p") % 10).alias("first"))
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region"))
    k = table(spark, d, "customer").select(F.col("c_custkey").alias("c"), "c_nationkey").join(t, "c", "left").join(F.broadcast(nation), "c_nationkey")
    k = k.select("c", F.coalesce("topics", F.array().cast("array<string>")).alias("topics"), "first", "region")
    nxt = k.select((F.col("c") - 1).alias("c"), *(F.col(x).alias(f"{x}_b") for x in ("topics", "first", "region")))
    e = V.label_evidence(F.col("topics"), F.col("topics_b"), F.col("first"), F.col("first_b"))
    return k.join(nxt, "c").select("c", *(v.alias(name) for name, v in e.items()), (F.col("region") == F.col("region_b")).alias("near"))


@query(TOPICS + " SELECT c, n_shared::INT AS n_shared, primary_equal, labelled FROM e")
def d22_label_evidence(spark, d):
    return evidence(spark, d).drop("near")


@query(TOPICS + """ SELECT c, CASE WHEN n_shared = 0 THEN 'cross' ELSE 'same' END AS disjoint, CASE WHEN primary_equal OR n_shared >= 2 THEN 'same' ELSE 'cross' END AS overlap2, CASE WHEN primary_equal THEN 'same' ELSE 'cross' END AS primary,
  CASE WHEN n_shared = 0 AND NOT near THEN 'cross' ELSE 'same' END AS domain_jump, CASE WHEN NOT labelled THEN NULL WHEN primary_equal THEN 'same_primary' WHEN n_shared >= 2 THEN 'overlap_2plus' WHEN n_shared = 1 THEN 'overlap_1' ELSE 'disjoint' END AS band FROM e""")
def e51_policies(spark, d):
    """Each policy's verdict on a pair, and the graded scale."""
    e = evidence(spark, d)
    names = ("disjoint", "overlap2", "primary", "domain_jump")
    return e.select("c", *(V.policy(n, F.col("n_shared"), F.col("primary_equal"), F.col("near")).alias(n) for n in names), V.band(F.col("labelled"), F.col("n_shared"), F.col("primary_equal")).alias("band"))


@query("""WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM conversations), c AS (SELECT conv_id, turn, x, count(*) AS n FROM (SELECT conv_id, turn, unnest(t) AS x FROM w) GROUP BY ALL),
  s AS (SELECT a.conv_id, a.turn, b.turn AS truth, sum(least(a.n, b.n)) AS shared FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn <> b.turn AND a.x = b.x GROUP BY ALL),
  p AS (SELECT a.conv_id, a.turn, b.turn AS truth, a.t = b.t AS exact, coalesce(shared::DOUBLE / nullif(len(a.t), 0), 0) AS precision, coalesce(shared::DOUBLE / nullif(len(b.t), 0), 0) AS recall, coalesce(2.0 * shared / nullif(len(a.t) + len(b.t), 0), 0)::DOUBLE AS f1
    FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn <> b.turn LEFT JOIN s ON s.conv_id = a.conv_id AND s.turn = a.turn AND s.truth = b.turn)
  SELECT conv_id, turn, bool_or(exact) AS exact, round(max(f1), 6) AS f1, round(arg_max(precision, round(f1, 9) * 1000000 - truth), 6) AS precision, round(arg_max(recall, round(f1, 9) * 1000000 - truth), 6) AS recall FROM p GROUP BY ALL""")
def d25_max_over_truths(spark, d):
    """A turn against all others of its conversation: the best exact match and F1, with that one's precision and recall."""
    w = table(spark, d, "conversations").select("conv_id", "turn", T.tokens_alnum(F.col("text")).alias("t"))
    c = w.select("conv_id", "turn", F.explode("t").alias("x")).groupBy("conv_id", "turn", "x").agg(F.count("*").alias("n"))
    shared = c.join(c.withColumnsRenamed({"turn": "truth", "n": "m"}), ["conv_id", "x"]).where("turn <> truth").groupBy("conv_id", "turn", "truth").agg(F.sum(F.least("n", "m")).alias("shared"))
    p = w.join(w.withColumnsRenamed({"turn": "truth", "t": "u"}), "conv_id").where("turn <> truth").join(shared, ["conv_id", "turn", "truth"], "left")
    ratio = lambda a, b: F.coalesce(F.when(b > 0, a / b), F.lit(0.0))
    p = p.select("conv_id", "turn", "truth", (F.col("t") == F.col("u")).alias("exact"), ratio(F.col("shared"), F.size("t")).alias("precision"), ratio(F.col("shared"), F.size("u")).alias("recall"), ratio(2.0 * F.col("shared"), F.size("t") + F.size("u")).alias("f1"))
    best = p.groupBy("conv_id", "turn").agg(F.bool_or("exact").alias("exact"), F.max("f1").alias("f1"), F.max_by(F.struct("precision", "recall"), F.struct(F.round("f1", 9), -F.col("truth"))).alias("x"))
    return best.select("conv_id", "turn", "exact", F.round("f1", 6).alias("f1"), F.round("x.precision", 6).alias("precision"), F.round("x.recall", 6).alias("recall"))


SCORE = "(round(o_totalprice * 100)::BIGINT % 100) / 100.0::DOUBLE"


@query(f"WITH s AS (SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 1.0::DOUBLE ELSE {SCORE} END AS score FROM orders) SELECT o_orderkey, score, CASE WHEN score >= 0.95 THEN 'exact' WHEN score >= 0.8 THEN 'strong' WHEN score >= 0.62 THEN 'weak' ELSE 'none' END AS tier, score >= 0.8 AS accepted FROM s")
def j19_candidates(spark, d):
    """Candidates by tier; those found by an identifier are trusted, near misses are kept as rejected (E48)."""
    raw = (F.round(F.col("o_totalprice") * 100).cast("long") % 100) / 100.0
    score = F.when(F.col("o_orderpriority").startswith("1"), 1.0).otherwise(raw)
    return table(spark, d, "orders").select("o_orderkey", score.alias("score")).withColumns({"tier": V.tier(F.col("score")), "accepted": F.col("score") >= V.ACCEPT})


@query("SELECT CASE WHEN l_linenumber <= 2 OR l_suppkey % 3 > 0 OR l_returnflag = 'A' THEN 'supports' WHEN l_linenumber >= 5 AND l_suppkey % 3 = 0 THEN 'contradicts' ELSE 'neutral' END AS verdict, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL")
def e49_corroboration(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy(V.corroboration(F.col("l_linenumber"), F.col("l_suppkey") % 3, F.col("l_returnflag") == "A").alias("verdict"), "l_linenumber").agg(F.count("*").alias("n"))


@query("WITH m AS (SELECT p_partkey AS id, p_name AS title, p_brand AS who, p_size % 10 = 0 AS bare FROM part), t AS (SELECT title, bool_or(bare) AS mixed FROM m GROUP BY title) SELECT id, min(id) OVER (PARTITION BY title, CASE WHEN mixed THEN '' ELSE who END) AS work FROM m JOIN t USING (title)")
def e50_same_works(spark, d):
    """Records of one title are one work if they share an author, or some have none."""
    authors = F.when(F.col("p_size") % 10 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand"))
    return V.same_works(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), authors.alias("authors")))


@query("""WITH x AS (SELECT c.c_custkey, CASE WHEN c.c_custkey % 13 = 0 THEN NULL ELSE a.n_name END AS a, b.n_name AS b, CASE WHEN a.n_nationkey % 6 <> 0 THEN a.n_regionkey END AS da, CASE WHEN b.n_nationkey % 6 <> 0 THEN b.n_regionkey END AS db
  FROM customer c JOIN customer n ON n.c_custkey = c.c_custkey + 1 JOIN nation a ON a.n_nationkey = c.c_nationkey JOIN nation b ON b.n_nationkey = n.c_nationkey)
  SELECT c_custkey, CASE WHEN a IS NULL THEN NULL WHEN a = b THEN 'same_field' WHEN da IS NULL OR db IS NULL THEN 'cross_field_unknown_domain' WHEN da = db THEN 'cross_field_same_domain' ELSE 'cross_domain' END AS distance FROM x""")
def e52_field_distance(spark, d):
    """How far the nations of two customers are apart; for some no region is known."""
    n = table(spark, d, "nation")
    name = n.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(name), "c_nationkey").select("c_custkey", F.col("n_name").alias("a"))
    pairs = c.join(c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("a").alias("b")), "c_custkey").withColumn("a", F.when(F.col("c_custkey") % 13 != 0, F.col("a")))
    return S.field_distance(pairs, n.where("n_nationkey % 6 <> 0").select(F.col("n_name").alias("field"), F.col("n_regionkey").alias("domain"))).select("c_custkey", "distance")


GROUP = "CASE WHEN {0} IN (0, 2) THEN 'near' WHEN {0} IN (1, 3) THEN 'far' END"


@query(f"""WITH x AS (SELECT DISTINCT a.n_regionkey AS src, b.n_regionkey AS gold FROM nation a, nation b), g AS (SELECT src, gold, {GROUP.format('src')} AS a, {GROUP.format('gold')} AS b FROM x)
  SELECT src, gold, CASE WHEN a = 'near' AND b = 'near' THEN 'same' WHEN a = 'near' AND b = 'far' THEN 'cross' END AS near_only, CASE WHEN a = 'near' AND b = 'far' THEN 'cross' ELSE 'same' END AS binary, CASE b WHEN 'near' THEN 'same' WHEN 'far' THEN 'cross' END AS gold_only,
  CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN a = b THEN 'same' ELSE 'cross' END AS group_jump, CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN a = 'far' THEN 'method' WHEN b = 'near' THEN 'same' ELSE 'cross' END AS three_way FROM g""")
def e53_strata(spark, d):
    """All pairs of five regions under each definition."""
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("src"))
    pairs = r.crossJoin(F.broadcast(r.withColumnRenamed("src", "gold")))
    out = S.strata(F.col("src"), F.col("gold"), ["0", "2"], ["1", "3"])
    return pairs.select(F.col("src").cast("int").alias("src"), F.col("gold").cast("int").alias("gold"), *(c.alias(name) for name, c in out.items()))


@query("""WITH s AS (SELECT o_custkey AS query_id, o_orderkey, bool_and(l_quantity < 45) AS complete FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
  SELECT query_id, count(*) AS n_sets, count(*) FILTER (complete) AS n_complete, CASE WHEN count(*) FILTER (complete) >= 2 THEN 'alternatives' WHEN count(*) FILTER (complete) = 1 THEN 'unique' ELSE 'unresolved' END AS status FROM s GROUP BY query_id""")
def e54_set_status(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_quantity") < 45).alias("resolved"))
    return V.set_status(table(spark, d, "orders").join(li, "o_orderkey").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("set_id"), "resolved"))


@query("WITH v AS (SELECT o_custkey AS query_id, CASE WHEN o_orderpriority LIKE '1%' THEN 'cross' WHEN o_orderpriority LIKE '5%' THEN NULL ELSE 'same' END AS v FROM orders) SELECT query_id, CASE WHEN bool_or(coalesce(v = 'cross', false)) THEN 'cross_involved' WHEN bool_and(coalesce(v = 'same', false)) THEN 'same_only' ELSE 'unlabelled' END AS slice FROM v GROUP BY query_id")
def e55_query_slices(spark, d):
    v = F.when(F.col("o_orderpriority").startswith("1"), "cross").when(F.col("o_orderpriority").startswith("5"), None).otherwise("same")
    return V.query_slice(table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), v.alias("verdict")))


@query("SELECT conv_id, bool_or(length(text) < 120) AS drop_any, bool_and(length(text) < 120) AS drop_all FROM conversations GROUP BY conv_id")
def e56_short_golds(spark, d):
    """Queries to leave out because some, or all, of their texts are short."""
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.bool_or(F.length("text") < 120).alias("drop_any"), F.bool_and(F.length("text") < 120).alias("drop_all"))


@query("""WITH i AS (SELECT item_id AS query_id FROM benchmark UNION ALL SELECT 1), r AS (SELECT item_id AS query_id, item_id * k AS doc_id FROM benchmark, (SELECT unnest([3, 70]) AS k) WHERE item_id % 5 <> 0), t AS (SELECT doc_id, text FROM documents),
  q AS (SELECT query_id, count(*) AS n, count(t.doc_id) AS met FROM r LEFT JOIN (SELECT DISTINCT doc_id FROM t) t USING (doc_id) GROUP BY query_id)
  SELECT 'repeated_queries' AS check, count(*) AS n FROM (SELECT 1 FROM i GROUP BY query_id HAVING count(*) > 1) UNION ALL SELECT 'repeated_documents', count(*) FROM (SELECT 1 FROM t GROUP BY doc_id HAVING count(*) > 1)
  UNION ALL SELECT 'queries_without_gold', count(*) FROM (SELECT DISTINCT query_id FROM i) ANTI JOIN r USING (query_id) UNION ALL SELECT 'missing_golds', count(*) FROM (SELECT DISTINCT doc_id FROM r) ANTI JOIN t USING (doc_id)
  UNION ALL SELECT 'partial_queries', count(*) FROM q WHERE met > 0 AND met < n UNION ALL SELECT 'empty_texts', count(*) FROM t WHERE text IS NULL OR trim(text) = ''""")
def e57_consistency(spark, d):
    """What is wrong with a task, in counts (J40)."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    qrels = b.where("query_id % 5 <> 0").select("query_id", F.explode(F.array(F.col("query_id") * 3, F.col("query_id") * 70)).alias("doc_id"))
    return S.consistency(b.unionByName(spark.range(1, 2).withColumnRenamed("id", "query_id")), qrels, table(spark, d, "documents").select("doc_id", "text"))


@query("WITH r AS (SELECT l_suppkey, l_orderkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS nth FROM lineitem) SELECT s_suppkey, nth, l_extendedprice AS price FROM supplier CROSS JOIN (SELECT unnest([1, 2, 3]) AS nth) LEFT JOIN r ON l_suppkey = s_suppkey AND r.nth = nth_".replace("nth_", "nth.nth").replace("AS nth) LEFT", "AS nth) nth LEFT").replace("SELECT s_suppkey, nth,", "SELECT s_suppkey, nth.nth,"))
def g03_padded_topk(spark, d):
    """The first three of each group, with empty rows where a group has fewer."""
    nth = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"))
    top = table(spark, d, "lineitem").withColumn("nth", nth).where("nth <= 3").select(F.col("l_suppkey").alias("s_suppkey"), "nth", F.col("l_extendedprice").alias("price"))
    places = table(spark, d, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("nth"))
    return places.join(top, ["s_suppkey", "nth"], "left")


@query("WITH f AS (SELECT l_orderkey, l_suppkey, min(l_linenumber * 1000000 + l_suppkey) AS spot FROM lineitem GROUP BY ALL) SELECT l_orderkey AS query_id, string_agg(l_suppkey, ',' ORDER BY spot) AS members FROM f GROUP BY l_orderkey")
def j12_flat_sets(spark, d):
    """One set a query from a flat list, each member at its first place."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("xs"))
    return rows.select("query_id", F.array_join(F.array_distinct("xs.l_suppkey").cast("array<string>"), ",").alias("members"))


LEGACY = "CASE o_orderkey % 6 WHEN 0 THEN 'same_domain' WHEN 1 THEN 'cross_field' WHEN 2 THEN 'same' ELSE NULL END AS relation, CASE o_orderkey % 6 WHEN 3 THEN 'same_primary' WHEN 4 THEN 'overlap_1' WHEN 0 THEN 'far' END AS distance"


@query(f"WITH x AS (SELECT o_orderkey, {LEGACY} FROM orders) SELECT o_orderkey, CASE WHEN relation IN ('same', 'same_field', 'same_domain') THEN 'same' WHEN relation IN ('cross', 'cross_field', 'cross_domain') THEN 'cross' WHEN distance IN ('same_field', 'same_primary') THEN 'same' WHEN distance IS NOT NULL THEN 'cross' END AS stratum FROM x")
def j17_legacy_strata(spark, d):
    """The stratum under any spelling that was ever written."""
    x = table(spark, d, "orders").selectExpr("o_orderkey", *LEGACY.split(", CASE o_orderkey % 6 WHEN 3")[:1], "CASE o_orderkey % 6 WHEN 3" + LEGACY.split(", CASE o_orderkey % 6 WHEN 3")[1])
    return x.select("o_orderkey", S.stratum_of(F.col("relation"), F.col("distance")).alias("stratum"))


@query("SELECT DISTINCT l_orderkey AS query_id, unnest([l_suppkey, l_partkey % 50]) AS member FROM lineitem")
def j18_flat_members(spark, d):
    """Primary and alternative members, each once."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.explode(F.array("l_suppkey", F.col("l_partkey") % 50)).alias("member")).distinct()


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 <> 0 THEN source END, 'quality ' || quality, 'unknown') AS field FROM documents LEFT JOIN labels USING (doc_id)")
def j20_backfill(spark, d):
    """Only gaps are filled, in order of precedence."""
    known = table(spark, d, "labels").select("doc_id", F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("filled"))
    return table(spark, d, "documents").join(known, "doc_id", "left").select("doc_id", F.coalesce(F.when(F.col("doc_id") % 3 != 0, F.col("source")), "filled", F.lit("unknown")).alias("field"))


@query("SELECT p_partkey, first_value(p_partkey) OVER (PARTITION BY lower(trim(p_name)) ORDER BY p_partkey) AS work FROM part")
def j21_resolve_once(spark, d):
    """Titles resolved once for each normalised key."""
    part = table(spark, d, "part").select("p_partkey", "p_name")
    works = part.groupBy(F.lower(F.trim("p_name")).alias("key")).agg(F.min("p_partkey").alias("work"))
    return S.resolve_once(part, F.lower(F.trim("p_name")), lambda keys: keys.join(works, "key")).select("p_partkey", "work")


@query("SELECT l_orderkey, count(*) AS n_refs, count(*) FILTER (p_size < 10) AS unusable, count(*) FILTER (p_size < 10 AND p_retailprice > 1200) AS rescued FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey")
def j22_references(spark, d):
    """References joined to works, with what is unusable and what a second source rescues."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_retailprice")
    bad = F.col("p_size") < 10
    return table(spark, d, "lineitem").join(part, "l_partkey", "left").groupBy("l_orderkey").agg(F.count("*").alias("n_refs"), F.count_if(bad).alias("unusable"), F.count_if(bad & (F.col("p_retailprice") > 1200)).alias("rescued"))


@query("WITH s AS (SELECT o_custkey AS query_id, o_orderkey, string_agg(DISTINCT l_suppkey % 5, ',' ORDER BY l_suppkey % 5) AS members FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL) SELECT query_id, count(*) AS n_draws, count(DISTINCT members) AS n_sets FROM s GROUP BY query_id")
def j23_distinct_sets(spark, d):
    """How many different sets a query's draws make, whatever their order."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_suppkey") % 5).alias("x"))
    sets = table(spark, d, "orders").join(li, "o_orderkey").groupBy("o_custkey", "o_orderkey").agg(F.array_sort(F.collect_set("x")).alias("members"))
    return sets.groupBy(F.col("o_custkey").alias("query_id")).agg(F.count("*").alias("n_draws"), F.count_distinct("members").alias("n_sets"))


@query("""WITH f AS (SELECT item_id AS key, lower(substr(text, 3, 40)) AS text FROM benchmark), c AS (SELECT f.key, b.item_id AS candidate, lower(substr(b.text, 1, 40)) AS other, f.text FROM f JOIN benchmark b ON abs(b.item_id - f.key) <= 3)
  SELECT key, arg_min(candidate, levenshtein(text, other) * 1000000 + candidate) AS candidate FROM c GROUP BY key""")
def j25_closest_candidate(spark, d):
    """A generated fact mapped to the closest of its candidates."""
    b = table(spark, d, "benchmark")
    rows = b.select(F.col("item_id").alias("key"), F.lower(F.substring("text", 3, 40)).alias("text"))
    near = rows.select("key", F.explode(F.sequence(F.col("key") - 3, F.col("key") + 3)).alias("item_id")).join(b, "item_id")
    return S.closest(rows, near.select("key", F.col("item_id").alias("candidate"), F.lower(F.substring("text", 1, 40)).alias("text")))


@query("""WITH l AS (SELECT p_size AS query_id, p_brand AS kind, p_partkey AS rank, p_name || ': ' || p_type AS line FROM part), b AS (SELECT query_id, kind || chr(10) || string_agg(line, chr(10) ORDER BY rank) AS block FROM l GROUP BY query_id, kind)
  SELECT query_id, sha256(string_agg(block, chr(10) || chr(10) ORDER BY block)) AS prompt FROM b GROUP BY query_id""")
def j29_prompts(spark, d):
    """Prompt contexts by kind; their digests."""
    rows = table(spark, d, "part").select(F.col("p_size").alias("query_id"), F.col("p_brand").alias("kind"), F.col("p_partkey").alias("rank"), F.col("p_name").alias("name"), F.col("p_type").alias("value"))
    return S.prompt_blocks(rows).select("query_id", F.sha2("prompt", 256).alias("prompt"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, min(len) AS low, max(len) AS high, round(avg(len), 6) AS mean, round(avg(parts), 6) AS parts FROM (SELECT o_orderkey, o_orderpriority, o_orderstatus, count(*) AS len, count(DISTINCT l_partkey) AS parts FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL) GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def j39_statistics(spark, d):
    """Sizes of sets by stratum, with totals."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("len"), F.count_distinct("l_partkey").alias("parts"))
    o = table(spark, d, "orders").join(li, "o_orderkey")
    return o.rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.min("len").alias("low"), F.max("len").alias("high"), F.round(F.avg("len"), 6).alias("mean"), F.round(F.avg("parts"), 6).alias("parts"))


CARVE_SQL = """WITH q AS (SELECT o_custkey AS query_id FROM (SELECT DISTINCT o_custkey FROM orders) ORDER BY md5('3:' || o_custkey), o_custkey LIMIT 20),
r AS (SELECT DISTINCT o_custkey AS query_id, l_partkey AS doc_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey IN (FROM q)),
c AS (SELECT p_partkey AS doc_id FROM part ORDER BY (p_partkey NOT IN (SELECT doc_id FROM r))::INT, md5('3:' || p_partkey), p_partkey LIMIT 300)"""


def bought(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("doc_id"))
    return table(spark, d, "orders").join(li, "o_orderkey").select(F.col("o_custkey").alias("query_id"), "doc_id").distinct()


@query(CARVE_SQL + " SELECT query_id, doc_id FROM r JOIN c USING (doc_id)")
def a18_carve(spark, d):
    """A smaller task of twenty queries and three hundred documents, with its relevance labels."""
    queries = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id")).distinct()
    corpus = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"))
    return carve(queries, bought(spark, d), corpus, 20, 300, seed=3)[1]


@query("""WITH r AS (SELECT DISTINCT o_custkey AS query_id, l_partkey AS doc_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey), g AS (SELECT doc_id FROM (SELECT DISTINCT doc_id FROM r) ORDER BY md5('5:' || doc_id), doc_id LIMIT 15)
  SELECT query_id, doc_id FROM r WHERE query_id IN (SELECT query_id FROM r WHERE doc_id IN (FROM g))""")
def a21_training_subset(spark, d):
    """The queries of fifteen sampled golds, with all their golds."""
    return S.pick_by_golds(bought(spark, d), 15, seed=5)


@query("SELECT conv_id AS key, arg_min(text, turn) AS text FROM conversations WHERE length(text) >= 100 GROUP BY conv_id")
def a22_first_abstracts(spark, d):
    """The first text of a hundred characters or more of each key."""
    return S.first_long_texts(table(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("pos"), "text"), 100)


@query("WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY md5('9:' || doc_id), doc_id) AS n FROM (SELECT DISTINCT doc_id FROM documents)) SELECT doc_id, CASE WHEN n <= 50 THEN 'dev' ELSE 'train' END AS part FROM s WHERE n <= 150")
def j36_dev_and_train(spark, d):
    """Fifty documents for development, then a hundred others for training."""
    first = materialize(first_by_hash(table(spark, d, "documents").select("doc_id").distinct(), "doc_id", 150, seed=9), "first")
    dev = first_by_hash(first, "doc_id", 50, seed=9).withColumn("part", F.lit("dev"))
    return first.join(dev, "doc_id", "left").select("doc_id", F.coalesce("part", F.lit("train")).alias("part"))


@query("""WITH g AS (SELECT l_orderkey AS query_id, upper(CASE WHEN l_partkey % 11 = 0 THEN 'gone ' || l_partkey ELSE p_name || ' ' || p_partkey END) AS key FROM lineitem JOIN part ON l_partkey = p_partkey), k AS (SELECT lower(p_name || ' ' || p_partkey) AS key FROM part ORDER BY key LIMIT 40)
  SELECT query_id, lower(g.key) AS key, lower(g.key) IN (SELECT key FROM k) AS in_mini FROM (SELECT DISTINCT * FROM g) g WHERE lower(g.key) IN (SELECT lower(p_name || ' ' || p_partkey) FROM part)""")
def j35_staged_golds(spark, d):
    """Golds matched without regard to case; orphans go; a small corpus is the first forty keys in order."""
    part = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("name"))
    corpus = part.select(F.lower("name").alias("key"))
    mini = corpus.orderBy("key").limit(40).withColumn("in_mini", F.lit(True))
    gold = F.when(F.col("p_partkey") % 11 == 0, F.concat(F.lit("gone "), F.col("p_partkey").cast("string"))).otherwise(F.col("name"))
    golds = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("query_id"), F.lower(F.upper(gold)).alias("key")).distinct()
    return golds.join(corpus, "key", "left_semi").join(mini, "key", "left").select("query_id", "key", F.coalesce("in_mini", F.lit(False)).alias("in_mini"))
