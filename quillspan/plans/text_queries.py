"""Queries of text functions over documents, pages, benchmark items and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.plans.registry import query
from quillspan.session import read_table


def quoted(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query("SELECT page_id, trim(regexp_replace(lower(html), '\\s+', ' ', 'g')) AS norm FROM pages")
def b01_norm_space(spark, d):
    return read_table(spark, d, "pages").select("page_id", T.norm_space(F.col("html")).alias("norm"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) AS folded FROM documents")
def b02_fold(spark, d):
    return read_table(spark, d, "documents").select("doc_id", T.fold(F.col("text")).alias("folded"))


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(lower(strip_accents(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&[a-zA-Z#0-9]+;', ' ', 'g'))),
  '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) AS folded FROM pages""")
def b03_fold_markup(spark, d):
    return read_table(spark, d, "pages").select("page_id", T.fold_markup(F.col("html")).alias("folded"))


@query("""SELECT page_id, rtrim(regexp_replace(lower(trim(link)), '^(https?://)?(dx\\.)?doi\\.org/|^doi:\\s*', ''), '.') AS doi
  FROM (SELECT page_id, 'https://doi.org/10.1234/' || page_id || '.' AS link FROM pages)""")
def b05_norm_doi(spark, d):
    link = F.concat(F.lit("https://doi.org/10.1234/"), F.col("page_id").cast("string"), F.lit("."))
    return read_table(spark, d, "pages").select("page_id", T.norm_doi(link).alias("doi"))


@query("""SELECT p_partkey, '[part] ' || trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS node, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS bare, 'part' AS kind FROM part""")
def b06_typed_names(spark, d):
    node = T.typed_name("part", F.col("p_name"))
    return read_table(spark, d, "part").select("p_partkey", node.alias("node"), T.strip_type(node).alias("bare"), T.node_type(node).alias("kind"))


@query(f"""SELECT doc_id, sign(len(list_filter(w, lambda x: list_contains({quoted(T.POSITIVE)}, x)))::DOUBLE - len(list_filter(w, lambda x: list_contains({quoted(T.NEGATIVE)}, x))))::INTEGER AS polarity
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents)""")
def b08_polarity(spark, d):
    return read_table(spark, d, "documents").select("doc_id", T.polarity(F.col("text")).alias("polarity"))


@query(f"""SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) > 2 AND NOT list_contains({quoted(T.RETRIEVAL_STOP)}, x)))::BIGINT AS n_alpha,
  len(regexp_extract_all(lower(text), '[a-z0-9]+'))::BIGINT AS n_alnum FROM documents""")
def b09_tokens(spark, d):
    t = F.col("text")
    return read_table(spark, d, "documents").select("doc_id", F.size(T.tokens_alpha(t)).cast("long").alias("n_alpha"), F.size(T.tokens_alnum(t)).cast("long").alias("n_alnum"))


@query(f"""WITH t AS (SELECT item_id, list_distinct(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')), ' ')) AS w FROM benchmark),
  k AS (SELECT item_id, w, list_filter(w, lambda x: NOT list_contains({quoted(T.CONTENT_STOP)}, x)) AS c FROM t)
  SELECT item_id, len(CASE WHEN len(c) > 0 THEN c ELSE w END)::BIGINT AS n_content,
    len(list_filter(w, lambda x: length(x) > 2 AND NOT list_contains({quoted(T.TITLE_STOP)}, x)))::BIGINT AS n_title FROM k""")
def b10_content_words(spark, d):
    norm = T.alnum_only(F.col("text"))
    return read_table(spark, d, "benchmark").select("item_id", F.size(T.content_words(norm)).cast("long").alias("n_content"), F.size(T.title_tokens(norm)).cast("long").alias("n_title"))


@query("""SELECT doc_id, CASE WHEN instr(text, '. ') > 0 THEN substr(text, 1, instr(text, '. ') - 1) ELSE text END AS title,
  length(CASE WHEN instr(text, '. ') > 0 THEN substr(text, instr(text, '. ') + 2) ELSE '' END)::BIGINT AS rest FROM documents""")
def b12_split_title(spark, d):
    t = F.col("text")
    return read_table(spark, d, "documents").select("doc_id", T.title_part(t).alias("title"), F.length(T.rest_part(t)).cast("long").alias("rest"))


@query("SELECT conv_id, turn, CASE WHEN instr(text, '?') > 0 THEN substr(text, 1, instr(text, '?')) ELSE text END AS question FROM conversations")
def b13_split_question(spark, d):
    return read_table(spark, d, "conversations").select("conv_id", "turn", T.question_part(F.col("text")).alias("question"))


@query("""SELECT doc_id, CASE WHEN n > 1 THEN title || ' (' || n || ')' ELSE title END AS title FROM (
  SELECT doc_id, title, row_number() OVER (PARTITION BY lower(title) ORDER BY doc_id) AS n FROM (
    SELECT doc_id, CASE WHEN instr(text, '. ') > 0 THEN substr(text, 1, instr(text, '. ') - 1) ELSE text END AS title FROM documents))""")
def b14_disambiguate_titles(spark, d):
    t = read_table(spark, d, "documents").select("doc_id", T.title_part(F.col("text")).alias("title"))
    n = F.row_number().over(Window.partitionBy(F.lower("title")).orderBy("doc_id"))
    return t.withColumn("n", n).select("doc_id", F.when(F.col("n") > 1, F.concat("title", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))).otherwise(F.col("title")).alias("title"))


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS pos FROM documents),
  inverted AS (SELECT doc_id, word, list(pos) AS places FROM w GROUP BY doc_id, word)
  SELECT doc_id, md5(string_agg(word, ' ' ORDER BY pos)) AS text_md5 FROM (SELECT doc_id, word, unnest(places) AS pos FROM inverted) GROUP BY doc_id""")
def b18_inverted_text(spark, d):
    """Word positions back to text: the inverted form is made first, from the same documents."""
    words = read_table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    inverted = words.groupBy("doc_id", "word").agg(F.collect_list("pos").alias("places"))
    back = inverted.select("doc_id", "word", F.explode("places").alias("pos"))
    rows = F.sort_array(F.collect_list(F.struct("pos", "word")))
    return back.groupBy("doc_id").agg(F.md5(F.array_join(F.transform(rows, lambda r: r["word"]), " ")).alias("text_md5"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
  t AS (SELECT user_id, max(n)::DOUBLE / sum(n) AS purity FROM c GROUP BY user_id)
  SELECT user_id, round(purity, 3) AS purity, CASE WHEN purity >= 2.0 / 3 THEN 'clear' ELSE 'ambiguous' END AS confidence FROM t""")
def b19_topic_purity(spark, d):
    c = read_table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    t = c.groupBy("user_id").agg((F.max("n") / F.sum("n")).alias("purity"))
    return t.select("user_id", F.round("purity", 3).alias("purity"), F.when(F.col("purity") >= 2.0 / 3, "clear").otherwise("ambiguous").alias("confidence"))


DROP_SQL = "CASE WHEN lang <> 'en' THEN 'language' WHEN length(text) < 200 THEN 'short' WHEN source IN ('src1', 'src2') THEN 'source' WHEN n_chars > 20000 THEN 'long' ELSE 'kept' END"


@query(f"SELECT reason, count(*) AS n FROM (SELECT {DROP_SQL} AS reason FROM documents) GROUP BY reason")
def b21_drop_reasons(spark, d):
    """The first reason that holds counts; one pass over the rows."""
    reason = F.when(F.col("lang") != "en", "language").when(F.length("text") < 200, "short").when(F.col("source").isin("src1", "src2"), "source").when(F.col("n_chars") > 20000, "long").otherwise("kept")
    return read_table(spark, d, "documents").select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, 'name: ' || p_name || chr(10) || 'type: part' || chr(10) || 'brand: ' || p_brand || chr(10) || 'size: ' || p_size AS attributes FROM part")
def b22_attributes_text(spark, d):
    attributes = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("none"), F.lit(None).cast("string"), F.lit("size"), F.col("p_size").cast("string"))
    return read_table(spark, d, "part").select("p_partkey", T.attributes_text(F.col("p_name"), F.lit("part"), attributes).alias("attributes"))


@query("SELECT doc_id, md5(trim(lower(regexp_replace(text, '[^A-Za-z0-9 ]', ' ', 'g')), ' ')) AS phrase_md5 FROM documents")
def b23_clean_phrase(spark, d):
    return read_table(spark, d, "documents").select("doc_id", F.md5(T.clean_phrase(F.col("text"))).alias("phrase_md5"))


@query("SELECT event_id, regexp_extract('so ' || props || ' end', '\\{[^{}]*\\}') AS found, (props::JSON ->> 'k')::BIGINT AS k FROM events")
def b24_json_in_text(spark, d):
    found = T.json_in_text(F.concat(F.lit("so "), F.col("props"), F.lit(" end")))
    return read_table(spark, d, "events").select("event_id", found.alias("found"), F.from_json(found, "k long")["k"].alias("k"))


@query("""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[!-/:-@\\[-`{-~]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS answer FROM conversations""")
def b25_normalize_answer(spark, d):
    return read_table(spark, d, "conversations").select("conv_id", "turn", T.normalize_answer(F.col("text")).alias("answer"))


LEXICON = (("people", "that|they|who"), ("place", "over|under|on |in "))


@query("""SELECT doc_id, CASE WHEN a = 0 AND b = 0 THEN 'none' WHEN a >= b THEN 'people' ELSE 'place' END AS label FROM (
  SELECT doc_id, len(regexp_extract_all(lower(text), 'that|they|who')) AS a, len(regexp_extract_all(lower(text), 'over|under|on |in ')) AS b FROM documents)""")
def b27_lexicon_label(spark, d):
    """The label with most hits of its pattern; the first one on ties, none without hits."""
    hits = [F.regexp_count(F.lower("text"), F.lit(p)) for _, p in LEXICON]
    label = F.when(F.greatest(*hits) == 0, "none")
    for (name, _), n in zip(LEXICON, hits):
        label = label.when(n == F.greatest(*hits), name)
    return read_table(spark, d, "documents").select("doc_id", label.alias("label"))


@query("""SELECT item_id, length(text) < 15 OR length(regexp_replace(text, '[^0-9]', '', 'g'))::DOUBLE / length(text) > 0.18 AS citation FROM benchmark""")
def b30_citation_strings(spark, d):
    return read_table(spark, d, "benchmark").select("item_id", T.is_citation(F.col("text")).alias("citation"))


@query("SELECT page_id, '10.1234/' || page_id AS doi FROM pages")
def b31_find_doi(spark, d):
    ref = F.concat(F.lit("Some Author, Title. doi:10.1234/"), F.col("page_id").cast("string"), F.lit(". 2020"))
    return read_table(spark, d, "pages").select("page_id", T.find_doi(ref).alias("doi"))


@query()
def b34_untag(spark, d):
    return read_table(spark, d, "pages").select("page_id", T.untag(F.col("html")).alias("plain"))


TOKS = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+'), lambda x: length(x) > 3 AND NOT list_contains(" + quoted(T.LEAK_STOP) + ", x)))"


@query(f"""SELECT item_id, doc_id, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b))::DOUBLE / len(a) ELSE 0 END, 6) AS leak FROM (
  SELECT item_id, doc_id, {TOKS.format('q.text')} AS a, {TOKS.format('x.text')} AS b FROM benchmark q JOIN documents x ON q.item_id = x.doc_id)""")
def b38_title_leak(spark, d):
    q = read_table(spark, d, "benchmark").select("item_id", F.col("text").alias("title"))
    both = q.join(read_table(spark, d, "documents"), F.col("item_id") == F.col("doc_id"))
    return both.select("item_id", "doc_id", F.round(T.title_leak(F.col("title"), F.col("text")), 6).alias("leak"))


@query("""WITH b AS (SELECT doc_id, unnest(range(0, greatest(length(text) - 299, 0), 150)) AS place, text FROM documents),
  k AS (SELECT doc_id, substr(text, place + 1, 300) AS block FROM b),
  n AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT block) AS again FROM k GROUP BY doc_id)
  SELECT doc_id, round(coalesce(again::DOUBLE / n, 0), 6) AS dup_fraction FROM documents LEFT JOIN n USING (doc_id)""")
def b43_dup_fraction(spark, d):
    """Share of blocks of 300 characters, every 150, that the text had before."""
    blocks = F.filter(F.sequence(F.lit(0), F.greatest(F.length("text") - 300, F.lit(0)), F.lit(150)), lambda i: i + 300 <= F.length("text"))
    cut = F.transform(blocks, lambda i: F.substr("text", i + 1, F.lit(300)))
    n = F.size(cut)
    return read_table(spark, d, "documents").select("doc_id", F.round(F.when(n > 0, (n - F.size(F.array_distinct(cut))) / n).otherwise(0.0), 6).alias("dup_fraction"))


WORDSET = "list_distinct(list_filter(string_split(lower({0}), ' '), lambda x: length(x) > 2))"


@query("""WITH w AS (SELECT item_id, list_distinct(list_filter(string_split(lower(text), ' '), lambda x: length(x) > 2)) AS w FROM benchmark), e AS (SELECT item_id, len(w) AS n, unnest(w) AS x FROM w),
  s AS (SELECT a.item_id AS a, b.item_id AS b, a.n AS n_a, b.n AS n_b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.item_id < b.item_id GROUP BY ALL) SELECT a, b, round(n::DOUBLE / (n_a + n_b - n), 6) AS jaccard FROM s""")
def b44_jaccard(spark, d):
    """All pairs of items that share a word; any other pair has 0."""
    words = read_table(spark, d, "benchmark").select("item_id", F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda w: F.length(w) > 2)).alias("w"))
    words = words.select("item_id", F.size("w").alias("n"), F.explode("w").alias("word"))
    a, b = words.select(F.col("item_id").alias("a"), F.col("n").alias("n_a"), "word"), words.select(F.col("item_id").alias("b"), F.col("n").alias("n_b"), "word")
    shared = a.join(b, "word").where("a < b").groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("n"))
    return shared.select("a", "b", F.round(F.col("n") / (F.col("n_a") + F.col("n_b") - F.col("n")), 6).alias("jaccard"))


@query("""SELECT r_name AS name, lower(n_name) AS doi, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE 'q:' || substr(sha1(lower(n_name)), 1, 16) END AS doc_id
  FROM nation JOIN region ON n_regionkey = r_regionkey""")
def b15_document_ids(spark, d):
    n = read_table(spark, d, "nation").join(read_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    doi = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name"))
    return n.select(F.col("r_name").alias("name"), F.lower("n_name").alias("doi"), T.document_id(doi, F.lower("n_name")).alias("doc_id"))
