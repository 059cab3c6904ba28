"""Queries of retrieval, score fusion, evaluation and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspan.functions.text import tokens_alnum, tokens_alpha
from quillspan.functions.text import RETRIEVAL_STOP
from quillspan.operators import evaluation as E
from quillspan.operators import metrics as M
from quillspan.operators import ranking as R
from quillspan.operators import retrieval as V
from quillspan.operators import views as W
from quillspan.plans import fixtures as X
from quillspan.plans.registry import query
from quillspan.session import materialize, read_table

DENSE = "WITH " + X.DENSE_SQL


def rounded(df, *columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


@query(DENSE + "SELECT query_id, doc_id, rank, round(score, 6) AS score FROM run WHERE rank <= 20")
def e37_dense_topk(spark, d):
    return rounded(X.dense_run(spark, d, 20), "score").select("query_id", "doc_id", "rank", "score")


@query(DENSE + ", best AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sims), k AS (SELECT * FROM best WHERE rank <= 5) "
  "SELECT query_id, doc_id, rank, round(score / max(score) OVER (PARTITION BY query_id), 6) AS norm_score FROM k")
def c09_entity_linking(spark, d):
    top = R.rank_by(X.dense_sims(spark, d), 5)
    return top.select("query_id", "doc_id", "rank", F.round(F.col("score") / F.max("score").over(R.by_query()), 6).alias("norm_score"))


METRIC_SQL = DENSE + """,
n AS (SELECT query_id, count(*) AS n_golds FROM qrels GROUP BY query_id),
h AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM run JOIN qrels USING (query_id, doc_id)),
m AS (SELECT query_id, n_golds, coalesce(1.0 / min(rank), 0) AS mrr, coalesce(sum(1.0 / rank), 0) / n_golds AS mgrr, coalesce(sum(nth::DOUBLE / rank), 0) / n_golds AS map,
  count(*) FILTER (rank <= 5)::DOUBLE / n_golds AS recall_5, count(*) FILTER (rank <= 20)::DOUBLE / n_golds AS recall_20, count(*) FILTER (rank <= 100)::DOUBLE / n_golds AS recall_100,
  (count(*) FILTER (rank <= 1) > 0)::INT::DOUBLE AS hits_1, (count(*) FILTER (rank <= 10) > 0)::INT::DOUBLE AS hits_10,
  coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 5), 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 6) t(i) WHERE i <= n_golds) AS ndcg_5,
  coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 10), 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= n_golds) AS ndcg_10
  FROM n LEFT JOIN h USING (query_id) GROUP BY query_id, n_golds)
"""
SHOWN = ("mrr", "mgrr", "map", "recall_5", "recall_20", "recall_100", "hits_1", "hits_10", "ndcg_5", "ndcg_10")


def dense_metrics(spark, d):
    return M.per_query(X.dense_run(spark, d), X.dense_qrels(spark, d))


@query(METRIC_SQL + "SELECT query_id, n_golds, " + ", ".join(f"round({c}, 6) AS {c}" for c in SHOWN) + " FROM m")
def h01_metrics(spark, d):
    return rounded(dense_metrics(spark, d), *SHOWN).select("query_id", "n_golds", *SHOWN)


@query(METRIC_SQL + ", s AS (SELECT m.*, q_label FROM m JOIN dq USING (query_id)), e AS (SELECT *, unnest(['all', CASE WHEN q_label < 5 THEN 'same' ELSE 'cross' END, 'label_' || q_label]) AS slice FROM s) "
  "SELECT slice, count(*) AS n, round(avg(map), 6) AS map, round(avg(recall_20), 6) AS recall_20, round(avg(ndcg_10), 6) AS ndcg_10 FROM e GROUP BY slice")
def h12_slices(spark, d):
    """One row of a query counts for all of its slices."""
    m = dense_metrics(spark, d).join(X.dense_queries(spark, d).select("query_id", "q_label"), "query_id")
    slices = F.array(F.lit("all"), F.when(F.col("q_label") < 5, "same").otherwise("cross"), F.concat(F.lit("label_"), F.col("q_label").cast("string")))
    return rounded(M.slice_means(m, slices, ["map", "recall_20", "ndcg_10"]), "map", "recall_20", "ndcg_10")


@query(METRIC_SQL + ", s AS (SELECT q_label < 5 AS same, map FROM m JOIN dq USING (query_id)) SELECT round(100 * (avg(map) FILTER (NOT same) - avg(map) FILTER (same)) / avg(map) FILTER (same), 4) AS gap FROM s")
def h22_relative_gap(spark, d):
    m = dense_metrics(spark, d).join(X.dense_queries(spark, d).select("query_id", "q_label"), "query_id")
    same, cross = (F.avg(F.when(c, F.col("map"))) for c in (F.col("q_label") < 5, F.col("q_label") >= 5))
    return m.agg(F.round(100 * (cross - same) / same, 4).alias("gap"))


SETS = ", sets AS (SELECT query_id, doc_id % 3 AS set_id, doc_id FROM qrels)"


@query(DENSE + SETS + """, p AS (SELECT query_id, set_id, max(coalesce(rank, 1000000000)) AS last FROM sets LEFT JOIN run USING (query_id, doc_id) GROUP BY ALL),
  b AS (SELECT query_id, min(last) AS best FROM p GROUP BY query_id) SELECT query_id, (best <= 20)::INT::DOUBLE AS complete_20, (best <= 50)::INT::DOUBLE AS complete_50, (best <= 100)::INT::DOUBLE AS complete_100 FROM b""")
def h06_complete_sets(spark, d):
    sets = X.dense_qrels(spark, d).withColumn("set_id", F.pmod("doc_id", F.lit(3)))
    return M.complete_sets(X.dense_run(spark, d), sets, (20, 50, 100))


@query(DENSE + ", f AS (SELECT query_id, doc_id, rank - row_number() OVER (PARTITION BY query_id ORDER BY rank) + 1 AS filtered FROM run JOIN qrels USING (query_id, doc_id)) SELECT query_id, doc_id, filtered FROM f")
def f04_filtered_ranks(spark, d):
    return R.filtered_rank(X.dense_run(spark, d), X.dense_qrels(spark, d)).select("query_id", "doc_id", "filtered")


@query(DENSE + ", c AS (SELECT query_id, doc_id, rank() OVER (PARTITION BY query_id ORDER BY round(score, 3) DESC) AS rank FROM sims) SELECT * FROM c WHERE rank <= 30")
def f02_competition_ranks(spark, d):
    return R.competition_rank(X.dense_sims(spark, d).withColumn("score", F.round("score", 3))).where("rank <= 30").select("query_id", "doc_id", "rank")


@query(DENSE + """, s AS (SELECT query_id, doc_id, score, avg(score) OVER w AS mean, stddev_samp(score) OVER w AS a, stddev_pop(score) OVER w AS b, min(score) OVER w AS low, max(score) OVER w AS high FROM sims WINDOW w AS (PARTITION BY query_id))
  SELECT query_id, doc_id, round((score - mean) / (a + 1e-6), 6) AS z_sample, round((score - mean) / (b + 1e-6), 6) AS z_population, round((score - low) / (high - low), 6) AS scaled FROM s""")
def b42_zscores(spark, d):
    s = X.dense_sims(spark, d)
    keys = ["query_id", "doc_id"]
    out = R.zscore(s).withColumnRenamed("score", "z_sample").join(R.zscore(s, sample=False).withColumnRenamed("score", "z_population"), keys)
    return rounded(out.join(R.minmax(s).withColumnRenamed("score", "scaled"), keys), "z_sample", "z_population", "scaled")


@query(DENSE + ", e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY query_id)) AS e FROM run) SELECT query_id, doc_id, round(e / (sum(e) OVER (PARTITION BY query_id) + 1e-12), 6) AS p FROM e")
def d17_segment_softmax(spark, d):
    return R.softmax(X.dense_run(spark, d)).select("query_id", "doc_id", F.round("score", 6).alias("p"))


VIEW_SQL = DENSE + """, hits AS (SELECT query_id, vec_id AS doc_id, greatest(list_dot_product(v::DOUBLE[], embedding::DOUBLE[]), 0) AS s FROM embeddings, views WHERE vec_id <> query_id),
own AS (SELECT query_id, doc_id, sum(s) AS total, max(s) AS best FROM hits GROUP BY ALL), every AS (SELECT doc_id, sum(total) AS every FROM own GROUP BY doc_id),
sig AS (SELECT query_id, doc_id, score AS dense, total, best, greatest(every - total, 1e-6) AS background FROM sims JOIN own USING (query_id, doc_id) JOIN every USING (doc_id))
"""


def blocks(spark, d):
    docs = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    return W.Blocks(W.with_views(X.dense_queries(spark, d).select("query_id", "q"), X.views(spark, d)), docs)


def labels(spark, d):
    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.array(F.col("label").cast("double")).alias("known"))


@query(VIEW_SQL + "SELECT query_id, doc_id, round(total, 6) AS total, round(best, 6) AS best, round(background, 6) AS background FROM sig")
def d15_background(spark, d):
    return W.view_signals(blocks(spark, d), 6)


@query(VIEW_SQL + """, z AS (SELECT query_id, doc_id, (dense - avg(dense) OVER w) / (stddev_samp(dense) OVER w + 1e-6) + (total / background - avg(total / background) OVER w) / (stddev_samp(total / background) OVER w + 1e-6)
  + (best / background - avg(best / background) OVER w) / (stddev_samp(best / background) OVER w + 1e-6) AS score FROM sig WINDOW w AS (PARTITION BY query_id)) SELECT query_id, doc_id, round(score, 5) AS score FROM z""")
def e38_multi_view(spark, d):
    return W.multi_view_score(blocks(spark, d), 5)


def tokens_sql(alpha: bool) -> str:
    if alpha:
        return "list_filter(regexp_extract_all(lower({0}), '[a-z]+'), lambda x: length(x) > 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in RETRIEVAL_STOP) + "], x))"
    return "regexp_extract_all(lower({0}), '[a-z0-9]+')"


def bm25_sql(alpha: bool, repeats: bool) -> str:
    t = tokens_sql(alpha)
    return f"""WITH s AS (SELECT doc_id, {t.format('text')} AS w FROM documents), l AS (SELECT doc_id, greatest(len(w), 1) AS len FROM s),
    st AS (SELECT count(*) AS n, avg(len) AS al FROM l), q AS (SELECT item_id AS query_id, unnest({t.format('text')}) AS term FROM benchmark), qt AS (SELECT query_id, term, count(*) AS qtf FROM q GROUP BY ALL),
    p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM s) WHERE term IN (SELECT term FROM qt) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY term)
    SELECT query_id, doc_id, round(sum({'qtf' if repeats else '1'} * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / al))), 5) AS score
    FROM p JOIN df USING (term) JOIN l USING (doc_id) JOIN qt USING (term), st GROUP BY query_id, doc_id"""


@query(bm25_sql(False, True))
def e34_bm25(spark, d):
    return rounded(V.bm25(read_table(spark, d, "documents"), X.text_queries(spark, d), tokens_alnum), "score", places=5)


@query(bm25_sql(False, False))
def e35_bm25_term_set(spark, d):
    return rounded(V.bm25(read_table(spark, d, "documents"), X.text_queries(spark, d), tokens_alnum, repeats=False), "score", places=5)


@query(bm25_sql(True, True))
def e36_bm25_words(spark, d):
    return rounded(V.bm25(read_table(spark, d, "documents"), X.text_queries(spark, d), tokens_alpha), "score", places=5)


@query("""WITH s AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), t AS (SELECT doc_id, unnest(w) AS term FROM s), f AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL)
  SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, max(tf) AS top_tf FROM f GROUP BY term""")
def d14_term_statistics(spark, d):
    tf = V.term_counts(read_table(spark, d, "documents"), "doc_id", tokens_alnum(F.col("text")))
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("top_tf"))


FUSE_SQL = VIEW_SQL + """, g AS (SELECT query_id, doc_id, total AS score FROM own),
zg AS (SELECT query_id, doc_id, (score - avg(score) OVER w) / (stddev_samp(score) OVER w + 1e-6) AS z FROM g WINDOW w AS (PARTITION BY query_id)),
zs AS (SELECT query_id, doc_id, (score - avg(score) OVER w) / (stddev_samp(score) OVER w + 1e-6) AS z FROM sims WINDOW w AS (PARTITION BY query_id))
"""


@query(FUSE_SQL + "SELECT query_id, doc_id, round(zs.z + 0.5 * coalesce(greatest(zg.z, 0), 0), 5) AS score FROM zs LEFT JOIN zg USING (query_id, doc_id)")
def e41_additive_fusion(spark, d):
    return W.additive_fusion(blocks(spark, d), 5, 0.5)


@query(VIEW_SQL + """, e AS (SELECT query_id, doc_id, exp(score - max(score) OVER (PARTITION BY query_id)) AS e FROM sims), ps AS (SELECT query_id, doc_id, e / (sum(e) OVER (PARTITION BY query_id) + 1e-12) AS p FROM e),
  pg AS (SELECT query_id, doc_id, total / sum(total) OVER (PARTITION BY query_id) AS g FROM own) SELECT query_id, doc_id, round(ln(0.7 * p + 0.3 * coalesce(g, 0) + 1e-12), 5) AS score FROM ps LEFT JOIN pg USING (query_id, doc_id)""")
def e42_mixture_fusion(spark, d):
    return W.mixture_fusion(blocks(spark, d), 5, 0.3)


@query(VIEW_SQL + """, a AS (SELECT query_id, doc_id, score FROM run WHERE rank <= 50), o AS (SELECT query_id, doc_id, total AS score, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, doc_id) AS r FROM own),
  u AS (SELECT query_id, doc_id, max(score) AS score FROM (SELECT * FROM a UNION ALL SELECT query_id, doc_id, score FROM o WHERE r <= 50) GROUP BY ALL)
  SELECT query_id, doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM u) WHERE rank <= 30""")
def g10_merge_runs(spark, d):
    views_run = blocks(spark, d).best(50)
    return rounded(R.merge_runs([X.dense_run(spark, d, 50), views_run], 30), "score").select("query_id", "doc_id", "rank", "score")


@query(VIEW_SQL + """, b AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, doc_id) AS rank FROM own)
  SELECT query_id, doc_id, a.rank AS rank_a, b.rank AS rank_b, coalesce(b.rank, 1000000) - coalesce(a.rank, 1000000) AS moved
  FROM (SELECT * FROM run WHERE rank <= 20) a FULL JOIN (SELECT * FROM b WHERE rank <= 20) b USING (query_id, doc_id)""")
def c18_rank_deltas(spark, d):
    a = X.dense_run(spark, d, 20).select("query_id", "doc_id", F.col("rank").alias("rank_a"))
    b = blocks(spark, d).best(20).select("query_id", "doc_id", F.col("rank").alias("rank_b"))
    gone = F.lit(1_000_000)
    return a.join(b, ["query_id", "doc_id"], "full").withColumn("moved", F.coalesce("rank_b", gone) - F.coalesce("rank_a", gone))


@query(VIEW_SQL + """, t AS (SELECT query_id, avg(score) FILTER (rank <= 5) AS top5, max(score) - avg(score) FILTER (rank <= 5) AS lead FROM run GROUP BY query_id),
  o AS (SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, doc_id) AS r FROM own) WHERE r <= 10),
  c AS (SELECT query_id, count(o.doc_id) AS hits FROM (SELECT * FROM run WHERE rank <= 10) r LEFT JOIN o USING (query_id, doc_id) GROUP BY query_id)
  SELECT query_id, round(top5, 6) AS top5, round(lead, 6) AS lead, round(hits / 10.0, 6)::DOUBLE AS shared FROM t JOIN c USING (query_id)""")
def f10_router_features(spark, d):
    run = X.dense_run(spark, d, 10)
    other = blocks(spark, d).best(10).select("query_id", "doc_id", F.lit(1).alias("hit"))
    top = F.avg(F.when(F.col("rank") <= 5, F.col("score")))
    both = run.join(other, ["query_id", "doc_id"], "left").groupBy("query_id").agg(top.alias("top5"), (F.max("score") - top).alias("lead"), (F.count("hit") / 10).alias("shared"))
    return rounded(both, "top5", "lead", "shared")


@query("""WITH r AS (SELECT user_id, value, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY value) AS a, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts)) AS b FROM events),
  m AS (SELECT user_id, avg(a) OVER (PARTITION BY user_id, value) AS x, avg(b) OVER (PARTITION BY user_id, t) AS y FROM r)
  SELECT user_id, round(covar_pop(x, y) / ((stddev_pop(x) + 1e-10) * (stddev_pop(y) + 1e-10)), 6) AS rho FROM m GROUP BY user_id""")
def f06_spearman(spark, d):
    e = read_table(spark, d, "events").select("user_id", "value", F.col("ts").cast("timestamp_ntz").alias("t"))
    return rounded(M.spearman(e, "value", "t", "user_id"), "rho")


@query("""WITH r AS (SELECT user_id, event_type = 'click' AS pos, avg(n) OVER (PARTITION BY user_id, value) AS r FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value) AS n FROM events)),
  c AS (SELECT user_id, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n, sum(r) FILTER (pos) AS s FROM r GROUP BY user_id)
  SELECT user_id, round(CASE WHEN p > 0 AND n > 0 THEN (s - p * (p + 1) / 2) / (p * n) END, 6) AS auroc FROM c""")
def f07_auroc(spark, d):
    e = read_table(spark, d, "events").select("user_id", "value", (F.col("event_type") == "click").alias("pos"))
    return rounded(M.auroc(e, "value", "pos", "user_id"), "auroc")


@query("""SELECT event_type, count(*) AS n, min(value) AS low, list_sort(list(value))[floor(count(*) / 2)::INT + 1] AS mid, list_sort(list(value))[floor(count(*) * 0.9)::INT + 1] AS p90, max(value) AS high FROM events GROUP BY event_type""")
def d06_upper_quantiles(spark, d):
    e = read_table(spark, d, "events").select("event_type", "value")
    out = e.groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    for name, share in (("mid", 0.5), ("p90", 0.9)):
        out = out.join(E.nth_value(e, ["event_type"], "value", share).withColumnRenamed("value", name), "event_type")
    return out


@query("SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q25, round(median(value), 6) AS q50, round(quantile_cont(value, 0.95), 6) AS q95, round(stddev_pop(value), 6) AS dev FROM events GROUP BY event_type")
def d07_percentiles(spark, d):
    return rounded(read_table(spark, d, "events").groupBy("event_type").agg(F.percentile("value", 0.25).alias("q25"), F.median("value").alias("q50"), F.percentile("value", 0.95).alias("q95"), F.stddev_pop("value").alias("dev")), "q25", "q50", "q95", "dev")


@query("""WITH g AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS h FROM events GROUP BY user_id)
  SELECT user_id, round((h / n::DOUBLE + 3.8416 / (2 * n) - 1.96 * sqrt(h / n::DOUBLE * (1 - h / n::DOUBLE) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS low,
  round((h / n::DOUBLE + 3.8416 / (2 * n) + 1.96 * sqrt(h / n::DOUBLE * (1 - h / n::DOUBLE) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS high FROM g""")
def h17_wilson(spark, d):
    g = read_table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("h"))
    low, high = M.wilson(F.col("h"), F.col("n"))
    return rounded(g.select("user_id", low.alias("low"), high.alias("high")), "low", "high")


JUDGED = "CASE WHEN a.value > b.value THEN 1.0 WHEN a.value = b.value THEN 0.5 ELSE 0.0 END"


@query(f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events)
  SELECT a.event_type AS arm_a, b.event_type AS arm_b, count(*) AS games, sum({JUDGED})::DOUBLE AS points, round(avg({JUDGED}), 6)::DOUBLE AS share
  FROM e a JOIN e b ON a.user_id = b.user_id AND a.n = b.n AND a.event_type < b.event_type GROUP BY ALL""")
def h19_paired_points(spark, d):
    e = read_table(spark, d, "events")
    e = e.withColumn("n", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id")))
    a, b = (e.select("user_id", "n", F.col("event_type").alias(f"arm_{x}"), F.col("value").alias(x)) for x in "ab")
    points = F.when(F.col("a") > F.col("b"), 1.0).when(F.col("a") == F.col("b"), 0.5).otherwise(0.0)
    met = a.join(b, ["user_id", "n"]).where("arm_a < arm_b")
    return rounded(met.groupBy("arm_a", "arm_b").agg(F.count("*").alias("games"), F.sum(points).alias("points"), F.avg(points).alias("share")), "share")


@query()
def h18_ratings(spark, d):
    """Ratings of the event types, as arms, from their paired points."""
    games = h19_paired_points(spark, d).select(F.col("arm_a").alias("a"), F.col("arm_b").alias("b"), F.col("points").alias("points_a"), F.col("games").alias("n"))
    return spark.createDataFrame(M.bradley_terry(games), "arm string, rating double")


POISSON = " + ".join(f"(u > {p})::INT" for p in M.poisson_steps())


@query(VIEW_SQL + f""", brun AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, doc_id) AS rank FROM sig) WHERE rank <= 100),
  n AS (SELECT query_id, count(*) AS n FROM qrels GROUP BY query_id),
  ap AS (SELECT arm, query_id, sum(nth::DOUBLE / rank) AS s FROM (SELECT *, row_number() OVER (PARTITION BY arm, query_id ORDER BY rank) AS nth FROM (SELECT 'a' AS arm, query_id, doc_id, rank FROM run UNION ALL SELECT 'b', query_id, doc_id, rank FROM brun) JOIN qrels USING (query_id, doc_id)) GROUP BY ALL),
  diffs AS (SELECT n.query_id AS key, coalesce(b.s, 0) / n - coalesce(a.s, 0) / n AS diff FROM n LEFT JOIN ap a ON a.query_id = n.query_id AND a.arm = 'a' LEFT JOIN ap b ON b.query_id = n.query_id AND b.arm = 'b'),
  us AS (SELECT replicate, diff, (('0x' || substr(md5('13:' || replicate || ':' || key), 1, 10))::BIGINT + 0.5) / 1099511627776.0::DOUBLE AS u FROM diffs, (SELECT unnest(range(1000)) AS replicate)),
  ms AS (SELECT replicate, sum(t * diff) / greatest(sum(t), 1) AS m FROM (SELECT replicate, diff, {POISSON} AS t FROM us) GROUP BY replicate)
  SELECT round(list_sort(list(m))[1 + 25], 6) AS low, round(list_sort(list(m))[1 + 975], 6) AS high, count(*) AS replicates FROM ms""")
def h16_bootstrap(spark, d):
    """Bounds of the mean difference of two runs' average precision."""
    a = dense_metrics(spark, d).select("query_id", F.col("map").alias("a"))
    run = blocks(spark, d).best(100)
    b = M.per_query(run, X.dense_qrels(spark, d)).select("query_id", F.col("map").alias("b"))
    means = materialize(M.bootstrap_differences(a.join(b, "query_id").select(F.col("query_id").alias("key"), (F.col("b") - F.col("a")).alias("diff")), 1000), "replicates")
    low, high = (E.nth_value(means.select("mean_diff"), [], "mean_diff", q).select(F.round("mean_diff", 6).alias(name)) for q, name in ((0.025, "low"), (0.975, "high")))
    return low.crossJoin(high).crossJoin(means.agg(F.count("*").alias("replicates")))


@query(DENSE + """, c AS (SELECT k, query_id, count(q.doc_id) AS hits FROM run CROSS JOIN (SELECT unnest([1, 5, 10, 20, 50, 100]) AS k) LEFT JOIN qrels q USING (query_id, doc_id) WHERE rank <= k GROUP BY ALL),
  n AS (SELECT query_id, count(*) AS n FROM qrels GROUP BY query_id) SELECT k, round(avg(hits::DOUBLE / n), 6) AS recall, round(sum(hits)::DOUBLE / sum(n), 6) AS share FROM c JOIN n USING (query_id) GROUP BY k""")
def h20_recall_curve(spark, d):
    qrels = X.dense_qrels(spark, d)
    n = qrels.groupBy("query_id").agg(F.count("*").alias("n"))
    run = X.dense_run(spark, d).join(qrels.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    at = run.withColumn("k", F.explode(F.array(*map(F.lit, (1, 5, 10, 20, 50, 100))))).where("rank <= k").groupBy("k", "query_id").agg(F.count("hit").alias("hits"))
    return rounded(at.join(n, "query_id").groupBy("k").agg(F.avg(F.col("hits") / F.col("n")).alias("recall"), (F.sum("hits") / F.sum("n")).alias("share")), "recall", "share")
