"""Queries of joins, aggregates, sets, sampling and sources over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspan.operators.sampling import first_by_hash, stratified
from quillspan.plans.registry import query
from quillspan.session import read_table
from quillspan.streaming.events import tumbling_counts

T = read_table


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def r01_pricing_summary(spark, d):
    li = T(spark, d, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02'")
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(revenue), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def c01_key_lookups(spark, d):
    """Names for keys: the two small tables are broadcast only under Spark's own size check."""
    o, c, n = T(spark, d, "orders"), T(spark, d, "customer"), T(spark, d, "nation")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "c_name", "n_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def c03_semi(spark, d):
    o = T(spark, d, "orders").where("o_orderpriority LIKE '1%'")
    return T(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def c04_anti(spark, d):
    return T(spark, d, "customer").join(T(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("WITH k AS (SELECT item_id, substr(text, 1, 40) AS key FROM benchmark) SELECT item_id, doc_id FROM k JOIN documents ON starts_with(text, key) UNION ALL SELECT item_id, d.doc_id FROM (SELECT doc_id AS item_id, substr(text, 1, 30) AS key FROM documents WHERE length(text) >= 30) JOIN documents d ON starts_with(text, key)")
def c15_prefix_join(spark, d):
    """Keys that a text begins with: an equi-join on length and prefix, one probe for each length of a key."""
    docs = T(spark, d, "documents").select("doc_id", "text")
    keys = T(spark, d, "benchmark").select("item_id", F.substring("text", 1, 40).alias("key"))
    keys = keys.unionAll(docs.where("length(text) >= 30").select(F.col("doc_id").alias("item_id"), F.substring("text", 1, 30).alias("key")))
    keys = keys.withColumn("len", F.length("key"))
    lengths = keys.select("len").distinct()
    probes = docs.join(F.broadcast(lengths), F.length("text") >= F.col("len")).select("doc_id", "len", F.substr("text", F.lit(1), F.col("len")).alias("key"))
    return keys.join(probes, ["len", "key"]).select("item_id", "doc_id")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN 'part' WHEN s_suppkey IS NOT NULL AND s_acctbal > 0 THEN 'supplier' WHEN o_orderkey IS NOT NULL THEN 'order' END AS route
  FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus = 'O') SELECT coalesce(route, 'none') AS route, count(*) AS n FROM r GROUP BY ALL""")
def c16_route_cascade(spark, d):
    """The first route that resolves a row; dearer routes see only what is left."""
    li = T(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    first = li.where("l_partkey % 3 = 0").select(F.lit("part").alias("route"))
    rest = li.where("l_partkey % 3 <> 0")
    s = T(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    o = T(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    second = rest.join(s, "l_suppkey", "left_semi").select(F.lit("supplier").alias("route"))
    left = rest.join(s, "l_suppkey", "left_anti")
    third = left.join(o, "l_orderkey", "left_semi").select(F.lit("order").alias("route"))
    none = left.join(o, "l_orderkey", "left_anti").select(F.lit("none").alias("route"))
    return first.union(second).union(third).union(none).groupBy("route").agg(F.count("*").alias("n"))


@query("SELECT coalesce(a.k, b.k) AS k, a.n AS n_customers, b.n AS n_suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b ON a.k = b.k")
def c17_full_outer(spark, d):
    a = T(spark, d, "customer").where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n_customers"))
    b = T(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_suppliers"))
    return a.join(b, "k", "full")


@query("SELECT lower(split_part(text, ' ', 1)) AS key, min(doc_id) AS first_id, arg_min(source, doc_id) AS source, count(*) AS n FROM documents GROUP BY 1")
def c19_first_wins(spark, d):
    key = F.lower(F.substring_index("text", " ", 1))
    return T(spark, d, "documents").groupBy(key.alias("key")).agg(F.min("doc_id").alias("first_id"), F.min_by("source", "doc_id").alias("source"), F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def d24_rollup(spark, d):
    return T(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
def d05_grouping_sets(spark, d):
    return T(spark, d, "customer").groupingSets([["c_mktsegment"], ["c_nationkey"], []], "c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT text) AS n_distinct, count(*) - count(DISTINCT text) AS n_dup, count(DISTINCT lang) AS n_langs FROM documents")
def d04_distinct(spark, d):
    digest = F.xxhash64("text"), F.md5("text")
    return T(spark, d, "documents").agg(F.count("*").alias("n"), F.count_distinct(*digest).alias("n_distinct"), (F.count("*") - F.count_distinct(*digest)).alias("n_dup"), F.count_distinct("lang").alias("n_langs"))


@query("""WITH c AS (SELECT c_nationkey AS target, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE 'Other' END AS source, count(*) AS n FROM customer GROUP BY ALL)
  SELECT target, source, n, round(n / sum(n) OVER (PARTITION BY target), 6) AS share FROM c""")
def d11_contingency(spark, d):
    source = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.col("c_mktsegment")).otherwise("Other")
    c = T(spark, d, "customer").groupBy(F.col("c_nationkey").alias("target"), source.alias("source")).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("target")), 6))


@query("SELECT least(floor(l_quantity / 5), 9)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def d12_histogram(spark, d):
    return T(spark, d, "lineitem").groupBy(F.least(F.floor(F.col("l_quantity") / 5), F.lit(9)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT p_brand, round(1.0 / count(*), 8)::DOUBLE AS weight FROM part GROUP BY p_brand")
def d13_inverse_frequency(spark, d):
    return T(spark, d, "part").groupBy("p_brand").agg(F.round(1.0 / F.count("*"), 8).alias("weight"))


@query("SELECT l_suppkey, round(sum(l_tax), 4) AS total, round(avg(l_tax), 6) AS mean, min(l_tax) AS low, max(l_tax) AS high FROM lineitem GROUP BY l_suppkey")
def d16_scatter_reduce(spark, d):
    return T(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum("l_tax"), 4).alias("total"), F.round(F.avg("l_tax"), 6).alias("mean"), F.min("l_tax").alias("low"), F.max("l_tax").alias("high"))


@query("SELECT n_name, c_custkey, c_acctbal, rank FROM (SELECT n_name, c_custkey, c_acctbal, row_number() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE rank <= 3")
def g02_topk_per_type(spark, d):
    c = T(spark, d, "customer").join(T(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    w = Window.partitionBy("n_name").orderBy(F.desc("c_acctbal"), "c_custkey")
    return c.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("n_name", "c_custkey", "c_acctbal", "rank")


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def g07_intersect(spark, d):
    return T(spark, d, "orders").select(F.col("o_custkey").alias("k")).intersect(T(spark, d, "customer").where("c_acctbal > 0").select("c_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000")
def g08_difference(spark, d):
    return T(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(T(spark, d, "orders").where("o_totalprice > 100000").select("o_custkey"))


@query("SELECT s_nationkey AS k, 's' AS side FROM supplier UNION SELECT c_nationkey, 'c' FROM customer")
def g06_union(spark, d):
    return T(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("s").alias("side")).unionByName(T(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit("c").alias("side"))).distinct()


@query("""WITH pool AS (SELECT l_orderkey AS q, l_partkey AS p, 1 AS pool FROM lineitem WHERE l_quantity > 45 UNION ALL SELECT l_orderkey, l_suppkey, 2 FROM lineitem WHERE l_quantity > 40),
  u AS (SELECT q, p, min(pool) AS pool FROM pool GROUP BY ALL) SELECT q, p, pool FROM (SELECT *, row_number() OVER (PARTITION BY q, pool ORDER BY p) AS n FROM u) WHERE n <= 2""")
def g05_pools(spark, d):
    """Candidates of several pools: the first pool that has one keeps it; two a pool."""
    li = T(spark, d, "lineitem")
    pool = li.where("l_quantity > 45").select(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("p"), F.lit(1).alias("pool"))
    pool = pool.unionByName(li.where("l_quantity > 40").select(F.col("l_orderkey").alias("q"), F.col("l_suppkey").alias("p"), F.lit(2).alias("pool")))
    own = pool.groupBy("q", "p").agg(F.min("pool").alias("pool"))
    return own.withColumn("n", F.row_number().over(Window.partitionBy("q", "pool").orderBy("p"))).where("n <= 2").drop("n")


@query("SELECT user_id, event_id, value, lag(value) OVER w AS last_value, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running, ntile(4) OVER w AS quarter FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def f05_running(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return T(spark, d, "events").select("user_id", "event_id", "value", F.lag("value").over(w).alias("last_value"), F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"), F.ntile(4).over(w).alias("quarter"))


@query("""WITH g AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 3600 THEN 0 ELSE 1 END AS new FROM events),
  s AS (SELECT user_id, ts, value, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
  SELECT user_id, session::BIGINT AS session, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, session""")
def s02_sessions(spark, d):
    e = T(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp_ntz").cast("timestamp").cast("double"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when(F.col("t") - F.lag("t").over(w) <= 3600, 0).otherwise(1)
    s = e.withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def s01_tumbling_windows(spark, d):
    """Counts a day and type; the streaming job of the same name gives the same rows."""
    return tumbling_counts(T(spark, d, "events"))


@query()
def s03_stream_equals_batch(spark, d):
    """The streaming job run to its end over the table."""
    from quillspan.streaming.events import run_stream

    return run_stream(spark, d)


@query("SELECT c_mktsegment, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer) WHERE r <= 20 OR c_mktsegment = 'BUILDING' GROUP BY c_mktsegment")
def a20_stratified(spark, d):
    """All rows of one stratum and twenty of each other one."""
    return stratified(T(spark, d, "customer"), "c_mktsegment", 20, whole=("BUILDING",), key="c_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 100")
def a19_nested_sample(spark, d):
    """A hundred documents in the order of a seeded hash; smaller samples are its beginnings."""
    return first_by_hash(T(spark, d, "documents").select("doc_id", "lang"), "doc_id", 100, seed=7)
