"""Queries over the typed graph of the foreign keys."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspan.functions.text import node_type
from quillspan.operators import graph as G
from quillspan.operators.components import connected_components
from quillspan.operators.dense import linked
from quillspan.plans import fixtures as X
from quillspan.plans.registry import query
from quillspan.session import materialize, read_table

GRAPH = "WITH RECURSIVE " + X.EDGES_SQL
STEP_SQL = GRAPH + """, ends AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges),
p AS MATERIALIZED (SELECT src, dst, count(*) / sum(count(*)) OVER (PARTITION BY src) AS w FROM ends GROUP BY src, dst),
x0 AS (SELECT query_id, node, 1.0::DOUBLE / count(*) OVER (PARTITION BY query_id) AS m FROM (SELECT DISTINCT * FROM seeds))
"""


def walk_sql(steps: int, restart: float) -> str:
    parts = []
    for i in range(1, steps + 1):
        parts.append(f"""x{i} AS (SELECT query_id, node, sum(m) AS m FROM (SELECT query_id, dst AS node, {1 - restart} * m * w AS m FROM x{i - 1} JOIN p ON node = src
          UNION ALL SELECT query_id, node, {restart} * m FROM x0) GROUP BY ALL)""")
    return ", ".join(parts)


@query(GRAPH + "SELECT src, rel, dst FROM edges UNION ALL SELECT dst, 'inverse_' || rel, src FROM edges")
def e10_inverse_edges(spark, d):
    return G.with_inverse(X.edges(spark, d))


@query(GRAPH + ", e AS (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) SELECT node, count(*) AS degree FROM e GROUP BY node")
def d01_degrees(spark, d):
    return G.degrees(X.edges(spark, d))


@query(GRAPH + "SELECT dst AS node, count(*) AS n_orders FROM edges WHERE rel = 'contains' GROUP BY dst")
def d02_document_degrees(spark, d):
    return X.edges(spark, d).where("rel = 'contains'").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_orders"))


@query(GRAPH + "SELECT rel, count(*) AS n, count(DISTINCT src) AS heads, count(DISTINCT dst) AS tails FROM edges GROUP BY rel")
def d03_relation_counts(spark, d):
    return X.edges(spark, d).groupBy("rel").agg(F.count("*").alias("n"), F.count_distinct("src").alias("heads"), F.count_distinct("dst").alias("tails"))


@query(STEP_SQL + ", " + walk_sql(3, 0.15) + " SELECT query_id, node, round(m, 8) AS mass FROM x3")
def e15_random_walk(spark, d):
    x = G.random_walk(X.edges(spark, d), X.seeds(spark, d))
    return x.select("query_id", "node", F.round("mass", 8).alias("mass"))


@query(GRAPH + """, ends AS (SELECT src, dst FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst),
  p AS MATERIALIZED (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM ends), x0 AS (SELECT query_id, node, 1.0::DOUBLE / count(*) OVER (PARTITION BY query_id) AS m FROM (SELECT DISTINCT * FROM seeds)), """
  + walk_sql(50, 0.05) + " SELECT query_id, node, round(m, 8) AS mass FROM x50")
def e16_personalised_rank(spark, d):
    """All fifty rounds, and every node with a mass."""
    return G.personalised_rank(X.edge_rows(spark, d), X.seeds(spark, d)).select("query_id", "node", F.round("mass", 8).alias("mass"))


HOPS_SQL = GRAPH + """, ends AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), h0 AS (SELECT DISTINCT query_id, node, 0 AS hops FROM seeds),
  h1 AS (SELECT * FROM h0 UNION ALL SELECT DISTINCT query_id, dst, 1 FROM h0 JOIN ends ON node = src WHERE (query_id, dst) NOT IN (SELECT query_id, node FROM h0)),
  h2 AS (SELECT * FROM h1 UNION ALL SELECT DISTINCT query_id, dst, 2 FROM h1 JOIN ends ON node = src WHERE hops = 1 AND (query_id, dst) NOT IN (SELECT query_id, node FROM h1)),
  h3 AS (SELECT * FROM h2 UNION ALL SELECT DISTINCT query_id, dst, 3 FROM h2 JOIN ends ON node = src WHERE hops = 2 AND (query_id, dst) NOT IN (SELECT query_id, node FROM h2))
"""


@query(HOPS_SQL + "SELECT query_id, node, hops FROM h3")
def e18_hops(spark, d):
    return G.hops(X.edges(spark, d), X.seeds(spark, d), 3)


@query(HOPS_SQL + "SELECT query_id, split_part(substr(node, 2), ']', 1) AS kind, hops, count(*) AS n FROM h3 GROUP BY ALL")
def e20_reach_by_type(spark, d):
    h = G.hops(X.edges(spark, d), X.seeds(spark, d), 3)
    return h.groupBy("query_id", node_type(F.col("node")).alias("kind"), "hops").agg(F.count("*").alias("n"))


@query(GRAPH + """, near AS (SELECT DISTINCT query_id, dst AS node FROM seeds JOIN edges ON node = src), golds AS (SELECT c_nationkey % 5 AS query_id, '[order] ' || o_orderkey AS node FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority LIKE '1%')
  SELECT query_id, count(*) AS n_golds, count(n.node) AS reached, bool_or(n.node IS NOT NULL) AS any_gold, bool_and(n.node IS NOT NULL) AS all_golds FROM golds LEFT JOIN near n USING (query_id, node) GROUP BY query_id""")
def e21_one_hop_golds(spark, d):
    near = X.seeds(spark, d).join(X.edges(spark, d), F.col("node") == F.col("src")).select("query_id", F.col("dst").alias("node")).distinct().withColumn("hit", F.lit(True))
    o = read_table(spark, d, "orders").where("o_orderpriority LIKE '1%'").join(read_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    golds = o.select((F.col("c_nationkey") % 5).alias("query_id"), F.concat(F.lit("[order] "), F.col("o_orderkey").cast("string")).alias("node"))
    met = golds.join(near, ["query_id", "node"], "left")
    hit = F.coalesce("hit", F.lit(False))
    return met.groupBy("query_id").agg(F.count("*").alias("n_golds"), F.count("hit").alias("reached"), F.bool_or(hit).alias("any_gold"), F.bool_and(hit).alias("all_golds"))


TARGETS_SQL = "goal AS (SELECT DISTINCT s_nationkey AS query_id, '[supplier] ' || s_suppkey AS node, 1.0::DOUBLE AS p FROM supplier)"


@query(STEP_SQL.replace("p AS MATERIALIZED (SELECT src, dst, count", "w AS MATERIALIZED (SELECT src, dst, count") + f""", {TARGETS_SQL},
  g1 AS (SELECT * FROM goal UNION ALL SELECT query_id, src, sum(p * w) FROM goal JOIN w ON node = dst WHERE (query_id, src) NOT IN (SELECT query_id, node FROM goal) GROUP BY ALL),
  g2 AS (SELECT * FROM goal UNION ALL SELECT query_id, src, sum(p * w) FROM g1 JOIN w ON node = dst WHERE (query_id, src) NOT IN (SELECT query_id, node FROM goal) GROUP BY ALL)
  SELECT query_id, node, round(p, 8) AS p FROM g2""")
def e22_hitting(spark, d):
    goal = read_table(spark, d, "supplier").select(F.col("s_nationkey").alias("query_id"), F.concat(F.lit("[supplier] "), F.col("s_suppkey").cast("string")).alias("node"))
    return G.hitting(X.edges(spark, d), goal, 2).select("query_id", "node", F.round("p", 8).alias("p"))


WEIGHTS = (("placed", 1.0), ("contains", 0.9), ("supplied_by", 0.75), ("in_nation", 0.5), ("in_region", 0.25))
WEIGHT_SQL = f"wt AS (SELECT * FROM (VALUES {', '.join(f"('{rel}', {w}::DOUBLE)" for rel, w in WEIGHTS)}) t(rel, weight)), s0 AS (SELECT DISTINCT query_id, node, 1.0::DOUBLE AS value FROM seeds)"


def layers_sql(n: int, op: str, fold: str) -> str:
    return ", ".join(
        f"s{i} AS (SELECT query_id, node, {fold}(value) AS value FROM (SELECT query_id, dst AS node, value {op} weight AS value FROM s{i - 1} JOIN edges ON node = src JOIN wt USING (rel) UNION ALL SELECT * FROM s{i - 1}) GROUP BY ALL)"
        for i in range(1, n + 1)
    )


def layers(spark, d, n, **how):
    weights = spark.createDataFrame(WEIGHTS, "rel string, weight double")
    state = X.seeds(spark, d).distinct().withColumn("value", F.lit(1.0))
    edges = X.edges(spark, d)
    for _ in range(n):
        state = G.message_pass(edges, state, weights, **how)
    return state.select("query_id", "node", F.round("value", 6).alias("value"))


@query(GRAPH + f", {WEIGHT_SQL}, {layers_sql(1, '*', 'sum')} SELECT query_id, node, round(value, 6) AS value FROM s1")
def e24_sum_product(spark, d):
    return layers(spark, d, 1)


@query(GRAPH + f", {WEIGHT_SQL}, {layers_sql(1, '+', 'max')} SELECT query_id, node, round(value, 6) AS value FROM s1")
def e24_max_plus(spark, d):
    return layers(spark, d, 1, message="add", aggregate="max")


@query(GRAPH + f", {WEIGHT_SQL}, {layers_sql(1, '*', 'min')} SELECT query_id, node, round(value, 6) AS value FROM s1")
def e24_min_product(spark, d):
    return layers(spark, d, 1, aggregate="min")


@query(GRAPH + f", {WEIGHT_SQL}, {layers_sql(3, '*', 'sum')} SELECT query_id, node, round(value, 6) AS value FROM s3")
def e25_bellman_ford(spark, d):
    return layers(spark, d, 3)


@query(GRAPH + """, st AS (SELECT query_id, node, 1.0::DOUBLE + query_id AS value FROM (SELECT DISTINCT * FROM seeds)),
  a AS (SELECT query_id, dst AS node, avg(value) AS mean, max(value) AS largest, min(value) AS smallest, sqrt(greatest(avg(value * value) - avg(value) * avg(value), 1e-6)) AS deviation, ln(count(*) + 1.0) AS ld FROM st JOIN edges ON node = src GROUP BY ALL)
  SELECT query_id, node, round(mean, 6) AS mean, largest, smallest, round(deviation, 6) AS deviation, round(ld / avg(ld) OVER (PARTITION BY query_id), 6) AS scale FROM a""")
def d20_moments(spark, d):
    state = X.seeds(spark, d).distinct().withColumn("value", 1.0 + F.col("query_id"))
    m = G.moments(X.edges(spark, d), state)
    return m.withColumns({c: F.round(c, 6) for c in ("mean", "deviation", "scale")})


@query(GRAPH + """SELECT DISTINCT a.src, 'short_' || b.rel AS rel, b.dst FROM edges a JOIN edges b ON a.dst = b.src AND ((a.rel = 'contains' AND b.rel = 'supplied_by') OR (a.rel = 'in_nation' AND b.rel = 'in_region')) WHERE a.src <> b.dst""")
def c05_shortcuts(spark, d):
    return G.shortcuts(X.edge_rows(spark, d), [("contains", "supplied_by"), ("in_nation", "in_region")])


@query(GRAPH + """, ends AS (SELECT DISTINCT rel, src AS node, 'head' AS side FROM edges UNION SELECT DISTINCT rel, dst, 'tail' FROM edges)
  SELECT DISTINCT a.rel AS r1, a.side || '_' || b.side AS kind, b.rel AS r2 FROM ends a JOIN ends b USING (node)""")
def e13_relation_graph(spark, d):
    return G.relation_graph(X.edges(spark, d))


@query(GRAPH + """, n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges)
  SELECT (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM edges WHERE src = dst) AS n_loops,
  (SELECT count(*) FROM supplier WHERE '[supplier] ' || s_suppkey NOT IN (SELECT dst FROM edges WHERE rel = 'supplied_by')) AS unused_suppliers,
  (SELECT count(*) FROM customer WHERE '[customer] ' || c_custkey NOT IN (SELECT src FROM edges WHERE rel = 'placed')) AS idle_customers,
  (SELECT count(DISTINCT node) FROM seeds) AS n_seeds, (SELECT count(*) FROM (SELECT query_id FROM seeds GROUP BY query_id)) AS n_queries""")
def e33_audit(spark, d):
    e = materialize(X.edges(spark, d), "edges")
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    counts = e.agg(F.count("*").alias("n_edges"), F.count_if(F.col("src") == F.col("dst")).alias("n_loops")).crossJoin(nodes.agg(F.count("*").alias("n_nodes")))
    name = lambda kind, c: F.concat(F.lit(f"[{kind}] "), F.col(c).cast("string"))
    s = read_table(spark, d, "supplier").join(e.where("rel = 'supplied_by'"), name("supplier", "s_suppkey") == F.col("dst"), "left_anti")
    c = read_table(spark, d, "customer").join(e.where("rel = 'placed'"), name("customer", "c_custkey") == F.col("src"), "left_anti")
    seeds = X.seeds(spark, d).agg(F.count_distinct("node").alias("n_seeds"), F.count_distinct("query_id").alias("n_queries"))
    return counts.crossJoin(s.agg(F.count("*").alias("unused_suppliers"))).crossJoin(c.agg(F.count("*").alias("idle_customers"))).crossJoin(seeds)


VEC_SQL = "WITH RECURSIVE v AS (SELECT CAST(label AS VARCHAR) AS kind, vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"


def vectors(spark, d):
    return read_table(spark, d, "embeddings").select(F.col("label").cast("string").alias("kind"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@query(VEC_SQL + " SELECT x.kind, x.id AS a, y.id AS b, round(list_dot_product(x.v, y.v), 6) AS sim FROM v x JOIN v y ON x.kind = y.kind AND x.id < y.id WHERE list_dot_product(x.v, y.v) >= 0.3")
def c07_similar_pairs(spark, d):
    return G.similar_pairs(vectors(spark, d), 0.3).withColumn("sim", F.round("sim", 6))


@query(VEC_SQL + """, n AS (SELECT x.kind, x.id AS a, y.id AS b, list_dot_product(x.v, y.v) AS sim, row_number() OVER (PARTITION BY x.id ORDER BY list_dot_product(x.v, y.v) DESC, y.id) AS r FROM v x JOIN v y ON x.kind = y.kind AND x.id <> y.id),
  k AS (SELECT * FROM n WHERE r <= 8) SELECT k.kind, k.a, k.b, round(k.sim, 6) AS sim FROM k JOIN k j ON k.a = j.b AND k.b = j.a WHERE k.a < k.b AND k.sim BETWEEN 0.1 AND 0.9""")
def e03_mutual_neighbours(spark, d):
    return G.mutual_neighbours(vectors(spark, d), 8, 0.1, 0.9).withColumn("sim", F.round("sim", 6))


@query(VEC_SQL + """, e AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.kind = y.kind AND x.id <> y.id WHERE list_dot_product(x.v, y.v) >= 0.35),
  r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.a, r.root FROM e JOIN r ON e.b = r.node)
  SELECT node, min(root) AS component FROM r GROUP BY node""")
def e02_consolidation(spark, d):
    """Single-linkage clusters of similar vectors of one label."""
    return connected_components(linked(vectors(spark, d), 0.35))


@query(GRAPH + """SELECT DISTINCT a.dst AS node FROM edges a WHERE a.rel = 'supplied_by' AND a.src IN (SELECT dst FROM edges WHERE rel = 'contains' AND src = '[order] 1')
  UNION SELECT dst FROM edges WHERE rel = 'in_nation' AND src = '[customer] 1'""")
def e46_logical_query(spark, d):
    q = ("or", ("step", "supplied_by", ("step", "contains", ("node", "[order] 1"))), ("step", "in_nation", ("node", "[customer] 1")))
    return G.answer(q, X.edges(spark, d))


@query(GRAPH + "SELECT b.rel, b.src, count(*) AS n_matching FROM edges b JOIN (SELECT DISTINCT rel, src FROM edges) q USING (rel, src) GROUP BY ALL")
def c12_edge_match(spark, d):
    e = X.edges(spark, d)
    q = e.select("rel", "src").distinct()
    return e.join(q, ["rel", "src"]).groupBy("rel", "src").agg(F.count("*").alias("n_matching"))


@query(GRAPH + "SELECT src, rel, dst FROM edges WHERE (src, dst) NOT IN (SELECT '[supplier] ' || s_suppkey, '[nation] ' || s_nationkey FROM supplier WHERE s_acctbal < 0)")
def c13_remove_edges(spark, d):
    gone = read_table(spark, d, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("[supplier] "), F.col("s_suppkey").cast("string")).alias("src"), F.concat(F.lit("[nation] "), F.col("s_nationkey").cast("string")).alias("dst"))
    return X.edges(spark, d).join(gone, ["src", "dst"], "left_anti").select("src", "rel", "dst")


@query(GRAPH + """, m AS (SELECT query_id, dst AS nation, count(*) AS n FROM seeds JOIN edges ON node = src WHERE rel = 'in_nation' GROUP BY ALL), df AS (SELECT dst AS nation, count(*) AS df FROM edges WHERE rel = 'in_nation' GROUP BY dst)
  SELECT query_id, r.dst AS region, round(sum(n / df::DOUBLE), 6) AS score FROM m JOIN df USING (nation) JOIN edges r ON r.src = nation AND r.rel = 'in_region' GROUP BY ALL""")
def e28_entity_ranker(spark, d):
    """Entity scores weighted by inverse frequency, summed for what mentions them."""
    e = X.edges(spark, d)
    inn = e.where("rel = 'in_nation'").select(F.col("src").alias("node"), F.col("dst").alias("nation"))
    m = X.seeds(spark, d).join(inn, "node").groupBy("query_id", "nation").agg(F.count("*").alias("n"))
    df = inn.groupBy("nation").agg(F.count("*").alias("df"))
    reg = e.where("rel = 'in_region'").select(F.col("src").alias("nation"), F.col("dst").alias("region"))
    return m.join(df, "nation").join(reg, "nation").groupBy("query_id", "region").agg(F.round(F.sum(F.col("n") / F.col("df")), 6).alias("score"))


@query(GRAPH + ", g AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node), w AS (SELECT query_id, node, pow(degree, -0.5) AS w FROM (SELECT DISTINCT * FROM seeds) JOIN g USING (node)) "
  "SELECT query_id, node, round(w / sum(w) OVER (PARTITION BY query_id), 6) AS weight FROM w")
def e29_seed_weights(spark, d):
    """Seeds weighted by a negative power of their degree; a query's mass stays 1."""
    w = X.seeds(spark, d).distinct().join(G.degrees(X.edges(spark, d)), "node").withColumn("w", F.pow("degree", F.lit(-0.5)))
    return w.select("query_id", "node", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("query_id")), 6).alias("weight"))
