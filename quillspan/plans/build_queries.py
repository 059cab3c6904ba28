"""Queries of graph construction, paths and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions.text import node_type
from quillspan.operators import build as B
from quillspan.operators import graph as G
from quillspan.operators import paths as P
from quillspan.operators.components import connected_components
from quillspan.operators.dense import linked, nearest
from quillspan.operators.staging import contaminated
from quillspan.plans import fixtures as X
from quillspan.plans.graph_queries import GRAPH, HOPS_SQL, STEP_SQL, VEC_SQL, vectors, walk_sql
from quillspan.plans.registry import query
from quillspan.session import materialize, read_table


def named(kind: str, c: str):
    return F.concat(F.lit(f"[{kind}] "), F.col(c).cast("string"))


SIM = "round(list_dot_product(x.v, y.v), 12)"
SNAP_SQL = VEC_SQL + f""", snap AS (SELECT * FROM (SELECT x.kind, x.id AS phrase, y.id AS node, {SIM} AS score, row_number() OVER (PARTITION BY x.id ORDER BY {SIM} DESC, y.id) AS rank
  FROM v x JOIN v y ON x.kind = y.kind AND x.id <> y.id WHERE {SIM} >= 0.2) WHERE rank <= 3)"""


def snapped(spark, d):
    v = vectors(spark, d)
    return nearest(v, v, 3, by=["kind"], least=0.2, same=True).select("kind", F.col("query_id").alias("phrase"), F.col("doc_id").alias("node"), "score", "rank")


@query(SNAP_SQL + " SELECT kind, phrase, node, rank, round(score, 6) AS score FROM snap")
def c08_knn_snap(spark, d):
    """Each phrase's nearest three concepts of its kind, at a least similarity."""
    return snapped(spark, d).withColumn("score", F.round("score", 6))


@query("WITH " + X.DENSE_SQL + ", r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM sims) SELECT * FROM r WHERE rank <= 10")
def c11_chunked_topk(spark, d):
    """The first ten of all vectors in blocks that hold a hundred at most, merged."""
    docs = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = X.dense_queries(spark, d).select(F.col("query_id").alias("id"), F.col("q").alias("v"))
    return nearest(q, docs, 10, same=True, size=100).select("query_id", "doc_id", "rank")


@query("""WITH t AS (SELECT lower(trim(p_name)) AS title, p_partkey AS doi FROM part), l AS (SELECT DISTINCT l_partkey AS doi FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 3),
  m AS (SELECT title, count(*) AS n_works, count(l.doi) > 0 AS in_layer FROM t LEFT JOIN l USING (doi) GROUP BY title) SELECT doi AS id, n_works, in_layer FROM t JOIN m USING (title)""")
def c14_contamination(spark, d):
    """Titles to works of the same title to their layer."""
    title = F.lower(F.trim("p_name")).alias("title")
    part, li = read_table(spark, d, "part"), read_table(spark, d, "lineitem")
    layer = li.where("l_returnflag = 'R' AND l_quantity < 3").select(F.col("l_partkey").alias("doi"))
    return contaminated(part.select(F.col("p_partkey").alias("id"), title), part.select(title, F.col("p_partkey").alias("doi")), layer)


CLUSTER_SQL = VEC_SQL + """, e AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.kind = y.kind AND x.id <> y.id WHERE list_dot_product(x.v, y.v) >= 0.35),
  r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.a, r.root FROM e JOIN r ON e.b = r.node), c AS (SELECT node, min(root) AS cluster FROM r GROUP BY node)"""


@query(CLUSTER_SQL + """, m AS (SELECT cluster, node AS id, 'concept ' || node AS name, node % 7 AS weight, v FROM c JOIN v ON v.id = node),
  k AS (SELECT cluster, id AS rep FROM m QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, length(name), id) = 1),
  s AS (SELECT cluster, count(*) AS size FROM m GROUP BY cluster), p AS (SELECT cluster, place, avg(x) AS x FROM (SELECT cluster, unnest(range(len(v))) AS place, unnest(v) AS x FROM m) GROUP BY ALL),
  z AS (SELECT cluster, sqrt(sum(x * x)) AS z FROM p GROUP BY cluster) SELECT k.cluster, rep, size, round(p.x / z, 6) AS first_place FROM k JOIN s USING (cluster) JOIN z USING (cluster) JOIN p ON p.cluster = k.cluster AND place = 0""")
def e02_representatives(spark, d):
    """The concept that stands for each cluster, and its centroid."""
    v = vectors(spark, d)
    c = connected_components(linked(v, 0.35)).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    m = v.join(c, "id").select("cluster", "id", F.concat(F.lit("concept "), F.col("id").cast("string")).alias("name"), (F.col("id") % 7).alias("weight"), "v")
    return B.representatives(m).select("cluster", "rep", "size", F.round(F.col("centroid")[0], 6).alias("first_place"))


@query(GRAPH + """, canon AS (SELECT '[supplier] ' || s_suppkey AS node, '[supplier] ' || min(s_suppkey) OVER (PARTITION BY s_nationkey) AS rep FROM supplier)
  SELECT DISTINCT coalesce(a.rep, src) AS src, rel, coalesce(b.rep, dst) AS dst FROM edges LEFT JOIN canon a ON src = a.node LEFT JOIN canon b ON dst = b.node WHERE coalesce(a.rep, src) <> coalesce(b.rep, dst)""")
def e02b_canonical(spark, d):
    """Suppliers of one nation are one node."""
    s = read_table(spark, d, "supplier")
    first = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("first"))
    return B.canonical(X.edges(spark, d), s.join(first, "s_nationkey").select(named("supplier", "s_suppkey").alias("node"), named("supplier", "first").alias("rep")))


@query(VEC_SQL + """, n AS (SELECT x.kind, x.id AS a, y.id AS b, list_dot_product(x.v, y.v) AS sim, row_number() OVER (PARTITION BY x.id ORDER BY list_dot_product(x.v, y.v) DESC, y.id) AS r FROM v x JOIN v y ON x.kind = y.kind AND x.id <> y.id),
  k AS (SELECT * FROM n WHERE r <= 8), p AS (SELECT k.kind, k.a, k.b FROM k JOIN k j ON k.a = j.b AND k.b = j.a WHERE k.a < k.b AND k.sim BETWEEN 0.1 AND 0.9)
  SELECT a AS src, 'similar_' || kind AS rel, b AS dst FROM p WHERE kind NOT IN ('1', '2', '3') OR (a % 3 - 1) * (b % 3 - 1) >= 0""")
def e03_soft_edges(spark, d):
    """Mutual neighbours; in three kinds those of opposite signs stay apart."""
    v = vectors(spark, d)
    return B.soft_edges(G.mutual_neighbours(v, 8, 0.1, 0.9), v.select("id", (F.col("id") % 3 - 1).alias("sign")), ["1", "2", "3"])


@query(SNAP_SQL + ", m AS (SELECT DISTINCT id % 20 AS query_id, kind, id AS phrase FROM v) SELECT query_id, kind, node, round(max(score), 6) AS score FROM m JOIN snap USING (kind, phrase) GROUP BY ALL")
def e04_query_seeds(spark, d):
    """The concepts that a query's phrases snap to, by kind."""
    mentions = vectors(spark, d).select((F.col("id") % 20).alias("query_id"), "kind", F.col("id").alias("phrase"))
    return B.seeds_of_phrases(mentions, snapped(spark, d)).withColumn("score", F.round("score", 6))


@query(GRAPH + """, frame AS (SELECT * FROM edges WHERE rel IN ('in_nation', 'in_region')), facts AS (SELECT * FROM edges WHERE rel = 'supplied_by' UNION ALL SELECT '[part] ' || p_partkey, 'next_to', '[part] ' || (p_partkey + 1) FROM part),
  few AS (SELECT node FROM (SELECT src AS node FROM facts UNION ALL SELECT dst FROM facts) GROUP BY node HAVING count(*) <= 25),
  named AS (SELECT DISTINCT dst AS node, src AS doc FROM edges WHERE rel = 'contains' AND src IN (SELECT '[order] ' || o_orderkey FROM orders WHERE o_orderstatus = 'F')),
  kept AS (SELECT DISTINCT '[part] ' || p_partkey AS node FROM part WHERE p_size <= 20 AND '[part] ' || p_partkey IN (SELECT node FROM few) AND '[part] ' || p_partkey IN (SELECT node FROM named))
  SELECT src, rel, dst FROM frame UNION SELECT node, 'entity_in', doc FROM named WHERE node IN (FROM kept) UNION SELECT src, rel, dst FROM facts WHERE src IN (FROM kept) AND dst IN (FROM kept)""")
def e05_hybrid_merge(spark, d):
    """A frame of places, with the parts that queries seed, of few facts, and the orders that name them."""
    e, part = materialize(X.edges(spark, d), "edges"), read_table(spark, d, "part")
    after = part.select(named("part", "p_partkey").alias("src"), F.lit("next_to").alias("rel"), F.concat(F.lit("[part] "), (F.col("p_partkey") + 1).cast("string")).alias("dst"))
    mentions = e.where("rel = 'contains'").select(F.col("dst").alias("node"), F.col("src").alias("doc"))
    seeds = part.where("p_size <= 20").select(F.col("p_size").alias("query_id"), named("part", "p_partkey").alias("node"))
    docs = read_table(spark, d, "orders").where("o_orderstatus = 'F'").select(named("order", "o_orderkey").alias("doc"))
    return B.hybrid_merge(e.where("rel IN ('in_nation', 'in_region')"), e.where("rel = 'supplied_by'").unionByName(after), mentions, seeds, docs, cap=25)


@query("SELECT c_nationkey AS query_id, count(*) AS n_seeds, count(*) FILTER (c_mktsegment <> 'BUILDING') AS n_left, count(*) FILTER (c_mktsegment <> 'BUILDING') = 0 AS lost FROM customer GROUP BY c_nationkey")
def e06_seed_ablation(spark, d):
    """What is left of a query's seeds without those of one channel."""
    own = F.col("c_mktsegment") != "BUILDING"
    return read_table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("query_id")).agg(F.count("*").alias("n_seeds"), F.count_if(own).alias("n_left"), (F.count_if(own) == 0).alias("lost"))


@query("""WITH t AS (SELECT '[order] ' || l_orderkey AS doc, lpad(l_orderkey::VARCHAR, 12, '0') || l_linenumber || l_returnflag || l_linestatus AS pos, 'part ' || l_partkey AS head,
  CASE WHEN l_quantity > 45 THEN '' ELSE lower(l_returnflag) || ' ' || lower(l_linestatus) END AS rel, 'supplier ' || l_suppkey AS tail FROM lineitem), c AS (SELECT * FROM t WHERE rel <> '')
  SELECT head AS src, arg_max(rel, pos) AS rel, tail AS dst FROM c GROUP BY head, tail UNION ALL SELECT DISTINCT unnest([head, tail]), 'is_mentioned_in', doc FROM c""")
def e07_extracted_graph(spark, d):
    """Triples as they might be extracted, with markup around phrases and empty relations."""
    li = read_table(spark, d, "lineitem")
    pos = F.concat(F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.col("l_linenumber").cast("string"), "l_returnflag", "l_linestatus")
    rel = F.when(F.col("l_quantity") > 45, "?!").otherwise(F.concat("l_returnflag", F.lit("-"), "l_linestatus"))
    head, tail = (F.concat(F.lit(f"{kind}#"), F.col(c).cast("string")) for kind, c in (("Part", "l_partkey"), (" Supplier", "l_suppkey")))
    return B.extracted_graph(li.select(named("order", "l_orderkey").alias("doc"), pos.alias("pos"), head.alias("head"), rel.alias("rel"), tail.alias("tail")))


@query(VEC_SQL + f""", n AS (SELECT * FROM (SELECT x.id AS phrase, y.id AS other, {SIM} AS score, row_number() OVER (PARTITION BY x.id ORDER BY {SIM} DESC, y.id) AS rank FROM v x JOIN v y ON x.kind = y.kind) WHERE rank <= 6),
  s AS (SELECT phrase, other, score, score / max(score) OVER (PARTITION BY phrase) AS share FROM n)
  SELECT 'c' || phrase AS src, 'equivalent' AS rel, 'c' || other AS dst FROM (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY score DESC, 'c' || other) AS nth FROM s WHERE share >= 0.3 AND phrase <> other AND length('c' || phrase) > 2) WHERE nth <= 3""")
def e08_synonyms(spark, d):
    """Phrases near each other relative to their best; three each at most."""
    v = vectors(spark, d)
    name = lambda c: F.concat(F.lit("c"), F.col(c).cast("string"))
    near = nearest(v, v, 6, by=["kind"]).select(name("query_id").alias("phrase"), name("doc_id").alias("other"), "score")
    return B.synonyms(near, 0.3, 2)


@query(GRAPH + "SELECT node, CASE WHEN node LIKE '[%' THEN substr(node, 2, strpos(node, ']') - 2) ELSE 'entity' END AS kind, count(*) AS n_edges FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node")
def e09_graph_nodes(spark, d):
    """The node table of a graph: every end of an edge, with its type."""
    e = X.edges(spark, d)
    ends = e.select(F.col("src").alias("node")).unionAll(e.select(F.col("dst").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("n_edges")).withColumn("kind", node_type(F.col("node")))


@query(GRAPH + """SELECT src, rel, dst FROM edges WHERE src NOT LIKE '[order]%' AND dst NOT LIKE '[order]%'
  UNION ALL SELECT DISTINCT node, 'maps_to', target FROM (SELECT src AS node, dst AS target FROM edges WHERE dst LIKE '[order]%' AND src NOT LIKE '[order]%' UNION ALL SELECT dst, src FROM edges WHERE src LIKE '[order]%' AND dst NOT LIKE '[order]%')""")
def e12_projection(spark, d):
    """Orders leave the graph; what they touch maps to them."""
    kept, pairs = B.projection(X.edges(spark, d), lambda c: node_type(c) == "order")
    return kept.unionByName(pairs.select(F.col("node").alias("src"), F.lit("maps_to").alias("rel"), F.col("target").alias("dst")))


@query("""WITH e AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT l_partkey // 100 AS part, count(*) AS n_edges, count(DISTINCT l_orderkey) FILTER (l_partkey // 100 <> l_orderkey // 1000) AS n_remote FROM e GROUP BY part""")
def e14_boundaries(spark, d):
    """Contiguous ranges of targets as parts, and the sources that they need from others."""
    e = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return B.boundaries(e, F.expr("dst div 100"), F.expr("src div 1000"))


@query(STEP_SQL + ", " + walk_sql(3, 0.15) + " SELECT query_id, node, round(m, 8) AS mass FROM x3 UNION ALL SELECT query_id + 100, node, round(m, 8) FROM x3")
def e17_walk_prior(spark, d):
    """Two queries with each set of seeds; the walk is taken once a set."""
    s = X.seeds(spark, d)
    twice = s.unionByName(s.select((F.col("query_id") + 100).alias("query_id"), "node"))
    edges = X.edges(spark, d)
    return P.prior_by_seed_set(twice, lambda own: G.random_walk(edges, own)).withColumn("mass", F.round("mass", 8))


@query(GRAPH + """, ends AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), p0 AS (SELECT DISTINCT query_id, node, [node] AS path FROM seeds),
  n1 AS (SELECT query_id, dst AS node, min(list_append(path, dst)) AS path FROM p0 JOIN ends ON node = src WHERE (query_id, dst) NOT IN (SELECT query_id, node FROM p0) GROUP BY ALL), p1 AS (FROM p0 UNION ALL FROM n1),
  n2 AS (SELECT query_id, dst AS node, min(list_append(path, dst)) AS path FROM n1 JOIN ends ON node = src WHERE (query_id, dst) NOT IN (SELECT query_id, node FROM p1) GROUP BY ALL)
  SELECT query_id, node, array_to_string(path, ' > ') AS path FROM (FROM p1 UNION ALL FROM n2)""")
def e19_shortest_paths(spark, d):
    p = P.shortest_paths(X.edges(spark, d), X.seeds(spark, d), 2)
    return p.select("query_id", "node", F.array_join("path", " > ").alias("path"))


@query(HOPS_SQL + ", g AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node) SELECT query_id, count(*) FILTER (hops <= 2) AS flood, round(avg((degree > 1)::INT) FILTER (hops = 0), 6) AS hub_share FROM h3 JOIN g USING (node) GROUP BY query_id")
def h23_flood(spark, d):
    """How many nodes two hops reach, and how many seeds have several edges."""
    e = X.edges(spark, d)
    h = G.hops(e, X.seeds(spark, d), 3).join(G.degrees(e), "node")
    hub = F.avg(F.when(F.col("hops") == 0, (F.col("degree") > 1).cast("int")))
    return h.groupBy("query_id").agg(F.count_if(F.col("hops") <= 2).alias("flood"), F.round(hub, 6).alias("hub_share"))


@query(VEC_SQL + """, m AS (SELECT kind, place, avg(x) AS mean FROM (SELECT kind, unnest(range(len(v))) AS place, unnest(v) AS x FROM v WHERE id % 2 = 0) GROUP BY ALL),
  f AS (SELECT kind, id, ln(1 + sum((x - mean) * (x - mean))) AS far FROM (SELECT kind, id, unnest(range(len(v))) AS place, unnest(v) AS x FROM v) JOIN m USING (kind, place) GROUP BY ALL),
  s AS (SELECT kind, avg(far) AS c, stddev_pop(far) AS s FROM f GROUP BY kind) SELECT kind, id, round(1 - 0.5 * (1 - 1 / (1 + exp(-(far - c) / (s + 1e-6)))), 5) AS gate FROM f JOIN s USING (kind)""")
def e27_information_gate(spark, d):
    """States far from the mean of the reference ones pass."""
    v = vectors(spark, d)
    return B.information_gate(v, v.where("id % 2 = 0")).withColumn("gate", F.round("gate", 5))


@query(GRAPH + """, ends AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), b0 AS (SELECT DISTINCT query_id, node, [node] AS path, 0.0::DOUBLE AS total FROM seeds),
  m1 AS (SELECT query_id, dst AS node, list_append(path, dst) AS path, total + 1.0::DOUBLE / (1 + length(dst)) AS total FROM b0 JOIN ends ON node = src),
  b1 AS (SELECT * FROM m1 QUALIFY row_number() OVER (PARTITION BY query_id, node ORDER BY round(total, 9) DESC, path) <= 2),
  m2 AS (SELECT query_id, dst AS node, list_append(path, dst) AS path, total + 1.0::DOUBLE / (2 + length(dst)) AS total FROM b1 JOIN ends ON node = src),
  b2 AS (SELECT * FROM m2 QUALIFY row_number() OVER (PARTITION BY query_id, node ORDER BY round(total, 9) DESC, path) <= 2) SELECT query_id, node, array_to_string(path, ' > ') AS path, round(total / 2, 6) AS weight FROM b2""")
def e30_beam_paths(spark, d):
    """The best two paths of two hops to each node, by mean edge weight."""
    near = G.both_ways(X.edges(spark, d)).distinct()
    layer = lambda i: near.select(F.lit(i).alias("layer"), "src", "dst", (1.0 / (i + F.length("dst"))).alias("w"))
    p = P.beam_paths(layer(1).unionByName(layer(2)), X.seeds(spark, d), 2, 2)
    return p.select("query_id", "node", F.array_join("path", " > ").alias("path"), F.round("weight", 6).alias("weight"))


HOP_ROWS = """h AS (SELECT o_orderkey AS k, o_custkey AS c, min(l_partkey) AS p, arg_min(l_suppkey, l_partkey * 100000 + l_suppkey) AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
hops AS (SELECT k AS path_id, 1 AS hop, '[customer] ' || c AS src, 'placed' AS rel, '[order] ' || k AS dst FROM h UNION ALL SELECT k, 2, '[order] ' || k, 'contains', '[part] ' || p FROM h
  UNION ALL SELECT k, 3, CASE WHEN k % 5 = 0 THEN '[part] 0' ELSE '[part] ' || p END, 'supplied_by', CASE WHEN k % 7 = 0 THEN '[customer] ' || c ELSE '[supplier] ' || s END FROM h)"""


def hop_rows(spark, d):
    """(path_id, hop, src, rel, dst): a path an order, from its customer to a supplier; some are broken or go back."""
    li = read_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("m"))
    h = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c")).join(li, "k").select("k", "c", F.col("m.l_partkey").alias("p"), F.col("m.l_suppkey").alias("s"))
    row = lambda hop, src, rel, dst: F.struct(F.lit(hop).alias("hop"), src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"))
    broken = F.when(F.col("k") % 5 == 0, "[part] 0").otherwise(named("part", "p"))
    last = F.when(F.col("k") % 7 == 0, named("customer", "c")).otherwise(named("supplier", "s"))
    three = F.array(row(1, named("customer", "c"), "placed", named("order", "k")), row(2, named("order", "k"), "contains", named("part", "p")), row(3, broken, "supplied_by", last))
    return h.select(F.col("k").alias("path_id"), F.explode(three).alias("x")).select("path_id", "x.*")


@query("WITH " + HOP_ROWS + """, o AS (SELECT *, lag(dst) OVER (PARTITION BY path_id ORDER BY hop) AS before FROM hops), n AS (SELECT path_id, unnest(CASE WHEN hop = 1 THEN [src, dst] ELSE [dst] END) AS node FROM hops),
  u AS (SELECT path_id, count(*) = count(DISTINCT node) AS simple FROM n GROUP BY path_id)
  SELECT path_id, count(*) AS n_hops, path_id % 3 <> 0 AS starts, bool_and(hop = 1 OR src = before) AS chains, simple FROM o JOIN u USING (path_id) GROUP BY path_id, simple""")
def e31_path_checks(spark, d):
    h = hop_rows(spark, d)
    seeds = h.where("hop = 1 AND path_id % 3 <> 0").select("path_id", F.col("src").alias("node"))
    return P.path_checks(h, seeds)


@query("WITH RECURSIVE " + X.EDGES_SQL + ", " + HOP_ROWS + """, i AS (SELECT src, rel, dst FROM edges UNION ALL SELECT dst, 'inverse_' || rel, src FROM edges), k AS (SELECT src, rel, dst, count(*) AS n FROM i GROUP BY ALL)
  SELECT path_id, bool_and(coalesce(n = 1, false)) AND path_id % 7 <> 0 AND path_id % 4 <> 0 AS resolved, count(DISTINCT hops.src) AS senders FROM hops LEFT JOIN k USING (src, rel, dst) GROUP BY path_id""")
def j31_resolved_paths(spark, d):
    """Paths whose hops are edges of the graph, to a supplier that is relevant; and their distinct senders."""
    h = materialize(hop_rows(spark, d), "hops")
    golds = h.where("hop = 3 AND path_id % 4 <> 0 AND path_id % 7 <> 0").select("path_id", F.col("dst").alias("node"))
    return P.resolved_paths(h, X.edges(spark, d), golds)


@query("WITH RECURSIVE " + X.EDGES_SQL + ", " + HOP_ROWS + ", w AS (SELECT src, dst, max(1.0::DOUBLE / length(rel)) AS w FROM edges WHERE rel <> 'placed' GROUP BY ALL) SELECT path_id, round(avg(coalesce(w, 0)), 6) AS weight FROM hops LEFT JOIN w USING (src, dst) GROUP BY path_id")
def e60_path_weights(spark, d):
    w = X.edges(spark, d).where("rel <> 'placed'").select("src", "dst", (1.0 / F.length("rel")).alias("w"))
    return P.path_weights(hop_rows(spark, d), w).withColumn("weight", F.round("weight", 6))


@query(GRAPH + """, raw AS (SELECT '[order] ' || l_orderkey AS src, 'contains' AS rel, '[part] ' || l_partkey AS dst FROM lineitem UNION ALL FROM edges UNION ALL SELECT DISTINCT src, 'loop', src FROM edges WHERE rel = 'in_region'),
  nodes AS (SELECT '[order] ' || o_orderkey AS node FROM orders UNION ALL SELECT '[part] ' || p_partkey FROM part UNION ALL SELECT '[customer] ' || c_custkey FROM customer UNION ALL SELECT '[nation] ' || n_nationkey FROM nation UNION ALL SELECT '[nation] ' || n_nationkey FROM nation WHERE n_nationkey < 3),
  golds AS (SELECT l_orderkey % 50 AS query_id, CASE WHEN l_quantity > 40 THEN '[part] x' ELSE '[part] ' || l_partkey END AS node FROM lineitem), ends AS (SELECT src AS node FROM raw UNION SELECT dst FROM raw), known AS (SELECT DISTINCT node FROM nodes),
  q AS (SELECT query_id, count(*) AS n, count(k.node) AS met FROM golds LEFT JOIN known k USING (node) GROUP BY query_id)
  SELECT 'nodes' AS check, count(*) AS n FROM nodes UNION ALL SELECT 'repeated_nodes', count(*) FROM (SELECT node FROM nodes GROUP BY node HAVING count(*) > 1) UNION ALL SELECT 'edges', count(*) FROM raw
  UNION ALL SELECT 'repeated_edges', count(*) FROM (SELECT 1 FROM raw GROUP BY src, rel, dst HAVING count(*) > 1) UNION ALL SELECT 'loops', count(*) FROM raw WHERE src = dst UNION ALL SELECT 'dangling', count(*) FROM ends WHERE node NOT IN (FROM known)
  UNION ALL SELECT 'isolated_documents', count(*) FROM known WHERE node LIKE '[order]%' AND node NOT IN (FROM ends) UNION ALL SELECT 'queries_without_gold', count(*) FROM q WHERE met = 0 UNION ALL SELECT 'queries_with_part', count(*) FROM q WHERE met > 0 AND met < n""")
def e33_full_audit(spark, d):
    """A graph with repeats and loops, without the nodes of suppliers and regions."""
    t = lambda name: read_table(spark, d, name)
    edges = X.edges(spark, d)
    raw = t("lineitem").select(named("order", "l_orderkey").alias("src"), F.lit("contains").alias("rel"), named("part", "l_partkey").alias("dst")).unionByName(edges)
    raw = materialize(raw.unionByName(edges.where("rel = 'in_region'").select("src", F.lit("loop").alias("rel"), F.col("src").alias("dst")).distinct()), "raw")
    nodes = t("orders").select(named("order", "o_orderkey").alias("node"))
    for more in (t("part").select(named("part", "p_partkey")), t("customer").select(named("customer", "c_custkey")), t("nation").select(named("nation", "n_nationkey")), t("nation").where("n_nationkey < 3").select(named("nation", "n_nationkey"))):
        nodes = nodes.unionAll(more)
    golds = t("lineitem").select((F.col("l_orderkey") % 50).alias("query_id"), F.when(F.col("l_quantity") > 40, "[part] x").otherwise(named("part", "l_partkey")).alias("node"))
    return B.audit(nodes, raw, golds, lambda c: node_type(c) == "order")


POLICY_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS policy, event_type, count(*) AS n, round(avg(g), 6) AS mean, count(*) FILTER (g < 1) AS suppressed, count(*) FILTER (g > 1) AS amplified, round(sum(greatest(1 - g, 0)), 4) AS suppression FROM (SELECT event_type, {rule} AS g FROM e) GROUP BY event_type"
    for name, rule in (
        ("off", "1.0::DOUBLE"), ("frozen", "v"), ("path_only", "CASE WHEN p THEN v ELSE 1 END"), ("outside_full", "CASE WHEN p THEN 1 ELSE v END"),
        ("outside_suppress", "CASE WHEN p THEN 1 ELSE least(v, 1) END"), ("outside_amplify", "CASE WHEN p THEN 1 ELSE greatest(v, 1) END"),
    )
)


@query("WITH e AS (SELECT event_type, 0.5 + (event_id % 11) / 10.0::DOUBLE AS v, user_id % 3 = 0 AS p FROM events) " + POLICY_SQL)
def j30_gate_policies(spark, d):
    """Gates under each counterfactual, and what they suppress and amplify."""
    e = read_table(spark, d, "events").select("event_type", (0.5 + (F.col("event_id") % 11) / 10.0).alias("v"), (F.col("user_id") % 3 == 0).alias("p"))
    names = ("off", "frozen", "path_only", "outside_full", "outside_suppress", "outside_amplify")
    rows = e.select("event_type", F.explode(F.array(*(F.struct(F.lit(n).alias("policy"), B.gate_policy(n, F.col("v"), F.col("p")).alias("g")) for n in names))).alias("x")).select("event_type", "x.*")
    g = F.col("g")
    return rows.groupBy("policy", "event_type").agg(F.count("*").alias("n"), F.round(F.avg(g), 6).alias("mean"), F.count_if(g < 1).alias("suppressed"), F.count_if(g > 1).alias("amplified"), F.round(F.sum(F.greatest(1 - g, F.lit(0.0))), 4).alias("suppression"))
