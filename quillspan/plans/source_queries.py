"""Queries that write a file format to the shared folder and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators.staging import cached_vectors
from quillspan.plans import fixtures as X
from quillspan.plans.rank_queries import DENSE
from quillspan.plans.registry import query
from quillspan.session import read_table, scratch_path
from quillspan.sources import files as S


@query("SELECT item_id::VARCHAR AS doc_id, row_number() OVER (ORDER BY item_id) - 1 AS pos, sha256(text) AS digest FROM benchmark")
def a01_corpus_object(spark, d):
    """A JSON object from ids to texts."""
    path = scratch_path(spark, "corpus")
    b = read_table(spark, d, "benchmark").agg(F.array_sort(F.collect_list(F.struct("item_id", "text"))).alias("xs"))
    whole = F.map_from_entries(F.transform("xs", lambda x: F.struct(x["item_id"].cast("string"), x["text"])))
    b.select(F.to_json(whole).alias("value")).write.text(path)
    return S.read_corpus(spark, f"{path}/part-*").select("doc_id", "pos", F.sha2("text", 256).alias("digest"))


QUERY_TABLE = "SELECT conv_id::VARCHAR AS id, min(text) FILTER (role = 'user') AS question, list_sort(list(DISTINCT turn::VARCHAR)) AS docs FROM conversations GROUP BY conv_id"


def written_queries(spark, d):
    path = scratch_path(spark, "queries")
    c = read_table(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("id")).agg(F.min(F.when(F.col("role") == "user", F.col("text"))).alias("question"), F.array_sort(F.collect_set(F.col("turn").cast("string"))).alias("supporting_documents"))
    S.write_array(c.withColumn("quartet", F.lit("not read")), path)
    return S.read_queries(spark, f"{path}/part-*")


@query(f"SELECT id, sha256(coalesce(question, '')) AS question, len(docs) AS n_docs FROM ({QUERY_TABLE})")
def a02_export(spark, d):
    """A JSON array of queries with a further field."""
    return written_queries(spark, d).select("id", F.sha2(F.coalesce("question", F.lit("")), 256).alias("question"), F.size("supporting_documents").cast("long").alias("n_docs"))


@query(f"SELECT id AS query_id, unnest(docs) AS doc_id, unnest(range(len(docs))) AS gold_pos FROM ({QUERY_TABLE})")
def a03_loader_rows(spark, d):
    """The relevance rows of nested lists."""
    return S.qrels_of(written_queries(spark, d)).withColumn("gold_pos", F.col("gold_pos").cast("long"))


@query("SELECT conv_id * 100 + turn AS uid, sha256(text) AS digest, role FROM conversations")
def a04_node_csv(spark, d):
    """CSV with line breaks, quotes and commas inside fields, and a key that doesn't repeat."""
    path = scratch_path(spark, "nodes")
    c = read_table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("uid"), "text", "role")
    c.write.options(header=True, quote='"', escape='"', quoteAll=True).csv(path)
    rows = S.require_unique(S.read_csv(spark, path, "uid long, text string, role string"), "uid")
    return rows.select("uid", F.sha2("text", 256).alias("digest"), "role")


@query("WITH RECURSIVE " + X.EDGES_SQL + "SELECT src AS source, rel AS relation, dst AS target FROM edges")
def a09_graph_files(spark, d):
    """A graph's folders of CSV; what its edges read as."""
    path = scratch_path(spark, "graph")
    e = X.edges(spark, d).select(F.col("src").alias("source"), F.col("rel").alias("relation"), F.col("dst").alias("target"))
    S.write_graph(e.select(F.col("source").alias("name")).distinct(), e, path)
    return S.read_csv(spark, f"{path}/edges", "source string, relation string, target string")


@query("SELECT event_id, event_type, value FROM events WHERE event_id % 7 <> 0")
def a06_json_lines(spark, d):
    """JSON lines among blank and broken ones."""
    path = scratch_path(spark, "lines")
    e = read_table(spark, d, "events")
    good = F.to_json(F.struct("event_id", "event_type", "value"))
    e.select(F.when(F.col("event_id") % 7 != 0, good).when(F.col("event_id") % 2 == 0, "").otherwise(F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "event'))).alias("line")).write.text(path)
    return S.read_jsonl(spark, path, "event_id long, event_type string, value double")


@query("SELECT o_orderkey, o_custkey FROM orders")
def a07_resumed_sink(spark, d):
    """A sink that a job was cut off from and run again."""
    path = scratch_path(spark, "sink")
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey")
    S.append_new(o.where("o_custkey > 40"), path, "o_orderkey")
    S.append_new(o, path, "o_orderkey")
    return spark.read.parquet(path)


@query(DENSE + " SELECT query_id::VARCHAR AS query_id, rank, doc_id::VARCHAR AS doc_id, round(score, 6) AS score FROM run WHERE rank <= 20")
def a10_run_files(spark, d):
    """A run as lists of pairs, written and read."""
    path = scratch_path(spark, "run")
    run = X.dense_run(spark, d, 20)
    lists = run.groupBy(F.col("query_id").cast("string").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("x"))
    pairs = F.transform("x", lambda p: F.array(p["doc_id"].cast("string"), p["score"].cast("string")))
    S.write_array(lists.select("id", F.struct(pairs.alias("document")).alias("predictions")), path)
    return S.read_run(spark, f"{path}/part-*").withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT sha256(string_agg(n_name || chr(10), '' ORDER BY n_nationkey)) AS sha256, sum(length(n_name) + 1)::BIGINT AS n_bytes FROM nation")
def a12_file_digests(spark, d):
    """A file's size and digest, for comparison with a manifest."""
    path = scratch_path(spark, "file")
    read_table(spark, d, "nation").orderBy("n_nationkey").coalesce(1).sortWithinPartitions("n_nationkey").select("n_name").write.text(path)
    return S.digests(spark, f"{path}/part-*").select("sha256", "n_bytes")


@query("SELECT 'documents' AS name, count(*) AS n_rows FROM documents UNION ALL SELECT 'eval', count(*) FROM benchmark UNION ALL SELECT 'eval_primary', count(*) FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT 'sets', count(*) FROM (SELECT DISTINCT conv_id, role FROM conversations)")
def a13_export(spark, d):
    """All shapes of an export from one job, and its manifest."""
    b = read_table(spark, d, "benchmark")
    tables = {"documents": read_table(spark, d, "documents").select("doc_id", "text"), "eval": b, "eval_primary": b.where("item_id % 2 = 0"), "sets": read_table(spark, d, "conversations").select("conv_id", "role").distinct()}
    return S.export(spark, tables, scratch_path(spark, "export"))


def lengths(texts):
    """(text, v): how many words of each length modulo 12 a text has; stands for a model in tests."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return texts.select("text", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.size(F.filter(words, lambda w: F.length(w) % 12 == i)).cast("double")).alias("v"))


@query("""WITH w AS (SELECT item_id, unnest(range(12)) AS i, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM benchmark), v AS (SELECT item_id, i, len(list_filter(ws, lambda w: length(w) % 12 = i))::DOUBLE AS x FROM w WHERE i < 8),
  n AS (SELECT item_id, greatest(sqrt(sum(x * x)), 1e-12) AS z FROM v GROUP BY item_id) SELECT item_id, string_agg(round(x / z, 4)::VARCHAR, ',' ORDER BY i) AS v FROM v JOIN n USING (item_id) GROUP BY item_id""")
def a16_cached_vectors(spark, d):
    """Vectors of distinct texts, in two calls of which the second finds a part stored."""
    b, path = read_table(spark, d, "benchmark"), scratch_path(spark, "vectors")
    cached_vectors(b.where("item_id % 2 = 0").select("text"), lengths, path, dims=8)
    v = cached_vectors(b.select("text"), lengths, path, dims=8)
    return b.join(v, "text").select("item_id", F.array_join(F.transform("v", lambda x: F.round(x, 4).cast("string")), ",").alias("v"))


@query("SELECT l_partkey AS src, l_suppkey AS dst, count(*) AS n FROM lineitem GROUP BY ALL")
def a17_indexer(spark, d):
    """A graph that is built once, found by the next call, and built anew if forced."""
    path, built = scratch_path(spark, "index"), []

    def build():
        built.append(1)
        return read_table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.count("*").alias("n"))

    S.ensure_table(spark, path, build)
    S.ensure_table(spark, path, build, force=True)
    out = S.ensure_table(spark, path, build)
    if len(built) != 2:
        raise RuntimeError(f"the table was built {len(built)} times")
    return out
