"""Readers and writers of the file formats of corpora, queries, graphs and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERY_ROWS = "id string, question string, answer string, supporting_documents array<string>, stratum string"
NODES = "name string, type string, attributes string"
EDGES = "source string, relation string, target string, attributes string"
RUN_ROWS = "id string, stratum string, supporting_documents array<string>, predictions struct<document: array<array<string>>>"
AFFORDANCES = (
    "id string, affordance struct<task: array<string>, domain: string, task_limitations: array<string>, findings: array<string>, "
    "contributions: array<struct<name: string, achieves: array<string>, overcomes: array<string>, mechanism: array<string>, builds_on: array<string>>>>"
)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, pos, text) of a JSON object from ids to texts; ``pos`` is the order of the keys."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return whole.select(F.posexplode(F.map_entries("m")).alias("pos", "e")).select(F.col("e.key").alias("doc_id"), F.col("pos").cast("long"), F.col("e.value").alias("text"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON array of queries; further fields are not read."""
    return spark.read.schema(QUERY_ROWS).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank and malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of CSV with a header; ``NA`` and ``None`` stay text, and a wrong number of columns fails."""
    return spark.read.schema(schema).options(header=True, quote='"', escape='"', multiLine=True, mode="FAILFAST", emptyValue="").csv(path)


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """``df``, or an error if a key repeats."""
    n, distinct = df.agg(F.count(key), F.count_distinct(key)).first()
    if n != distinct:
        raise ValueError(f"{n - distinct} rows repeat an earlier {key}")
    return df


def qrels_of(queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, gold_pos) of the nested lists, in their order, repeats left out."""
    return queries.select(F.col("id").alias("query_id"), F.posexplode(F.array_distinct("supporting_documents")).alias("gold_pos", "doc_id")).select("query_id", "doc_id", "gold_pos")


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, rank, doc_id, score) of predictions as lists of ids, or of pairs of id and score."""
    rows = spark.read.schema("id string, predictions string").option("multiLine", True).json(path)
    inner = F.coalesce(F.get_json_object("predictions", "$.document"), F.col("predictions"))
    each = rows.select(F.col("id").alias("query_id"), F.posexplode(F.from_json(inner, "array<string>")).alias("pos", "e"))
    pair = F.from_json("e", "array<string>")
    is_pair = F.col("e").startswith("[")
    return each.select("query_id", (F.col("pos") + 1).alias("rank"), F.when(is_pair, pair[0]).otherwise(F.col("e")).alias("doc_id"), F.when(is_pair, F.try_element_at(pair, F.lit(2)).cast("double")).alias("score"))


def write_run(run: DataFrame, path: str, k: int = 300) -> None:
    """One JSON line a query, with its first ``k`` documents in order."""
    top = run.where(F.col("rank") <= k).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("document"))
    top.select(F.col("query_id").alias("id"), F.struct("document").alias("predictions")).write.mode("overwrite").json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Folders ``nodes``, ``edges`` and ``relations`` of CSV, sorted."""
    for name, df in (("nodes", nodes), ("edges", edges), ("relations", edges.select(F.col("relation").alias("name")).distinct())):
        df.sort(*df.columns).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path of any store that Spark reads."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path)


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the table at ``path`` doesn't have; a job that is run again adds nothing twice."""
    spark = df.sparkSession
    if exists(spark, path):
        df = df.join(spark.read.parquet(path).select(key), key, "left_anti")
    df.dropDuplicates([key]).write.mode("append").parquet(path)


def ensure_table(spark: SparkSession, path: str, build, *, force: bool = False) -> DataFrame:
    """The table at ``path``; ``build`` makes it if it isn't there, or if forced."""
    if force or not exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_array(rows: DataFrame, path: str) -> None:
    """One JSON array of all rows, for readers of small exports; the rows of one file come together in one task."""
    line = F.to_json(F.struct(*rows.columns))
    rows.select(line.alias("line")).coalesce(1).groupBy().agg(F.concat(F.lit("["), F.array_join(F.collect_list("line"), ","), F.lit("]")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def export(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write every table under its name, and return the manifest (name, n_rows), which is written last."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    counts = [spark.read.parquet(f"{path}/{name}").agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows") for name in tables]
    manifest = counts[0]
    for c in counts[1:]:
        manifest = manifest.unionByName(c)
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, n_bytes, sha256) of files, for comparison with a manifest."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def affordance_edges(records: DataFrame) -> DataFrame:
    """(src, rel, dst) of nested records: one branch of explodes for each relation."""
    a = records.select(F.col("id").alias("doc"), "affordance.*")
    # Generators must stand alone, so that names are made before arrays are exploded.
    name = lambda kind, c: F.concat(F.lit(f"[{kind}] "), F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")))
    listed = lambda c, rel, kind: a.select(F.col("doc").alias("src"), F.lit(rel).alias("rel"), F.explode(F.transform(c, lambda x: name(kind, x))).alias("dst"))
    own = a.select("doc", F.explode("contributions").alias("c"))
    method = name("method", F.col("c.name"))
    inner = lambda c, rel, kind: own.select("c", F.explode(f"c.{c}").alias("x")).select(method.alias("src"), F.lit(rel).alias("rel"), name(kind, F.col("x")).alias("dst"))
    parts = [
        listed("task", "addresses", "task"),
        listed("task_limitations", "limited_by", "limitation"),
        listed(F.transform("findings", lambda x: F.substring(x, 1, 70)), "reports", "finding"),
        a.where("domain IS NOT NULL").select(F.col("doc").alias("src"), F.lit("in_field").alias("rel"), name("domain", F.col("domain")).alias("dst")),
        own.select(F.col("doc").alias("src"), F.lit("contributes").alias("rel"), method.alias("dst")),
        inner("achieves", "achieves", "function"),
        inner("overcomes", "overcomes", "limitation"),
        inner("mechanism", "works_via", "mechanism"),
        inner("builds_on", "builds_on", "method"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("src IS NOT NULL AND dst IS NOT NULL").distinct()
