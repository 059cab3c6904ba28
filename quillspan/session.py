"""Session settings, the shared folder, and tables that cut a plan's lineage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

# Only for sessions that name no shared folder, such as tests on one machine.
LOCAL_SHARED = "/tmp/checkpoints/quillspan"


#: The most buckets that Spark lets a table have by default.
MAX_BUCKETS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = LOCAL_SHARED
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/quillspan-scratch/{name}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def tidy(spark: SparkSession):
    """What is written within leaves no shuffle files behind; for tables that nothing but what was written is read of."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def apart(spark: SparkSession):
    """Tables of one partition that are united within keep a task each."""
    return setting(spark, "spark.sql.unionOutputPartitioning", "false")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The plan starts anew at the written files, so a lost executor costs no more than
    the tasks that read them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """``materialize`` into ``buckets`` buckets by ``column``: joins on it with tables that have as many need no exchange.

    Each task writes a file for each bucket that it has rows of. A table that isn't dealt
    out by ``repartition(buckets, column)`` before should have few values of it in a task.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = "quillspan_" + path.rsplit("-", 1)[1]
    df.write.bucketBy(buckets, column).sortBy(column).option("path", path).saveAsTable(table)
    return spark.table(table)


def release(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` or ``bucketed`` wrote and that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/quillspan-scratch/" not in folder:
            raise ValueError(f"{folder} is no scratch table")
        spark.sql(f"DROP TABLE IF EXISTS quillspan_{folder.rsplit('-', 1)[1]}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean_scratch(spark: SparkSession) -> None:
    """Delete every table that ``materialize`` and ``bucketed`` wrote; for use between jobs."""
    for table in spark.catalog.listTables():
        if table.name.startswith("quillspan_"):
            spark.sql(f"DROP TABLE IF EXISTS {table.name}")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quillspan-scratch")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``. From here on, Python workers find this package."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
