"""Streaming jobs over events, each with a batch equal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.session import read_table, scratch_path


def tumbling_counts(events: DataFrame) -> DataFrame:
    """(day, event_type, n, total): the same plan over a table and over a stream."""
    by = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        by = by.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["event_id"])
    counts = by.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def run_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run the counts as a stream over the table's files to their end; rows of the last state."""
    schema = read_table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", "events*").load(sf_dir)
    name = f"counts_{uuid.uuid4().hex}"
    job = tumbling_counts(stream).writeStream.outputMode("complete").format("memory").queryName(name)
    running = job.option("checkpointLocation", scratch_path(spark, "stream")).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(name)


def merge_batch(target: str, keys: list[str]):
    """A ``foreachBatch`` function that appends rows whose keys the table doesn't have yet."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        if spark.catalog.tableExists(target):
            new = new.join(spark.table(target), keys, "left_anti")
        new.write.mode("append").saveAsTable(target)

    return add
