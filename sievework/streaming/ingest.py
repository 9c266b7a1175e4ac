"""Incremental ingestion with Structured Streaming: the same transformation as in batch, once for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import sized


def appended(spark: SparkSession, batch: DataFrame, path: str, key: tuple[str, ...] = ("channel", "msg_id")) -> None:
    """Appends the rows of a batch whose key isn't stored yet. Run again with the same batch, it adds nothing.

    Only the batch's keys are looked for in the stored ones. ``PostStore`` keeps clusters, index and counts as well.
    """
    fresh = batch.dropDuplicates(list(key))
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        stored = spark.read.schema(batch.schema).parquet(path).select(*key)
        known = stored.join(sized(fresh.select(*key)), list(key), "left_semi").distinct()
        fresh = fresh.join(sized(known), list(key), "left_anti")
    fresh.write.mode("append").parquet(path)


def ingest(stream: DataFrame, path: str, checkpoint: str, transform=lambda df: df, key: tuple[str, ...] = ("channel", "msg_id")):
    """A query that reads what is there, transforms it and appends new keys; offsets survive in ``checkpoint``."""
    def each(batch: DataFrame, _: int) -> None:
        appended(batch.sparkSession, transform(batch), path, key)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and the sum of their values in each window and type; works on streams and tables alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def new_since(posts: DataFrame, since: int) -> DataFrame:
    return posts.where(F.col("ts") > since)
