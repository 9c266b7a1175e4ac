"""Writers of exports, logs and snapshots."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT = re.compile(r"^[0-9T:-]+$")


def json_lines(posts: DataFrame, path: str) -> None:
    """All posts and the valuable ones, as ``clean`` and ``valuable``."""
    from ..functions.text import len16

    posts.write.mode("overwrite").json(f"{path}/clean")
    posts.where((F.col("content") >= 2) & (len16(F.col("text")) >= 10)).write.mode("overwrite").json(f"{path}/valuable")


def csv(rows: DataFrame, path: str) -> None:
    """Every cell quoted, quotes doubled."""
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def append_log(messages: DataFrame, path: str) -> None:
    """The live log, partitioned by month."""
    messages.withColumn("month", F.substring("date", 1, 7)).write.mode("append").partitionBy("month").json(path)


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _checked(name: str) -> str:
    if not SNAPSHOT.match(name):
        raise ValueError(f"not a snapshot's name: {name}")
    return name


def snapshot(tables: dict[str, DataFrame], root: str, name: str) -> None:
    """Copies of tables under ``root/name``."""
    for k, df in tables.items():
        df.write.parquet(f"{root}/{_checked(name)}/{k}")


def snapshots(spark: SparkSession, root: str) -> list[str]:
    fs, p = _files(spark, root)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def restored(spark: SparkSession, root: str, name: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{_checked(name)}/{table}")


def delete_snapshot(spark: SparkSession, root: str, name: str) -> bool:
    fs, p = _files(spark, f"{root}/{_checked(name)}")
    return fs.delete(p, True)
