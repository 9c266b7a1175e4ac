"""Deduplication and build statistics of raw messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import len16
from .classify import not_spam


def dispositions(rows: DataFrame, order: list[Column], key: list[str] = ("channel", "msg_id"), text_col: str = "text", spam_col: str | None = "spam", least: int = 25) -> DataFrame:
    """``rows`` with disposition dup_id, dup_text, spam or clean.

    Of rows of one key the first in ``order`` counts; of those, longer texts than ``least`` the first of each
    text; spam is told apart last, so that a spam row still covers its copies. The first of each key and text
    is found by a partial aggregate (the smallest order), so a hot text isn't gathered anywhere.
    """
    digest = F.struct(F.xxhash64(text_col).alias("a"), F.crc32(F.col(text_col).cast("binary")).alias("b"), F.length(text_col).alias("n"))
    spam = ~not_spam(F.col(spam_col), F.col(text_col)) if spam_col else F.lit(False)
    # what the joins need of a text is taken before them, so that it moves only if it is asked for
    ordered = rows.withColumn("_seq", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).withColumn("_text", F.when(len16(F.col(text_col)) > least, digest)).withColumn("_spam", spam)
    firsts = ordered.groupBy(*key).agg(F.min("_seq").alias("_first"))
    marked = ordered.join(firsts, list(key)).withColumn("_dup_id", F.col("_seq") != F.col("_first")).drop("_first")
    marked = marked.withColumn("_text", F.when(~F.col("_dup_id"), F.col("_text")))
    texts = marked.where(F.col("_text").isNotNull()).groupBy("_text").agg(F.min("_seq").alias("_first"))
    told = marked.join(texts, "_text", "left").withColumn("_dup_text", F.col("_first").isNotNull() & (F.col("_seq") != F.col("_first")))
    kind = F.when(F.col("_dup_id"), "dup_id").when(F.col("_dup_text"), "dup_text").when(F.col("_spam"), "spam").otherwise("clean")
    return told.withColumn("disposition", kind).select(*rows.columns, "disposition")


def build_stats(marked: DataFrame) -> DataFrame:
    """raw, dup_id, dup_text, spam, clean of each channel."""
    counts = [F.count_if(F.col("disposition") == d).alias(d) for d in ("dup_id", "dup_text", "spam", "clean")]
    return marked.groupBy("channel").agg(F.count("*").alias("raw"), *counts)


def last_writer(rows: DataFrame, key: list[str], at: str) -> DataFrame:
    """The newest row of each key: overlays are append-only tables read through this."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), F.col(at)).alias("r")).select("r.*")


def first_per_key(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")
