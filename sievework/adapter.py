"""Posts made from the driver's tables, for queries and tests: a document is a post of its source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import normalize_text
from .functions.urls import cluster_key, domain_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, values, tags and links are arithmetic of the document's number, exact in any engine."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    tag = lambda k, name: F.when(n % k == 0, F.lit(name))
    tags = F.filter(F.array(tag(2, "免费"), tag(3, "限时"), tag(5, "风险"), tag(7, "开源")), lambda x: x.isNotNull())
    item = F.concat(F.lit("https://www.example.com/item/"), (n % 97).cast("string"), F.lit("?utm_source=a"))
    links = F.when(n % 4 == 0, F.array(item)).when(n % 9 == 0, F.array(F.concat(F.lit("https://github.com/a/"), (n % 11).cast("string")))).otherwise(F.array().cast("array<string>"))
    day = (n % 365).cast("int")
    return d.select(
        n.alias("id"), F.col("source").alias("channel"), n.alias("msg_id"), F.date_add(F.lit("2024-01-01").cast("date"), day).cast("string").alias("date"),
        (F.lit(1704067200) + day * 86400).cast("long").alias("ts"), F.col("n_chars").alias("views"), normalize_text(F.col("text")).alias("text"), F.col("lang").alias("category"),
        tags.alias("tags"), ((n * 7) % 21 * 0.5).alias("value"), ((n * 5) % 13 * 0.5).alias("content"), links.alias("links"),
        F.when(n % 10 == 0, "group").otherwise("channel").alias("source"), F.concat(F.lit("title "), F.col("source")).alias("group_title")).withColumn("cluster_key", cluster_key(F.col("links"))).withColumn("domains", F.transform("links", domain_of))


#: The same posts for the oracle: ``WITH`` clauses that a query's SQL begins with.
POSTS_SQL = r"""
posts AS (
  SELECT doc_id AS id, source AS channel, doc_id AS msg_id, CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS VARCHAR)[1:10] AS date,
    1704067200 + (doc_id % 365) * 86400 AS ts, n_chars AS views,
    regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \t\x{00a0}]+', ' ', 'g'), '\n{2,}', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text,
    lang AS category,
    list_filter([CASE WHEN doc_id % 2 = 0 THEN '免费' END, CASE WHEN doc_id % 3 = 0 THEN '限时' END, CASE WHEN doc_id % 5 = 0 THEN '风险' END, CASE WHEN doc_id % 7 = 0 THEN '开源' END], lambda x: x IS NOT NULL) AS tags,
    CAST((doc_id * 7) % 21 AS DOUBLE) * 0.5 AS value, CAST((doc_id * 5) % 13 AS DOUBLE) * 0.5 AS content,
    CASE WHEN doc_id % 4 = 0 THEN ['https://www.example.com/item/' || (doc_id % 97) || '?utm_source=a'] WHEN doc_id % 9 = 0 THEN ['https://github.com/a/' || (doc_id % 11)] ELSE [] END AS links,
    CASE WHEN doc_id % 4 = 0 THEN ['example.com'] WHEN doc_id % 9 = 0 THEN ['github.com'] ELSE [] END AS domains,
    CASE WHEN doc_id % 10 = 0 THEN 'group' ELSE 'channel' END AS source, 'title ' || source AS group_title,
    CASE WHEN doc_id % 4 = 0 THEN 'link:example.com/item/' || (doc_id % 97) WHEN doc_id % 9 = 0 THEN 'link:github.com/a/' || (doc_id % 11) END AS cluster_key
  FROM documents)
"""
