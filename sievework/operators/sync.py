"""A run over sources: which of them are synced, what of a batch is new, and the counts that are reported."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import sized

#: Fixed value: kinds of sources that can be read again.
SYNCABLE = ("channel", "web")


def syncable(sources: DataFrame) -> DataFrame:
    return sources.where(F.col("kind").isin(*SYNCABLE))


def from_group(chat: Column, bot: Column, text: Column) -> Column:
    """Whether a group's message is kept: from a person, of eight characters at least, and no command."""
    raw = F.trim(F.coalesce(text, F.lit("")))
    return chat.isin("group", "supergroup") & ~F.coalesce(bot, F.lit(False)) & (F.length(raw) >= 8) & ~F.startswith(raw, F.lit("/"))


def high_water(posts: DataFrame) -> DataFrame:
    """last_id, before a run: posts beyond it are the run's own. Zero for an empty table."""
    return posts.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("last_id"))


def counts(sources: DataFrame, incoming: DataFrame, stored: DataFrame, key: tuple[str, ...] = ("channel", "msg_id")) -> DataFrame:
    """channel, seen, added, duplicate of every syncable source, sources without messages too.

    A key that comes twice or is stored is added once at most. Keys alone are shuffled.
    """
    keys = incoming.groupBy(*key).agg(F.count("*").alias("n"))
    known = keys.join(stored.select(*key).distinct().withColumn("known", F.lit(1)), list(key), "left")
    each = known.groupBy("channel").agg(F.sum("n").alias("seen"), F.count_if(F.col("known").isNull()).alias("added"))
    rows = syncable(sources).select("channel").distinct().join(each, "channel", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.select("channel", zero("seen").alias("seen"), zero("added").alias("added"), zero(F.col("seen") - F.col("added")).alias("duplicate"))


def run(store, sources: DataFrame, incoming: DataFrame, key: str = "manual_sync", date: str = "", least: float = 7, most: int = 20) -> tuple[dict, DataFrame]:
    """One import into a ``PostStore``: the posts of syncable sources, what they came to, the new posts of much value, and a row of the run.

    Returns imported, skipped, scanned and sources, and the highlights (id, category, channel, date, value, title). A run
    of the same key and date replaces the row of the one before.
    """
    from .facets import highlights

    before = store.versions.current().facts.get("next_id", 1) - 1
    # texts aren't dealt by channels, of which there may be few
    mine = incoming.join(sized(syncable(sources).select("channel").distinct()), "channel", "left_semi")
    scanned = mine.count()
    imported = store.append(mine)
    came = {"imported": imported, "skipped": scanned - imported, "scanned": scanned, "sources": syncable(sources).count()}
    now = store.versions.current()
    row = store.spark.createDataFrame([(key, date, "done", now.number, json.dumps({k: came[k] for k in ("imported", "scanned", "sources")}))], "job_key string, run_date string, status string, number long, detail string")
    store.versions.commit(now, {"jobs": [*now.tables.get("jobs", []), store.versions.write("jobs", row)]}, {})
    best = highlights(store.posts(), before, most, least)
    return came, best.select("id", "category", "channel", "date", "value", F.substring(F.substring_index("text", "\n", 1), 1, 90).alias("title"))


def runs(store) -> DataFrame:
    """The last row of each job and date."""
    rows = store.versions.read(store.versions.current(), "jobs")
    return rows.groupBy("job_key", "run_date").agg(F.max_by(F.struct("status", "detail"), "number").alias("r")).select("job_key", "run_date", "r.*")


def resolved(inputs: DataFrame, posts: DataFrame, text_col: str = "input") -> DataFrame:
    """``inputs`` with what a pasted text is (kind, username, msg_id, url, host; null kind for none) and ``existing``: stored posts of that channel."""
    from ..functions.urls import parse_link

    link = parse_link(F.col(text_col))
    rows = inputs.select("*", *(link[c].alias(c) for c in ("kind", "username", "msg_id", "url", "host")))
    have = posts.groupBy(F.col("channel").alias("username")).agg(F.count("*").alias("existing"))
    return rows.join(have, "username", "left").withColumn("existing", F.when(F.col("kind") == "tme", F.coalesce("existing", F.lit(0))).otherwise(0).cast("long"))
