"""Clusters of posts about one event."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import len16
from .index import sized


def cluster(posts: DataFrame, counted: bool = False) -> DataFrame:
    """``posts`` with rep_id, cluster_size, is_rep.

    Posts of one cluster_key in two channels at least form a cluster; the most valuable, then longest, then
    earliest (by id) is its representative. Every other post stands for itself. Keys are summed up first and
    joined back, so a hot key costs one row for each map task and a splittable join. Of posts that are stored, keys
    are counted first (``counted``), and texts move only if the keys are too many to broadcast.
    """
    base = posts.drop("rep_id", "cluster_size", "is_rep")
    best = F.max_by("id", F.struct("value", len16(F.col("text")).alias("n"), (-F.col("id")).alias("i")))
    keys = base.where("cluster_key is not null").groupBy("cluster_key").agg(best.alias("_rep"), F.count("*").alias("_n"), F.min("channel").alias("_a"), F.max("channel").alias("_b"))
    keys = keys.where("_a <> _b").select("cluster_key", "_rep", "_n")
    out = base.join(sized(keys) if counted else keys, "cluster_key", "left")
    return out.select(*base.columns, F.coalesce("_rep", "id").alias("rep_id"), F.coalesce("_n", F.lit(1)).cast("int").alias("cluster_size"), (F.coalesce("_rep", "id") == F.col("id")).alias("is_rep"))


def members(clustered: DataFrame, rep_id: int, limit: int = 50) -> DataFrame:
    return clustered.where(F.col("rep_id") == rep_id).orderBy(F.desc("value"), F.desc("ts"), "id").limit(limit)


def cluster_stats(clustered: DataFrame) -> DataFrame:
    """keyed rows, keys, merged rows, clusters: one row."""
    return clustered.agg(
        F.count("cluster_key").alias("keyed"), F.count_distinct("cluster_key").alias("keys"), F.count_if(~F.col("is_rep")).alias("merged"),
        F.count_if(F.col("is_rep") & (F.col("cluster_size") > 1)).alias("clusters"))


#: Parts of a key's posts that are numbered apart, so that a hot key isn't one task's work.
PARTS = 256


def joined(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """``batch`` with rep_id, cluster_size, is_rep as if its posts came one by one, in the order of their ids, on top of ``stored``.

    A post joins the representative that another channel has for its key: the first one, whose size grows by one,
    which is the post's own size for good. A post of the representatives' own channel, or without a key, stands
    for itself. All representatives of a key are of one channel, that of the first post, so each key's state is
    one row. Ids of the batch are larger than those stored. ``grown`` gives the stored representatives' new sizes.
    """
    new = batch.drop("rep_id", "cluster_size", "is_rep")
    keyed = new.where("cluster_key is not null").select("id", "cluster_key", "channel")
    old = stored.where("is_rep and cluster_key is not null").groupBy("cluster_key").agg(F.min_by(F.struct("id", "channel", "cluster_size"), "id").alias("old"))
    first = keyed.groupBy("cluster_key").agg(F.min_by(F.struct("id", "channel", F.lit(1).alias("cluster_size")), "id").alias("new"))
    owner = first.join(old, "cluster_key", "left").select("cluster_key", F.coalesce("old", "new").alias("_owner"))
    rows = keyed.join(owner, "cluster_key").withColumn("_joins", F.coalesce(F.col("channel") != F.col("_owner.channel"), F.lit(False)))
    span = new.agg(F.min("id").alias("_least"), F.max("id").alias("_most"))
    part = F.floor((F.col("id") - F.col("_least")) * PARTS / (F.col("_most") - F.col("_least") + 1)).cast("int")
    joins = rows.where("_joins").join(F.broadcast(span)).select("id", "cluster_key", "_owner", part.alias("_part"))
    sums = joins.groupBy("cluster_key", "_part").agg(F.count("*").alias("_n"))
    by_part = Window.partitionBy("cluster_key").orderBy("_part")
    # at most PARTS rows of a key
    sums = sums.select("cluster_key", "_part", (F.sum("_n").over(by_part) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("cluster_key", "_part").orderBy("id"))
    places = joins.withColumn("_place", place).join(sums, ["cluster_key", "_part"]).select("id", F.col("_owner.id").alias("_rep"), (F.col("_owner.cluster_size") + F.col("_before") + F.col("_place")).alias("_size"))
    totals = sums_of(rows).select(F.col("_rep").alias("id"), "_rep", (1 + F.col("_joined")).alias("_size"))
    # texts meet these rows by ids alone: by keys, all posts without one would be one task's work
    out = new.join(sized(places.unionByName(totals)), "id", "left")
    return out.select(*new.columns, F.coalesce("_rep", "id").alias("rep_id"), F.coalesce("_size", F.lit(1)).cast("int").alias("cluster_size"), (F.coalesce("_rep", "id") == F.col("id")).alias("is_rep"))


def sums_of(rows: DataFrame) -> DataFrame:
    return rows.where("_joins").groupBy(F.col("_owner.id").alias("_rep")).agg(F.count("*").alias("_joined"))


def grown(stored: DataFrame, came: DataFrame) -> DataFrame:
    """``stored`` with the sizes of representatives that posts of ``joined`` came to."""
    more = came.where("not is_rep").groupBy(F.col("rep_id").alias("_rep")).agg(F.count("*").alias("_more"))
    out = stored.join(more, F.col("id") == F.col("_rep"), "left")
    return out.select(*(c for c in stored.columns if c != "cluster_size"), (F.col("cluster_size") + F.coalesce("_more", F.lit(0))).cast("int").alias("cluster_size"))
