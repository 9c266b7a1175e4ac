"""Sharding by balanced label propagation.

Documents with equal texts form one node, weighted by their number. Nodes are linked through the lines they
share: a line is a hub, so a line of many documents costs one row for each of them and never a pair.

Families come first: the smallest name spreads from node to node over hubs that a shard has room for, and families
are laid side by side, each with its nearest relatives together; equal shares of that row are the first labels. Then
labels propagate between shards: in each round a hub takes the label that weighs most among its nodes and a node
wants the label that most of its hubs have; so many moves are let through as the wanted shard has room for. The law
``rows`` is then exact: documents are numbered in the order of label, family, anchor and text, and equal shares of
that order are the shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import Scratch

BUCKETS = 64
#: Rounds in which names spread over a family; hubs apart by so many steps or fewer are one family.
SPREAD = 4


def propagate(scratch: Scratch, nodes: DataFrame, links: DataFrame, shards: int, rounds: int, slack: float) -> DataFrame:
    """``nodes`` (node, weight, label) with labels moved along ``links`` (node, hub) under quotas."""
    total = nodes.agg(F.sum("weight")).first()[0] or 0
    quota = (1 + slack) * total / shards
    for r in range(rounds):
        at = links.join(nodes, "node")
        votes = at.groupBy("hub", "label").agg(F.sum("weight").alias("votes"))
        hubs = scratch.keep(votes.groupBy("hub").agg(F.max(F.struct("votes", "label")).alias("b")).select("hub", F.col("b.label").alias("hub_label"), F.col("b.votes").alias("votes")), "hubs")
        # a hub that few share says more than one that many share
        calls = links.join(hubs, "hub").groupBy("node", "hub_label").agg(F.sum(1 / F.log2(F.col("votes") + 2)).alias("pull"))
        wants = calls.groupBy("node").agg(F.max(F.struct("pull", "hub_label")).alias("b")).select("node", F.col("b.hub_label").alias("want"))
        wanted = scratch.keep(nodes.join(wants, "node", "left").withColumn("want", F.coalesce("want", "label")), "wants")
        # two sums for each shard: at most 2 * shards rows
        room = wanted.groupBy("label").agg(F.sum("weight").alias("load")).join(
            wanted.where("want <> label").groupBy(F.col("want").alias("label")).agg(F.sum("weight").alias("asked")), "label", "full")
        share = F.greatest(F.lit(0.0), F.lit(quota) - F.coalesce("load", F.lit(0))) / F.greatest(F.coalesce("asked", F.lit(0)), F.lit(1))
        chance = room.select(F.col("label").alias("want"), share.alias("chance"))
        draw = F.pmod(F.xxhash64("node", F.lit(r)), F.lit(1 << 20)) / F.lit(float(1 << 20))
        moved = wanted.join(F.broadcast(chance), "want", "left")
        goes = (F.col("want") != F.col("label")) & (draw < F.col("chance")) & (F.col("weight") <= quota / 8)
        old = nodes
        nodes = scratch.keep(moved.select("node", "weight", F.when(goes, F.col("want")).otherwise(F.col("label")).alias("label")), "nodes")
        scratch.drop(hubs, wanted, *([old] if r else []))
    return nodes


def families(scratch: Scratch, nodes: DataFrame, links: DataFrame, rounds: int = SPREAD) -> DataFrame:
    """``nodes`` (node, weight, anchor) with ``family``: the smallest anchor within ``rounds`` steps over ``links`` (node, hub)."""
    own = nodes.withColumn("family", F.col("anchor"))
    for r in range(rounds):
        least = links.join(own.select("node", "family"), "node").groupBy("hub").agg(F.min("family").alias("near"))
        near = links.join(least, "hub").groupBy("node").agg(F.min("near").alias("near"))
        old, own = own, scratch.keep(own.join(near, "node", "left").withColumn("family", F.least("family", F.coalesce("near", "family"))).drop("near"), "families")
        if r:
            scratch.drop(old)
    return own


def in_order(rows: DataFrame, first: list[str], total: int, shards: int, most: int) -> DataFrame:
    """``rows`` (node, family, anchor, id, of_family, of_node) with ``place``, their number in the order of ``first``, family, anchor and node.

    Families lie in hashed buckets, those of more rows than a bucket should hold in parts by anchor, and copies of a
    text that are more in parts by id: at most shards * BUCKETS buckets and as many parts again, whatever the number of rows.
    """
    large = F.col("of_family") > most
    key = [*first, "bucket", "part", "salt"]
    at = rows.withColumn("bucket", F.when(large, F.lit(-1)).otherwise(F.pmod(F.xxhash64("family", F.lit(1)), F.lit(shards * BUCKETS))).cast("long"))
    at = at.withColumn("bucket", F.when(large, F.col("family")).otherwise(F.col("bucket")))
    at = at.withColumn("part", F.when(large, F.pmod(F.xxhash64("anchor"), F.ceil(F.col("of_family") / most))).otherwise(F.lit(-1)).cast("long"))
    at = at.withColumn("salt", F.when(F.col("of_node") > most, F.pmod(F.xxhash64("id"), F.ceil(F.col("of_node") / most))).otherwise(F.lit(-1)).cast("long"))
    counts = at.groupBy(*key).agg(F.count("*").alias("n"))
    before = counts.select(*key, F.coalesce(F.sum("n").over(Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy(*key).orderBy("family", "anchor", "node", "id")) - 1
    return at.withColumn("row", number).join(F.broadcast(before), key).withColumn("place", F.col("before") + F.col("row")).drop("bucket", "part", "salt", "row", "before")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, rounds: int = 3, slack: float = 0.1) -> DataFrame:
    """``id_col``, size, text_crc32, law ``rows``, shard, slot, grown_shard (null) of every row.

    Counts of the shards differ by one at most. A null text counts as empty and holds no bytes. Equal texts
    stay together but where the end of a shard cuts them or they are more than a shard holds; repeated rows and null
    ids are rows; equal keys of the order are settled by the id. Very long texts and lines of any length take part. Extra columns are left out. No rows give no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    scratch = Scratch(docs.sparkSession, "sharding")
    rows = scratch.keep(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("node")), "rows")
    lines = F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: x != ""), lambda x: F.xxhash64(x)))
    pairs = scratch.keep(docs.select(F.xxhash64(text).alias("node"), F.explode(lines).alias("hub")).distinct(), "lines")
    total = rows.count()
    most = max(1, total // (shards * BUCKETS))
    weights = scratch.keep(rows.groupBy("node").agg(F.count("*").alias("weight")), "weights")
    shared = scratch.keep(pairs.groupBy("hub").agg(F.count("*").alias("degree")).where("degree > 1"), "shared")
    links = scratch.keep(pairs.join(shared, "hub"), "links")
    scratch.drop(pairs)
    # hubs of a family are those that a quarter of a shard holds; the anchor of a node is its least shared one, else itself
    close = links.where(F.col("degree") <= max(16, total // (4 * shards)))
    anchors = close.groupBy("node").agg(F.min(F.struct("degree", "hub")).alias("h")).select("node", F.col("h.hub").alias("hub"))
    nodes = scratch.keep(weights.join(anchors, "node", "left").select("node", "weight", F.coalesce("hub", "node").alias("anchor")), "anchors")
    named = families(scratch, nodes, close.select("node", "hub"))
    sums = scratch.keep(named.groupBy("family").agg(F.sum("weight").alias("of_family")), "sums")
    named = scratch.keep(named.join(sums, "family").withColumnRenamed("weight", "of_node"), "named")
    at = rows.select("id", "node").join(named, "node")
    first = in_order(at, [], total, shards, most).groupBy("node").agg(F.count("*").alias("weight"), F.min(F.expr(f"cast((place * {shards}) div {max(1, total)} as int)")).alias("label"))
    labels = propagate(scratch, scratch.keep(first, "start"), links.select("node", "hub"), shards, rounds, slack)
    placed = rows.join(scratch.keep(named.join(labels.select("node", "label"), "node"), "placed"), "node")
    exact = in_order(placed, ["label"], total, shards, most).withColumn("shard", F.expr(f"cast((place * {shards}) div {max(1, total)} as int)"))
    slot = F.expr(f"place - ((cast(shard as bigint) * {total} + {shards - 1}) div {shards})")
    return exact.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
