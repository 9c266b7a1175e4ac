"""Stored posts that grow by batches: posts, clusters, search index and counts change together or not at all.

A batch writes folders of its own: its new posts with the cluster each joins, the clusters it opens, how much
stored clusters grow, a segment of the index, and signed counts. One version then names them all, together with the
number of the stream's batch. A batch that is cut off anywhere left no version, and is done anew; one that came
through is passed over when the stream sends it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster as K
from ..operators import index as I
from ..operators.index import sized
from ..sources.versions import Version, Versions

#: Fixed value: posts of that value at least count in the histogram of tags.
TAG_VALUE = 4.0
#: Bytes of a row group of texts, so that a batch that came in one file is several tasks' work.
GROUP = 16_000_000


def numbered(rows: DataFrame, versions: Versions, first: int) -> DataFrame:
    """``rows`` with ids from ``first`` on, without gaps, in the order in which they lie in a folder written for it."""
    folder = versions.write("drafts", rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_turn")))
    rows = versions.spark.read.parquet(f"{versions.root}/{folder}")
    before, at = {}, first
    for r in rows.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():  # a row for each task that wrote
        before[r["_part"]] = at
        at += r["n"]
    starts = versions.spark.createDataFrame(list(before.items()), "_part int, _first long")
    return rows.join(F.broadcast(starts), "_part").withColumn("id", F.col("_first") + F.col("_turn")).drop("_part", "_turn", "_first")


def counted(posts: DataFrame, sign: int = 1) -> DataFrame:
    """kind, key, n: what ``posts`` add to each kept count (or take from it). One pass, summed before the shuffle."""
    shown = F.col("is_rep")
    one = lambda kind, key, cond: F.when(cond, F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key")))
    each = F.array(
        one("posts", F.lit(""), F.lit(True)), one("visible", F.lit(""), shown), one("category", F.col("category"), shown), one("channel", F.col("channel"), shown),
        one("month", F.substring("date", 1, 7), F.lit(True)), one("eligible", F.lit(""), (F.col("value") >= TAG_VALUE) & (F.length("text") >= 15)), one("merged", F.lit(""), ~shown))
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: one("tag", t, shown & (F.col("value") >= TAG_VALUE)))
    rows = posts.select(F.explode(F.filter(F.concat(each, tags), lambda x: x.isNotNull())).alias("c"))
    return rows.groupBy("c.kind", "c.key").agg((F.count("*") * sign).alias("n"))


class PostStore:
    """Posts (id, channel, msg_id, date, ts, text, category, tags, value, links, cluster_key, ...) below a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.versions = spark, Versions(spark, root)

    # --- writing ---

    def build(self, posts: DataFrame) -> Version:
        """The first posts, clustered as a whole; they have ids. Replaces nothing: the store is empty."""
        now = self.versions.current()
        if now.number:
            raise ValueError("the store has posts; append to it, or recluster it")
        drafts = self.spark.read.parquet(f"{self.versions.root}/{self.versions.write('drafts', posts, GROUP)}")
        folder = self.versions.write("posts", K.cluster(drafts, counted=True), GROUP)
        return self._commit(now, folder, {}, {})

    def append(self, batch: DataFrame, stream: str = "", number: int | None = None) -> int:
        """Adds the posts of a batch whose (channel, msg_id) isn't stored, as if they came one by one; how many it added.

        Posts without an id get the next ones. With ``number`` the batch counts once for its ``stream``, whatever
        happens in between. Null keys are keys like others; of a key's rows in one batch one stays.
        """
        now = self.versions.current()
        done = now.facts.get("batches", {})
        if number is not None and done.get(stream, -1) >= number:
            return 0
        key = [F.coalesce("channel", F.lit("")).alias("_c"), F.coalesce("msg_id", F.lit(-1)).cast("long").alias("_m")]
        # texts are written as they come and don't move: which rows stay is found by keys and the rows' numbers
        drafts = self.spark.read.parquet(f"{self.versions.root}/{self.versions.write('drafts', batch.withColumn('_row', F.monotonically_increasing_id()), GROUP)}")
        asked = drafts.select("_row", *key)
        kept = asked.groupBy("_c", "_m").agg(F.min("_row").alias("_row"))
        stored = self.versions.read(now, "posts")
        if stored is not None:
            # only the keys of the batch are looked for in the stored ones
            known = stored.select(*key).join(sized(kept.select("_c", "_m")), ["_c", "_m"], "left_semi").distinct()
            kept = kept.join(sized(known), ["_c", "_m"], "left_anti")
        # written, for what follows reads the batch several times
        gone = self.spark.read.parquet(f"{self.versions.root}/{self.versions.write('drafts', asked.select('_row').join(kept.select('_row'), '_row', 'left_anti'))}")
        fresh = (drafts if gone.isEmpty() else drafts.join(sized(gone), "_row", "left_anti")).drop("_row")
        if "id" not in batch.columns:
            fresh = numbered(fresh, self.versions, now.facts.get("next_id", 1))
        if fresh.isEmpty():
            if number is not None:
                self.versions.commit(now, {}, {"batches": done | {stream: number}})
            return 0
        owners = self.versions.read(now, "owners")
        if owners is None:
            owners = fresh.select("cluster_key", "id", "channel", F.lit(1).alias("cluster_size")).limit(0)
        else:
            few = sized(fresh.where("cluster_key is not null").select("cluster_key").distinct())
            grown = self.versions.read(now, "grown")
            owners = owners.join(few, "cluster_key", "left_semi").groupBy("cluster_key").agg(F.min_by(F.struct("id", "channel", "cluster_size"), "id").alias("o")).select("cluster_key", "o.*")
            if grown is not None:
                sums = grown.groupBy(F.col("id")).agg(F.sum("more").alias("more"))
                owners = owners.join(sums, "id", "left").withColumn("cluster_size", (F.col("cluster_size") + F.coalesce("more", F.lit(0))).cast("int")).drop("more")
        came = K.joined(owners.withColumn("is_rep", F.lit(True)), fresh)
        folder = self.versions.write("posts", came, GROUP)
        posts = self.spark.read.parquet(f"{self.versions.root}/{folder}")
        mine = posts.select(F.col("id").alias("rep_id"))
        more = posts.where("not is_rep").groupBy("rep_id").agg(F.count("*").alias("more")).join(mine, "rep_id", "left_anti").select(F.col("rep_id").alias("id"), "more")
        tables = {"grown": [*now.tables.get("grown", []), self.versions.write("grown", more)]}
        new = self._commit(now, folder, tables, {"batches": done | {stream: number}} if number is not None else {})
        return new.facts["stored"] - now.facts.get("stored", 0)

    def _commit(self, now: Version, folder: str, tables: dict, facts: dict) -> Version:
        """The version with one more folder of posts, its index segment, its clusters and its counts."""
        posts = self.spark.read.parquet(f"{self.versions.root}/{folder}")
        owners = posts.where("is_rep and cluster_key is not null").select("cluster_key", "id", "channel", "cluster_size")
        indexed, own = I.added(self.versions, now, posts)
        n, last = posts.agg(F.count("*"), F.max("id")).first()
        made = {"posts": folder, "owners": self.versions.write("owners", owners), "counts": self.versions.write("counts", counted(posts))}
        tables = tables | indexed | {k: [*now.tables.get(k, []), f] for k, f in made.items()}
        facts = facts | own | {"stored": now.facts.get("stored", 0) + n, "next_id": max(now.facts.get("next_id", 1), (last or 0) + 1)}
        return self.versions.commit(now, tables, facts)

    def recluster(self) -> Version:
        """Clusters all posts as a whole; counts change by what differs."""
        now = self.versions.current()
        before = self.posts(now)
        folder = self.versions.write("posts", K.cluster(before, counted=True))
        after = self.spark.read.parquet(f"{self.versions.root}/{folder}")
        delta = counted(after).unionByName(counted(before, -1)).groupBy("kind", "key").agg(F.sum("n").alias("n")).where("n <> 0")
        owners = after.where("is_rep and cluster_key is not null").select("cluster_key", "id", "channel", "cluster_size")
        tables = {"posts": [folder], "grown": [], "owners": [self.versions.write("owners", owners)], "counts": [*now.tables["counts"], self.versions.write("counts", delta)]}
        return self.versions.commit(now, tables, {})

    def compact(self) -> Version:
        """One folder for each table; what the posts, counts and ranks are doesn't change."""
        now = self.versions.current()
        tables, facts = I.compacted(self.versions, now)
        if now.tables.get("posts"):
            tables |= {"posts": [self.versions.write("posts", self.posts(now))], "counts": [self.versions.write("counts", self.counts(now))], "grown": []}
            rows = self.spark.read.parquet(f"{self.versions.root}/{tables['posts'][0]}")
            tables["owners"] = [self.versions.write("owners", rows.where("is_rep and cluster_key is not null").select("cluster_key", "id", "channel", "cluster_size"))]
        return self.versions.commit(now, tables, facts)

    def ingest(self, stream: DataFrame, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, name: str = "stream"):
        """A query that appends what is there, once each batch; offsets survive in ``checkpoint``."""
        def each(batch: DataFrame, number: int) -> None:
            self.append(transform(batch), name, number)

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    # --- reading ---

    def posts(self, now: Version | None = None) -> DataFrame:
        """All posts with the sizes that their clusters have now."""
        now = now or self.versions.current()
        rows, grown = self.versions.read(now, "posts"), self.versions.read(now, "grown")
        if rows is None or grown is None:
            return rows
        sums = grown.groupBy("id").agg(F.sum("more").alias("_more"))
        out = rows.join(sized(sums), "id", "left")
        return out.select(*(c if c != "cluster_size" else (F.col(c) + F.coalesce("_more", F.lit(0))).cast("int").alias(c) for c in rows.columns))

    def index(self, now: Version | None = None) -> I.Index:
        return I.view(self.versions, now)

    def counts(self, now: Version | None = None) -> DataFrame:
        """kind, key, n of all kept counts."""
        rows = self.versions.read(now or self.versions.current(), "counts")
        return rows.groupBy("kind", "key").agg(F.sum("n").alias("n")).where("n <> 0")

    def facet(self, kind: str, name: str, n: int | None = None) -> DataFrame:
        """``name``, n: keys of one kind of count; with ``n`` the most frequent ones."""
        rows = self.counts().where(F.col("kind") == kind).select(F.col("key").alias(name), "n")
        return rows if n is None else rows.orderBy(F.desc("n"), name).limit(n)

    def totals(self) -> DataFrame:
        """n, visible: one row."""
        own = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias("n" if k == "posts" else k)
        return self.versions.read(self.versions.current(), "counts").agg(own("posts"), own("visible"))
