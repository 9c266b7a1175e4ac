"""Readers of raw and live messages, lists and update logs."""

from __future__ import annotations

import importlib
import json
import re

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.html import MESSAGE

LIVE = "channel string, msgId long, date string, ts long, views long, text string, category string, categories string, tags string, hashtags string, value double, content double, url string, links string, domains string, lpTitle string, source string, author string, groupTitle string"
#: Fixed value: words of lines whose sources aren't wanted.
SKIP_WORDS = ("色情", "博彩", "赌博", "成人", "约炮", "porn", "sex", "赌", "彩票", "招嫖", "洗钱", "跑分")


def numbered_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """value, file, line: the lines of text files with their numbers from 1, however the files are split.

    Lines of one split follow each other in one task, and the splits' numbers of lines are summed first: a row for
    each split, and no shuffle of lines.
    """
    reader = spark.read
    for k, v in options.items():
        reader = reader.option(k, v)
    rows = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    splits = rows.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("file", "_block", (before - F.col("_first") + 1).alias("_start"))
    # few bytes for each split of 128 MB
    return rows.join(F.broadcast(starts), ["file", "_block"]).select("value", "file", (F.col("_start") + F.col("_at")).alias("line"))


def raw_messages(spark: SparkSession, path: str) -> DataFrame:
    """Raw messages (JSON lines, a folder for each channel), with channel, file and line; unreadable rows are left out."""
    rows = numbered_lines(spark, path, recursiveFileLookup="true", pathGlobFilter="*.jsonl")
    rows = rows.select(F.from_json("value", f"{MESSAGE}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("m"), F.element_at(F.split("file", "/"), -2).alias("channel"), "file", "line")
    return rows.select("m.*", "channel", "file", "line").where(F.col("_bad").isNull() & F.col("i").isNotNull() & ~F.startswith("channel", F.lit("_"))).drop("_bad")


def tailed(spark: SparkSession, path: str, schema: str, files: int = 0, size: str = "", kind: str = "json", **options) -> DataFrame:
    """A stream over a folder of files, of which a trigger takes at most so many ``files``, or of about ``size`` ("1g"); what is left comes next."""
    reader = spark.readStream.schema(schema)
    limits = {"maxFilesPerTrigger": files} if files else {"maxBytesPerTrigger": size} if size else {}
    for k, v in (limits | options).items():
        reader = reader.option(k, v)
    return reader.format(kind).load(path)


def live_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages of the live log that have a channel and a number, with lists split."""
    rows = spark.read.schema(LIVE).option("recursiveFileLookup", "true").json(path).where("channel is not null and msgId is not null")
    for c, by in (("categories", ","), ("tags", ","), ("hashtags", ","), ("links", r"\s+"), ("domains", r"\s+")):
        rows = rows.withColumn(c, listed(F.col(c), by))
    return rows


def listed(c, by: str = ","):
    """Elements of a delimited text, none empty; null gives none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), by), lambda x: x != "")


def channel_order(rows: DataFrame, priority: list[str]) -> DataFrame:
    """``rows`` with input_order: preferred channels first, then by channel, file and line."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.col("channel")) if priority else F.lit(0)
    return rows.withColumn("input_order", F.struct(F.when(place > 0, place).otherwise(99).alias("p"), "channel", "file", "line"))


def listed_sources(spark: SparkSession, path: str) -> DataFrame:
    """handle, line of curated lists: the first line of each handle, without lines that name no channel."""
    rows = numbered_lines(spark, path)
    for w in SKIP_WORDS:
        rows = rows.where(~F.contains(F.lower("value"), F.lit(w)))
    handles = F.regexp_extract_all("value", F.lit(r"(?:t\.me/(?:s/)?|@)([A-Za-z][A-Za-z0-9_]{4,31})"), 1)
    return rows.select("line", F.explode(F.transform(handles, F.lower)).alias("handle")).groupBy("handle").agg(F.min("line").alias("line"))


class Segment(InputPartition):
    def __init__(self, channel: str, first: int, last: int):
        self.channel, self.first, self.last = channel, first, last


def called(name: str, *args):
    """The result of an injected ``module:function``."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)(*args)


def segments(channel: str, first: int, last: int, span: int) -> list[Segment]:
    """The ids from ``first`` to ``last`` in segments of ``span``."""
    return [Segment(channel, a, min(a + span - 1, last)) for a in range(first, last + 1, span)]


def pages_of(segment: Segment, fetcher: str):
    """(channel, before, first, last, html) of the pages that hold a segment's ids, newest first."""
    before = segment.last + 1
    while before > segment.first:
        html = called(fetcher, segment.channel, before)
        ids = [int(x) for x in re.findall(r'data-post="[^"]+/(\d+)"', html or "")]
        if not ids or min(ids) >= before:
            return
        yield segment.channel, before, segment.first, segment.last, html
        before = min(ids)


def in_segment(messages: DataFrame) -> DataFrame:
    """Messages (``parse_messages`` of a ``channel_history``) of their own segment: a page reaches into the one before."""
    return messages.where("i between first and last").drop("before", "first", "last")


class HistorySource(DataSource):
    """``channel_history``: pages of message previews of channels, in segments of ids that executors read.

    Options: fetcher (``module:function`` of channel and ``before`` id, giving a page's html or None), span (ids in
    a segment, 12000). Batch: channels (comma-separated ``name:latest``). Stream: channels (names), newest
    (``module:function`` of a channel, giving its newest id), plans (a shared folder; a file below it tells how far triggers
    were planned), most (ids of each channel that a trigger takes, 0 for all; what is left comes next).
    """

    @classmethod
    def name(cls) -> str:
        return "channel_history"

    def schema(self) -> str:
        return "channel string, before long, first long, last long, html string"

    def reader(self, schema):
        return HistoryReader(self.options)

    def streamReader(self, schema):
        return HistoryStream(self.options)


class HistoryReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        span = int(self.options.get("span", 12000))
        given = (part.partition(":") for part in self.options["channels"].split(","))
        return [s for channel, _, latest in given for s in segments(channel, 1, int(latest), span)]

    def read(self, segment):
        return pages_of(segment, self.options["fetcher"])


class HistoryStream(DataSourceStreamReader):
    """Offsets are the last id of each channel. A trigger's end is written down before Spark hears of it, so that after a
    restart, wherever the last run stopped, the next end lies behind all ends so far and no id comes twice."""

    def __init__(self, options):
        self.channels = options["channels"].split(",")
        self.fetcher, self.newest = options["fetcher"], options["newest"]
        self.span, self.most = int(options.get("span", 12000)), int(options.get("most", 0))
        self.files, root = fs.FileSystem.from_uri(options["plans"]) if "://" in options["plans"] else (fs.LocalFileSystem(), options["plans"])
        self.files.create_dir(root, recursive=True)
        self.root = root.rstrip("/")

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.channels, 0)

    def planned(self) -> dict:
        """The largest end of each channel that was written down whole."""
        out = self.initialOffset()
        for f in self.files.get_file_info(fs.FileSelector(self.root)):
            if f.base_name.startswith("plan-"):
                with self.files.open_input_stream(f.path) as held:
                    own = json.loads(held.read() or b"{}")
                out = {c: max(out[c], own.get(c, 0)) for c in out}
        return out

    def latestOffset(self) -> dict:
        start, end = self.planned(), {}
        for c in self.channels:
            newest = max(start[c], int(called(self.newest, c) or 0))
            end[c] = min(newest, start[c] + self.most) if self.most else newest
        if end != start:
            draft, name = f"{self.root}/draft", f"{self.root}/plan-{sum(end.values()):020d}"
            with self.files.open_output_stream(draft) as out:
                out.write(json.dumps(end).encode())
            self.files.move(draft, name)
        return end

    def partitions(self, start: dict, end: dict):
        return [s for c in self.channels for s in segments(c, start.get(c, 0) + 1, end.get(c, 0), self.span)]

    def read(self, segment):
        return pages_of(segment, self.fetcher)

    def commit(self, end: dict) -> None:
        """Plans that a later one covers go."""
        plans = sorted(f.path for f in self.files.get_file_info(fs.FileSelector(self.root)) if f.base_name.startswith("plan-"))
        for path in plans[:-1]:
            self.files.delete_file(path)
