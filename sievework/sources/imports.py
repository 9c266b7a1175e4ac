"""Posts made of what was fetched: web pages, messages of channels, and updates that come with offsets."""

from __future__ import annotations

import importlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..functions.html import extract_web
from ..functions.urls import links_in, parse_link
from ..operators.classify import classify
from ..operators.sync import from_group

#: Fixed value: messages of a channel that one import reads.
MOST_MESSAGES = 2000
#: The parts of an update that are read.
UPDATE = (
    "message struct<message_id: long, date: long, text: string, caption: string, chat: struct<id: long, type: string, title: string, username: string>,"
    " from: struct<is_bot: boolean, first_name: string, last_name: string, username: string>,"
    " entities: array<struct<type: string, offset: int, length: int, url: string>>, caption_entities: array<struct<type: string, offset: int, length: int, url: string>>>")


def page_number(url: Column) -> Column:
    """A number of a page that every run and every retry gives again: 60 bits of its digest, which two of a million pages of a host share with a chance of 4e-7."""
    return F.conv(F.substring(F.md5(url.cast("binary")), 1, 15), 16, 10).cast("long")


def as_posts(messages: DataFrame, as_of: int | None, previews: bool) -> DataFrame:
    """Classified messages with the columns of stored posts, and what else they have."""
    joined = lambda c: F.array_join(c, ",").alias(c)
    rows = classify(messages, as_of, previews_col="lp" if previews else None)
    used = ("t", "lk", "lp", "v", "ts", "text", "primary", "cats", "tags", "hashtags", "spam", "spam_hits", "content", "value", "domains", "links")
    return rows.select(
        *[c for c in rows.columns if c not in used], "ts", "text", F.col("primary").alias("category"), F.array_join("cats", ",").alias("categories"), joined("tags"), joined("hashtags"),
        "value", "content", F.array_join("links", " ").alias("links"), F.array_join("domains", " ").alias("domains"))


def web_posts(pages: DataFrame, at: int, url_col: str = "url", html_col: str = "html", also: tuple[str, ...] = ()) -> DataFrame:
    """A post for each page that has html and a host, found at epoch second ``at``. A narrow job.

    Its number comes from the url, so that an import run again adds nothing to what ``appended`` stored. Columns ``also`` come along.
    """
    url, page = F.col(url_col), extract_web(F.col(html_col))
    host = parse_link(url)["host"]
    known = pages.where((F.coalesce(F.col(html_col), F.lit("")) != "") & url.isNotNull())
    rows = known.select(
        *also, F.concat(F.lit("web_"), F.coalesce(host, F.lit("site"))).alias("channel"), page_number(url).alias("msg_id"), url.alias("url"),
        F.coalesce(F.nullif(page["title"], F.lit("")), host).alias("group_title"), page["text"].alias("t"), F.array(url).alias("lk"), F.lit(0).alias("v"), F.lit(at).cast("long").alias("ts"))
    day = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd").alias("date")
    return as_posts(rows, at, False).select("*", day, F.lit("web").alias("source"))


def channel_posts(messages: DataFrame, most: int = MOST_MESSAGES, as_of: int | None = None) -> DataFrame:
    """Posts of the ``most`` newest messages of each channel (columns of ``parse_messages``, and channel).

    Messages with neither text nor links are read but give no post. Every task keeps only the newest of each
    channel before rows are shuffled, so a channel of a third of all messages costs its task ``most`` rows
    from each other task.
    """
    place = F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("i")))
    newest = messages.withColumn("place", place).where(F.col("place") <= most).drop("place")
    rows = newest.select(
        "channel", F.col("i").alias("msg_id"), F.substring(F.coalesce("d", F.lit("")), 1, 10).alias("date"),
        F.concat(F.lit("https://t.me/"), F.col("channel"), F.lit("/"), F.col("i").cast("string")).alias("url"), "t", "lk", "lp", "v", F.coalesce("ts", F.lit(0)).alias("ts"))
    kept = F.size(F.coalesce("lk", F.array().cast("array<string>"))) > 0
    posts = as_posts(rows.withColumn("linked", kept), as_of, True)
    return posts.where((F.col("text") != "") | F.col("linked")).drop("linked").withColumn("source", F.lit("channel"))


def group_posts(updates: DataFrame, json_col: str = "json") -> DataFrame:
    """Posts of the group messages among updates, batch or stream. A narrow job; what isn't JSON or isn't kept gives no row.

    Places of links are counted in characters, which differs from the sender's count after characters beyond U+FFFF.
    """
    m = F.col("m")
    rows = updates.select(F.from_json(json_col, UPDATE)["message"].alias("m"))
    raw = F.regexp_replace(F.coalesce(F.nullif(m["text"], F.lit("")), m["caption"], F.lit("")), r"^\s+|\s+$", "")
    rows = rows.withColumn("t", raw).where(from_group(m["chat"]["type"], m["from"]["is_bot"], F.col("t")))
    marks = F.coalesce(m["entities"], m["caption_entities"], F.from_json(F.lit("[]"), "array<struct<type: string, offset: int, length: int, url: string>>"))
    marked = F.transform(marks, lambda e: F.when(e["type"] == "text_link", e["url"]).when(e["type"] == "url", F.substring(F.col("t"), e["offset"] + 1, e["length"])))
    name, number = F.nullif(m["chat"]["username"], F.lit("")), m["chat"]["id"].cast("string")
    author = F.concat_ws(" ", F.nullif(m["from"]["first_name"], F.lit("")), F.nullif(m["from"]["last_name"], F.lit("")))
    links = links_in(F.col("t"), F.filter(marked, lambda u: u.isNotNull()))
    rows = rows.select(
        F.coalesce(F.concat(F.lit("g_"), name), F.concat(F.lit("group_"), number)).alias("channel"), m["message_id"].alias("msg_id"),
        F.coalesce(F.date_format(F.timestamp_seconds(m["date"]), "yyyy-MM-dd"), F.lit("")).alias("date"),
        F.concat(F.lit("https://t.me/"), F.coalesce(name, F.concat(F.lit("c/"), number)), F.lit("/"), m["message_id"].cast("string")).alias("url"),
        F.coalesce(F.nullif(author, F.lit("")), m["from"]["username"], F.lit("")).alias("author"), F.coalesce(m["chat"]["title"], F.lit("")).alias("group_title"),
        "t", links.alias("lk"), F.lit(0).alias("v"), F.coalesce(m["date"], F.lit(0)).alias("ts"))
    return as_posts(rows, None, False).withColumn("source", F.lit("group"))


class Updates(DataSource):
    """``numbered_updates``: a stream of (update_id, json) from an injected fetcher, asked from the next number on.

    Options: fetcher (``module:function`` of an offset, giving updates of that number or later, in order), rows and
    bytes (how much one trigger takes at most; one update is always taken, and what is left comes next). A batch that
    is read again after a failure holds the same numbers.
    """

    @classmethod
    def name(cls) -> str:
        return "numbered_updates"

    def schema(self) -> str:
        return "update_id long, json string"

    def simpleStreamReader(self, schema):
        return UpdateReader(self.options["fetcher"], int(self.options.get("rows", 0)), int(self.options.get("bytes", 0)))


class UpdateReader(SimpleDataSourceStreamReader):
    def __init__(self, fetcher: str, rows: int = 0, size: int = 0):
        self.fetcher, self.rows, self.size = fetcher, rows, size

    def fetch(self, offset: int) -> list[tuple[int, str]]:
        module, _, name = self.fetcher.partition(":")
        return [(int(i), s) for i, s in getattr(importlib.import_module(module), name)(offset) if i >= offset]

    def initialOffset(self) -> dict:
        return {"offset": 0}

    def read(self, start: dict):
        taken, size = [], 0
        for number, text in self.fetch(start["offset"]):
            size += len(text.encode())
            if taken and (self.rows and len(taken) >= self.rows or self.size and size > self.size):
                break
            taken.append((number, text))
        return iter(taken), {"offset": max((i for i, _ in taken), default=start["offset"] - 1) + 1}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([r for r in self.fetch(start["offset"]) if r[0] < end["offset"]])
