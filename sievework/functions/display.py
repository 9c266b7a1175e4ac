"""What a reader is shown: marked terms, ages, short numbers, titles, and searches that are kept."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEARCH = "q string, cat string, tags array<string>, channel string, days int, sort string, semantic int"


def highlighted(text: Column, terms: list[str]) -> Column:
    """The text with each of at most eight terms of up to 24 characters between ``<mark>`` and ``</mark>``, in any case."""
    kept = [t.strip() for t in terms if 0 < len(t.strip()) <= 24][:8]
    text = F.coalesce(text, F.lit(""))
    return F.regexp_replace(text, f"(?i)({'|'.join(map(re.escape, kept))})", "<mark>$1</mark>") if kept else text


def age(date: Column, today: str) -> Column:
    """How long ago a date was; empty for none, and what isn't a date as it is."""
    days = F.date_diff(F.lit(today).cast("date"), date.try_cast("date"))
    ago = lambda n, unit: F.concat(F.floor(days / n).cast("string"), F.lit(unit))
    told = F.when(days <= 0, "今天").when(days == 1, "昨天").when(days < 30, ago(1, " 天前")).when(days < 365, ago(30, " 个月前")).otherwise(ago(365, " 年前"))
    return F.when(days.isNull(), F.coalesce(date, F.lit(""))).otherwise(told)


def short_number(n: Column) -> Column:
    """12300 as 1.2w, 1230 as 1.2k, half a tenth up; none as 0."""
    tenths = lambda k: F.floor((n + k // 20) / (k // 10))
    told = lambda k, unit: F.concat(F.floor(tenths(k) / 10).cast("string"), F.lit("."), (tenths(k) % 10).cast("string"), F.lit(unit))
    return F.when(n >= 10000, told(10000, "w")).when(n >= 1000, told(1000, "k")).otherwise(F.coalesce(n.cast("string"), F.lit("0")))


def title_and_body(text: Column) -> Column:
    """struct<title, body>: cut at the first line's end if that comes within 90 characters, else after 90."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    end = F.instr(t, "\n")  # counts from one
    near = (end > 1) & (end <= 90)
    return F.struct(F.when(near, F.substring(t, 1, end - 1)).otherwise(F.substring(t, 1, 90)).alias("title"), F.when(near, F.substring(t, end + 1, F.length(t))).otherwise(F.substring(t, 91, F.length(t))).alias("body"))


def captured(search: Column) -> Column:
    """A search (struct of ``SEARCH``) as JSON without what is empty or as usual; null if nothing is left."""
    said = lambda k: F.nullif(F.trim(search[k]), F.lit("")).alias(k)
    kept = F.struct(
        said("q"), said("cat"), F.when(F.size(search["tags"]) > 0, search["tags"]).alias("tags"), said("channel"), F.when(search["days"] > 0, search["days"]).alias("days"),
        F.nullif(said("sort"), F.lit("relevance")).alias("sort"), F.when(search["semantic"] > 0, 1).alias("semantic"))
    return F.nullif(F.to_json(kept), F.lit("{}"))


def restored(json: Column) -> Column:
    """The search that ``captured`` kept, with empty and usual values in place."""
    p = F.from_json(json, SEARCH)
    usual = {"q": F.lit(""), "cat": F.lit(""), "tags": F.array().cast("array<string>"), "channel": F.lit(""), "days": F.lit(0), "sort": F.lit("relevance"), "semantic": F.lit(0)}
    return F.struct(*(F.coalesce(p[k], v).alias(k) for k, v in usual.items()))
