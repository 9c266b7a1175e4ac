"""Candidates for new sources: handles that posts mention, told apart from known ones, with what a probe of them says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_empty
from .facets import NOISE, mention_histogram

#: Words of the themes that sources are sought for.
THEME = (
    "ai", "人工智能", "大模型", "gpt", "claude", "gemini", "agent", "智能体", "开源", "github", "工具", "软件", "羊毛", "免费", "白嫖", "优惠", "福利", "vps", "服务器", "节点", "机场", "订阅",
    "副业", "赚钱", "变现", "创业", "教程", "资源", "科技", "数码", "破解", "nas", "docker", "python", "linux", "前端", "后端", "程序员", "独立开发", "自动化", "爬虫",
)


def theme_hits(title: Column, about: Column) -> Column:
    """The theme words that a title and description hold, in the list's order."""
    hay = F.lower(F.concat_ws(" ", or_empty(title), or_empty(about)))
    return F.filter(F.array(*map(F.lit, THEME)), lambda w: F.contains(hay, w))


def candidates(posts: DataFrame, known: DataFrame, n: int = 260, noise: tuple[str, ...] = NOISE) -> DataFrame:
    """handle, n: the handles, as they are written, mentioned by most posts that aren't ``known`` (column handle, in whatever case); ties by handle."""
    counts = mention_histogram(posts, None, noise)
    own = known.select(F.lower("handle").alias("_known")).distinct()
    return counts.join(own, F.lower("handle") == F.col("_known"), "left_anti").orderBy(F.desc("n"), "handle").limit(n)


def ranked(probed: DataFrame) -> DataFrame:
    """``probed`` (handle, n, title, about, messages) with theme_hits, theme (six words) and status, the fittest first."""
    hits = theme_hits(F.col("title"), F.col("about"))
    rows = probed.withColumn("_hits", hits).withColumn("theme_hits", F.size("_hits")).withColumn("theme", F.slice("_hits", 1, 6)).drop("_hits")
    rows = rows.withColumn("status", F.when(F.col("messages") > 0, "scrapable").otherwise("no-preview"))
    return rows.orderBy(F.desc("theme_hits"), F.desc("n"), "handle")
