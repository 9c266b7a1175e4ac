"""Phrase search with weighted BM25, filters, orders and pages."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PUNCTUATION, SINGLE, tokens
from .index import B, FIELDS, K1, LEAST_IDF, Index, ranked  # noqa: F401

#: Fixed value: weight of a post's value in relevance.
VALUE_BLEND = 0.5
#: Digits by which ranks of related posts are told apart; equal ones go by id.
RANK_DIGITS = 6
SPECIAL = r"[\"'*():^\-]"


@dataclass
class Filters:
    """One set of conditions for every way to find posts; unset ones don't apply."""

    category: str = ""
    channel: str = ""
    date_from: str = ""
    date_to: str = ""
    since: int = 0
    min_value: float = 0
    tags: Sequence[str] = field(default_factory=tuple)
    collapse: bool = True
    days: int = 0
    as_of: str = ""

    def condition(self, columns: Sequence[str]) -> Column:
        c = F.lit(True)
        if self.category:
            c &= F.col("category") == self.category
        if self.channel:
            c &= F.col("channel") == self.channel
        if self.date_from:
            c &= F.col("date") >= self.date_from
        if self.date_to:
            c &= F.col("date") <= self.date_to
        if self.days and self.as_of:
            c &= F.col("date") >= F.date_sub(F.lit(self.as_of).cast("date"), self.days).cast("string")
        if self.since:
            c &= F.col("ts") > self.since
        if self.min_value:
            c &= F.col("value") >= float(self.min_value)
        for t in self.tags:
            c &= F.array_contains("tags", t)
        if self.collapse and "is_rep" in columns:
            c &= F.col("is_rep")
        return c


def filtered(posts: DataFrame, filters: Filters | None = None) -> DataFrame:
    return posts.where((filters or Filters()).condition(posts.columns))


def terms_of(q: str | None) -> list[str]:
    return re.sub(PUNCTUATION, " ", q or "").split()


def phrase_of(term: str) -> list[str]:
    """Lower-case tokens of a term, whatever parts them; single-word characters are tokens of their own."""
    return [w for w in re.split(r"[\W_]+", re.sub(rf"({SINGLE})", r" \1 ", term).lower()) if w]


def phrases_of(q: str | None) -> list[list[str]]:
    """A phrase for each term of a query."""
    return [p for p in map(phrase_of, terms_of(q)) if p]


def match_expression(q: str | None, mode: str = "gram") -> dict:
    """The query as quoted phrases joined by AND; in mode ``trigram`` terms under three characters are kept apart."""
    terms = terms_of(q)
    if mode == "gram":
        good = [g for g in (" ".join(re.sub(rf"({SINGLE})", r" \1 ", t).split()).replace('"', "") for t in terms) if g]
        long, short = terms, []
    else:
        long, short = [t for t in terms if len(t) >= 3], [t for t in terms if len(t) < 3]
        good = [g for g in (re.sub(SPECIAL, "", t) for t in long) if len(g) >= 3]
    return {"terms": terms, "long": long, "short": short, "expr": " AND ".join(f'"{g}"' for g in good) or None}


def any_expression(terms: Sequence[str]) -> str | None:
    """Terms of three characters at least, quoted and joined by OR."""
    good = [g for g in (re.sub(SPECIAL, "", t) for t in terms) if len(g) >= 3]
    return " OR ".join(f'"{g}"' for g in good) or None


def frequency(words: Column, phrase: Sequence[str]) -> Column:
    """How often a phrase stands in an array of tokens."""
    first = F.lit(phrase[0])
    if len(phrase) == 1:
        return F.size(F.filter(words, lambda w: w == first))
    whole = F.array(*map(F.lit, phrase))
    return F.size(F.filter(F.transform(words, lambda w, i: (w == first) & (F.slice(words, i + 1, len(phrase)) == whole)), lambda x: x))


def indexed(posts: DataFrame) -> DataFrame:
    """``posts`` with the tokens of each indexed field in ``_f_<field>`` and their number in ``_length``."""
    out = posts
    for name in FIELDS:
        if name in posts.columns:
            kind = posts.schema[name].dataType.simpleString()
            out = out.withColumn(f"_f_{name}", tokens(F.array_join(name, " ") if kind.startswith("array") else F.col(name)))
    mine = [c for c in out.columns if c.startswith("_f_")]
    return out.withColumn("_length", sum((F.size(c) for c in mine), F.lit(0)))


def bm25(posts: DataFrame, phrases: Sequence[Sequence[str]], every: bool = True, index: Index | None = None) -> DataFrame:
    """``posts`` that hold every phrase (or any), with ``rank``, where less is better.

    Without a stored ``index`` the texts are cut into tokens for this search.
    """
    index = index or Index.of(posts, sorted({w for p in phrases for w in p}))
    return posts.join(ranked(index, phrases, every), "id").select(*posts.columns, "rank")


def order(sort: str, ranked: bool) -> list[Column]:
    """Sort keys, made unique by the id."""
    if sort == "date":
        return [F.desc("date"), F.desc("ts"), F.asc("id")]
    if sort == "views":
        return [F.desc("views"), F.asc("id")]
    if sort == "value" or not ranked:
        return [F.desc("value"), F.desc("ts"), F.asc("id")]
    return [(F.col("rank") - VALUE_BLEND * F.col("value")).asc(), F.asc("id")]


def contains_all(posts: DataFrame, q: str) -> DataFrame:
    """Without an index: posts whose text contains every term, whatever the case."""
    for t in terms_of(q):
        posts = posts.where(F.contains(F.lower("text"), F.lit(t.lower())))
    return posts


@dataclass
class Found:
    mode: str
    page: int
    size: int
    hits: DataFrame
    items: DataFrame

    @property
    def total(self) -> int:
        return self.hits.count()


def search(posts: DataFrame, q: str = "", filters: Filters | None = None, sort: str = "relevance", page: int = 1, size: int = 30, like: bool = False, index: Index | None = None) -> Found:
    """A page of posts: by phrases if the query has any, else browsing; ``like`` matches substrings instead.

    Statistics come from all posts, filters apply to hits, as in a full-text index. Sizes are 1 to 100.
    """
    page, size = max(1, page), min(100, max(1, size))
    phrases = phrases_of(q)
    if like and phrases:
        mode, hits = "like", filtered(contains_all(posts, q), filters)
    elif phrases:
        mode, hits = "fts", filtered(bm25(posts, phrases, index=index), filters)
    else:
        mode, hits = "browse", filtered(posts, filters)
    items = hits.orderBy(*order(sort, mode == "fts")).offset((page - 1) * size).limit(size)
    return Found(mode, page, size, hits, items)


def related(posts: DataFrame, post_id: int, limit: int = 8, index: Index | None = None) -> DataFrame:
    """Posts that share key terms with one post, best first, without it.

    Each key term is one phrase, with inner dots too; of several words it is looked for in texts alone. Terms that
    differ in case only are one that is asked as often. Ranks that differ beyond ``RANK_DIGITS`` are equal.
    """
    from ..functions.text import key_terms

    row = posts.where(F.col("id") == post_id).select(key_terms(F.col("text")).alias("t")).first()
    asked = Counter(t.lower() for t in (row["t"] if row else []))
    found = [(p, n) for p, n in ((phrase_of(t), n) for t, n in asked.items()) if p]
    if not found:
        return posts.withColumn("rank", F.lit(0.0)).limit(0)
    phrases, times = zip(*found)
    index = index or Index.of(posts, sorted({w for p in phrases for w in p}))
    hits = ranked(index, phrases, False, times, ("text",)).where(F.col("id") != post_id)
    return posts.join(hits, "id").select(*posts.columns, "rank").orderBy(F.round("rank", RANK_DIGITS), "id").limit(limit)
