"""URL filtering by association rules.

Fixed (host, path) rules label the urls they fit. FP-growth mines combinations of url tokens with those
labels over the urls they fit; rules pruned by support, confidence and redundancy then judge the urls that
no fixed rule fits, matched by an inverted index from a rule's rarest token. Only DataFrame functions and Spark's own FP-growth run.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rule text and verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Rows that are broadcast at most, counted before; a shuffled join serves beyond.
MOST_BROADCAST = 100_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. Of equally long rules the first wins."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0]), reverse=False):
        h, slash, p = text.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(slash + p))
        name, verdict = F.when(fits, text).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """All tokens of a url: host, its suffixes, first, middle and last labels, every segment of the path, query names, ending."""
    labels = F.split(host, r"\.")
    size = F.size(labels)
    tail = lambda x, i: F.when((i <= size - 2) & ((i > 0) | (size == 2)), F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i + 1, size), ".")))
    middle = lambda x, i: F.when((i > 0) & (i < size - 1), F.concat(F.lit("label:"), x))
    ending = F.regexp_extract(path, r"\.([^./]+)$", 1)
    parts = F.array(
        F.when(host != "", F.concat(F.lit("host:"), host)),
        F.when(host != "", F.concat(F.lit("top:"), F.element_at(labels, -1))),
        F.when(size > 2, F.concat(F.lit("first:"), F.element_at(labels, 1))),
        F.when(ending != "", F.concat(F.lit("ending:"), ending)),
    )
    segments = F.transform(F.split(path, "/"), lambda x: F.when(x != "", F.concat(F.lit("path:"), x)))
    names = F.regexp_extract_all(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit("(?:^|&)([^=&]+)"), 1)
    named = F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda x: F.concat(F.lit("query:"), x))
    found = F.concat(parts, F.transform(labels, tail), F.transform(labels, middle), segments, named)
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def frequent(rows: DataFrame, least_support: float) -> DataFrame:
    """One row with two arrays, the tokens and their counts, of those that reach the support among labelled urls, as FP-growth counts it: rarer ones are in no rule."""
    labelled = rows.where(F.col("said").isNotNull()).select("tokens")
    least = math.ceil(least_support * labelled.count())
    counts = labelled.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") >= least)
    # each url holds few tokens: at most so many of them, divided by the support, are frequent
    both = F.array_sort(F.collect_list(F.struct("token", "count")))
    return counts.agg(both.alias("b")).select(F.col("b.token").alias("frequent"), F.col("b.count").alias("often"))


def mined(urls: DataFrame, least_support: float, least_confidence: float) -> DataFrame:
    """antecedent array, verdict, confidence, support of the pruned rules, from labelled ``urls`` (tokens, verdict)."""
    items = urls.select(F.concat("tokens", F.array(F.concat(F.lit("="), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least_support, minConfidence=least_confidence).fit(items)
    rules = model.associationRules.where(F.col("consequent")[0].startswith("=") & ~F.exists("antecedent", lambda x: x.startswith("=")))
    return rules.select(F.array_sort("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], 2, 99).alias("verdict"), "confidence", "support")


def irredundant(rules: DataFrame) -> DataFrame:
    """Without rules that contain a rule of one or two tokens, or of one token less, for the same verdict of at least the
    same confidence. Such a rule fits wherever they do, and has as much support: they decide nothing."""
    a = F.col("antecedent")
    singles = F.transform(a, lambda x: F.array(x))
    pairs = F.flatten(F.transform(a, lambda x: F.transform(F.filter(a, lambda y: y > x), lambda y: F.array(x, y))))
    less = F.transform(a, lambda x: F.filter(a, lambda y: y != x))
    shorter = F.filter(F.array_distinct(F.concat(singles, pairs, less)), lambda s: (F.size(s) > 0) & (F.size(s) < F.size(a)))
    inner = rules.select("antecedent", "verdict", "confidence", F.explode(shorter).alias("part"))
    known = rules.select(F.col("antecedent").alias("part"), "verdict", F.col("confidence").alias("known"))
    doubled = inner.join(known, ["part", "verdict"]).where(F.col("known") >= F.col("confidence")).select("antecedent", "verdict").distinct()
    return rules.join(doubled, ["antecedent", "verdict"], "left_anti")


def sized(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """Broadcast if it has at most ``most`` rows, else left to a shuffled join."""
    return F.broadcast(df) if df.count() <= most else df


def judge(pages: DataFrame, url_col: str = "url", rules=RULES, least_support: float = 0.002, least_confidence: float = 0.8) -> DataFrame:
    """All columns of ``pages`` but clashing ones, with host, path, rule, verdict and by_rule (mined antecedent, if any).

    A fixed rule's verdict stands. Else the most confident mined rule that fits decides, of equals the one
    with more support, then block before allow; without one the url is allowed. A null url, or one without
    ``://``, has an empty host and path and is allowed. Rows are never merged: repeated rows and null ids stay; very
    long urls give all their tokens; no rows give none. Columns of ``pages`` called like those made here give way.
    """
    made = ("host", "path", "rule", "verdict", "by_rule", "tokens", "said", "found", "frequent", "often")
    host, path = host_and_path(F.col(url_col))
    rows = pages.drop(*[c for c in made if c != url_col]).withColumn("host", host).withColumn("path", path)
    name, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", name).withColumn("said", verdict).withColumn("tokens", tokens(F.col(url_col), F.col("host"), F.col("path")))
    scratch = Scratch(pages.sparkSession, "urls")
    often = scratch.keep(frequent(rows, least_support), "frequent")
    rows = rows.crossJoin(F.broadcast(often)).withColumn("tokens", F.array_sort(F.array_intersect("tokens", "frequent"))).drop("frequent", "often")
    # equal token sets count once per label and are judged once; partial aggregation meets hot hosts
    sets = scratch.keep(rows.groupBy("tokens", F.col("said").alias("verdict")).count(), "sets")
    urls = rows.where(F.col("said").isNotNull()).select("tokens", F.col("said").alias("verdict"))
    found = scratch.keep(mined(urls, least_support, least_confidence), "mined")
    held = irredundant(found).crossJoin(F.broadcast(often)).withColumn("counts", F.map_from_arrays("frequent", "often"))
    rarest = F.array_min(F.transform("antecedent", lambda t: F.struct(F.col("counts")[t].alias("n"), t.alias("token"))))
    index = held.withColumn("token", rarest["token"]).drop("frequent", "often", "counts")
    open_sets = sets.where("verdict is null").select("tokens")
    hits = open_sets.withColumn("token", F.explode("tokens")).join(sized(scratch.keep(index, "index")), "token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.max(F.struct("confidence", "support", F.col("verdict").alias("verdict"), "antecedent")).alias("best")
    judged = scratch.keep(hits.groupBy("tokens").agg(best).select(F.col("tokens").alias("found"), "best"), "judged")
    out = rows.join(sized(judged), F.col("said").isNull() & (F.col("tokens") == F.col("found")), "left")
    by = F.when(F.col("said").isNull(), F.array_join("best.antecedent", " "))
    return out.withColumn("verdict", F.coalesce("said", "best.verdict", F.lit("allow"))).withColumn("by_rule", by).drop("tokens", "found", "best", "said")
