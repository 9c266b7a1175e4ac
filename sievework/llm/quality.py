"""Quality by hierarchical empirical Bayes.

A document's own evidence is a sum of log likelihood ratios over binned features of its text. Its prior is
the rate of low-quality documents on its path, shrunk toward the rate of its host, which is shrunk toward
that of all labelled documents. How strongly comes from the spread of the rates (method of moments), so
sparse sites follow the global prior and large ones their own record. All counts are grouped aggregates over
every labelled document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Scratch, unused
from .tables import sized as sized_to

#: Characters that mark up or decorate, and a word of upper-case letters.
SYMBOLS = "#$%&*|<>{}~^\\"
SHOUTED = r"(?<!\S)[\p{Lu}]{2,}+(?!\p{Ll})"
REPEATED = r"(?<!\S)(\S++)(?=\s++\1(?!\S))"
#: Bins of a share, finer near zero; characters that a share is shrunk by, since short texts say little; weight
#: of the overall rate in each bin, in documents.
BINS, SHRINK, DOUBT = 8, 30, 1.0
EDGES = [(i / BINS) ** 2 for i in range(1, BINS)]
#: Sites that are broadcast at most, counted before; a shuffled join serves beyond.
MOST_BROADCAST = 100_000
FEATURES = ("symbols", "shouted", "repeats")


def features(text: Column) -> dict[str, Column]:
    """Shares of symbols in the characters, and of upper-case words and of words equal to the next one in the words."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    words = F.length(text) - F.length(F.translate(text, " \n\t", "")) + F.lit(SHRINK / 6)
    return {
        "symbols": symbols / (F.length(text) + SHRINK),
        "shouted": F.regexp_count(text, F.lit(SHOUTED)) / words,
        "repeats": F.regexp_count(text, F.lit(REPEATED)) / words,
    }


@dataclass
class Model:
    """``ratios`` per feature and bin, the global prior, and the tables of hosts and paths with their priors."""

    ratios: dict[str, list[float]]
    prior: float
    hosts: DataFrame
    paths: DataFrame


def bin_of(value: Column) -> Column:
    """How many edges the value exceeds. The value is bound first, so that it is computed once and not for each edge."""
    return F.transform(F.array(value), lambda v: F.size(F.filter(F.array(*map(F.lit, EDGES)), lambda e: v > e)))[0]


def strength(sites: DataFrame, prior: float) -> float:
    """The weight, in documents, of the prior of a site's rate; ``sites`` has n and low."""
    m, total, squares, spread = sites.agg(F.count("*"), F.sum("n"), F.sum(F.col("n") * F.col("n")), F.sum(F.col("n") * (F.col("low") / F.col("n") - F.lit(prior)) ** 2)).first()
    if not m or m < 2 or total <= squares / total:
        return 100.0
    own = prior * (1 - prior)
    between = (spread - (m - 1) * own) / (total - squares / total)
    return min(1e6, max(1.0, own / between - 1)) if between > 0 else 1e6


def fit(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learns from every labelled document (label 1 good, 0 low; null labels take no part)."""
    scratch = Scratch(docs.sparkSession, "quality")
    text = F.coalesce(F.col(text_col), F.lit(""))
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg((F.min(label_col) == 0).cast("int").alias("low"))
    seen = docs.select(F.col(id_col).alias("id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), *(c.alias(k) for k, c in features(text).items()))
    rows = scratch.keep(seen.join(scratch.keep(known, "known"), "id"), "features")
    n, low = rows.agg(F.count("*"), F.coalesce(F.sum("low"), F.lit(0))).first()
    prior = (low + 1) / (n + 2)
    bins = F.array(*(F.struct(F.lit(k).alias("feature"), bin_of(F.col(k)).alias("bin")) for k in FEATURES))
    counts = rows.select("low", F.explode(bins).alias("b")).groupBy("b.feature", "b.bin").agg(F.count("*").alias("n"), F.sum("low").alias("low"))
    ratios = {k: [0.0] * BINS for k in FEATURES}
    for r in counts.collect():  # a row for each feature and bin
        bad, good = (r["low"] + DOUBT * prior) / (low + DOUBT), (r["n"] - r["low"] + DOUBT * (1 - prior)) / (n - low + DOUBT)
        ratios[r["feature"]][r["bin"]] = math.log(bad / good) - math.log(prior / (1 - prior)) + math.log((low + DOUBT) / (n - low + DOUBT))
    paths = scratch.keep(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("low").alias("low")), "paths")
    hosts = scratch.keep(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("low").alias("low")), "hosts")
    k = strength(hosts, prior)
    hosts = hosts.select("host", ((F.col("low") + k * prior) / (F.col("n") + k)).alias("host_prior"))
    k = strength(paths, prior)
    above = paths.join(hosts, "host")
    paths = above.select("host", "path", ((F.col("low") + k * F.col("host_prior")) / (F.col("n") + k)).alias("path_prior"))
    return Model(ratios, prior, scratch.keep(hosts, "host-priors"), scratch.keep(paths, "path-priors"))


def sized(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """Broadcast if it has at most ``most`` rows, else left to a shuffled join."""
    return sized_to(df, most)


def score(docs: DataFrame, model: Model, host: Column, path: Column, text_col: str = "text", made: tuple[str, str, str] = ("evidence", "prior", "p_low")) -> DataFrame:
    """Every row with evidence (log ratio), prior and p_low, named by ``made``. A host or path without labels has the prior of what is above it.

    A null text counts as empty. Columns of ``docs`` that have the names of the new ones give way to them; all
    others stay. Texts aren't shuffled while the sites fit a broadcast.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    found = features(text)
    evidence = sum((F.element_at(F.array(*map(F.lit, model.ratios[k])), bin_of(found[k]) + 1) for k in FEATURES), F.lit(0.0))
    h, p, above, own = unused([*docs.columns, *made], "host", "path", "host_prior", "path_prior")
    rows = docs.drop(*made).withColumn(h, F.coalesce(host, F.lit(""))).withColumn(p, F.coalesce(path, F.lit("")))
    rows = rows.withColumn(made[0], evidence)
    hosts = model.hosts.toDF(h, above)
    paths = model.paths.toDF(h, p, own)
    rows = rows.join(sized(paths), [h, p], "left").join(sized(hosts), h, "left")
    prior = F.coalesce(own, above, F.lit(model.prior))
    z = F.col(made[0]) + F.log(prior / (1 - prior))
    return rows.withColumn(made[1], prior).withColumn(made[2], 1 / (1 + F.exp(-z))).drop(h, p, above, own)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = 0.5, made: tuple[str, str, str, str] = ("evidence", "prior", "p_low", "keep")) -> DataFrame:
    """All columns of ``docs``, and evidence, prior, p_low and keep (p_low below ``threshold``), named by ``made``.

    Without labels all is kept. Null texts are empty, null hosts and paths are the empty ones, very long texts are read
    whole; null and repeated ids are rows like others. Labels of one id that contradict each other make it low, null
    labels and labels of null ids take no part. Equal texts of one site have equal scores; a score at the threshold goes. Columns of ``docs``
    that are called like the new ones give way to them, all others come out as they are. No rows give none.
    """
    model = fit(docs, labels, F.col(host_col), F.col(path_col), id_col, text_col)
    rows = score(docs.drop(made[3]), model, F.col(host_col), F.col(path_col), text_col, made[:3])
    return rows.withColumn(made[3], F.col(made[2]) < threshold)
