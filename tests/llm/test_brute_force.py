"""Verdicts of mined url rules, quality and shards against plain versions."""

import itertools
import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sievework.llm import quality, sharding, url_rules
from tests.conftest import SMALL


def test_mined_verdicts(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url")
    support, confidence = 0.02, 0.8
    host, path = url_rules.host_and_path(F.col("url"))
    name, verdict = url_rules.longest_rule(F.col("host"), F.col("path"))
    rows = pages.withColumn("host", host).withColumn("path", path).withColumn("said", verdict).withColumn("tokens", url_rules.tokens(F.col("url"), F.col("host"), F.col("path"))).collect()
    labelled = [(frozenset(r["tokens"]), r["said"]) for r in rows if r["said"]]
    least = math.ceil(support * len(labelled))
    count = defaultdict(int)
    for t, _ in labelled:
        for x in t:
            count[x] += 1
    often = {x for x, n in count.items() if n >= least}
    alone, both = defaultdict(int), defaultdict(int)
    for t, said in labelled:
        own = sorted(t & often)
        for k in range(1, len(own) + 1):
            for s in itertools.combinations(own, k):
                alone[s] += 1
                both[s, said] += 1
    rules = [(n / alone[s], n / len(labelled), said, s) for (s, said), n in both.items() if n >= least and n / alone[s] >= confidence]
    want = {}
    for r in rows:
        fits = [x for x in rules if set(x[3]) <= set(r["tokens"])] if not r["said"] else []
        want[r["page_id"]] = r["said"] or (max(fits)[2] if fits else "allow")
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge(pages, least_support=support, least_confidence=confidence).collect()}
    assert got == want and any(len(s) > 3 for _, _, _, s in rules)


def test_endings_and_long_rules(spark):
    rows = [(i, f"https://a.net/x/{i}.torrent") for i in range(20)] + [(100 + i, f"https://c{i}.example.net/en/{i}.html") for i in range(20)]
    rows += [(200, "https://other.org/y.torrent"), (201, "https://other.org/z.html"), (202, "https://other.org/" + "a/" * 300_000 + "z.torrent")]
    got = {r["page_id"]: (r["verdict"], r["by_rule"]) for r in url_rules.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[200] == ("block", "ending:torrent") and got[201] == ("allow", "ending:html") and got[202][0] == "block"


def test_quality_by_hand(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    rows, known = docs.collect(), {}
    for r in labels.where("quality in (0, 1)").collect():
        known[r["doc_id"]] = known.get(r["doc_id"], False) or r["quality"] == 0

    def features(t):
        words = len(t) - len(t.translate({32: None, 10: None, 9: None})) + quality.SHRINK / 6
        shouted = len(re.findall(r"(?<!\S)[A-ZÀ-ÖØ-ÞА-Я]{2,}(?![A-ZÀ-ÖØ-ÞА-Яa-zß-öø-ÿа-я])", t))
        repeated = sum(1 for _ in re.finditer(r"(?<!\S)(\S+)(?=\s+\1(?!\S))", t))
        return (sum(c in quality.SYMBOLS for c in t) / (len(t) + quality.SHRINK), shouted / words, repeated / words)

    bins = {r["doc_id"]: [sum(v > e for e in quality.EDGES) for v in features(r["text"] or "")] for r in rows}
    n, low = len(known), sum(known.values())
    prior = (low + 1) / (n + 2)
    ratios = {}
    for f, b in itertools.product(range(3), range(quality.BINS)):
        own = [known[i] for i in known if i in bins and bins[i][f] == b]
        bad, fine = (sum(own) + prior) / (low + 1), (len(own) - sum(own) + 1 - prior) / (n - low + 1)
        ratios[f, b] = math.log(bad / fine) - math.log(prior / (1 - prior)) + math.log((low + 1) / (n - low + 1)) if own else 0.0
    want = {i: sum(ratios[f, b] for f, b in enumerate(own)) for i, own in bins.items()}
    assert sum(abs(got[i]["evidence"] - want[i]) > 1e-9 for i in want) <= 0.02 * len(want)  # but for letters beyond the short classes above
    sites = defaultdict(list)
    for r in rows:
        if r["doc_id"] in known:
            sites[r["source"] or ""].append(known[r["doc_id"]])

    def strength(groups):
        m, total, squares = len(groups), sum(map(len, groups)), sum(len(g) ** 2 for g in groups)
        between = (sum(len(g) * (sum(g) / len(g) - prior) ** 2 for g in groups) - (m - 1) * prior * (1 - prior)) / (total - squares / total)
        return min(1e6, max(1.0, prior * (1 - prior) / between - 1)) if between > 0 else 1e6

    k = strength(list(sites.values()))
    hosts = {h: (sum(g) + k * prior) / (len(g) + k) for h, g in sites.items()}
    paths = defaultdict(list)
    for r in rows:
        if r["doc_id"] in known:
            paths[r["source"] or "", r["lang"] or ""].append(known[r["doc_id"]])
    k = strength(list(paths.values()))
    for r in rows:
        h, p = r["source"] or "", (r["source"] or "", r["lang"] or "")
        above = hosts.get(h, prior)
        own = (sum(paths[p]) + k * above) / (len(paths[p]) + k) if p in paths else above
        g = got[r["doc_id"]]
        assert g["prior"] == pytest.approx(own, rel=1e-9)
        assert g["p_low"] == pytest.approx(1 / (1 + math.exp(-(g["evidence"] + math.log(own / (1 - own))))), rel=1e-9) and g["keep"] == (g["p_low"] < 0.5)


def test_shards_cut_few_links(spark):
    families = [(f * 10 + k, f"line {f} one\nline {f} {k // 3}\nown {f} {k}\nx") for f in range(200) for k in range(10)]
    docs = spark.createDataFrame(families, "doc_id long, text string").repartition(5)
    shard = {r["doc_id"]: r["shard"] for r in sharding.shard(docs).collect()}
    pairs = [(f * 10 + a, f * 10 + b) for f in range(200) for a in range(10) for b in range(a)]
    cut = sum(shard[a] != shard[b] for a, b in pairs)
    assert cut < 0.2 * len(pairs), cut  # 39 of 40 by chance
    sizes = defaultdict(int)
    for s in shard.values():
        sizes[s] += 1
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 40
