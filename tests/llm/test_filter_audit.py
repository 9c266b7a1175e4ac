"""The filter audit against every order applied for itself, and its edges."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from sievework.llm import audit, tables

NAMES = "ABCDE"


def plain(docs, labels):
    """{(part, order, step): counts} by applying the filters of each order one after the other. docs: (doc_id, text, source)."""
    first: dict[str, int] = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    rows = []
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and t in first and i > first[t])
        rows.append((s or "", dict(zip(NAMES, bad)), i is not None and i in good, i is not None and i in toxic))
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in itertools.permutations(NAMES):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                fails = sum(r[1][f] for r in own)
                out[part, "".join(order), step] = [len(left), len(gone), fails - len(gone), sum(r[1][f] and sum(r[1].values()) == 1 for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: tuple(v) + (shapley[k[0], k[1][k[2] - 1]],) for k, v in out.items()}


def got(df):
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    rows = df.collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in columns) for r in rows}
    assert len(found) == len(rows)
    return found


LONG = " ".join(f"w{i}" for i in range(220))
DOCS = [
    (1, LONG, "a"), (2, LONG, "a"), (3, LONG, "b"), (3, LONG, "b"), (None, LONG, "b"), (4, LONG + " #", "a"), (5, "SHOUT " * 300, "a"), (6, "x " * 300, None), (7, None, None), (8, "", "a"), (9, " \n\t", "a"),
    (10, LONG.upper() + " $", "b"), (11, "w " * 100_000, "only"), (None, None, "b"), (12, LONG.upper() + " $", "b")]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (5, 0, 1), (None, 1, 1), (10, 1, None)]


@pytest.fixture(scope="module")
def frames(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string")
    for c in ("part", "good", "toxic", "E", "digest", "first_id", "copies", "texts", "state"):
        docs = docs.withColumn(c, F.lit(c))
    return docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_every_order(frames):
    assert got(audit.audit(*frames)) == plain(DOCS, LABELS)


def test_no_rows(frames):
    docs, labels = frames
    assert audit.audit(docs.limit(0), labels).count() == 0
    assert got(audit.audit(docs.where("doc_id < 5"), labels.limit(0))) == plain([d for d in DOCS if d[0] is not None and d[0] < 5], [])


def test_states_are_made_once(frames, spark):
    scratch = tables.Scratch(spark, "test")
    rows, names = audit.judged(*frames, scratch)
    before = scratch.count
    states = audit.trie(rows, names, scratch)
    assert len(states) == 31 and scratch.count - before == 31 + 30  # counts of each state, and survivors but of none and all


def test_groups_join_alike_however_large_they_are(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 30}") for i in range(300)] + [(-1, None), (-2, "alone")], "id long, key string")
    groups = rows.where("key <> 'alone'").groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("copies")).where("copies > 1")
    want = sorted(map(tuple, tables.join_groups(rows, groups, "key", "copies").select("id", "key", "least").collect()), key=repr)
    for most, heavy in ((0, 5), (2, 5), (2, 10_000)):
        assert sorted(map(tuple, tables.join_groups(rows, groups, "key", "copies", most=max(1, most), heavy=heavy).select("id", "key", "least").collect()), key=repr) == want
    assert len(want) == 302
