"""Vector codes against plain Lloyd in whole numbers."""

import hashlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievework.llm import registry, yinyang
from tests.conftest import SMALL


def plain(rows, parts=4, entries=256, rounds=4):
    """{id: (code, error)} and the digest, with Python's whole numbers; rows: (id, list of whole numbers)."""
    width = len(rows[0][1]) // parts
    books = [[q[p * width : (p + 1) * width] for _, q in rows[:entries]] for p in range(parts)]

    def nearest(x, b):
        return min((sum((a - c) ** 2 for a, c in zip(x, e)), i) for i, e in enumerate(b))

    for _ in range(rounds):
        for p, b in enumerate(books):
            own = defaultdict(list)
            for _, q in rows:
                x = q[p * width : (p + 1) * width]
                own[nearest(x, b)[1]].append(x)
            books[p] = [[sum(v) // len(v) for v in zip(*own[i])] if i in own else e for i, e in enumerate(b)]
    found = {}
    for i, q in rows:
        near = [nearest(q[p * width : (p + 1) * width], b) for p, b in enumerate(books)]
        found[i] = ("".join(f"{n[1]:02x}" for n in near), sum(n[0] for n in near))
    return found, hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


def test_query(spark):
    table = pd.read_parquet(f"{SMALL}/embeddings.parquet").sort_values("vec_id")
    got = registry.queries()["op11_vector_codes"](spark, SMALL).toPandas()
    rows = [(i, [int(v) for v in np.floor(1024 * np.asarray(x, float))]) for i, x in zip(table["vec_id"], table["embedding"])]
    want, digest = plain(rows)
    assert {r.vec_id: (r.code, r.error) for r in got.itertuples()} == want and len(got) == len(table)
    assert set(got["codebooks_sha256"]) == {digest}
    label = dict(zip(table["vec_id"], table["label"]))
    by_label = defaultdict(int)
    for i, (_, e) in want.items():
        by_label[label[i]] += e
    assert all(r.label_error == by_label[label[r.vec_id]] for r in got.itertuples())


@pytest.mark.parametrize("scale", [3, 300, 1 << 26, 1 << 45])
def test_bounds_lose_no_tie(scale):
    rng = np.random.default_rng(scale)
    x = rng.integers(-scale, scale + 1, (300, 3))
    b = yinyang.book(x[:24].copy(), 5)
    code, low, error = yinyang.first_codes(x, b)
    looked = 0
    for _ in range(5):
        d = ((x.astype(object)[:, None] - b.entries.astype(object)[None]) ** 2).sum(2)
        want = [min((v, j) for j, v in enumerate(row)) for row in d.tolist()]
        assert list(zip(map(int, error), code)) == want
        new = b.entries.copy()
        for e in np.unique(code):
            new[e] = [sum(map(int, col)) // int((code == e).sum()) for col in x[code == e].T]
        b = yinyang.moved(b, new)
        code, low, error, n = yinyang.next_codes(x, code, yinyang.below(low).astype(float), b)
        looked += n
    assert scale < 100 or looked < 0.7 * 5 * 300 * 24


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [0.0, 1.0, -0.0001, 2.0], 1), (5, [0.0, 1.0, -0.0001, 2.0], 1), (None, [9.0, 9.0, 9.0, 9.0], None), (7, None, 1), (8, [nan, 1.0, 1.0, 1.0], 1), (9, [1.0, None, 1.0, 1.0], 1),
        (10, [inf, 1.0, 1.0, 1.0], 1), (11, [1.0, 2.0], 2), (12, [], None), (13, [1e30, -1e30, 1e9, 1e5], 3)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for c in ("id", "q", "v", "codes", "copies", "error"):
        vectors = vectors.withColumn(c, F.lit(c))
    got = {(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in yinyang.encode(vectors).collect()}
    assert {(11, None, None, None), (12, None, None, 0), (13, "02020202", 0, 0)} <= got
    assert {r[0] for r in got} == {5, None, 11, 12, 13} and yinyang.encode(vectors).count() == 6
    assert next(r for r in got if r[0] == 5)[1:] == ("00000000", 0, 0)
    assert yinyang.encode(vectors.limit(0)).count() == 0
    assert yinyang.encode(vectors.where("vec_id = 12")).collect()[0]["code"] is None
    assert yinyang.encode(vectors.withColumn("vec_id", F.col("vec_id").cast("string"))).count() == 6
