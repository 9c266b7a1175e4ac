"""Ids, columns and words come through as they are, whatever stands beside them."""

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sievework.llm import bpe, jaccard, media, packing, pii, quality, sharding, toxicity, vptree, wordbytes

BIG = 2**60 + 1
MADE = ("score", "predicted", "evidence", "prior", "p_low", "keep", "_host", "_path", "_id", "_h", "_g", "_spans", "spans", "base", "other", "h", "i", "id")


def thue_morse(k):
    a = "a"
    for _ in range(k):
        a += a.translate(str.maketrans("ab", "ba"))
    return a


def test_words_of_one_shape_have_their_own_hashes():
    for k in (3, 4, 5, 6, 10):
        a = thue_morse(k)
        raw = (a + " " + a.translate(str.maketrans("ab", "ba"))).encode()
        data, n = np.frombuffer(raw, np.uint8), len(a)
        h = wordbytes.hashes(data, np.array([0, n + 1]), np.array([n, 2 * n + 1]))
        assert h[0] != h[1]
        again = wordbytes.hashes(data[n + 1 :], np.array([0]), np.array([n]))
        assert again[0] == h[1]


def test_long_words_and_thue_morse_words_encode_as_the_library_does():
    found = bpe.SpeculativeBpe(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a = thue_morse(10)
    texts = [a, a.translate(str.maketrans("ab", "ba")), "ab" * 30000, "the" * 20000 + "q"]
    for got, t in zip(found.encode_batch(texts), texts):
        assert got.tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["packing", "bpe", "media", "jaccard", "toxicity", "sharding", "pii", "quality"])
def test_ids_beside_nulls(spark, name):
    docs = spark.createDataFrame([(BIG, "one two three four"), (None, "five six seven"), (BIG + 1, None)], "doc_id long, text string").withColumn("source", F.lit("s")).withColumn("lang", F.lit("l")).coalesce(1)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    run = {
        "packing": lambda: packing.pack(packing.pieces(docs)), "bpe": lambda: bpe.round_trip(docs), "media": lambda: media.digests(docs), "jaccard": lambda: jaccard.join(docs),
        "toxicity": lambda: toxicity.classify(docs, none), "sharding": lambda: sharding.shard(docs), "pii": lambda: pii.report(docs), "quality": lambda: quality.judge(docs, none),
    }
    assert {r["doc_id"] for r in run[name]().collect()} == {BIG, BIG + 1, None}


def test_string_ids(spark):
    docs = spark.createDataFrame([("b", "one two three four"), ("a", "One two three four"), ("c", "other words")], "doc_id string, text string")
    assert {tuple(r) for r in jaccard.join(docs).collect()} == {("a", 2, "a"), ("b", 2, "a"), ("c", 1, "c")}
    vectors = spark.createDataFrame([("x", [1.0, 0.0]), ("20", [1.0, 0.0]), ("3", [0.5, 0.5])], "vec_id string, embedding array<double>")
    assert [tuple(r) for r in vptree.nearest(vectors, F.col("vec_id") == "20").collect()] == [(20, 1, 3, 0.5)]


def test_vectors_of_other_lengths_are_no_candidates(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0, 1.0]), (2, [1.0]), (3, [0.5, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in vptree.nearest(vectors, F.col("vec_id") == 0).collect()] == [(0, 1, 3, 0.5)]


def test_stages_leave_clashing_columns_alone(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some words of document {i} mail me at u{i}@example.com please", "en", "src", 50) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    for c in MADE:
        docs = docs.withColumn(c, F.concat(F.lit(f"my {c} "), F.col("doc_id").cast("string")))
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, str(tmp_path)).toPandas()
        assert list(rows.columns) == docs.columns and len(rows)
        for c in MADE:
            assert (rows[c] == f"my {c} " + rows["doc_id"].astype(str)).all()


def test_large_families_are_dealt_in_parts(spark, monkeypatch):
    """Near copies of one text in parts of a few members give the classes that one task gives."""
    from tests.llm.test_contracts import linked

    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(90):
        own = list(words)
        for k in rng.integers(0, 60, rng.integers(0, 4)):
            own[k] = f"x{rng.integers(0, 9)}"
        texts.append(" ".join(own))
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    want = linked(docs, 3, 90)
    for name, value in (("PART", 8), ("SHARE", 10), ("LEAST_HEAVY", 10**9)):
        monkeypatch.setattr(jaccard, name, value)
    got = jaccard.join(spark.createDataFrame(docs)).toPandas()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == want


@pytest.mark.parametrize(("percent", "parts"), [(90, 1), (80, 1), (60, 3)])
def test_bitmaps_move_only_for_what_may_link(percent, parts):
    """Of every linked pair both are left in the list of their first common token; of sets that share the last token of their prefixes none."""
    rng = np.random.default_rng(percent)
    sets, none = [], np.zeros(0, np.int64)
    for _ in range(60):
        own = np.unique(rng.integers(-(2**62), 2**62, rng.integers(1, 80)))
        for _ in range(3):
            sets.append(own)
            own = np.unique(np.append(own[rng.random(len(own)) > 0.05], rng.integers(-(2**62), 2**62, rng.integers(0, 4))))
            own = own if len(own) else sets[-1]
    first, late = len(sets), 2**61 + np.arange(3)
    before = 80 - -(-percent * 80 // 100)
    sets += [np.concatenate([np.sort(rng.integers(0, 2**60, before)), rng.choice(late, 1), np.sort(rng.integers(2**61 + 9, 2**62, 79 - before))]) for _ in range(60)]
    rows = []
    for node, own in enumerate(sets):
        for at, token in enumerate(jaccard.prefix(own, none, percent)):
            p = node % parts
            rows += [(node, len(own), at, token, min(p, q), max(p, q), int(p > q)) for q in range(parts)]
    lists = pd.DataFrame(rows, columns=["node", "size", "at", "token", "i", "j", "part"]).sort_values(["token", "i", "j", "size"], ignore_index=True)
    left = lists[jaccard.matched(lists, percent)]
    met = {}
    for (_, i, j), g in left.groupby(["token", "i", "j"]):
        for a in g.itertuples():
            for b in g.itertuples():
                if a.node < b.node and (i == j or a.part != b.part):
                    met[a.node, b.node] = True
    for a, one in enumerate(sets):
        for b in range(a + 1, len(sets)):
            shared = len(np.intersect1d(one, sets[b]))
            if shared and 100 * shared >= percent * (len(one) + len(sets[b]) - shared):
                assert (a, b) in met
    assert lists["token"].isin(late).sum() >= 60 and not (left["node"] >= first).any()
