"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from sievework.llm import bpe, jaccard, media, packing, pii, quality, sharding, toxicity, url_rules, vptree

CLASHING = ("id", "h", "node", "size", "piece", "score", "keep", "label", "found", "shard", "spans", "token")
LONG = "one two 123 " * 20000
TEXTS = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "same text of five words"), (6, "same text of five words"), (6, "same text of five words"), (None, "no id here at all"), (7, LONG), (8, "é𝒳 \x00 mail x1@y.org")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("source", F.when(F.col("doc_id") > 3, "s")).withColumn("lang", F.lit(None).cast("string"))
    for c in CLASHING:
        rows = rows.withColumn(c, F.lit(c))
    return rows


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 1), (6, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


PER_ROW = {
    "bpe": lambda d, la: bpe.round_trip(d),
    "quality": lambda d, la: quality.judge(d, la),
    "pii": lambda d, la: pii.report(d),
    "redact": lambda d, la: pii.redact(d),
    "media": lambda d, la: media.digests(d),
    "store": lambda d, la: media.inspect(media.store(d)),
    "toxicity": lambda d, la: toxicity.classify(d, la),
    "sharding": lambda d, la: sharding.shard(d),
    "jaccard": lambda d, la: jaccard.join(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_every_row_has_a_result(docs, labels, name):
    assert PER_ROW[name](docs, labels).count() == len(TEXTS)


@pytest.mark.parametrize("name", PER_ROW)
def test_no_rows_give_none(docs, labels, name):
    assert PER_ROW[name](docs.limit(0), labels).count() == 0


def test_packing_edges(docs):
    rows = packing.pack(packing.pieces(docs)).toPandas()
    assert rows.groupby("sequence_id")["length"].sum().max() <= 2048
    assert len(rows[rows["doc_id"] == 6]) == 2 and (rows[rows["doc_id"].isin([1, 2, 3])]["length"] == 1).all()
    assert packing.pack(packing.pieces(docs.limit(0))).count() == 0


def test_jaccard_edges(docs):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(docs).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 3, 5), (6, 3, 5), (7, 3, 7)} <= got


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://WWW.Example.NET/en/x?q#f"), (4, "HTTP://WWW.Example.NET/en/x?q#f"), (5, "x://badnet/"), (6, "a://"), (None, "https://b.org/fr/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("tokens", F.lit(1))
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(pages).collect()]
    assert len(got) == len(rows)
    assert (1, "", "", None, "allow") in got and got.count((4, "www.example.net", "/en/x", "example.net/en/", "allow")) == 2
    assert (None, "b.org", "/fr/", "org/fr/", "allow") in got and (5, "badnet", "/", None, "allow") in got
    assert url_rules.judge(pages.limit(0)).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, -1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = [tuple(r) for r in vptree.nearest(vectors, F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]
    assert vptree.nearest(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_malformed_media(spark):
    rows = spark.createDataFrame([(1, None), (2, bytearray()), (3, bytearray(b"\0\0\0\7moov")), (4, bytearray(media.contain(b"x" * 64)[:200]))], "doc_id long, media binary")
    assert media.inspect(rows).where("codec is null").count() == 4
