from pyspark.sql import functions as F

from sievework.functions import text, urls
from sievework.operators import cluster


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normalize_text(spark):
    assert one(spark, text.normalize_text(F.lit(" a​ \t b\n\n\nc "))) == "a b\nc"
    assert one(spark, text.normalize_text(F.lit(None).cast("string"))) == ""


def test_grams_part_ideographs(spark):
    assert one(spark, text.to_gram(F.lit("开源vps"))) == "开 源 vps"


def test_view_count(spark):
    assert one(spark, text.view_count(F.lit("1.2K"))) == 1200
    assert one(spark, text.view_count(F.lit("many"))) is None


def test_normalize_url_drops_tracking(spark):
    a, b = (one(spark, urls.normalize_url(F.lit(u))) for u in ("https://www.example.com/a/b/?utm_source=x", "http://example.com/a/b"))
    assert a == b is not None


def test_clusters_need_two_channels(spark):
    rows = [(1, "a", "k", 1.0, "x"), (2, "b", "k", 5.0, "y"), (3, "a", "m", 1.0, "x"), (4, "a", "m", 2.0, "x"), (5, "a", None, 1.0, "x")]
    posts = spark.createDataFrame(rows, "id long, channel string, cluster_key string, value double, text string")
    got = {r["id"]: (r["rep_id"], r["cluster_size"], r["is_rep"]) for r in cluster.cluster(posts).collect()}
    assert got == {1: (2, 2, False), 2: (2, 2, True), 3: (3, 1, True), 4: (4, 1, True), 5: (5, 1, True)}
