"""Stored posts against the same posts taken whole."""

import pytest
from pyspark.sql import functions as F

from sievework.adapter import posts
from sievework.operators import cluster as K
from sievework.operators import facets, index, search
from sievework.sources.versions import Versions
from sievework.streaming.store import PostStore, counted
from tests.conftest import SMALL

PHRASES = [["the"], ["of", "the"]]


@pytest.fixture(scope="module")
def all_posts(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("posts") / "t")
    posts(spark, SMALL).write.parquet(path)
    return spark.read.parquet(path)


def rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_segments_rank_as_one_build(spark, tmp_path, all_posts):
    whole = index.build(all_posts, str(tmp_path / "whole"))
    versions = Versions(spark, str(tmp_path / "parts"))
    step = lambda change: versions.commit(versions.current(), *change(versions.current()))
    step(lambda v: index.added(versions, v, all_posts.where("id % 10 < 5").withColumn("text", F.when(F.col("id") % 2 == 0, "of the old text of the").otherwise(F.col("text")))))
    step(lambda v: index.added(versions, v, all_posts.where("id % 10 = 5")))
    step(lambda v: index.added(versions, v, all_posts.where("id % 10 < 5 and id % 2 = 0"), replace=True))
    step(lambda v: index.added(versions, v, all_posts.where("id % 10 > 5 and id % 10 < 8").withColumn("text", F.lit("to go"))))
    step(lambda v: index.removed(versions, v, all_posts.where("id % 10 = 6")))
    step(lambda v: index.added(versions, v, all_posts.where("id % 10 = 6 or id % 10 >= 8")))
    step(lambda v: index.added(versions, v, all_posts.where("id % 10 = 7"), replace=True))
    for phrases in (PHRASES, [["the"], ["and"]], [["nowhere"]]):
        for every in (True, False):
            want = rows(index.ranked(whole, phrases, every))
            assert rows(index.ranked(index.view(Versions(spark, versions.root)), phrases, every)) == want  # opened anew
            assert rows(index.ranked(index.Index.of(all_posts, sorted({w for p in phrases for w in p})), phrases, every)) == want
    want = rows(index.ranked(whole, PHRASES))
    step(lambda v: index.compacted(versions, v))
    now = versions.current()
    assert len(now.tables["postings"]) == 1 and "gone" not in now.tables and want
    assert rows(index.ranked(index.view(versions), PHRASES)) == want
    assert versions.clean() > 10
    assert rows(index.ranked(index.view(versions), PHRASES)) == want


def test_batches_join_clusters_as_posts_one_by_one(spark, tmp_path, all_posts):
    one = K.joined(K.cluster(all_posts).limit(0), all_posts)
    store = PostStore(spark, str(tmp_path / "store"))
    ids = [r["id"] for r in all_posts.select("id").orderBy("id").collect()]
    for k, (a, b) in enumerate([(0, 40), (40, 41), (41, 150), (150, len(ids))]):
        part = all_posts.where(F.col("id").between(ids[a], ids[b - 1]))
        assert store.append(part, "s", k) == b - a
        store = PostStore(spark, store.versions.root)
        assert store.append(part, "s", k) == 0 == store.append(part)  # sent again; and without a number
    columns = ["id", "rep_id", "cluster_size", "is_rep"]
    want = rows(one.where("is_rep").select(*columns))
    assert rows(store.posts().where("is_rep").select(*columns)) == want
    assert rows(store.posts().select("id", "rep_id", "is_rep")) == rows(one.select("id", "rep_id", "is_rep"))
    assert rows(store.counts()) == rows(counted(one))
    assert rows(search.search(store.posts(), "the", index=store.index()).hits.select("id", "rank")) == rows(search.search(one, "the").hits.select("id", "rank"))
    store.compact()
    assert rows(store.counts()) == rows(counted(one)) and rows(store.posts().where("is_rep").select(*columns)) == want
    store.recluster()
    again = K.cluster(all_posts)
    assert rows(store.posts().select(*columns)) == rows(again.select(*columns))
    assert rows(store.counts()) == rows(counted(again)) and rows(store.totals()) == rows(facets.totals(again))
    assert rows(store.facet("tag", "tag", 40)) == rows(facets.tag_histogram(again)) and rows(store.facet("category", "category")) == rows(facets.by_category(again))


def test_a_batch_cut_off_leaves_nothing(spark, tmp_path, all_posts, monkeypatch):
    store = PostStore(spark, str(tmp_path / "store"))
    store.append(all_posts.where("id % 2 = 0"), "s", 0)
    before = rows(store.posts().select("id", "rep_id"))
    monkeypatch.setattr(index, "added", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.append(all_posts, "s", 1)
    assert rows(store.posts().select("id", "rep_id")) == before and store.versions.current().facts["batches"] == {"s": 0}
    monkeypatch.undo()
    assert store.append(all_posts, "s", 1) == all_posts.where("id % 2 <> 0").count()
    assert store.posts().count() == all_posts.count() == store.counts().where("kind = 'posts'").first()["n"]


def test_a_stream_restarts_in_mid_batch(spark, tmp_path, all_posts, monkeypatch):
    given, root, checkpoint = (str(tmp_path / n) for n in ("given", "store", "checkpoint"))
    all_posts.drop("id").where("msg_id % 2 = 0").coalesce(1).write.parquet(given)
    start = lambda: PostStore(spark, root).ingest(spark.readStream.schema(all_posts.drop("id").schema).option("maxFilesPerTrigger", 1).parquet(given), checkpoint)
    start().awaitTermination()
    all_posts.drop("id").where("msg_id % 3 = 0").coalesce(1).write.mode("append").parquet(given)
    commit = Versions.commit
    monkeypatch.setattr(Versions, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception, match="lost"):
        start().awaitTermination()
    monkeypatch.setattr(Versions, "commit", commit)
    start().awaitTermination()
    got = PostStore(spark, root).posts()
    want = all_posts.where("msg_id % 2 = 0 or msg_id % 3 = 0").count()
    assert got.count() == want == got.select("channel", "msg_id").distinct().count()
    assert rows(got.select("id")) == [(i,) for i in range(1, want + 1)]


def test_empty_batches_and_nulls(spark, tmp_path, all_posts):
    store = PostStore(spark, str(tmp_path / "store"))
    assert store.append(all_posts.limit(0), "s", 0) == 0
    odd = all_posts.limit(3).withColumn("channel", F.lit(None).cast("string")).withColumn("text", F.lit(None).cast("string")).withColumn("tags", F.lit(None).cast("array<string>"))
    assert store.append(odd.withColumn("msg_id", F.lit(7).cast("long"))) == 1
    assert store.append(odd) == 3 and store.counts().where("kind = 'posts'").first()["n"] == 4
