"""Labels that contradict each other, ids with unlike texts, empty stages, and tables that go in the end."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievework.llm import pii, quality, tables, toxicity
from tests.conftest import SMALL


def test_labels_that_contradict_each_other(spark):
    rows = [(i, f"vile nasty words {i} of a kind" if i % 2 else f"kind and quiet words {i} here") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s")).withColumn("lang", F.lit("l"))
    once = [(i, 1 - i % 2, i % 2) for i in range(40)]
    labels = spark.createDataFrame(once, "doc_id long, quality int, toxic int")
    # said twice, or the other way round as well for one: repeated labels count once, a low or toxic one wins
    again = labels.unionByName(labels).unionByName(spark.createDataFrame([(1, 1, 0), (None, 0, 1), (2, None, None)], labels.schema))
    sort = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    assert sort(toxicity.classify(docs, again), "doc_id", "score", "predicted") == sort(toxicity.classify(docs, labels), "doc_id", "score", "predicted")
    assert sort(quality.judge(docs, again), "doc_id", "p_low") == sort(quality.judge(docs, labels), "doc_id", "p_low")


def test_an_id_with_unlike_texts(spark):
    rows = [(1, "mail a1@example.org now"), (1, "no data"), (1, "call +49 30 1234567 now"), (None, "mail b2@example.org"), (None, None)]
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, ""), (0, "mail [EMAIL]"), (1, "call [PHONE] now"), (1, "mail [EMAIL] now"), (1, "no data")]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_nulls_and_nothing(spark, name, stage):
    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = [(None, None, None, None, None), (None, "", "", None, 0), (1, None, "en", "src0", None), (2, "a few words alone", None, None, 17), (2, "a few words alone", None, None, 17)]
    docs = spark.createDataFrame(odd, given.schema)
    kept = stage(spark, docs, SMALL)
    assert stage(spark, docs.limit(0), SMALL).count() == 0
    if (name, stage) != corpus_pipeline.STAGES[-1]:
        assert kept.columns == docs.columns
        assert kept.count() == (4 if name.startswith("n-gram") else 5)
    else:
        assert kept.count() == 5


def test_tables_go_in_the_end(spark):
    scratch = tables.Scratch(spark, "gone")
    kept = scratch.keep(spark.range(3))
    assert kept.count() == 3 and tables.clear(spark) is True and tables.clear(spark) is False
