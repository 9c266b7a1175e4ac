"""The pipeline's stages against brute force."""

import re

import pandas as pd

import corpus_pipeline
from sievework.llm import pii, quality, toxicity
from tests.conftest import SMALL
from tests.llm.test_contracts import base_spans, linked


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {}
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        before = rows.toPandas()
        rows = stage(spark, rows, SMALL)
        after = rows.toPandas()
        kept[name] = (before, after)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert rows.columns == docs.columns
            rows = spark.createDataFrame(after, docs.schema)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    before, after = kept["quality classifier"]
    want = quality.judge(docs, labels).where("p_low < 0.5").toPandas()
    assert set(after["doc_id"]) == set(want["doc_id"]) and 0.5 * len(before) < len(after) < len(before)
    before, after = kept["toxicity"]
    d = spark.createDataFrame(before, docs.schema)
    scored = toxicity.score(d, toxicity.fit(d, labels)).toPandas()
    assert set(after["doc_id"]) == set(scored[scored["score"] < 0.5]["doc_id"])
    before, after = kept["n-gram Jaccard join"]
    assert set(after["doc_id"]) == {i for i, (_, c) in linked(before, 5, 80).items() if i == c}
    before, after = kept["personal data"]
    texts = after.set_index("doc_id")["text"]
    extra = {r["doc_id"]: [s for s in r["spans"].split(",") if s.startswith("other")] for r in pii.report(spark.createDataFrame(before, docs.schema)).collect()}
    for i, t in zip(before["doc_id"], before["text"]):
        if pd.isna(t):
            assert pd.isna(texts[i])
            continue
        spans = sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in base_spans(t) + extra[i]))
        out, at = "", 0
        for s, e, k in spans:
            if s >= at:
                out += t[at:s] + f"[{k.upper()}]"
            at = max(at, e)
        assert texts[i] == out + t[at:]
    assert not texts.dropna().map(lambda t: bool(re.search(r"@[a-z]+\.(com|org|net)", t))).any()
    before, after = kept["best-fit packing"]
    assert set(after["doc_id"]) == set(before["doc_id"]) and after.groupby("sequence_id")["length"].sum().max() <= 2048
