"""Shortest-pack-first against the tokenizer, and its sequences token by token."""

import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievework.llm import histogram_packing as hp
from sievework.llm import registry
from tests.conftest import SMALL


def tokens(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def hold(got, capacity=1024):
    """Sequences are gapless from 0 and full or powers of two."""
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert (rows["offset"].to_numpy() == (rows["length"].cumsum() - rows["length"]).to_numpy()).all()
        fill = int(rows["length"].sum())
        assert fill <= capacity and fill & (fill - 1) == 0


def test_query(spark):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    got = registry.queries()["op12_histogram_packing"](spark, SMALL).toPandas()
    hold(got)
    by_doc = dict(list(got.sort_values("start").groupby("doc_id")))
    assert len(by_doc) == len(docs)
    for i, text in zip(docs["doc_id"], docs["text"]):
        ids, at = tokens(text), 0
        for r in by_doc[i].itertuples():
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 1024) + 10 + (got.groupby("sequence_id")["length"].sum() < 1024).sum()


@pytest.mark.parametrize("seed", range(5))
def test_patterns_hold_the_histogram(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 64): rng.randint(1, 10 ** rng.randint(0, 6)) for _ in range(40)}
    patterns = hp.shortest_pack_first(histogram, 64)
    held: dict[int, int] = {}
    for p in patterns:
        assert p.count > 0 and p.fill <= 64 and p.lengths == sorted(p.lengths, reverse=True)
        for x in p.lengths:
            held[x] = held.get(x, 0) + p.count
    assert held == histogram
    plan = hp.layout(patterns, 64)
    place, size, sequence, offset = plan.gaps
    key, count, _, _ = plan.slots
    for x, n in histogram.items():  # loose pieces and slots take each rank once
        own = sorted((int(k) & (1 << hp.RANK_BITS) - 1, int(c)) for k, c in zip(key, count) if int(k) >> hp.RANK_BITS == x)
        rank = plan.loose.get(x, (0, 0))[1]
        for first, c in own:
            assert first == rank
            rank += c
        assert rank == n


def test_longest_first_in_the_shortest_pack():
    assert [(p.count, p.lengths) for p in hp.shortest_pack_first({6: 2, 5: 1, 3: 3, 2: 1}, 10)] == [(1, [5, 3, 2]), (2, [6, 3])]


def test_edges(spark):
    texts = [(1, None), (2, ""), (3, "a"), (4, "some words " * 9000), (None, "no id"), (None, "no id"), (5, "same"), (5, "same"), (6, "é𝒳 <|endoftext|> \x00")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for c in ("ids", "length", "rank", "task", "offset", "Start"):
        docs = docs.withColumn(c, F.lit(c))
    got = hp.pack(docs).toPandas()
    hold(got)
    assert got["length"].sum() == sum(len(tokens(t)) for _, t in texts)
    assert got["doc_id"].isna().sum() >= 2 and set(got["doc_id"].dropna()) == {1, 2, 3, 4, 5, 6}
    assert hp.pack(docs.limit(0)).count() == 0
    assert set(hp.pack(docs.withColumn("doc_id", F.concat(F.lit("k"), F.col("doc_id")))).toPandas()["doc_id"].dropna()) == {f"k{i}" for i in range(1, 7)}


def test_new_words_are_the_librarys():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["", " ", "don't we'll 's ' 's  ''x", " a\n b\t\tc  d\r\n", "x" * 3000 + " " + "yz" * 2000, "\n\n  lead", "12 3a4 $%& a-b", "Ünïcode Ärger ß 漢字 　 é́ ", "tail  ", "<|endoftext|> a <|endoftext|>", "\x00 \x7f a", " q" * 500]
    own = hp.LibraryBpe(path)
    for few in (texts, texts[::-1], [t for t in texts for _ in range(2)]):
        assert [x.tolist() for x in own.encode_batch(few)] == [library.encode(t, add_special_tokens=False).ids for t in few]
