"""Each query over a whole small table against a brute-force version."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievework.llm import jaccard, pii, quality, registry, toxicity, vptree
from tests.conftest import SMALL

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def run(spark, name):
    return registry.queries()[name](spark, SMALL).toPandas()


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SMALL}/documents.parquet")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 13 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def linked(docs, n, percent):
    """doc_id: (size, component) by comparing all pairs of different sets."""
    sets = {i: shingles(t, n) for i, t in zip(docs["doc_id"], docs["text"])}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = defaultdict(list)
    for i, s in sets.items():
        if s:
            by[frozenset(s)].append(i)
    own = sorted(by.items(), key=lambda x: len(x[0]))
    for ids in by.values():
        for i in ids:
            a, b = sorted((root(i), root(ids[0])))
            parent[b] = a
    for x, (s, ids) in enumerate(own):
        for t, others in own[x + 1 :]:
            if 100 * len(s) < percent * len(t):
                break
            k = len(s & t)
            if 100 * k >= percent * (len(s) + len(t) - k):
                a, b = sorted((root(ids[0]), root(others[0])))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_packing(spark, docs):
    got = run(spark, "op1_packing")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, t in zip(docs["doc_id"], docs["text"].fillna("")):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            want[i, k // 2048] = (k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want and len(got) == len(want)
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert (rows["offset"].to_numpy() == (rows["length"].cumsum() - rows["length"]).to_numpy()).all()
        assert rows["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 2048) * 1.01 + 1


def test_neighbours(spark):
    table = pd.read_parquet(f"{SMALL}/embeddings.parquet")
    got = run(spark, "op2_neighbours").set_index(["query_id", "rank"]).sort_index()
    x, ids = np.stack(table["embedding"]).astype(float), table["vec_id"].to_numpy()
    for q in ids[ids % 20 == 0]:
        score = (x * x[ids == q][0]).sum(1)
        score[ids == q] = -np.inf
        top = np.lexsort((ids, -np.round(score, 10)))[:20]
        own = got.loc[q]
        assert np.allclose(own["score"], score[top], rtol=1e-12, atol=1e-12)
        assert set(own["vec_id"]) == set(ids[top])
        assert own.index.tolist() == list(range(1, len(own) + 1))


def test_neighbours_of_relaxed_search_are_mostly_right(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    exact, fast = (vptree.nearest(table, F.col("vec_id") % 20 == 0, factor=f, shard=200, block=10, leaf=8).toPandas() for f in (1.0, 1.3))
    pairs = [set(zip(f["query_id"], f["vec_id"])) for f in (exact, fast)]
    assert len(pairs[0] & pairs[1]) >= 0.9 * len(pairs[0])


def test_url_rules(spark):
    pages = pd.read_parquet(f"{SMALL}/pages.parquet").set_index("page_id")
    got = run(spark, "op3_url_rules")
    assert len(got) == len(pages)
    for r in got.itertuples():
        url = pages.loc[r.page_id, "url"]
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [k for k in RULES if (host == k.split("/", 1)[0] or host.endswith("." + k.split("/", 1)[0])) and path.startswith("/" + k.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        assert (r.host, r.path, None if pd.isna(r.rule) else r.rule) == (host, path, rule)
        assert r.verdict in ("allow", "block") and (rule is None or r.verdict == RULES[rule])


def test_bpe(spark, docs):
    got = run(spark, "op4_bpe").set_index("doc_id")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    assert len(got) == len(docs)
    for i, t in zip(docs["doc_id"], docs["text"].fillna("")):
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        assert tuple(got.loc[i, ["n_tokens", "ids_sha256", "decoded_sha256"]]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_quality_separates_held_out_documents(spark, docs):
    labels = pd.read_parquet(f"{SMALL}/../sf0.01/labels.parquet")
    d = spark.read.parquet(f"{SMALL}/../sf0.01/documents.parquet")
    known = spark.createDataFrame(labels[["doc_id", "quality"]])
    got = quality.judge(d, known.where("doc_id % 3 <> 0")).select("doc_id", "p_low").toPandas().merge(labels[labels["doc_id"] % 3 == 0], on="doc_id")
    low, good = got[got["quality"] == 0]["p_low"].to_numpy(), got[got["quality"] == 1]["p_low"].to_numpy()
    assert (low[:, None] > good[None]).mean() + 0.5 * (low[:, None] == good[None]).mean() > 0.8


def test_personal_data(spark, docs):
    got = run(spark, "op6_pii").set_index("doc_id")
    for i, t in zip(docs["doc_id"], docs["text"].fillna("")):
        want = base_spans(t)
        row = got.loc[i]
        assert row["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [row[f"n_{k}"] for k in BASE] == [sum(s.startswith(k) for s in want) for k in BASE]
        assert row["spans"].split(",")[: len(want)] == want or not want


def test_personal_data_patterns_on_random_texts(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "Z", ".", "1", "22", "255", "4111 1111 1111 1111", "@", "-", "+", " ", "(", ")", "é", "𝒳", "_", "%", "\n"]) for _ in range(rng.randrange(60))) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [f"{x['kind']}:{x['s']}:{x['e']}" for x in r["b"]] for r in rows.select("doc_id", pii.base_spans("text").alias("b")).collect()}
    assert all(got[i] == base_spans(t) for i, t in enumerate(texts))


def test_patterns_find_unseen_identifiers(spark):
    seeds = [(i, f"please mail to user{i + 1000}@example.com for more news {i}") for i in range(12)]
    new = [(100, "please mail to AB-99887766 for more"), (101, "the room has 12345678 lights in it")]
    got = {r["doc_id"]: r for r in pii.report(spark.createDataFrame(seeds + new, "doc_id long, text string")).collect()}
    assert got[100]["spans"] == "other:15:26" and got[100]["n_other"] == 1
    assert got[101]["spans"] == ""


def test_media(spark, docs):
    got = run(spark, "op7_media").set_index("doc_id")
    for i, t in zip(docs["doc_id"], docs["text"].fillna("")):
        raw = t.encode()
        pad = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got.loc[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        assert r["media_bytes"] > len(pad)


def test_toxicity_on_held_out_labels(spark):
    d = f"{SMALL}/../sf0.1"
    got = registry.queries()["op8_toxicity"](spark, d).toPandas().merge(pd.read_parquet(f"{d}/labels.parquet"), on="doc_id")
    held = got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)
    assert (held == got["held_out"]).all() and got["score"].between(0, 1).all()
    own = got[held]
    bad, fine = own[own["toxic"] == 1]["score"].to_numpy(), own[own["toxic"] == 0]["score"].to_numpy()
    assert (bad[:, None] > fine[None]).mean() > 0.95
    assert (own["predicted"] == own["toxic"]).mean() > 0.95


def test_sharding(spark, docs):
    got = run(spark, "op9_sharding")
    raw = docs.set_index("doc_id")["text"].fillna("").map(str.encode)
    assert len(got) == len(docs) and set(got["law"]) == {"rows"} and got["grown_shard"].isna().all()
    for i, size, crc in zip(got["doc_id"], got["size"], got["text_crc32"]):
        assert (size, crc) == (len(raw[i]) + 16, zlib.crc32(raw[i]))
    count = got.groupby("shard").size()
    assert set(count.index) == set(range(40)) and count.max() - count.min() <= 1
    for _, rows in got.groupby("shard"):
        assert sorted(rows["slot"]) == list(range(len(rows)))


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(spark, n, percent):
    table = spark.read.parquet(f"{SMALL}/../sf0.01/documents.parquet")
    got = jaccard.join(table, n=n, percent=percent).toPandas()
    want = linked(pd.read_parquet(f"{SMALL}/../sf0.01/documents.parquet"), n, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == want


def test_ngram_join_of_drifting_copies(spark):
    """Chains of near copies, long lists of equal phrases and sizes at the very threshold."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = []
    for _ in range(25):
        words = [word() for _ in range(rng.randrange(2, 120))]
        for _ in range(rng.randrange(1, 12)):
            texts.append(" ".join(words))
            words[rng.randrange(len(words))] = word()
    shared = " ".join(word() for _ in range(60))
    texts += [f"{shared} {' '.join(word() for _ in range(rng.randrange(3, 40)))}" for _ in range(60)]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    got = jaccard.join(spark.createDataFrame(docs)).toPandas()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == linked(docs, 3, 90)


def test_toxicity_needs_no_labels(spark, docs):
    d = spark.createDataFrame(docs[["doc_id", "text"]].head(20))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.classify(d, none).agg(F.max("predicted")).first()[0] == 0
