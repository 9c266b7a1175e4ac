"""Search among quantised vectors, and building their table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, normalized, quantized, stored_norm


def encode(rows: DataFrame, vec_col: str = "embedding", id_col: str = "id") -> DataFrame:
    """id, vec array<int>, norm, dim of float vectors; null vectors are left out."""
    v = rows.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), quantized(normalized(F.col(vec_col))).alias("vec"))
    return v.select("id", "vec", stored_norm(F.col("vec")).alias("norm"), F.size("vec").alias("dim"))


def nearest(items: DataFrame, query: Sequence[int], query_norm: float, k: int = 200) -> DataFrame:
    """id, score of the k items of the query's dimension with the largest cosine; ties by id.

    The query is a literal, so items are scanned once, without a join, and each task keeps k of them.
    """
    q = F.array(*(F.lit(int(x)) for x in query))
    score = cosine(F.col("vec"), q, F.col("norm"), F.lit(float(query_norm or 1.0)))
    return items.where(F.col("vec").isNotNull() & (F.size("vec") == len(query))).select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


#: Rows of a stored block.
BLOCK = 4096
BLOCKS = "ids binary, vecs binary, norms binary, n int, dim int"


def blocks_of(items: DataFrame, rows: int = BLOCK) -> DataFrame:
    """ids, vecs, norms, n, dim: vectors (of ``encode``) of one length packed as binaries, a row for each block. A narrow job.

    Ids are 64-bit numbers, components bytes, norms double floats, all little-endian. Null vectors and ids are left out.
    """
    def run(batches):
        held: dict[int, list] = {}
        for pdf in batches:
            for dim, own in pdf.groupby("dim"):
                held.setdefault(int(dim), []).append(own)
                while sum(map(len, held[dim])) >= rows:
                    whole = pd.concat(held[dim])
                    yield packed(whole.iloc[:rows], dim)
                    held[dim] = [whole.iloc[rows:]]
        for dim, own in held.items():
            if sum(map(len, own)):
                yield packed(pd.concat(own), dim)

    def packed(pdf, dim):
        vecs = np.stack(pdf["vec"].to_numpy()).astype(np.int8) if dim else np.zeros((len(pdf), 0), np.int8)
        return pd.DataFrame({"ids": [pdf["id"].to_numpy("<i8").tobytes()], "vecs": [vecs.tobytes()], "norms": [pdf["norm"].to_numpy("<f8").tobytes()], "n": [len(pdf)], "dim": [dim]})

    given = items.where(F.col("vec").isNotNull() & F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), "vec", "norm", F.size("vec").alias("dim"))
    return given.mapInPandas(run, BLOCKS)


def nearest_in(blocks: DataFrame, queries: list[tuple[int, Sequence[int], float]], k: int = 200, within: DataFrame | None = None) -> DataFrame:
    """query, id, score, rank of the k items of each query's length with the largest cosine; ties by id.

    ``queries`` (number, vector, norm) are few enough to send; all of them meet a block in one matrix product, which is exact,
    as products of bytes sum up to whole numbers that single floats hold. Each task keeps k items a query. ``within``: ids
    (at most a million) that alone may be found.
    """
    by_dim: dict[int, list] = {}
    for q in queries:
        by_dim.setdefault(len(q[1]), []).append(q)
    sent = {d: (np.array([q[0] for q in own], np.int64), np.array([q[1] for q in own], np.float32).reshape(len(own), d), np.array([q[2] or 1.0 for q in own])) for d, own in by_dim.items()}
    wanted = None if within is None else np.sort(np.array([r["id"] for r in within.select("id").distinct().limit(1_000_001).collect()], np.int64))
    if wanted is not None and len(wanted) > 1_000_000:
        raise ValueError("within holds more than a million ids: join the result instead")

    def run(batches):
        best: dict[int, list] = {}
        for batch in batches:
            for ids, vecs, norms, n, dim in zip(*(batch.column(c).to_pylist() for c in ("ids", "vecs", "norms", "n", "dim"))):
                if dim not in sent:
                    continue
                numbers, asked, lengths = sent[dim]
                own, norm = np.frombuffer(ids, "<i8"), np.frombuffer(norms, "<f8")
                x = np.frombuffer(vecs, np.int8).reshape(n, dim)
                if wanted is not None:
                    keep = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, own), max(0, len(wanted) - 1))] == own) if len(wanted) else np.zeros(0, np.int64)
                    own, norm, x = own[keep], norm[keep], x[keep]
                exact = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64
                score = (asked.astype(exact) @ x.astype(exact).T).astype(np.float64) / (norm[None] * lengths[:, None])
                for i, number in enumerate(numbers.tolist()):
                    s, at = score[i], own
                    if number in best:
                        s, at = np.concatenate([best[number][0], s]), np.concatenate([best[number][1], at])
                    top = np.lexsort((at, -s))[:k]
                    best[number] = (s[top], at[top])
        for number, (s, at) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number)), pa.array(at), pa.array(s)], ["query", "id", "score"])

    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return blocks.mapInArrow(run, "query long, id long, score double").withColumn("rank", rank).where(F.col("rank") <= k)


def nearest_to(items: DataFrame, item_id: int, n: int = 8) -> DataFrame | None:
    """The n items most like one of them, without it; None if it has no vector."""
    own = items.where(F.col("id") == item_id).select("vec", "norm").first()
    if own is None:
        return None
    return nearest(items, own["vec"], own["norm"], n + 1).where(F.col("id") != item_id).limit(n)


def semantic_search(posts: DataFrame, items: DataFrame, query: Sequence[int], query_norm: float, filters=None, k: int = 200) -> DataFrame:
    """Posts with their score, best first; filters hold for vectors as for words, before the k best are taken."""
    from .search import filtered

    mine = filtered(posts, filters) if filters else posts
    hits = nearest(items.join(mine.select("id"), "id", "left_semi") if filters else items, query, query_norm, k)
    return mine.join(F.broadcast(hits), "id").orderBy(F.desc("score"), "id")


def eligible(posts: DataFrame, least_value: float = 4, least_length: int = 15) -> DataFrame:
    return posts.where((F.col("value") >= float(least_value)) & (F.length("text") >= least_length))


def queue(posts: DataFrame, indexed: DataFrame, n: int, least_value: float = 4) -> DataFrame:
    """The n most valuable eligible posts without a vector."""
    return eligible(posts, least_value).join(indexed.select("id"), "id", "left_anti").orderBy(F.desc("value"), "id").limit(n)


def build(posts: DataFrame, embedder: Callable[[list[str]], list[list[float]]], model: str, batch: int = 16, most: int = 512) -> DataFrame:
    """id, vec, norm, dim, model of posts, by a callable that takes a batch of texts cut to ``most`` characters."""
    most, batch = min(2000, max(64, most)), min(128, max(1, batch))

    def run(pdfs):
        for pdf in pdfs:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                yield pd.DataFrame({"id": part["id"], "embedding": [list(map(float, v)) for v in embedder(part["text"].tolist())]})

    raw = posts.select("id", F.substring("text", 1, most).alias("text")).mapInPandas(run, "id long, embedding array<double>")
    return encode(raw).withColumn("model", F.lit(model))


def consistent(items: DataFrame) -> bool:
    """Whether all vectors are of one model and dimension."""
    return items.select("model", "dim").distinct().limit(2).count() <= 1


def stats(items: DataFrame) -> DataFrame:
    return items.agg(F.count("*").alias("n"), F.min("dim").alias("dim"), *([F.max("model").alias("model")] if "model" in items.columns else []))


def progress(posts: DataFrame, items: DataFrame, least_value: float = 4) -> DataFrame:
    """eligible, indexed, left, percent (whole, 100 at most) of building the vectors: one row."""
    own = items.select("id").distinct().withColumn("_has", F.lit(1))
    rows = eligible(posts, least_value).select("id").join(own, "id", "left").agg(F.count("*").alias("eligible"), F.count("_has").alias("indexed"))
    percent = F.when(F.col("eligible") > 0, F.least(F.lit(100), F.floor(F.col("indexed") * 100 / F.col("eligible")))).otherwise(100)
    return rows.select("eligible", "indexed", (F.col("eligible") - F.col("indexed")).alias("left"), percent.cast("int").alias("percent"))


def reranked(posts: DataFrame, items: DataFrame, query: Sequence[int], query_norm: float, scorer: Callable[[list[str]], list[float]], recall: int = 50, k: int = 10, most: int = 1200) -> tuple[DataFrame, str]:
    """The k best of ``recall`` neighbours in the order of a scorer, and its error ('' if none).

    The scorer takes the recalled texts, cut to ``most`` characters, and gives each a score; if it fails, the
    neighbours' own order stands. The driver holds ``recall`` texts at most, whatever the size of the tables.
    """
    hits = nearest(items, query, query_norm, max(recall, k))
    pool = posts.join(F.broadcast(hits), "id").select("id", "score", F.substring("text", 1, most).alias("text")).orderBy(F.desc("score"), "id").collect()
    error, scores = "", [0.0] * len(pool)
    try:
        scores = [float(x) for x in scorer([r["text"] or "" for r in pool])]
        if len(scores) != len(pool):
            raise ValueError("a score for each text is needed")
    except Exception as e:  # noqa: BLE001  the scorer is foreign code and only improves the order
        error, scores = str(e), [0.0] * len(pool)
    best = sorted(range(len(pool)), key=lambda i: (-scores[i], i))[:k]
    rows = [(pool[i]["id"], float(pool[i]["score"]), scores[i], n) for n, i in enumerate(best, 1)]
    return posts.sparkSession.createDataFrame(rows, "id long, score double, rerank double, rank int"), error
