"""Vector codes: each part of a vector becomes the number of its nearest codebook entry, by Yinyang Lloyd.

The entries of a codebook are clustered into groups. For each part of a vector one lower bound a group is kept of
the distance to the group's other entries, besides the distance to its own entry. When entries have moved, a group's
bound falls by the furthest move in the group; only groups whose bound no longer exceeds the distance to the own
entry are scanned. Distances are compared as whole numbers, and a group that could hold an equally near entry is
always scanned, so that ties go to the lower index exactly as in a full search.

Vectors stay where they are: an iteration is a narrow job that writes codes and bounds, then one row of sums for
each task and entry. Only codebooks (256 entries a part) pass the driver.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Scratch, join_groups

#: Room for rounding in bounds; distances are compared without it.
SLACK = 1e-5
#: Sums of squares up to these keep every step exact in double floats, and in 64-bit numbers.
FLOAT_SAFE, LONG_SAFE = 1 << 53, 1 << 62
#: Components beyond this become it: their squares are no longs, whatever they are.
MOST = (1 << 63) - 1
#: Rows of a batch whose distances are held at once.
ROWS = 8192


@dataclass
class Book:
    """A codebook of one part: entries, the group of each, and how far each group's and each entry moved last."""

    entries: np.ndarray
    group: np.ndarray
    groups: int
    moved: np.ndarray
    group_moved: np.ndarray


def fitting(*arrays: np.ndarray) -> type:
    """The cheapest type in which squared distances of these whole numbers are exact."""
    most = max((int(abs(a).max()) for a in arrays if a.size), default=0)
    reach = (2 * most) ** 2 * max(a.shape[-1] for a in arrays)
    return np.float64 if reach <= FLOAT_SAFE else np.int64 if reach <= LONG_SAFE else object


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row to each entry."""
    kind = fitting(x, entries)
    a, b = x.astype(kind), entries.astype(kind)
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)


def own_squares(x: np.ndarray, entries: np.ndarray, code: np.ndarray) -> np.ndarray:
    kind = fitting(x, entries)
    d = x.astype(kind) - entries.astype(kind)[code]
    return (d * d).sum(1)


def roots(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64))


def grouped(entries: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """The entries' groups, by a few Lloyd rounds over the entries themselves."""
    x = entries.astype(np.float64)
    middle = x[np.linspace(0, len(x) - 1, groups).astype(int)]
    for _ in range(rounds):
        code = ((x[:, None] - middle[None]) ** 2).sum(2).argmin(1)
        middle = np.stack([x[code == g].mean(0) if (code == g).any() else middle[g] for g in range(groups)])
    return code


def book(entries: np.ndarray, groups: int) -> Book:
    groups = max(1, min(groups, len(entries)))
    return Book(entries, grouped(entries, groups), groups, np.zeros(len(entries)), np.zeros(groups))


def moved(old: Book, entries: np.ndarray) -> Book:
    far = roots(own_squares(entries, old.entries, np.arange(len(entries)))) * (1 + SLACK)
    by_group = np.zeros(old.groups)
    np.maximum.at(by_group, old.group, far)
    return Book(entries, old.group, old.groups, far, by_group)


def first_codes(x: np.ndarray, b: Book) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, lower bounds by group, exact squared errors, by a full search."""
    d = squares(x, b.entries)
    code = d.argmin(1)
    error = d[np.arange(len(x)), code].copy()
    rest = roots(d)
    rest[np.arange(len(x)), code] = np.inf
    low = np.full((len(x), b.groups), np.inf)
    for g in range(b.groups):
        if (b.group == g).any():
            low[:, g] = rest[:, b.group == g].min(1)
    return code, low, error


def next_codes(x: np.ndarray, code: np.ndarray, low: np.ndarray, b: Book) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same from earlier codes and bounds, and how many distances it took."""
    low = low - b.group_moved[None]
    best = own_squares(x, b.entries, code)
    upper = roots(best)
    start, start_far = code, upper  # the entry that the bounds leave out, and its distance now
    code, best = code.copy(), best.copy()
    looked = len(x)
    todo = low <= (upper * (1 + SLACK) + SLACK)[:, None]
    for g in np.flatnonzero(todo.any(0)):
        members = np.flatnonzero(b.group == g)
        rows = np.flatnonzero(todo[:, g])
        d = squares(x[rows], b.entries[members])
        looked += d.size
        at = d.argmin(1)
        nearest, index = d[np.arange(len(rows)), at], members[at]
        better = (nearest < best[rows]) | (nearest == best[rows]) & (index < code[rows])
        code[rows[better]], best[rows[better]] = index[better], nearest[better]
        far = roots(d)
        far[members[None] == start[rows][:, None]] = np.inf
        low[rows, g] = far.min(1)
    # a bound leaves out the own entry alone: the earlier one counts again, the new one no longer
    changed = np.flatnonzero(code != start)
    g = b.group[start[changed]]
    low[changed, g] = np.minimum(low[changed, g], start_far[changed])
    for c in np.unique(code[changed]):
        rows = changed[code[changed] == c]
        others = np.flatnonzero((b.group == b.group[c]) & (np.arange(len(b.group)) != c))
        low[rows, b.group[c]] = roots(squares(x[rows], b.entries[others])).min(1) if len(others) else np.inf
        looked += len(rows) * len(others)
    return code, low, best, looked


def below(low: np.ndarray) -> np.ndarray:
    """Single floats that are no larger."""
    few = low.astype(np.float32)
    return np.where(few.astype(np.float64) > low, np.nextafter(few, np.float32(-np.inf)), few)


def whole(x: Column) -> Column:
    """floor(1024 * x) as a long; beyond the longs the largest or smallest one."""
    y = F.floor(x.cast("double") * 1024.0)
    return F.when(x.cast("double") >= float(1 << 53), F.lit(MOST)).when(x.cast("double") < -float(1 << 53), F.lit(-MOST)).otherwise(y).cast("long")


def usable(vec: Column) -> Column:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~bad


def assigned(rows: DataFrame, books: list[Book], first: bool, q: str, codes: str, bounds: str, error: str) -> DataFrame:
    """``rows`` with new codes, bounds and errors. A narrow job.

    ``q``: the whole numbers of a vector. A row of another number of them than the codebooks' has null in all three.
    """
    parts, width = len(books), books[0].entries.shape[1]
    keep = [f for f in rows.schema if f.name not in (codes, bounds, error)]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    names = [*(f.name for f in keep), codes, bounds, error]

    def run(batches):
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, ROWS):
                batch = whole_batch.slice(start, ROWS)
                n, vectors = batch.num_rows, batch.column(q)
                fits = np.flatnonzero(np.diff(vectors.offsets.to_numpy()) == parts * width)
                x = vectors.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(len(fits), parts, width)
                if not first:
                    old = batch.column(codes).take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(len(fits), parts).astype(np.int64)
                    lows = batch.column(bounds).take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(len(fits), sum(b.groups for b in books)).astype(np.float64)
                out_codes, out_lows, total, at = [], [], np.zeros(len(fits), object), 0
                for p, b in enumerate(books):
                    if first:
                        code, low, squared = first_codes(x[:, p], b)
                    else:
                        code, low, squared, _ = next_codes(x[:, p], old[:, p], lows[:, at : at + b.groups], b)
                    at += b.groups
                    out_codes.append(code)
                    out_lows.append(below(low))
                    total = total + np.array([int(v) for v in squared.tolist()], object)
                made = {int(i): k for k, i in enumerate(fits)}
                where = pa.array([made.get(i) for i in range(n)], pa.int64())
                lists = lambda a, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.reshape(-1), kind)).take(where)
                errors = pa.array([v if v <= MOST else None for v in total.tolist()], pa.int64()).take(where)
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), lists(np.stack(out_codes, 1).astype(np.int16), pa.int16()), lists(np.concatenate(out_lows, 1), pa.float32()), errors], names)

    return rows.mapInArrow(run, f"{fields}, `{codes}` array<short>, `{bounds}` array<float>, `{error}` long")


def sums(rows: DataFrame, books: list[Book], q: str, codes: str) -> DataFrame:
    """part, entry, place, total, n: what the vectors of each entry add up to."""
    parts, (k, width) = len(books), books[0].entries.shape

    def run(batches):
        total, count = np.zeros((parts, k, width), object), np.zeros((parts, k), np.int64)
        for batch in batches:
            has = np.flatnonzero(batch.column(codes).is_valid().to_numpy(zero_copy_only=False))
            x = batch.column(q).take(pa.array(has)).flatten().to_numpy(zero_copy_only=False).reshape(len(has), parts, width)
            code = batch.column(codes).take(pa.array(has)).flatten().to_numpy(zero_copy_only=False).reshape(len(has), parts)
            kind = np.int64 if fitting(x) is not object else object  # a batch is far too small for sums beyond that
            for p in range(parts):
                own = np.zeros((k, width), kind)
                np.add.at(own, code[:, p], x[:, p].astype(kind))
                total[p] += own.astype(object)
                count[p] += np.bincount(code[:, p], minlength=k)
        p, e = np.nonzero(count)
        if len(p):
            made = [[Decimal(int(v)) for v in total[i, j]] for i, j in zip(p, e)]
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(made, pa.list_(pa.decimal128(38, 0))), pa.array(count[p, e], pa.int64())], ["part", "entry", "totals", "n"])

    few = rows.select(q, codes).mapInArrow(run, "part int, entry int, totals array<decimal(38,0)>, n long")
    return few.select("part", "entry", "n", F.posexplode("totals").alias("place", "value")).groupBy("part", "entry", "place").agg(F.sum("value").cast("decimal(38,0)").alias("total"), F.sum("n").alias("n"))


def encode(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, groups: int = 16) -> DataFrame:
    """``id_col``, code, error, label_error, codebooks_sha256 of every usable vector.

    Vectors that are null or hold null or non-finite components take no part. The vector of the smallest id fixes
    the number of components; vectors of another number, and all if it isn't a positive multiple of ``parts``,
    have null code and error. The first codebooks are those of the ``entries`` smallest ids, ties by the
    components, null ids last; of fewer vectors there are fewer entries. Repeated rows are rows like others. An
    error beyond a long is null. No rows give none. Extra columns are left out, whatever their names.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "yinyang")
    wanted = [F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v")]
    rows = scratch.keep(vectors.select(*wanted).where(usable(F.col("v"))).select("id", "label", F.transform("v", whole).alias("q")), "numbers")
    seeds = rows.orderBy(F.asc_nulls_last("id"), "q").limit(1).select(F.size("q")).first()
    width = seeds[0] // parts if seeds and seeds[0] % parts == 0 else 0
    if not width:
        return _named(rows.select("id", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("long").alias("label_error"), F.sha2(F.lit(""), 256).alias("codebooks_sha256")), id_col)
    seeds = rows.where(F.size("q") == parts * width).orderBy(F.asc_nulls_last("id"), "q").limit(entries).select("q").collect()
    start = np.array([r["q"] for r in seeds], np.int64).reshape(len(seeds), parts, width)
    books = [book(start[:, p], groups) for p in range(parts)]
    state = scratch.keep(assigned(rows, books, True, "q", "codes", "bounds", "error"), "codes")
    scratch.drop(rows)
    for _ in range(rounds):
        # at most parts x entries x width rows, whatever the number of vectors
        new = [b.entries.copy() for b in books]
        for r in sums(state, books, "q", "codes").collect():
            new[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
        books = [moved(b, e) for b, e in zip(books, new)]
        before, state = state, scratch.keep(assigned(state, books, False, "q", "codes", "bounds", "error"), "codes")
        scratch.drop(before)
    digest = hashlib.sha256(",".join(str(int(v)) for b in books for v in b.entries.reshape(-1)).encode()).hexdigest()
    code = F.concat(*(F.lower(F.lpad(F.hex(F.col("codes")[p]), 2, "0")) for p in range(parts)))
    by_label = state.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"), F.count("*").alias("copies"))
    key = "label_key"  # nulls are a label too
    tagged = lambda df: df.withColumn(key, F.struct(F.col("label")))
    done = join_groups(tagged(state.select("id", "label", code.alias("code"), "error")), tagged(scratch.keep(by_label, "labels")).drop("label"), key, "copies")
    return _named(done.select("id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")), id_col)


def _named(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.withColumnRenamed("id", id_col)
