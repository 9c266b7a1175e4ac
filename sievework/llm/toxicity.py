"""Toxicity by the byte n-grams of whole texts.

A text is lower-cased and every run of other characters than letters and digits becomes one space. Each place of
it begins one n-gram of each length, across words too, and each word is a unit as a whole, so that every byte counts wherever it
stands. Units that set toxic or ordinary labelled texts apart carry their log odds; a text's evidence for
either side is the sum over its units. A logistic threshold over the evidence, fitted on labelled texts that
chose no units, gives the score. Compression against two trained zstandard dictionaries was tried first and
does far worse: see the README.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import map_texts, unused
from .wordbytes import chunks, hashes, joined, mix, runs

#: Bytes of the n-grams, spaces among them.
LENGTHS = (5, 7)
#: A unit sets a class apart from this likelihood-ratio statistic on and in so many texts at least.
LEAST_RATIO, LEAST_TEXTS = 16.0, 3
#: Labelled toxic rows that are fetched to fit, at most, and ordinary ones for each of these; bytes of the texts of
#: either class, at most. Texts are whole: those that come first by the hashes of their ids as long as there is room.
SAMPLE, ORDINARY, SAMPLE_BYTES = 2500, 4, 32 << 20
#: Bits of a code that the first look-up of a unit takes.
BITS = 22
WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    WORD[_a:_b] = True


def lowered(text: str | None) -> bytes:
    """A lone surrogate, which UTF-8 lacks, becomes a question mark."""
    return (text or "").lower().encode("utf-8", "replace")


def spaced(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One byte array of the texts, each as a space and its words with a space after each, and where each begins (one more at the end)."""
    data, at = joined([b" " + t for t in texts])
    word = WORD[data]
    keep = word.copy()
    keep[1:] |= word[:-1]
    keep[at[:-1]] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    return np.where(word, data, 32).astype(np.uint8)[keep], place[at]


def units(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of n-grams, then whole words: codes, and where those of each text begin and end."""
    data, at = spaced(texts)
    code, wide = np.zeros(len(data), np.uint64), data.astype(np.uint64)
    for j in range(max(LENGTHS)):
        m = max(0, len(data) - j)
        code = code[:m] * np.uint64(0x100000001B3) + wide[j:] + np.uint64(1)
        if j + 1 in LENGTHS:
            yield mix(code), np.minimum(at[:-1], m), np.minimum(np.maximum(at[:-1], at[1:] - j), m)
    starts, ends = runs(data != 32)
    first = np.searchsorted(starts, at)
    yield hashes(data, starts, ends), first[:-1], first[1:]


def distinct(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each part of the texts: the different codes of each text, one text after the other."""
    for _, _, own in chunks(texts, 1 << 19):
        made = list(units(own))
        yield np.concatenate([np.unique(np.concatenate([c[a[i] : b[i]] for c, a, b in made])) for i in range(len(own))])


def frequent(texts: list[bytes], least: int = LEAST_TEXTS) -> np.ndarray:
    """Codes that stand in ``least`` texts or more, sorted. A first pass counts groups of codes, so that few are held."""
    held = np.zeros(1 << 24, np.uint16)
    for more in distinct(texts):
        at, times = np.unique((more >> np.uint64(40)).astype(np.uint32), return_counts=True)
        held[at] = np.minimum(held[at] + times, 65535)
    code, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for more in distinct(texts):
        new, times = np.unique(more[held[more >> np.uint64(40)] >= least], return_counts=True)
        code, to = np.unique(np.concatenate([code, new]), return_inverse=True)
        count = np.bincount(to, np.concatenate([count, times]), len(code)).astype(np.int64)
    return code[count >= least]


def counted(texts: list[bytes], known: np.ndarray) -> np.ndarray:
    """In how many texts each of the ``known`` codes stands."""
    out = np.zeros(len(known), np.int64)
    for code in distinct(texts) if len(known) else ():
        at = np.minimum(np.searchsorted(known, code), len(known) - 1)
        out += np.bincount(at[known[at] == code], minlength=len(known))
    return out


@dataclass
class Model:
    codes: np.ndarray
    odds: np.ndarray
    weights: np.ndarray

    def __post_init__(self):
        self.first = np.zeros(1 << BITS, bool)
        self.first[self.codes >> np.uint64(64 - BITS)] = True

    def __reduce__(self):
        return Model, (self.codes, self.odds, self.weights)

    def of(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the codes that the model knows, and their log odds."""
        place = np.flatnonzero(self.first[code >> np.uint64(64 - BITS)])
        if not len(place):
            return place, np.zeros(0)
        at = np.minimum(np.searchsorted(self.codes, code[place]), len(self.codes) - 1)
        same = self.codes[at] == code[place]
        return place[same], self.odds[at[same]]


def evidence(texts: list[bytes], model: Model) -> np.ndarray:
    """For each text: bytes, summed log odds for toxic and for ordinary, and the units that are clearly toxic."""
    out = np.zeros((len(texts), 4))
    for first, last, own in chunks(texts):
        out[first:last, 0] = np.diff(spaced(own)[1])
        for code, begin, end in units(own):
            place, odds = model.of(code)
            # between two texts stand n-grams that belong to neither
            owner = np.searchsorted(begin, place, "right") - 1
            inside = place < end[owner]
            owner, odds = owner[inside], odds[inside]
            for k, x in enumerate((np.maximum(odds, 0), np.maximum(-odds, 0), odds > 2), 1):
                out[first:last, k] += np.bincount(owner, x, len(own))
    return out


def features(found: np.ndarray) -> np.ndarray:
    size, toxic, ordinary, clear = found.T
    return np.stack([np.ones(len(found)), np.log1p(toxic), np.log1p(ordinary), np.log1p(clear), np.log1p(size), 10 * toxic / (size + 20), 10 * ordinary / (size + 20)], 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 40) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def likelihood_ratio(k1: np.ndarray, n1: int, k0: np.ndarray, n0: int) -> np.ndarray:
    """Twice the log likelihood that the codes' rates in two classes gain over one common rate."""
    def log_of(k, n, p):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(p), 0) + np.where(n > k, (n - k) * np.log1p(-p), 0)

    p = (k1 + k0) / (n1 + n0)
    return 2 * (log_of(k1, n1, k1 / n1) + log_of(k0, n0, k0 / n0) - log_of(k1, n1, p) - log_of(k0, n0, p))


def train(toxic: list[str], ordinary: list[str], share: float) -> Model:
    """A model from labelled texts; ``share``: how many of all labelled texts are toxic. Two thirds choose units, the rest the threshold."""
    raw = [[lowered(t) for t in x] for x in (toxic, ordinary)]
    learn, tune = ([x[: 2 * len(x) // 3] for x in raw], [x[2 * len(x) // 3 :] for x in raw])
    n1, n0 = len(learn[0]) + 1, len(learn[1]) + 1
    # a unit that sets ordinary texts apart is in so many of them at least, so that one of ORDINARY parts has its share
    possible = np.flatnonzero(likelihood_ratio(np.zeros(n0), n1, np.arange(n0), n0) >= LEAST_RATIO)
    known = frequent(learn[0])
    for part in range(ORDINARY) if len(possible) else ():
        known = np.union1d(known, frequent(learn[1][part::ORDINARY], max(1, -(-int(possible[0]) // ORDINARY))))
    k1, k0 = counted(learn[0], known), counted(learn[1], known)
    apart = likelihood_ratio(k1, n1, k0, n0) >= LEAST_RATIO
    odds = np.log((k1 + 0.5) / n1) - np.log((k0 + 0.5) / n0)
    model = Model(known[apart], odds[apart], np.zeros(7))
    x = np.concatenate([features(evidence(t, model)) for t in tune])
    y = np.concatenate([np.ones(len(tune[0])), np.zeros(len(tune[1]))])
    if len(tune[0]) and len(tune[1]):
        model.weights = logistic(x, y)
        # back from the sample's share of toxic texts to that of all labelled ones
        model.weights[0] += np.log(share / (1 - share)) - np.log(len(tune[0]) / len(tune[1])) if 0 < share < 1 else 0.0
    else:
        model.weights[0] = -10.0
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from at most ``sample`` toxic texts and ``ORDINARY`` times as many ordinary ones, of ``most_bytes`` bytes each at most.

    Those with the smallest hashes of their ids are taken, whole. Null labels and null ids take no part; an id with
    both labels is toxic, of its rows the smallest text counts. With fewer than two texts of a class every text is ordinary.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and id is not null").groupBy("id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = [known.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(most) for c, most in ((1, sample), (0, ORDINARY * sample))]
    # at most (1 + ORDINARY) * sample ids
    few = F.broadcast(chosen[0].unionByName(chosen[1]))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(few, "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    before = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("held", F.sum(F.octet_length("text")).over(before)).where(F.col("held") <= most_bytes).select("label", "text").collect()
    by = {c: [r["text"] for r in rows if r["label"] == c] for c in (1, 0)}
    for x in by.values():
        x.sort(key=lambda t: (zlib.crc32(t.encode("utf-8", "replace")), t))
    return train(by[1], by[0], counts.get(1, 0) / max(1, counts.get(1, 0) + counts.get(0, 0)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """Every row with its score (0 to 1) and prediction (1 from 0.5 on); a null text is an empty one. A narrow job.

    Columns of ``docs`` that have the names of the two new ones give way to them; all others come out as they
    went in, null and repeated ids too. Very long texts are scored whole; equal texts have equal scores; no rows give none.
    """
    again = unused([*docs.columns, score_col, predicted_col], "text")[0]
    rows = docs.drop(score_col, predicted_col).withColumn(again, F.col(f"`{text_col}`"))

    def run(texts):
        z = np.clip(features(evidence([lowered(t) for t in texts], model)) @ model.weights, -30, 30)
        p = 1 / (1 + np.exp(-z))
        yield None, {score_col: p, predicted_col: (p >= 0.5).astype(np.int32)}

    return map_texts(rows, run, f"`{score_col}` double, `{predicted_col}` int", again)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """``id_col``, held_out, score, predicted of every row, learnt from labels whose crc32(id) mod ``folds`` isn't 0.

    Null texts are empty; a null id isn't held out. Ties and repeated rows have the scores of their texts. Other
    columns are left out, whatever their names; no rows give none. Labels that contradict each other: see ``fit``.
    """
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
    model = fit(docs, labels.where(fold != 0), id_col, text_col)  # null ids have no fold and teach nothing
    rows = score(docs.select(id_col, F.coalesce(text_col, F.lit("")).alias(text_col)), model, id_col, text_col)
    return rows.select(id_col, F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted")
