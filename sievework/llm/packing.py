"""Best-fit packing by a grouping genetic algorithm.

Documents become token pieces of at most ``capacity`` tokens. The pieces are dealt by hash into blocks of a
bounded size; several islands evolve packings of each block, exchange their elite packings between epochs,
and the best packing of a block wins. Whole well-filled bins stay. What is left of all blocks is dealt anew
into fewer blocks and evolves again, so that the last, loosely filled bins are few in the whole corpus.

A block never holds more than about ``block`` pieces, whatever the sizes of sources or groups of copies.
"""

from __future__ import annotations

import bisect
import itertools
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CACHE_IDS, IdStore, blocks, distinct
from .tables import Scratch, map_texts
from .wordbytes import hashes

CAPACITY = 2048
CACHE = 500_000
#: Texts of these characters alone are cut into words in numpy; the tokenizer's own steps take the others whole.
SIMPLE = re.compile(r"[\t\n\r -&(-~À-ÖØ-öø-ÿ]*")
#: Classes of lower-cased bytes in such texts: 0 white space and between texts, 1 letters, 2 digits, 3 the rest.
CLASS = np.full(256, 3, np.uint8)
CLASS[[0, 9, 10, 13, 32]] = 0
CLASS[[*range(97, 123), *range(128, 256)]] = 1
CLASS[48:58] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class WordTokens(IdStore):
    """The tokenizers library's encoding, word by word: every new word is encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        n = self.tokenizer.get_vocab_size()
        self.last = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(n)])

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data = LOWER[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
        lead = np.flatnonzero(data[:-1] == 0xC3) + 1  # the second byte of À to Þ
        data[lead[data[lead] < 0x9F]] += 32
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=at[1:])
        kind = CLASS[data]
        starts = np.ones(len(data), bool)
        starts[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        begin = np.flatnonzero(starts)
        end = np.append(begin[1:], len(data))
        word = kind[begin] != 0
        return data, begin[word], end[word], np.searchsorted(begin[word], at)

    def learn(self, keys: list, words: list[bytes]) -> None:
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):  # a word that the library cuts otherwise
            self.add(keys, [x.ids for x in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)])
        else:
            self.add(keys, [x.tolist() for x in np.split(ids, ends[:-1])])

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        if self.size > CACHE or len(self.flat) > CACHE_IDS:
            self.forget()
        simple = [bool(SIMPLE.fullmatch(t)) and "<|" not in t for t in texts]
        raw = [t.encode() for t, s in zip(texts, simple) if s]
        quick = iter(())
        if raw:
            data, begin, end, first = self.words(raw)
            codes, found, seen = distinct(hashes(data, begin, end))
            keys = found.tolist()
            at = np.fromiter(map(self.known.get, keys, itertools.repeat(-1)), np.int64, len(keys))
            fresh = np.flatnonzero(at < 0)
            if len(fresh):
                flat = data.tobytes()
                at[fresh] = self.size + np.arange(len(fresh))
                self.learn([keys[i] for i in fresh.tolist()], [flat[begin[k] : end[k]] for k in seen[fresh].tolist()])
            ids, total = self.gather(at[codes])
            total = np.concatenate([[0], total])[first]
            quick = iter([ids[total[i] : total[i + 1]] for i in range(len(raw))])
        slow = self.tokenizer.encode_batch_fast([t for t, s in zip(texts, simple) if not s], add_special_tokens=False)
        slow = iter([np.array(x.ids, np.uint32) for x in slow])
        return [next(quick) if s else next(slow) for s in simple]


_loaded: dict[str, WordTokens] = {}


def loaded(path: str) -> WordTokens:
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, name: str = "word_bpe_49k.json", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every whole text's tokens and one closing ``end_id``.

    A narrow job. A null text is an empty one, whose only token is the closing one. Ids may be of any type;
    null and repeated ids are rows like others. Extra columns are left out, whatever their names.
    """
    def run(texts):
        tokens = loaded(vocab or public_tokenizers.path(name))
        for first, few in blocks(texts):
            at, out = [], []
            for i, x in enumerate(tokens.encode_batch(few), first):
                x = np.append(x, end_id).astype("<u4")
                for k in range(0, len(x), capacity):
                    part = x[k : k + capacity]
                    at.append(i)
                    out.append((k // capacity, k, len(part), zlib.crc32(part.tobytes())))
            piece, start, length, crc = zip(*out)
            yield at, {"piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(rows, run, "piece int, start long, length long, ids_crc32 long")


class Packing:
    """A chromosome: its genes are whole bins of item numbers, with their fills."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.fills: list[int] = []

    def best_fit(self, items: list[int], open_bins: list[int] | None = None) -> None:
        """Puts each item, in the order given, where it leaves least room, opening bins as needed."""
        sizes, capacity = self.sizes, self.capacity
        room = sorted((capacity - self.fills[b], b) for b in (range(len(self.bins)) if open_bins is None else open_bins) if self.fills[b] < capacity)
        for i in items:
            s = sizes[i]
            at = bisect.bisect_left(room, (s, -1))
            if at < len(room):
                left, b = room.pop(at)
                self.bins[b].append(i)
                self.fills[b] += s
            else:
                left, b = capacity, len(self.bins)
                self.bins.append([i])
                self.fills.append(s)
            if left - s:
                bisect.insort(room, (left - s, b))

    def fitness(self) -> tuple[int, float]:
        """Fewer bins, then bins filled as unevenly as can be."""
        return -len(self.bins), sum((f / self.capacity) ** 2 for f in self.fills)

    def crossed(self, other: Packing, rng: random.Random, full: float) -> Packing:
        """A child: the other's well-filled bins go in whole, own bins that share an item with them dissolve,
        and their remaining items are best-fitted, largest first."""
        least = full * self.capacity
        gift = [b for b, f in enumerate(other.fills) if f >= least and rng.random() < 0.6]
        child = Packing(self.sizes, self.capacity)
        taken = set()
        for b in gift:
            child.bins.append(list(other.bins[b]))
            child.fills.append(other.fills[b])
            taken.update(other.bins[b])
        loose = []
        for items, fill in zip(self.bins, self.fills):
            if taken.isdisjoint(items):
                child.bins.append(list(items))
                child.fills.append(fill)
            else:
                loose.extend(i for i in items if i not in taken)
        # a few poorly filled bins dissolve as well, which is the mutation
        poor = {b for b in range(len(gift), len(child.bins)) if child.fills[b] < least and rng.random() < 0.3}
        loose.extend(i for b in poor for i in child.bins[b])
        child.bins = [x for b, x in enumerate(child.bins) if b not in poor]
        child.fills = [x for b, x in enumerate(child.fills) if b not in poor]
        loose.sort(key=lambda i: (-self.sizes[i], i))
        child.best_fit(loose)
        return child


def evolve(sizes: list[int], capacity: int, seed: int, given: list[list[int]], population: int = 5, generations: int = 8) -> list[int]:
    """The bin of each item. ``given``: packings to start from, as bins of items. Deterministic for a seed."""
    rng = random.Random(seed)
    lower = -(-sum(sizes) // capacity)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    people = []
    for bins in given:
        p = Packing(sizes, capacity)
        for _, items in itertools.groupby(sorted(range(len(sizes)), key=bins.__getitem__), key=bins.__getitem__):
            p.bins.append(list(items))
            p.fills.append(sum(sizes[i] for i in p.bins[-1]))
        people.append(p)
    while len(people) < population:
        p = Packing(sizes, capacity)
        noise = 0.25 * len(people)
        p.best_fit(order if not people else sorted(order, key=lambda i: -sizes[i] * (1 + noise * rng.random())))
        people.append(p)
    for _ in range(generations):
        people.sort(key=Packing.fitness, reverse=True)
        if -people[0].fitness()[0] <= lower:
            break
        child = people[0].crossed(people[rng.randrange(1, len(people))], rng, 0.98)
        other = people[rng.randrange(1, len(people))].crossed(people[0], rng, 0.98)
        people[-2:] = [child, other]
    best = max(people, key=Packing.fitness)
    out = [0] * len(sizes)
    for b, items in enumerate(best.bins):
        for i in items:
            out[i] = b
    return out


def _epoch(rows: DataFrame, capacity: int, first: bool, epoch: int) -> DataFrame:
    """One epoch on every island (block, deme). The first numbers the items of a block, alike on all its islands."""
    schema = rows.schema
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema if f.name not in ("item", "bin", "immigrant", "bins"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        by = ["length", "doc_id", "piece", "ids_crc32"] if first else ["item"]
        pdf = pdf.sort_values(by, ascending=not first, na_position="last").reset_index(drop=True)
        given = [] if first else [pdf[c].tolist() for c in ("bin", "immigrant") if not pdf[c].isna().any()]
        bins = evolve(pdf["length"].tolist(), capacity, hash((int(key[0]), int(key[1]), epoch)), given)
        out = pdf[[f.name for f in schema if f.name not in ("item", "bin", "immigrant", "bins")]].copy()
        out["item"] = range(len(pdf)) if first else pdf["item"]
        out["bin"], out["bins"] = bins, max(bins, default=-1) + 1
        return out

    return rows.groupBy("block", "deme").applyInPandas(run, f"{fields}, item int, bin int, bins int")


def pack(parts: DataFrame, capacity: int = CAPACITY, block: int = 3000, demes: int = 2, rounds: int = 2) -> DataFrame:
    """``parts`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Lengths are 1 to ``capacity``. Every row is placed once, repeated rows and those without an id too; no rows
    give no rows. A sequence is filled gaplessly from 0. Ties are settled by doc_id, piece and checksum. ``rounds`` times
    the bins under 99.5 % are dissolved and dealt into blocks with others' before the last epoch stands.
    """
    scratch = Scratch(parts.sparkSession, "packing")
    kind = parts.schema["doc_id"].dataType
    # as text on its way through pandas, where a null beside it would turn a number into a float
    rows = scratch.keep(parts.select(F.col("doc_id").cast("string").alias("doc_id"), "piece", "start", "length", "ids_crc32"), "pieces")
    done = []
    for r in range(rounds + 1):
        n = max(1, -(-rows.count() // block))
        salt = F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(r))
        islands = rows.withColumn("block", F.pmod(salt, F.lit(n)).cast("int")).withColumn("deme", F.explode(F.sequence(F.lit(0), F.lit(demes - 1))))
        once = scratch.keep(_epoch(islands, capacity, True, 0), "epoch")
        elite = once.select("block", "item", ((F.col("deme") + 1) % demes).alias("deme"), F.col("bin").alias("immigrant"))
        twice = scratch.keep(_epoch(once.join(elite, ["block", "deme", "item"]), capacity, False, 1), "epoch")
        best = twice.groupBy("block").agg(F.min(F.struct("bins", "deme")).alias("b")).select("block", F.col("b.deme").alias("deme"))
        won = scratch.keep(twice.join(best, ["block", "deme"]).drop("deme", "bins", "item"), "won")
        fills = won.groupBy("block", "bin").agg(F.sum("length").alias("fill"))
        if r < rounds:
            loose = fills.where(F.col("fill") < F.lit(0.995 * capacity)).select("block", "bin")
            rows = scratch.keep(won.join(loose, ["block", "bin"], "left_semi").drop("block", "bin"), "loose")
            won = won.join(loose, ["block", "bin"], "left_anti")
        done.append(won.withColumn("sequence_id", F.lit(r).cast("long") * F.lit(1 << 56) + F.col("block").cast("long") * F.lit(1 << 24) + F.col("bin")))
        scratch.drop(once, twice)
    placed = done[0]
    for d in done[1:]:
        placed = placed.unionByName(d)
    return in_sequence(placed.drop("block", "bin").withColumn("doc_id", F.col("doc_id").cast(kind)))


def in_sequence(placed: DataFrame) -> DataFrame:
    """Adds each row's offset in its sequence; a sequence holds at most ``capacity`` rows."""
    from pyspark.sql import Window

    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "piece", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
