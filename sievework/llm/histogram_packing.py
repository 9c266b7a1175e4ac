"""Packing by shortest-pack-first over the histogram of lengths.

Documents become pieces of at most ``capacity`` tokens. Only the number of pieces of each length reaches the
driver, ``capacity`` numbers at most. There lengths are placed longest first, each into the packs that are
shortest so far; packs filled alike are one pattern with a count. Patterns then come back to the pieces by rank:
the ``r``-th piece of a length takes the ``r``-th place that the patterns have for it.

Packs that would need padding are mended, as documents may be cut freely: the emptiest of them dissolve, their
pieces laid end to end fill the gaps of the others, cut where a gap ends, and the rest becomes sequences of powers
of two. So no sequence needs padding.
"""

from __future__ import annotations

import itertools
import zlib
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import SpeculativeBpe, blocks
from .tables import Scratch, few_at_once, sized

CAPACITY = 1024
#: Bits of a rank within a length.
RANK_BITS = 48


class LibraryBpe(SpeculativeBpe):
    """The same ids, of which the tokenizers library makes those of new words that begin with a blank.

    Such words are cut alike when they stand end to end, and none but a word's first token begins with a blank.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.leads = np.array([x.startswith(b" ") for x in self.bytes_of])

    def learn(self, keys: list, words: list) -> None:
        if not isinstance(keys[0], int):  # words of texts that the pattern cuts, with white space of any kind
            return super().learn(keys, words)
        led = np.fromiter((w[:1] == b" " and len(w) > 1 and w[1] > 32 for w in words), bool, len(words))
        ids = np.zeros(0, np.uint32)
        if led.any():
            whole = b"".join(itertools.compress(words, led.tolist())).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([whole], add_special_tokens=False)[0].ids, np.uint32)
        begin = np.flatnonzero(self.leads[ids])
        if len(begin) != led.sum():  # an exact way for words that the library cuts otherwise
            return super().learn(keys, words)
        others = [self.merged(words[i]) for i in np.flatnonzero(~led).tolist()]
        size = np.empty(len(words), np.int64)
        size[led] = np.diff(np.append(begin, len(ids)))
        size[~led] = [len(x) for x in others]
        # callers number new words by their order
        source = np.empty(len(words), np.int64)
        source[led] = begin
        source[~led] = len(ids) + np.cumsum(size[~led]) - size[~led]
        ids = np.concatenate([ids, np.fromiter(itertools.chain.from_iterable(others), np.uint32)])
        end = np.cumsum(size)
        self.add_flat(keys, ids[np.arange(end[-1]) + np.repeat(source - (end - size), size)], end)
        return None

    def add_flat(self, keys: list, ids: np.ndarray, end: np.ndarray) -> None:
        """Words whose ids lie end to end; ``end``: how many of them end with each word."""
        n, first = self.size, int(self.ends[self.size])
        while first + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(keys) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[first : first + len(ids)] = ids
        self.ends[n + 1 : n + 1 + len(keys)] = first + end
        self.known.update(zip(keys, range(n, n + len(keys))))
        self.size += len(keys)


_loaded: dict[str, LibraryBpe] = {}


def loaded(path: str) -> LibraryBpe:
    """One vocabulary for each Python worker."""
    if path not in _loaded:
        _loaded[path] = LibraryBpe(path)
    return _loaded[path]


@dataclass
class Pattern:
    """``count`` sequences that hold pieces of these lengths, in this order."""

    count: int
    lengths: list[int]

    @property
    def fill(self) -> int:
        return sum(self.lengths)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that together hold the pieces of the histogram, longest first, each in the shortest pack that there is."""
    by_room: dict[int, list[Pattern]] = {}
    done: list[Pattern] = []

    def put(count: int, lengths: list[int], room: int) -> None:
        (by_room.setdefault(room, []) if room else done).append(Pattern(count, lengths))

    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        left = histogram[length]
        while left:
            room = max(by_room, default=0)
            if room < length:  # not even the shortest pack takes it
                put(left, [length], capacity - length)
                break
            packs = by_room[room]
            shortest = packs.pop()
            if not packs:
                del by_room[room]
            n = min(left, shortest.count)
            if n < shortest.count:
                put(shortest.count - n, shortest.lengths, room)
            put(n, [*shortest.lengths, length], room - length)
            left -= n
    return done + [p for room in sorted(by_room) for p in by_room[room]]


def padded(fill: int, capacity: int) -> bool:
    return fill < capacity and fill & (fill - 1) != 0


@dataclass
class Layout:
    """Where the pieces of each length go by rank.

    ``loose``: of each length so many pieces, the first by rank, are laid end to end, from a place on the line.
    ``slots``: keys (length and first rank), number of pieces, first sequence, offset.
    ``gaps``: first place on the line, size of a gap, first sequence, offset.
    """

    capacity: int
    loose: dict[int, tuple[int, int]]
    slots: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    gaps: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def layout(patterns: list[Pattern], capacity: int) -> Layout:
    fine = [p for p in patterns if not padded(p.fill, capacity)]
    poor = sorted((p for p in patterns if padded(p.fill, capacity)), key=lambda p: p.fill)
    missing = sum((capacity - p.fill) * p.count for p in poor)  # by so much the gaps exceed what is loose
    loose: dict[int, int] = {}
    for i, p in enumerate(poor):
        n = min(p.count, -(-missing // capacity))
        if n <= 0:
            break
        missing -= n * capacity  # a dissolved sequence has no gap any more, and its tokens fill others
        for length in p.lengths:
            loose[length] = loose.get(length, 0) + n
        poor[i] = Pattern(p.count - n, p.lengths)
    place, line = 0, {}
    for length in sorted(loose, reverse=True):
        line[length] = (place, loose[length])
        place += length * loose[length]
    slots, gaps, sequence, at = [], [], 0, 0
    taken = dict(loose)
    for p in itertools.chain(fine, (p for p in poor if p.count)):
        offset = 0
        for length in p.lengths:
            rank = taken.get(length, 0)
            slots.append((length << RANK_BITS | rank, p.count, sequence, offset))
            taken[length] = rank + p.count
            offset += length
        if padded(offset, capacity):
            gaps.append((at, capacity - offset, sequence, offset))
            at += (capacity - offset) * p.count
        sequence += p.count
    for bit in reversed(range(capacity.bit_length())):  # what is left of the line, under one sequence
        if (place - at) & 1 << bit:
            gaps.append((at, 1 << bit, sequence, 0))
            at += 1 << bit
            sequence += 1
    table = lambda rows: tuple(np.array(c, np.int64) for c in (zip(*rows) if rows else [()] * 4))
    return Layout(capacity, line, table(sorted(slots)), table(gaps))


def occurrence(keys: np.ndarray) -> np.ndarray:
    """How many equal keys stand before each."""
    by = np.argsort(keys, kind="stable")
    new = np.flatnonzero(np.append(True, keys[by][1:] != keys[by][:-1])) if len(keys) else np.zeros(0, np.int64)
    out = np.empty(len(keys), np.int64)
    out[by] = np.arange(len(keys)) - np.repeat(new, np.diff(np.append(new, len(keys))))
    return out


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, name: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, cut, task, turn, ids of every whole text's tokens and ``end_id``.

    A narrow job. ``turn`` counts the pieces of one length and ``cut`` in a task; ``ids`` are kept for pieces
    under ``capacity``. Write the table before it is used twice.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    path = vocab or public_tokenizers.path(name)

    def run(batches):
        bpe, task = loaded(path), TaskContext.get().partitionId()
        turns = np.zeros(2 * capacity + 2, np.int64)
        for batch in few_at_once(batches):
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for first, few in blocks([t or "" for t in texts]):
                at, out = [], []
                for i, x in enumerate(bpe.encode_batch(few), first):
                    raw, n = np.append(x, end_id).astype("<u4").tobytes(), len(x) + 1
                    for k in range(0, n, capacity):
                        part = raw[4 * k : 4 * (k + capacity)]
                        at.append(i)
                        out.append((k, len(part) // 4, zlib.crc32(part), n, part if len(part) < 4 * capacity else None))
                start, length, crc, total, kept = zip(*out)
                cut = np.array(total) > capacity
                key = 2 * np.array(length) + cut
                turn = turns[key] + occurrence(key)
                np.add.at(turns, key, 1)
                columns = [ids.take(pa.array(at)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array(cut), pa.array(np.full(len(at), task, np.int32)), pa.array(turn), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "cut", "task", "turn", "ids"])

    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, cut boolean, task int, turn long, ids binary")


def placed(ranked: DataFrame, plan: Layout) -> DataFrame:
    """``ranked`` (pieces with their rank) in their sequences; loose pieces are cut where their gaps end. A narrow job."""
    kind = ranked.schema["doc_id"].dataType.simpleString()
    slot_key, slot_count, slot_sequence, slot_offset = plan.slots
    gap_place, gap_size, gap_sequence, gap_offset = plan.gaps
    of = np.zeros((plan.capacity + 1, 2), np.int64)
    for length, x in plan.loose.items():
        of[length] = x
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def cuts(place: int, length: int):
        """Piece by piece of one that lies at ``place`` of the line: tokens before it, tokens, sequence, offset."""
        done = 0
        while done < length:
            c = int(np.searchsorted(gap_place, place + done, "right")) - 1
            i, inside = divmod(place + done - int(gap_place[c]), int(gap_size[c]))
            n = min(length - done, int(gap_size[c]) - inside)
            yield done, n, int(gap_sequence[c]) + i, int(gap_offset[c]) + inside
            done += n

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            start, length, rank, crc = (batch.column(c).to_numpy() for c in ("start", "length", "rank", "ids_crc32"))
            free = rank < of[length, 1]
            at = np.flatnonzero(~free)
            if len(at):
                s = np.searchsorted(slot_key, length[at] << RANK_BITS | rank[at], "right") - 1
                inside = rank[at] - (slot_key[s] & (1 << RANK_BITS) - 1)
                whole = batch.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*whole.columns, pa.array(slot_sequence[s] + inside), pa.array(slot_offset[s])], names)
            at = np.flatnonzero(free)
            if len(at):
                rows, out = [], []
                for i, raw in zip(at.tolist(), batch.column("ids").take(pa.array(at)).to_pylist()):
                    n = int(length[i])
                    for before, size, sequence, offset in cuts(int(of[n, 0]) + int(rank[i]) * n, n):
                        rows.append(i)
                        out.append((int(start[i]) + before, size, zlib.crc32(raw[4 * before : 4 * (before + size)]), sequence, offset))
                begin, size, sums, sequence, offset = (pa.array(c, pa.int64()) for c in zip(*out))
                own = batch.select(["doc_id", "doc_tokens"]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([own.column(0), begin, size, sums, own.column(1), sequence, offset], names)

    return ranked.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, name: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: every whole text's tokens in sequences.

    A sequence is filled gaplessly from 0, to ``capacity`` (a power of two) or to a smaller power of two. A null
    text is an empty one, whose only token is the closing one. Ids may be of any type; null and repeated ids are
    rows like others. Very long texts are cut at multiples of ``capacity`` first. Pieces of one length rank by the
    order in which tasks read them, those of cut documents first, so that a cut hits them first. Extra columns are
    left out, whatever their names; no rows give none.
    """
    scratch = Scratch(docs.sparkSession, "histogram")
    rows = scratch.keep(pieces(docs, id_col, text_col, vocab, name, capacity, end_id), "pieces")
    counts = scratch.keep(rows.groupBy("length", "cut", "task").agg(F.count("*").alias("n")), "counts")
    # one row for each length
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = layout(shortest_pack_first(histogram, capacity), capacity)
    before = Window.partitionBy("length").orderBy(F.desc("cut"), "task").rowsBetween(Window.unboundedPreceding, -1)
    first = scratch.keep(counts.select("length", "cut", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "first")
    # only lengths of which some are cut take their ids along
    own = rows.withColumn("ids", F.when(F.col("length").isin(list(plan.loose)), F.col("ids")))
    ranked = own.join(sized(first), ["length", "cut", "task"]).withColumn("rank", F.col("turn") + F.col("first"))
    return placed(ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", "ids"), plan).withColumnRenamed("doc_id", id_col)
