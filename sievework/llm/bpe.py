"""Byte-level BPE by speculation and verification.

A token sequence is the BPE encoding of its bytes exactly when every adjacent pair of tokens is
compatible: no merge across the boundary would have come before the two tokens were complete. So a
greedy longest match proposes tokens for each new word, numpy tests all adjacent pairs of all new words
together, and only the words with a failing pair go through the merges one by one.

Words are encoded once per Python worker and kept, up to ``CACHE`` words, by a 64-bit hash of their
bytes (two of a million words share one with a chance of about 3e-8) or by their text.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import map_texts
from .wordbytes import hashes

#: Words and ids that a worker keeps.
CACHE, CACHE_IDS = 500_000, 1 << 23
#: White space as the tokenizer's pattern means it, then the pattern itself.
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


#: Texts of these characters alone are cut into words in numpy; the others by the pattern.
SIMPLE = re.compile(r"[\t\n\r -&(-~À-ÖØ-öø-ÿ]*")
#: Classes of bytes in such texts: 0 between texts, 1 white space, 2 letters, 3 digits, 4 the rest.
CLASS = np.full(256, 4, np.uint8)
CLASS[0] = 0
CLASS[[9, 10, 13, 32]] = 1
CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 2
CLASS[48:58] = 3


class IdStore:
    """Ids of known words, one after another in a flat array."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.known: dict = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)
        self.size = 0

    def add(self, keys: list, ids: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        n, first = self.size, self.ends[self.size]
        total = int(sizes.sum())
        while first + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(ids) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[first : first + total] = np.fromiter((i for x in ids for i in x), np.uint32, total)
        self.ends[n + 1 : n + 1 + len(ids)] = first + np.cumsum(sizes)
        self.known.update(zip(keys, range(n, n + len(ids))))
        self.size += len(ids)

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words ``at``, and how many of them end with each word."""
        first = self.ends[at]
        size = self.ends[at + 1] - first
        total = np.cumsum(size)
        where = np.arange(total[-1] if len(total) else 0) + np.repeat(first - (total - size), size)
        return self.flat[where], total


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's place among the distinct ones, the distinct hashes, and where each stands first."""
    codes, found = pd.factorize(hashes)
    first = np.empty(len(found), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, found, first


def simple_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts texts of SIMPLE characters as PATTERN does: bytes, starts, ends, and the first word of each text."""
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    kind = CLASS[data]
    starts = np.ones(len(data), bool)
    starts[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 0)
    after_white = np.flatnonzero(starts[1:] & (kind[1:] >= 2) & (kind[:-1] == 1)) + 1
    starts[after_white - 1] = True  # the last white byte of a run stands alone or goes with the word
    starts[after_white[data[after_white - 1] == 32]] = False
    begin = np.flatnonzero(starts)
    end = np.append(begin[1:], len(data))
    word = kind[begin] != 0
    begin, end = begin[word], end[word]
    return data, begin, end, np.searchsorted(begin, at)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class SpeculativeBpe(IdStore):
    """A vocabulary whose ids from 256 on are in merge order, as in the file named by ``path``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = {bytes(letters[c] for c in k): v for k, v in spec["model"]["vocab"].items()}
        self.ids = vocab
        #: The longest token by its first bytes, at most three.
        self.longest: dict[bytes, int] = {}
        for k in vocab:
            for n in range(1, min(3, len(k)) + 1):
                self.longest[k[:n]] = max(len(k), self.longest.get(k[:n], 0))
        n = 1 + max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])])
        self.bytes_of = [b""] * n
        for k, v in vocab.items():
            self.bytes_of[v] = k
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for k, v in self.special.items():
            self.bytes_of[v] = k.encode()
        self.cut = regex.compile("|".join(f"({regex.escape(k)})" for k in self.special)) if self.special else None
        self.words = regex.compile(PATTERN)
        self.left, self.right = np.arange(n), np.arange(n)
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        keys, made = [], []
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            a, b = (bytes(letters[c] for c in x) for x in (a, b))
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.ranks[x, y] = (rank, z)
            if self.left[z] == z:
                self.left[z], self.right[z] = x, y
            keys.append(x * n + y)
            made.append(z)
        order = np.argsort(keys)
        self.n = n
        self.keys, self.made = np.array(keys)[order], np.array(made)[order]
        super().__init__()

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, i, n, ids, longest = [], 0, len(word), self.ids, self.longest
        while i < n:
            head = word[i : i + 3]
            j = min(n, i + (longest.get(head) or longest.get(head[:2]) or 1))
            while (found := ids.get(word[i:j])) is None:
                j -= 1
            out.append(found)
            i = j
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of adjacent tokens keeps its boundary under the merges.

        Goes back in time: of the two pieces at the boundary the one made later is undone, and a merge
        of the pieces before that moment would have crossed the boundary. Of equal merges the left one
        comes first, so an undone right piece gives way to an equal crossing merge.
        """
        a, b = a.copy(), b.copy()
        good = np.ones(len(a), bool)
        limit = np.full(len(a), self.n + 1, np.int64)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * self.n + y
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            crossed = (self.keys[at] == key) & (self.made[at] < limit[live])
            good[live[crossed]] = False
            live = live[~crossed & (np.maximum(x, y) >= 256)]
            x, y = a[live], b[live]
            undo_left = x > y
            limit[live] = np.where(undo_left, x, y + 1)
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
        return good

    def merged(self, word: bytes) -> list[int]:
        """The exact merges, lowest rank first and of equal ones the leftmost, from a heap of neighbouring pairs."""
        parts = [self.ids[word[i : i + 1]] for i in range(len(word))]
        n, ranks = len(parts), self.ranks
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(*found, i, i + 1, parts[i], parts[i + 1]) for i in range(n - 1) if (found := ranks.get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, made, i, j, x, y = heapq.heappop(heap)
            if after[i] != j or parts[i] != x or parts[j] != y:
                continue  # one of the two has been merged since
            parts[i], parts[j] = made, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if found := ranks.get((made, parts[k])):
                    heapq.heappush(heap, (*found, i, k, made, parts[k]))
            h = before[i]
            if h >= 0 and (found := ranks.get((parts[h], made))):
                heapq.heappush(heap, (*found, h, i, parts[h], made))
        return [x for x in parts if x >= 0]

    def learn(self, keys: list, words: list[bytes]) -> None:
        """Encodes words that aren't known yet."""
        ids = [self.propose(w) for w in words]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(ids)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inner] * self.n + flat[inner + 1], return_inverse=True)
        good = self.compatible(pairs // self.n, pairs % self.n)
        for i in np.unique(owner[inner[~good[back]]]):
            ids[i] = self.merged(words[i])
        self.add(keys, ids)

    def encode_simple(self, texts: list[bytes]) -> list[np.ndarray]:
        """Texts of SIMPLE characters."""
        data, begin, end, first = simple_words(texts)
        codes, found, seen = distinct(hashes(data, begin, end))
        keys = found.tolist()
        at = np.fromiter(map(self.known.get, keys, itertools.repeat(-1)), np.int64, len(keys))
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            raw = data.tobytes()
            at[fresh] = self.size + np.arange(len(fresh))
            self.learn([keys[i] for i in fresh.tolist()], [raw[begin[k] : end[k]] for k in seen[fresh].tolist()])
        ids, total = self.gather(at[codes])
        total = np.concatenate([[0], total])[first]
        return [ids[total[i] : total[i + 1]] for i in range(len(texts))]

    def encode_other(self, text: str) -> np.ndarray:
        """Any text; the strings of special tokens become those tokens."""
        words: list[str] = []
        for piece in self.cut.split(text) if self.cut is not None and any(k in text for k in self.special) else [text]:
            if piece in self.special:
                words.append(piece)
            elif piece:
                words.extend(self.words.findall(piece))
        known = self.known
        fresh = sorted({w for w in words if w not in known and w not in self.special})
        if fresh:
            self.learn(fresh, [w.encode() for w in fresh])
        marks = [k for k in self.special if k not in known]
        if marks:
            self.add(marks, [[self.special[k]] for k in marks])
        return self.gather(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))[0]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit numbers."""
        if self.size > CACHE or len(self.flat) > CACHE_IDS:
            self.forget()
        simple = [bool(SIMPLE.fullmatch(t)) and not any(k in t for k in self.special) for t in texts]
        quick = iter(self.encode_simple([t.encode() for t, s in zip(texts, simple) if s]) if any(simple) else ())
        return [next(quick) if s else self.encode_other(t) for t, s in zip(texts, simple)]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


_loaded: dict[str, SpeculativeBpe] = {}


def loaded(path: str) -> SpeculativeBpe:
    """One vocabulary for each Python worker."""
    if path not in _loaded:
        _loaded[path] = SpeculativeBpe(path)
    return _loaded[path]


def blocks(texts: list[str], most: int = 1 << 19) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of together about ``most`` characters."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        if held and size + len(t) > most:
            yield first, held
            held, size, first = [], 0, i
        held.append(t)
        size += len(t)
    if held:
        yield first, held


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, name: str = "byte_bpe_50k.json") -> DataFrame:
    """``id_col``, ``ids array<int>`` of every row; a null text is an empty one. Extra columns are left out, whatever their names."""
    def run(texts):
        bpe = loaded(vocab or public_tokenizers.path(name))
        for _, few in blocks(texts):
            yield None, {"ids": pa.array([x.astype(np.int32) for x in bpe.encode_batch(few)], pa.list_(pa.int32()))}

    return map_texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, "ids array<int>").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocab: str | None = None, name: str = "byte_bpe_50k.json") -> DataFrame:
    """``id_col``, ``text`` of every row of ids; null or no ids give an empty text. Extra columns are left out; no rows give none."""
    def run(batches):
        bpe = loaded(vocab or public_tokenizers.path(name))
        for batch in batches:
            texts = [bpe.decode(np.asarray(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    given = rows.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return given.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, name: str = "byte_bpe_50k.json") -> DataFrame:
    """Encodes and decodes every whole text, and returns digests of both: id, n_tokens, ids_sha256, decoded_sha256.

    A narrow job without a shuffle. Null texts count as empty (no ids), null ids stay null, repeated rows give
    repeated results, no rows give none. Extra columns are left out, whatever their names.
    """
    def run(texts):
        bpe = loaded(vocab or public_tokenizers.path(name))
        for _, few in blocks(texts):
            ids = bpe.encode_batch(few)
            yield None, {
                "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids_sha256": [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids],
            }

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_texts(rows, run, "n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
