"""Words of many texts at once, as byte ranges and 64-bit hashes in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np

#: A random number for each byte at each of the first places of a word: words up to so long are hashed by their
#: sums (simple tabulation), which two different words share with a chance of 2 ** -64; longer ones by BLAKE2.
PLACES = 32
TABLE = np.random.default_rng(0x5EED).integers(0, 1 << 64, PLACES * 256 + PLACES + 1, np.uint64)
#: The six white-space bytes: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; equal bytes, equal hashes, wherever they stand. The ranges don't overlap."""
    size = ends - starts
    short = size <= PLACES
    begin, many = starts[short], size[short]
    total = np.concatenate([[0], np.cumsum(many)])
    place = np.arange(total[-1]) - np.repeat(total[:-1], many)
    sums = np.zeros(len(place) + 1, np.uint64)
    np.cumsum(TABLE[place * 256 + data[place + np.repeat(begin, many)]], out=sums[1:])
    out = np.empty(len(starts), np.uint64)
    out[short] = mix(sums[total[1:]] - sums[total[:-1]] + TABLE[PLACES * 256 + many])
    for i in np.flatnonzero(~short).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def chunks(texts: Iterable[bytes], most: int = 1 << 19) -> Iterator[tuple[int, int, list[bytes]]]:
    """Consecutive texts of together about ``most`` bytes; a longer text stands alone."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        if held and size + len(t) > most:
            yield first, i, held
            held, size, first = [], 0, i
        held.append(t)
        size += len(t) + 1
    if held:
        yield first, first + len(held), held


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One byte array with a line feed after each text, and where each text begins (one more at the end)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), at


def lowered_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (A-Z lower-cased, cut at white space) and the first word's place per text."""
    data, at = joined(texts)
    data = LOWER[data]
    starts, ends = runs(~SPACE[data])
    return hashes(data, starts, ends), np.searchsorted(starts, at)
