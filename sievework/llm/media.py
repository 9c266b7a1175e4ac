"""ISO media containers as binary columns.

``contain`` stores payloads as the samples of a one-track file. ``walk`` reads any ISO media file: it walks
the nested boxes and decodes the sample tables, and returns codec, duration and the byte ranges of
keyframes, without decoding a payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import map_texts

#: Fixed values of the format: boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}
CODEC = b"raw "
SAMPLE = 64
#: Samples in a chunk; each chunk begins with a keyframe.
CHUNK = 16
TIMESCALE = 1000
UNIT_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full_box(kind: bytes, *parts: bytes) -> bytes:
    return box(kind, b"\0\0\0\0", *parts)


def padded(text: bytes) -> bytes:
    """With zeros up to a positive multiple of the sample size."""
    return text + b"\0" * (max(SAMPLE, -(-len(text) // SAMPLE) * SAMPLE) - len(text))


def contain(payload: bytes) -> bytes:
    """A file with the payload's 8-bit samples in chunks, one tick of duration for each sample."""
    samples = len(payload) // SAMPLE
    chunks = -(-samples // CHUNK)
    head = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isommp42")
    rest = samples - (chunks - 1) * CHUNK
    runs = [(1, CHUNK)] * (chunks > 1) + [(chunks, rest)] * (chunks == 1 or rest != CHUNK)
    keys = np.arange(1, samples + 1, CHUNK, dtype=">u4").tobytes()

    def moov(first: int) -> bytes:
        offsets = (first + np.arange(chunks, dtype=np.int64) * CHUNK * SAMPLE).astype(">u8").tobytes()
        entry = box(CODEC, b"\0" * 6, struct.pack(">H", 1), struct.pack(">HHIHHHHI", 0, 0, 0, 1, 8, 0, 0, TIMESCALE << 16))
        stbl = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(">III", 1, samples, 1)),
            full_box(b"stss", struct.pack(">I", chunks), keys),
            full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", c, n, 1) for c, n in runs)),
            full_box(b"stsz", struct.pack(">II", SAMPLE, samples)),
            full_box(b"co64", struct.pack(">I", chunks), offsets),
        )
        minf = box(b"minf", full_box(b"smhd", b"\0" * 4), box(b"dinf", full_box(b"dref", struct.pack(">I", 1), box(b"url ", b"\0\0\0\1"))), stbl)
        mdia = box(b"mdia", full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, samples, 0x55C4, 0)), full_box(b"hdlr", b"\0" * 4, b"soun", b"\0" * 13), minf)
        tkhd = box(b"tkhd", b"\0\0\0\7", struct.pack(">IIIII", 0, 0, 1, 0, samples), b"\0" * 8, struct.pack(">HHHH", 0, 0, 0x100, 0), UNIT_MATRIX, b"\0" * 8)
        mvhd = full_box(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, samples, 0x10000, 0x100), b"\0" * 10, UNIT_MATRIX, b"\0" * 24, struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    first = len(head) + len(moov(0)) + 16
    return head + moov(first) + struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) + payload


def boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, start and end of the bodies of the boxes in a range; stops at what can't be a box."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and start + 16 <= end:
            size = struct.unpack_from(">Q", data, body)[0]
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            return
        yield kind, body, start + size
        start += size


def tracks(data: bytes) -> list[dict]:
    """The boxes of each track by kind, with nested ones walked."""
    found, todo = [], [(0, len(data), None)]
    while todo:
        start, end, track = todo.pop()
        for kind, a, b in boxes(data, start, end):
            inner = track
            if kind == b"trak":
                inner = {}
                found.append(inner)
            if kind in NESTED:
                todo.append((a, b, inner))
            elif track is not None:
                track[kind] = (a, b)
    return found


def table(data: bytes, at: tuple[int, int] | None, columns: int, kind: str = ">u4", skip: int = 4) -> np.ndarray:
    """The rows of a counted table in a full box."""
    if at is None:
        return np.zeros((0, columns), np.int64)
    n = struct.unpack_from(">I", data, at[0] + skip)[0]
    return np.frombuffer(data, kind, n * columns, at[0] + skip + 4).astype(np.int64).reshape(n, columns)


def walk(data: bytes) -> dict | None:
    """codec, timescale, duration, offsets and sizes of all samples, and keyframes (from 0), of the first track with samples; else None."""
    for t in tracks(data):
        if b"stsd" not in t or b"stsz" not in t or not (b"stco" in t or b"co64" in t):
            continue
        codec = data[t[b"stsd"][0] + 12 : t[b"stsd"][0] + 16].decode("latin-1")
        version = data[t[b"mdhd"][0]]
        timescale, duration = struct.unpack_from(">IQ" if version else ">II", data, t[b"mdhd"][0] + (20 if version else 12))
        each, n = struct.unpack_from(">II", data, t[b"stsz"][0] + 4)
        sizes = np.full(n, each, np.int64) if each else np.frombuffer(data, ">u4", n, t[b"stsz"][0] + 12).astype(np.int64)
        chunk_at = table(data, t[b"co64"], 1, ">u8")[:, 0] if b"co64" in t else table(data, t[b"stco"], 1)[:, 0]
        runs = table(data, t.get(b"stsc"), 3)
        per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunk_at) + 1)))
        chunk = np.repeat(np.arange(len(chunk_at)), per_chunk)[:n]
        before = np.cumsum(sizes) - sizes
        firsts = np.cumsum(per_chunk) - per_chunk
        offsets = chunk_at[chunk] + before - before[firsts[chunk]]
        keys = table(data, t[b"stss"], 1)[:, 0] - 1 if b"stss" in t else np.arange(n)
        return {"codec": codec, "timescale": timescale, "duration": duration, "offsets": offsets, "sizes": sizes, "keyframes": keys}
    return None


def read_samples(data: bytes, found: dict) -> bytes:
    """The samples in order, each contiguous run of them in one piece."""
    offsets, sizes = found["offsets"], found["sizes"]
    cut = np.flatnonzero(np.append(True, offsets[1:] != offsets[:-1] + sizes[:-1]))
    ends = np.append(cut[1:], len(offsets)) - 1
    return b"".join(data[a:b] for a, b in zip(offsets[cut].tolist(), (offsets[ends] + sizes[ends]).tolist()))


def feature(found: dict) -> str:
    """Codec, seconds, samples, and number and place of keyframe ranges, as text."""
    keys = found["keyframes"]
    at, size = found["offsets"][keys], found["sizes"][keys]
    ranges = zlib.crc32(np.stack([at, size], 1).astype("<i8").tobytes())
    return f"codec={found['codec'].strip()};seconds={found['duration'] / found['timescale']:.3f};samples={len(found['sizes'])};keyframes={len(keys)};first={at[0]}+{size[0]};last={at[-1]}+{size[-1]};ranges={ranges:08x}"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, media: every whole text in a container of its own; a null text is an empty one.

    Null and repeated ids are rows like others, no rows give none. Extra columns are left out, whatever their names.
    """
    def run(texts):
        for t in texts:
            raw = t.encode()
            yield None, {"n_bytes": pa.array([len(raw)], pa.int64()), "media": pa.array([contain(padded(raw))], pa.binary())}

    return map_texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, "n_bytes long, media binary").withColumnRenamed("id", id_col)


def inspect(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """``id_col``, codec, duration (s), samples, keyframes array<struct<start, length>> of every file.

    Null, empty and malformed files give nulls. No payload is decoded.
    """
    keyframes = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def run(batches):
        for batch in batches:
            out = []
            for m in batch.column("media"):
                try:
                    f = walk(m.as_py()) if m.is_valid else None
                except (struct.error, ValueError, IndexError, KeyError):
                    f = None
                k = f and f["keyframes"]
                out.append((f["codec"], f["duration"] / max(1, f["timescale"]), len(f["sizes"]), [{"start": int(a), "length": int(b)} for a, b in zip(f["offsets"][k], f["sizes"][k])]) if f else (None,) * 4)
            columns = zip(*out) if out else ((),) * 4
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.int64(), keyframes))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], ["id", "codec", "duration", "samples", "keyframes"])

    kind = media.schema[id_col].dataType.simpleString()
    rows = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    return rows.mapInArrow(run, f"id {kind}, codec string, duration double, samples long, keyframes array<struct<start: long, length: long>>").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text, reads the stored bytes back through the sample tables, and returns digests of both.

    A narrow job: the container lives only within its row's turn. Equal texts give equal values. A null text is
    an empty one; null and repeated ids are rows like others. Extra columns are left out, whatever their names.
    """
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def of(text: str) -> tuple:
        raw = text.encode()
        media = contain(padded(raw))
        found = walk(media)
        back = read_samples(media, found)
        return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(found)

    def run(texts):
        columns = zip(*map(of, texts)) if texts else ((),) * len(names)
        yield None, {n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)}

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_texts(rows, run, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("id", id_col)
