"""Exact n-gram Jaccard join with signature trees.

Equal shingle sets fold into one class. Two sets can only link if they share one of their first tokens in a
global order (prefix filter); the order puts tokens that are frequent in the corpus last, so that common
passages and phrases don't bring unlike documents together. Of the classes that share a token those are left whose
sizes and places of the token allow a link with another (position filter). They are searched by
signature trees: a node holds the OR of its members' token bitmaps and their range of sizes, and a dual
traversal passes over pairs of nodes whose largest possible overlap is too small.

Pairs that survive are not written down: what may link is connected where it is found, a row for each member
of a list, and the connected groups are families. Every link lies within one family, so the whole sets of a
family meet once and are joined there exactly. A family of more than one task's share is dealt as pairs of
parts. So nothing that moves grows with the square of a group of copies, near copies or almost near copies.

Shingles are told apart by 64-bit hashes: two different ones of a corpus of ``n`` are taken for one with a
chance of about n * n / 2 ** 65, and no family of words is known that makes it likelier.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch, few_at_once, map_texts, sized
from .wordbytes import chunks, lowered_words, mix

#: Tokens counted in the corpus, as a multiple of the prefix: those in the lowest part of the hash space. A token
#: in ``LEAST_HEAVY`` classes or more is heavy; of more such tokens than ``MOST_HEAVY``, the most frequent ones.
#: Which tokens are heavy changes the work and never the result.
COUNTED, LEAST_HEAVY, MOST_HEAVY = 2.5, 24, 1 << 19
#: Members of a token's list that one task takes at most; longer lists are dealt as pairs of parts.
PART = 1024
#: Members and tokens of a family's part.
SHARE, SHARE_TOKENS = 2048, 1 << 22
#: Members of a leaf, and nodes below an inner node.
LEAF, FAN = 16, 8
#: Bits of a bitmap: two for each token at least, a power of two within these.
FEWEST_BITS, MOST_BITS = 256, 1 << 13
#: Bytes of sets that are handed on at once, and nodes that a task remembers to have sent.
SLICE, REMEMBERED = 4 << 20, 1_000_000


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's n-word shingles; with fewer words, of the whole sequence."""
    words, at = lowered_words(texts)
    size = np.diff(at)
    out = []
    with np.errstate(over="ignore"):
        code = words.copy()
        for k in range(1, n):
            code = mix(code * np.uint64(31) + np.concatenate([words[k:], np.zeros(min(k, len(words)), np.uint64)])[: len(words)] + np.uint64(k))
        for i, a in enumerate(at[:-1].tolist()):
            m = int(size[i])
            if m >= n:
                own = np.unique(code[a : a + m - n + 1])
            elif m:
                h = np.uint64(m)
                for w in words[a : a + m]:
                    h = mix(np.array([h * np.uint64(37) + w]))[0]
                own = np.array([h])
            else:
                own = words[:0]
            out.append(own.view(np.int64))
    return out


def sets_of(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """The set of each text; a null text has none."""
    for _, _, own in chunks((t or "").encode("utf-8", "replace") for t in texts):
        yield from shingle_sets(own, n)


def set_hash(own: np.ndarray) -> int:
    """A 64-bit hash of a set."""
    if not len(own):
        return 0
    x = own.view(np.uint64)
    with np.errstate(over="ignore"):
        both = mix(np.array([x.sum(dtype=np.uint64) + np.uint64(len(x)) * np.uint64(0x9E3779B97F4A7C15), np.bitwise_xor.reduce(mix(x + np.uint64(1)))]))
        return int(mix(both[:1] * np.uint64(3) + both[1:]).view(np.int64)[0])


def counted(own: np.ndarray, percent: int) -> np.ndarray:
    """Whether each token is among those counted in the corpus."""
    return own.view(np.uint64) < np.uint64(min(1.0, COUNTED * (1 - percent / 100)) * (2**64 - 2**12))


def prefix(own: np.ndarray, heavy: np.ndarray, percent: int) -> np.ndarray:
    """The first tokens in the global order, enough for any linked set to share one of them.

    The order: counted tokens that aren't heavy, tokens that weren't counted, heavy ones; each by hash.
    """
    n = len(own)
    need = n - -(-percent * n // 100) + 1
    known = counted(own, percent)
    often = np.zeros(n, bool)
    if len(heavy):
        often = known & (heavy[np.minimum(np.searchsorted(heavy, own), len(heavy) - 1)] == own)
    order = np.lexsort((own.view(np.uint64), np.where(often, 2, np.where(known, 0, 1))))
    return own[order[:need]]


def bits_for(size: int) -> int:
    return min(MOST_BITS, max(FEWEST_BITS, 1 << int(2 * size - 1).bit_length())) if size else FEWEST_BITS


def bitmap(own: np.ndarray, bits: int) -> np.ndarray:
    """A bit for each token, as bytes."""
    out = np.zeros(bits, np.uint8)
    out[(own.view(np.uint64) >> np.uint64(20)) % np.uint64(bits)] = 1
    return np.packbits(out, bitorder="little")


def folded(maps: np.ndarray, bits: int) -> np.ndarray:
    """Bitmaps (rows of bytes) of fewer bits, by OR of their halves, which keeps every bound."""
    while maps.shape[1] * 8 > bits:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


COUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class SignatureTree:
    """Nodes over members in the order of their sizes; level 0 is the members, each level groups the one below."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray, owner: np.ndarray):
        self.levels = []
        low, high, least, every, fan = sizes, sizes, owner, maps, LEAF
        common = maps
        while True:
            most = least if not self.levels else most
            self.levels.append((low, high, every, common, least, most))
            if len(low) <= FAN:
                break
            cut = np.arange(0, len(low), fan)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            every, common = np.bitwise_or.reduceat(every, cut), np.bitwise_and.reduceat(common, cut)
            least, most = np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut)
            fan = FAN
        self.fans = [LEAF if k == 1 else FAN for k in range(len(self.levels))]

    def below(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of nodes, and which node each belongs to."""
        fan = self.fans[level]
        child = nodes[:, None] * fan + np.arange(fan)
        which = np.broadcast_to(np.arange(len(nodes))[:, None], child.shape)
        there = child < len(self.levels[level - 1][0])
        return child[there], which[there]


def possible(ta: SignatureTree, la: int, a: np.ndarray, tb: SignatureTree, lb: int, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether two nodes can hold linked members of different components.

    With sizes s >= t the overlap must be percent/(100+percent) of s + t, so t >= percent * s / 100, and no
    set may lack more of the other than its size less that overlap. Every member of a node has the bits
    common to it, and none has a bit that its OR lacks.
    """
    lo_a, hi_a, or_a, and_a, c0, c1 = (x[a] for x in ta.levels[la])
    lo_b, hi_b, or_b, and_b, d0, d1 = (x[b] for x in tb.levels[lb])
    good = (100 * hi_b >= percent * lo_a) & (100 * hi_a >= percent * lo_b)
    good &= ~((c0 == c1) & (d0 == d1) & (c0 == d0))
    at = np.flatnonzero(good)
    if len(at):
        # overlap * (100 + percent) >= percent * (s + t): what s may lack of t grows with s and falls with t
        spare_a = hi_a[at] - -(-percent * (hi_a[at] + np.maximum(lo_b[at], -(-percent * hi_a[at] // 100))) // (100 + percent))
        spare_b = hi_b[at] - -(-percent * (hi_b[at] + np.maximum(lo_a[at], -(-percent * hi_b[at] // 100))) // (100 + percent))
        good[at] = (COUNT[and_a[at] & ~or_b[at]].sum(1, dtype=np.int64) <= spare_a) & (COUNT[and_b[at] & ~or_a[at]].sum(1, dtype=np.int64) <= spare_b)
    return good


def dual(ta: SignatureTree, tb: SignatureTree, percent: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members that survive the dual traversal; of one tree with itself each pair once."""
    la, lb = len(ta.levels) - 1, len(tb.levels) - 1
    na, nb = len(ta.levels[la][0]), len(tb.levels[lb][0])
    a, b = (x.ravel() for x in np.meshgrid(np.arange(na), np.arange(nb), indexing="ij"))
    while True:
        if same:
            keep = a < b if la == 0 else a <= b
            a, b = a[keep], b[keep]
        parts = [np.flatnonzero(possible(ta, la, a[i : i + 8192], tb, lb, b[i : i + 8192], percent)) + i for i in range(0, len(a), 8192)]
        keep = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        a, b = a[keep], b[keep]
        if la == 0 and lb == 0:
            return a, b
        if la >= lb and la > 0:
            child, which = ta.below(la, a)
            la -= 1
            if same:  # both sides go down together
                a, b = child, b[which]
                child, which = tb.below(lb, b)
                lb -= 1
                a, b = a[which], child
            else:
                a, b = child, b[which]
        else:
            child, which = tb.below(lb, b)
            lb -= 1
            a, b = a[which], child


def joined_up(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """For each of ``n`` things the smallest one connected with it by the pairs (a, b), or by equal labels given."""
    label = np.arange(n) if label is None else label
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b):
            np.minimum.at(new, label[x], least)
            np.minimum.at(new, x, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


class Members:
    """Members of many lists, in the order of their lists: node, size, part, and their bitmaps by number of bits."""

    def __init__(self, pdf: pd.DataFrame):
        self.node, self.size, self.part = (pdf[c].to_numpy() for c in ("node", "size", "part"))
        self.raw = pdf["map"].to_numpy()
        self.bits = np.fromiter(map(len, self.raw), np.int64, len(pdf)) * 8

    def maps(self, at: np.ndarray, bits: int) -> np.ndarray:
        out = np.zeros((len(at), bits // 8), np.uint8)
        for b in np.unique(self.bits[at]).tolist():
            own = np.flatnonzero(self.bits[at] == b)
            out[own] = folded(np.frombuffer(b"".join(self.raw[at[own]]), np.uint8).reshape(len(own), b // 8), bits)
        return out

    def linkable(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Whether pairs of members may link, by sizes and bitmaps."""
        s, t = self.size[a].astype(np.int64), self.size[b].astype(np.int64)
        good = (100 * t >= percent * s) & (100 * s >= percent * t)
        need = -(-percent * (s + t) // (100 + percent))
        bits = np.minimum(self.bits[a], self.bits[b])
        for n in np.unique(bits[good]).tolist():
            pairs = np.flatnonzero(good & (bits == n))
            for i in range(0, len(pairs), 8192):
                at = pairs[i : i + 8192]
                x, y = self.maps(a[at], n), self.maps(b[at], n)
                good[at] = (COUNT[x & ~y].sum(1, dtype=np.int64) <= s[at] - need[at]) & (COUNT[y & ~x].sum(1, dtype=np.int64) <= t[at] - need[at])
        return good


def ends_of_lists(key: np.ndarray) -> np.ndarray:
    """For each row of lists that lie one after the other the row after its list."""
    start = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
    end = np.append(start[1:], len(key))
    return np.repeat(end, end - start)


def matched(pdf: pd.DataFrame, percent: int) -> np.ndarray:
    """Whether each row of whole lists, which lie by size, may link with another row that it meets there.

    Linked sets share enough tokens from their first common one on, in the list of that token: so many follow it in
    both, itself included. Rows of which this holds with no other of their list are found elsewhere, or link with none.
    """
    key = pdf[["token", "i", "j"]].to_numpy()
    size, part = pdf["size"].to_numpy(np.int64), pdf["part"].to_numpy()
    rest = size - pdf["at"].to_numpy(np.int64)
    end, alike = ends_of_lists(key), key[:, 1] == key[:, 2]
    good = np.zeros(len(pdf), bool)
    a, d = np.arange(len(pdf)), 1
    while len(a := a[a + d < end[a]]):
        a = a[100 * size[a] >= percent * size[a + d]]  # those further on are no smaller
        b = a + d
        able = (100 + percent) * np.minimum(rest[a], rest[b]) >= percent * (size[a] + size[b])
        able &= alike[a] | (part[a] != part[b])
        good[a[able]] = good[b[able]] = True
        d += 1
    return good


def whole_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of lists that lie one after the other, cut between lists."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        last = pdf[["token", "i", "j"]].to_numpy()
        cut = len(pdf) - int(np.argmax((last[::-1] != last[-1]).any(1))) if len(pdf) and (last != last[-1]).any() else 0
        rest = pdf.iloc[cut:].reset_index(drop=True)
        if cut:
            yield pdf.iloc[:cut].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def connected(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """(a, b): of each group of nodes that the lists of a frame connect, the smallest with each of the others.

    Members of part 0 meet each other where there is no part 1, else those of part 1. Short lists are single
    leaves; the others become trees, in which members that a long list's first, shortest or longest member
    connects count as one.
    """
    m = Members(pdf)
    key = pdf[["token", "i", "j"]].to_numpy()
    start = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
    count = np.diff(np.append(start, len(pdf)))
    group = np.repeat(np.arange(len(start)), count)
    which, nodes = pd.factorize(m.node, sort=True)
    small = (count <= LEAF)[group] & (m.part == 0) & ~np.isin(group, group[m.part == 1])
    found = []
    for d in range(1, LEAF):
        a = np.flatnonzero(small[:-d] & (group[:-d] == group[d:])) if len(pdf) > d else np.zeros(0, np.int64)
        if not len(a):
            break
        good = m.linkable(a, a + d, percent)
        found.append((which[a[good]], which[a[good] + d]))
    a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    label = joined_up(len(nodes), a, b)
    for g in np.unique(group[~small]).tolist():
        own = np.arange(start[g], start[g] + count[g])
        sides = [own[m.part[own] == p] for p in (0, 1)]
        if not len(sides[1]):
            if key[start[g], 1] != key[start[g], 2]:
                continue  # the other part of the list is empty
            sides[1] = sides[0]
        if not len(sides[0]):
            continue
        by_size = sides[0][np.argsort(m.size[sides[0]], kind="stable")]
        for hub in {int(sides[0][0]), int(by_size[0]), int(by_size[-1])}:
            hubs = np.full(len(sides[1]), hub)
            good = m.linkable(hubs, sides[1], percent)
            label = joined_up(len(nodes), which[hubs[good]], which[sides[1][good]], label)
        if len(np.unique(label[which[own]])) == 1:
            continue
        same = sides[0] is sides[1]
        bits = int(m.bits[own].min())
        sides = [x[np.lexsort((m.size[x], label[which[x]]))] for x in sides]
        grown = [SignatureTree(m.size[x].astype(np.int64), m.maps(x, bits), label[which[x]]) for x in sides[: 1 if same else 2]]
        a, b = dual(grown[0], grown[-1], percent, same)
        a, b = sides[0][a], sides[-1][b]
        good = m.linkable(a, b, percent)  # by each pair's own bits, where the tree's are those of the smallest member
        label = joined_up(len(nodes), which[a[good]], which[b[good]], label)
    to = nodes[label]
    apart = to != nodes
    return pd.DataFrame({"a": to[apart], "b": nodes[apart]})


def linked(sets: list[np.ndarray], part: np.ndarray, percent: int) -> np.ndarray:
    """For each set the first one that links connect it with. Sets of part 0 meet each other where there is no part 1, else those of part 1.

    Exact: bitmaps of eight bits a token in signature trees choose the pairs, whole sets decide.
    """
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    both = bool(part.any())
    label = np.arange(n)
    token = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    end = np.cumsum(size)
    begin = end - size
    marks = np.zeros(int(token.max()) + 1, bool)

    def meet(one: int, others: np.ndarray, label: np.ndarray) -> np.ndarray:
        others = others[label[others] != label[one]]
        if not len(others):
            return label
        marks[token[begin[one] : end[one]]] = True
        many = size[others]
        first = np.cumsum(many) - many
        at = np.arange(int(many.sum())) + np.repeat(begin[others] - first, many)
        shared = np.add.reduceat(marks[token[at]], first, dtype=np.int64)
        marks[token[begin[one] : end[one]]] = False
        good = others[100 * shared >= percent * (size[one] + many - shared)]
        if len(good):
            old = np.unique(label[good])
            least = min(int(label[one]), int(old[0]))
            label = np.where(np.isin(label, old) | (label == label[one]), least, label)
        return label

    def met(one: int, others: np.ndarray, label: np.ndarray) -> np.ndarray:
        for few in np.array_split(others, max(1, int(size[others].sum()) >> 22)):
            label = meet(one, few, label)
        return label

    zero, rest = np.flatnonzero(part == 0), np.flatnonzero(part == 1) if both else np.arange(n)
    if not len(zero) or n < 2:
        return label
    if n <= LEAF:
        for x in zero.tolist():
            label = met(x, rest if both else np.arange(x + 1, n), label)
        return label
    for x in {int(zero[0]), int(zero[np.argmin(size[zero])]), int(zero[np.argmax(size[zero])]), int(zero[len(zero) // 2])}:
        label = met(x, rest[rest != x], label)
    bits = min(MOST_BITS, 4 * bits_for(int(np.median(size))))
    order = [x[np.lexsort((size[x], label[x]))] for x in ([zero, rest] if both else [zero])]
    grown = [SignatureTree(size[x], np.stack([bitmap(sets[i], bits) for i in x.tolist()]), label[x]) for x in order]
    a, b = dual(grown[0], grown[-1], percent, not both)
    a, b = order[0][a], order[-1][b]
    by = np.argsort(a, kind="stable")
    a, b = a[by], b[by]
    cut = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else []
    for i, j in zip(cut, np.append(cut[1:], len(a))):
        label = met(int(a[i]), b[i:j], label)
    return label


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """node and ``name`` (the smallest node reachable) of every node of ``edges`` (a, b).

    Every node takes the smallest label among its neighbours', then its label's own label, until nothing
    changes; paths halve in each round. Labels move by joins, hot nodes by partial aggregation.
    """
    both = scratch.keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = scratch.keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        stepped = scratch.keep(label.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")), "stepped")
        up = stepped.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        jumped = scratch.keep(stepped.join(up, "comp", "left").select("node", "old", F.least("comp", F.coalesce("up", "comp")).alias("comp")), "jumped")
        scratch.drop(label, stepped)
        if jumped.where("comp <> old").isEmpty():
            scratch.drop(both)
            return jumped.select("node", F.col("comp").alias(name))
        path, label = jumped.table_path, jumped.select("node", "comp")
        label.table_path = path


def heavy_tokens(scratch: Scratch, given: DataFrame, n: int, percent: int) -> np.ndarray:
    """The counted tokens that are heavy, sorted: ``MOST_HEAVY`` at most."""
    def tally(batches):
        for batch in few_at_once(batches, 2000):
            found = [s[counted(s, percent)] for s in sets_of(batch.column(0).to_pylist(), n)]
            token, times = np.unique(np.concatenate(found or [np.zeros(0, np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(times.astype(np.int64))], ["token", "n"])

    sums = given.select("text").mapInArrow(tally, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    often = scratch.keep(sums.where(F.col("n") >= LEAST_HEAVY), "often")
    floor, held = LEAST_HEAVY, 0
    for r in often.groupBy(F.floor(F.log2("n")).alias("k")).count().orderBy(F.desc("k")).collect():  # a row for each power of two
        held += r["count"]
        if held > MOST_HEAVY:
            floor = 1 << (r["k"] + 1)
            break
    found = np.sort(often.where(F.col("n") >= floor).select("token").toPandas()["token"].to_numpy(np.int64))
    scratch.drop(often)
    return found


def dealt(rows: DataFrame, parts: str) -> DataFrame:
    """``rows`` (node, k parts) once for each pair of parts i <= j that theirs is in; ``part`` 1 is the second of two."""
    own = rows.withColumn("p", F.pmod(F.xxhash64("node"), F.col(parts)).cast("int"))
    own = own.withColumn("q", F.explode(F.sequence(F.lit(0), F.col(parts) - 1)))
    return own.withColumn("i", F.least("p", "q")).withColumn("j", F.greatest("p", "q")).withColumn("part", (F.col("p") > F.col("q")).cast("int")).drop("p", "q", parts)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """``id_col``, n_shingles, component_id (smallest id reachable by links, itself included) of every row.

    Two documents link when 100 * shared >= ``percent`` * (size of both together). Null, empty and wordless
    texts have no shingles and link with nothing. Ids may be of any ordered type; a null id takes no part and
    has a null component. Repeated rows are rows of one class, very long texts are sets like others. Extra
    columns are left out, whatever their names. No rows give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    heavy = spark.sparkContext.broadcast(heavy_tokens(scratch, given, n, percent))
    seen: set[int] = set()  # of each task: its function comes anew, so that a task that is run again sends all of its own

    def heads_of(texts):
        node, size, first, maps = [], [], [], []
        for s in sets_of(texts, n):
            h = set_hash(s)
            new = len(s) and h not in seen
            if new and len(seen) < REMEMBERED:
                seen.add(h)
            node.append(h)
            size.append(len(s))
            first.append(prefix(s, heavy.value, percent) if new else None)
            maps.append(bitmap(s, bits_for(len(s))).tobytes() if new else None)
        yield None, {"node": pa.array(node, pa.int64()), "size": pa.array(size, pa.int32()), "prefix": pa.array(first, pa.list_(pa.int64())), "map": pa.array(maps, pa.binary())}

    wide = scratch.keep(map_texts(given, heads_of, "node long, size int, prefix array<long>, map binary"), "wide")
    classes = scratch.keep(wide.where("size > 0 and id is not null").groupBy("node").agg(F.min("id").alias("first")), "classes")
    heads = wide.where("prefix is not null").dropDuplicates(["node"]).join(classes.select("node"), "node", "left_semi")
    heads = scratch.keep(heads.select("node", "size", "prefix", "map"), "heads")
    rows = scratch.keep(wide.select("id", "node", "size"), "rows")
    scratch.drop(wide)

    # the lists of the first tokens; long ones as pairs of parts
    entries = heads.select("node", "size", F.posexplode("prefix").alias("at", "token"))
    sums = entries.groupBy("token").agg(F.count("*").alias("length"), F.min("size").alias("least"), F.max("size").alias("most"))
    able = (F.col("length") > 2) | ((F.col("length") == 2) & (100 * F.col("least") >= percent * F.col("most")))
    counts = scratch.keep(sums.where(able).select("token", "length"), "counts")
    shared = scratch.keep(dealt(entries.join(counts, "token").withColumn("k", F.ceil(F.col("length") / PART).cast("int")).drop("length"), "k"), "shared")

    def meet(batches):
        for pdf in whole_lists(batches):
            yield pdf[matched(pdf, percent)]

    # bitmaps move for those alone that may link in a list by their sizes and its token's places
    by_list = shared.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "size")
    paired = by_list.mapInPandas(meet, shared.schema).drop("at")
    lists = paired.join(heads.select("node", "map"), "node").repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")

    def search(batches):
        for pdf in whole_lists(batches):
            yield connected(pdf, percent)

    close = scratch.keep(lists.mapInPandas(search, "a long, b long").distinct(), "close")
    family = components(scratch, close, "family")
    scratch.drop(counts, shared, close)

    # each family's sets meet once, in parts of a bounded size
    members = family.join(heads.select("node", "size"), "node").join(classes, "node").select("node", "family", "size", F.col("first").alias("id"))
    shares = members.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / SHARE, F.sum("size") / SHARE_TOKENS)).cast("int").alias("k"))
    asked = scratch.keep(members.join(shares, "family").select("id", "node", "family", "k"), "asked")
    sent: set[int] = set()  # of each task

    def sets_again(batches):
        for batch in few_at_once(batches):
            node = batch.column("node").to_pylist()
            at, own, weight = [], [], 0
            for r, s in enumerate(sets_of(batch.column("text").to_pylist(), n)):
                if set_hash(s) != node[r] or node[r] in sent:
                    continue  # another row with the id of the class's first
                if len(sent) < REMEMBERED:
                    sent.add(node[r])
                at.append(r)
                own.append(s.tobytes())
                weight += len(own[-1])
                if weight > SLICE:
                    yield taken(batch, at, own)
                    at, own, weight = [], [], 0
            if at:
                yield taken(batch, at, own)

    def taken(batch, at, own):
        few = batch.select(["node", "family", "k"]).take(pa.array(at, pa.int32()))
        return pa.RecordBatch.from_arrays([*few.columns, pa.array(own, pa.binary())], ["node", "family", "k", "own"])

    met = given.join(sized(asked), "id").select("text", "node", "family", "k").mapInArrow(sets_again, "node long, family long, k int, own binary")

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values("node")
        node = pdf["node"].to_numpy()
        part = pdf["part"].to_numpy()
        if pdf["i"].iloc[0] != pdf["j"].iloc[0] and not part.any():
            return pd.DataFrame({"a": node[:0], "b": node[:0]})  # the other part is empty
        to = node[linked([np.frombuffer(x, np.int64) for x in pdf["own"]], part, percent)]
        return pd.DataFrame({"a": to[to != node], "b": node[to != node]})

    links = scratch.keep(dealt(met, "k").groupBy("family", "i", "j").applyInPandas(resolve, "a long, b long"), "links")
    comps = components(scratch, links, "comp")

    first = scratch.keep(comps.join(classes, "node"), "firsts")
    named = scratch.keep(first.join(first.groupBy("comp").agg(F.min("first").alias("component_id")), "comp").select("node", "component_id"), "named")
    alone = rows.join(classes, "node", "left").join(named, "node", "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce(F.when(F.col("size") > 0, F.coalesce("component_id", "first")), F.col("id")))
    return alone.select(F.col("id").alias(id_col), F.col("size").cast("long").alias("n_shingles"), own.alias("component_id"))
