"""Tables that users and models lay over posts: favourites, labels, subscriptions, states, digests."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import search as S
from .classify import CATEGORIES, OTHER
from .dedup import last_writer
from .index import FIELDS, MOST_GONE, Index, at_hand, segment_of, sized


#: Fixed value: characters of a favourite's tag.
TAG_LENGTH = 12
#: Posts and characters of a block of posts, subscriptions of a group, about; a group meets a block in one task.
BLOCK, BLOCK_TEXT, GROUP = 32_768, 100_000_000, 250_000
#: Postings that a task packs at once.
PACKED = 1_000_000


def tagged(tags: Column, tag: Column) -> Column:
    """A favourite's tags with one more: trimmed, cut to ``TAG_LENGTH``, not twice, and not if it is empty."""
    own = F.substring(F.regexp_replace(F.coalesce(tag, F.lit("")), r"^\s+|\s+$", ""), 1, TAG_LENGTH)
    held = F.coalesce(tags, F.array().cast("array<string>"))
    return F.when((own != "") & ~F.array_contains(held, own), F.array_append(held, own)).otherwise(held)


def favourites(favs: DataFrame, posts: DataFrame, tag: str = "") -> DataFrame:
    """Posts that are favourites, newest first; of repeated additions the last holds. With ``tag`` those that carry it."""
    current = last_writer(favs, ["post_id"], "created_at")
    current = current.where(F.array_contains("tags", tag)) if tag else current
    return posts.join(current.select(F.col("post_id").alias("id"), F.col("tags").alias("fav_tags"), "note", "created_at"), "id").orderBy(F.desc("created_at"), "id")


def unlabelled(posts: DataFrame, labels: DataFrame, scope: str = "all", least_length: int = 40, category: str = "", channel: str = "", min_value: float = 0, date_from: str = "") -> DataFrame:
    """Candidates for labelling: posts of a scope without a label."""
    c = F.length("text") >= least_length
    c &= {"other": F.col("category") == OTHER, "lowvalue": F.col("value") <= 3, "highvalue": F.col("value") >= 5, "category": F.col("category") == category}.get(scope, F.lit(True))
    for given, cond in ((channel, F.col("channel") == channel), (min_value, F.col("value") >= float(min_value)), (date_from, F.col("date") >= date_from)):
        if given:
            c &= cond
    return posts.where(c).join(labels.select(F.col("post_id").alias("id")), "id", "left_anti")


def labelled(posts: DataFrame, labels: DataFrame) -> DataFrame:
    """Posts with active labels laid over category and value; the posts themselves stay as they are."""
    active = labels.where("active") if "active" in labels.columns else labels
    over = active.select(F.col("post_id").alias("id"), F.col("category").alias("_c"), F.col("value").alias("_v"))
    out = posts.join(over, "id", "left")
    return out.withColumn("category", F.coalesce("_c", "category")).withColumn("value", F.coalesce("_v", "value")).select(*posts.columns)


def parse_labels(answers: DataFrame) -> DataFrame:
    """batch, idx, category, value, reason from a model's answers: lines ``number|category|score|reason``.

    Full-width bars count, unknown categories take the first known one they contain or are part of, scores
    are held in 0 to 10, reasons cut to 20 characters; of repeated numbers the last line holds.
    """
    lines = answers.select("batch", F.posexplode(F.split("answer", "\n")).alias("line_no", "line"))
    p = r"^\|?(\d+)\s*[|｜]\s*([^|｜]+?)\s*[|｜]\s*(-?[\d.]+)\s*(?:[|｜]\s*(.*?))?\|?$"
    line = F.trim("line")
    part = lambda i: F.trim(F.regexp_extract(line, p, i))
    rows = lines.where(line.rlike(p)).select("batch", "line_no", part(1).cast("int").alias("idx"), part(2).alias("said"), part(3).try_cast("double").alias("v"), part(4).alias("reason"))
    known = [*CATEGORIES, OTHER]
    close = F.filter(F.array(*map(F.lit, known)), lambda k: F.contains(F.col("said"), k) | F.contains(k, F.col("said")))
    category = F.when(F.col("said").isin(*known), F.col("said")).otherwise(F.coalesce(F.try_element_at(close, F.lit(1)), F.lit(OTHER)))
    value = F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.coalesce("v", F.lit(0.0))))
    out = rows.select("batch", "idx", "line_no", category.alias("category"), (F.floor(value * 10 + 0.5) / 10).alias("value"), F.substring("reason", 1, 20).alias("reason"))
    return last_writer(out, ["batch", "idx"], "line_no").drop("line_no")


def label(posts: DataFrame, labeller: Callable[[list[str]], str], batch: int = 20) -> DataFrame:
    """batch, answer, ids: posts put to a model in batches; missing answers stay unlabelled but are marked as tried."""
    def run(pdfs):
        for pdf in pdfs:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                yield pd.DataFrame({"batch": [f"{part['id'].iloc[0]}"], "answer": [labeller(part["text"].tolist())], "ids": [part["id"].tolist()]})

    return posts.select("id", "text").mapInPandas(run, "batch string, answer string, ids array<long>")


def digest(posts: DataFrame, pushed: DataFrame, tags: list[str], as_of: str, days: int = 3, least: float = 6, limit: int = 12) -> DataFrame:
    """The best representatives of the last days with all tags that weren't pushed yet."""
    f = S.Filters(tags=tags, days=days, as_of=as_of, min_value=least)
    return S.filtered(posts, f).join(pushed.select("id"), "id", "left_anti").orderBy(F.desc("value"), "id").limit(limit)


def standing_phrases(subscriptions: DataFrame) -> DataFrame:
    """subscription, min_value, tags, phrases: each subscription's different phrases, words parted by blanks."""
    def run(pdfs):
        for pdf in pdfs:
            pdf["phrases"] = [sorted({" ".join(p) for p in S.phrases_of(k)}) for k in pdf["keyword"]]
            yield pdf[["subscription", "min_value", "tags", "phrases"]]

    rows = subscriptions.select(F.col("id").alias("subscription"), "min_value", "tags", "keyword")
    return rows.mapInPandas(run, "subscription long, min_value double, tags array<string>, phrases array<string>")


def packed(postings: DataFrame) -> DataFrame:
    """block, terms, many, spots, ids, at: a million of a task's postings (term, block, id, at) in one row for each block.

    ``ids`` has ``many`` values of each term, ``at`` those that aren't null, ``spots`` in number.
    """
    names = ["block", "terms", "many", "spots", "ids", "at"]

    def pack(rows: pa.Table) -> pa.RecordBatch:
        terms = rows.column("term").combine_chunks().dictionary_encode()
        block, ids, at = (rows.column(c).combine_chunks() for c in ("block", "id", "at"))
        block = block.to_numpy()
        kinds = len(terms.dictionary)
        key = block.astype(np.int64) * kinds + terms.indices.to_numpy()
        order = np.argsort(key, kind="stable")
        key, at = key[order], at.take(pa.array(order))
        begins = np.flatnonzero(np.diff(key, prepend=-1))
        ends = np.append(begins, len(key))
        known = np.append(0, np.cumsum(at.is_valid().to_numpy(zero_copy_only=False)))[ends]
        own, term = np.divmod(key[begins], kinds)
        rows = np.append(np.flatnonzero(np.diff(own, prepend=-1)), len(own))  # the first term of each block
        lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
        counts = lambda ends: lists(rows, pa.array(np.diff(ends).astype(np.int32)))
        columns = [pa.array(own[rows[:-1]].astype(np.int32)), lists(rows, terms.dictionary.take(pa.array(term))), counts(ends), counts(known), lists(ends[rows], ids.take(pa.array(order))), lists(known[rows], at.drop_null())]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACKED:
                yield pack(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield pack(pa.Table.from_batches(held))

    return postings.select("term", "block", "id", "at").mapInArrow(run, "block int, terms array<string>, many array<int>, spots array<int>, ids array<long>, at array<long>")


class Block:
    """Some posts, newest first, and where words stand in them: which posts hold phrases, have tags and are worth something."""

    def __init__(self, rows: pa.Table):
        posts = rows.filter(pc.is_valid(rows.column("id")))
        posts = posts.take(pc.sort_indices(posts, sort_keys=[("date", "descending"), ("ts", "descending"), ("id", "ascending")], null_placement="at_end"))
        self.posts, self.size = posts, posts.num_rows
        ids = posts.column("id").to_numpy()
        self._by_id = np.argsort(ids)
        self._ids = ids[self._by_id]
        self._values = posts.column("value").to_numpy()
        tags = posts.column("own_tags").combine_chunks()
        owner, each = np.repeat(np.arange(self.size), np.diff(tags.offsets.to_numpy())), tags.flatten().dictionary_encode(null_encoding="encode")
        codes = each.indices.to_numpy()
        self._tagged = {t: owner[codes == k] for k, t in enumerate(each.dictionary.to_pylist())}
        held = rows.filter(pc.is_null(rows.column("id")))
        terms, many, spots, ids, at = (held.column(c).combine_chunks().flatten() for c in ("terms", "many", "spots", "ids", "at"))
        terms, many = terms.dictionary_encode(), many.to_numpy()
        self._codes = {t: k for k, t in enumerate(terms.dictionary.to_pylist())}
        owner, (place, known) = np.repeat(terms.indices.to_numpy().astype(np.int64), many), self._places(ids.to_numpy())
        # one sorted number for each word and post; posts that aren't asked about fall out
        key = np.sort(owner[known] * max(1, self.size) + place[known])
        key = key[np.diff(key, prepend=-1) > 0]
        self._starts = np.searchsorted(key, np.arange(len(self._codes) + 1) * max(1, self.size))
        self._holders = (key % max(1, self.size)).astype(np.int32)
        # words of longer phrases: post and place of each time they stand there
        long = np.repeat(spots.to_numpy() > 0, many)
        owner, place, known = owner[long], place[long], known[long]
        spots = (place * len(FIELDS) << 32) + at.to_numpy()
        order = np.lexsort((spots[known], owner[known]))
        self._spots = spots[known][order]
        self._spot_starts = np.searchsorted(owner[known][order], np.arange(len(self._codes) + 1))
        self._bits, self._fit = {}, {}

    def _places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.size:
            return np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
        at = np.minimum(np.searchsorted(self._ids, ids), self.size - 1)
        return self._by_id[at], self._ids[at] == ids

    def holders(self, phrase: str) -> np.ndarray:
        """Sorted places of the posts that hold a phrase within one field."""
        words = phrase.split(" ")
        codes = [self._codes.get(w, -1) for w in words]
        if min(codes) < 0:
            return np.zeros(0, np.int32)
        if len(words) == 1:
            return self._holders[self._starts[codes[0]] : self._starts[codes[0] + 1]]
        own = [self._spots[self._spot_starts[c] : self._spot_starts[c + 1]] - k for k, c in enumerate(codes)]
        found = own[0]
        for more in own[1:]:
            found = np.intersect1d(found, more, assume_unique=True)
        return np.unique((found >> 32) // len(FIELDS)).astype(np.int32)

    def _packed(self, phrase: str, holders: np.ndarray) -> np.ndarray:
        """A frequent phrase's posts as bits."""
        if phrase not in self._bits:
            mask = np.zeros(self.size, bool)
            mask[holders] = True
            self._bits[phrase] = np.packbits(mask, bitorder="little")
        return self._bits[phrase]

    def holding(self, phrases: list[str]) -> np.ndarray:
        """The posts that hold all phrases: their sorted places, or bits if each of the phrases is frequent."""
        held = {p: self.holders(p) for p in phrases}
        each = sorted((len(h), p) for p, h in held.items())
        if not each or each[0][0] * 32 >= self.size:
            found = np.packbits(np.ones(self.size, bool), bitorder="little")
            for _, phrase in each:
                found = found & self._packed(phrase, held[phrase])
            return found
        found = held[each[0][1]]
        for many, phrase in each[1:]:
            if not len(found):
                break
            if many * 32 < self.size:
                at = np.minimum(np.searchsorted(held[phrase], found), many - 1)
                found = found[held[phrase][at] == found]
            else:
                found = found[self._packed(phrase, held[phrase])[found >> 3] >> (found & 7) & 1 == 1]
        return found

    def fitting(self, tags: tuple, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Which posts have all tags and a value of ``least`` at least, and that as bits; NaN is more than any number."""
        if (tags, least) not in self._fit:
            if len(self._fit) >= 1000:
                self._fit.clear()
            fit = (self._values >= least) | np.isnan(self._values)
            fit &= ~self.posts.column("value").is_null().to_numpy()
            for tag in tags:
                mask = np.zeros(self.size, bool)
                mask[self._tagged.get(tag, [])] = True
                fit &= mask
            self._fit[tags, least] = fit, np.packbits(fit, bitorder="little")
        return self._fit[tags, least]

    def newest(self, found: np.ndarray, tags: tuple, least: float, size: int) -> tuple[int, np.ndarray]:
        """How many posts of ``holding`` fit, and the places of the newest of them."""
        fit, bits = self.fitting(tags, least)
        if found.dtype != np.uint8:
            hits = found[fit[found]]
            return len(hits), hits[:size]
        both = found & bits
        some = np.flatnonzero(both)[:size]
        places = (some[:, None] * 8 + np.arange(8))[np.unpackbits(both[some], bitorder="little").reshape(-1, 8) == 1]
        return int(np.bitwise_count(both).sum(dtype=np.int64)), places[:size].astype(np.int32)


def answered(subscriptions: DataFrame, blocks: DataFrame, size: int) -> DataFrame:
    """subscription, id, date, ts, n: each subscription's newest ``size`` posts of each block, the first of them with the number of all."""
    out = "subscription long, id long, date string, ts long, n long"

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        block = Block(rows)
        owners, places, counts, last, found = [], [], [], None, None
        columns = (asked.column(c).to_pylist() for c in ("subscription", "phrases", "tags", "min_value"))
        for own, phrases, tags, least in sorted(zip(*columns), key=lambda r: r[1]) if block.size else ():
            if phrases != last:
                last, found = phrases, block.holding(phrases)
            if not len(found):
                continue
            many, newest = block.newest(found, tuple(tags), least, size)
            if many:
                owners += [own] * len(newest)
                places.append(newest)
                counts += [many] + [0] * (len(newest) - 1)
        posts = block.posts.take(pa.array(np.concatenate(places) if places else np.zeros(0, np.int32)))
        return pa.table({"subscription": pa.array(owners, pa.int64()), "id": posts.column("id"), "date": posts.column("date"), "ts": posts.column("ts"), "n": pa.array(counts, pa.int64())})

    return subscriptions.groupBy("deal", "block").cogroup(blocks.groupBy("deal", "block")).applyInArrow(run, out)


def subscription_hits(posts: DataFrame, subscriptions: DataFrame, since: int, size: int = 5, index: Index | None = None) -> DataFrame:
    """subscription, total, ids: each enabled subscription's posts after ``since``, the newest ``size`` of them.

    The new posts are dealt to blocks, each with the postings of its posts for the words that are asked (of a stored
    ``index`` of these posts; else their texts are cut), and groups of subscriptions meet the blocks. A subscription
    and a post never become a row: a block gives numbers of hits and the newest ones, from which the newest of all are
    taken. Equal subscriptions are answered once. Subscriptions stay a table, however many they are. Only words of
    longer phrases need positions.
    """
    rows = posts.where(F.col("ts") > since)
    rows = (rows.where("is_rep") if "is_rep" in posts.columns else rows).withColumn("id", F.col("id").cast("long"))
    n, text = rows.agg(F.count("*"), F.sum(F.length("text"))).first()
    blocks = max(1, -(-n // BLOCK), -(-(text or 0) // BLOCK_TEXT))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    asking = subscriptions.where("enabled").select(F.col("id").cast("long").alias("id"), "keyword", F.coalesce("min_value", F.lit(0)).cast("double").alias("min_value"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    alike = asking.groupBy("keyword", "min_value", "tags").agg(F.min("id").alias("id"), F.collect_set("id").alias("members"))
    asked, few = at_hand(standing_phrases(alike))
    deals = max(1, -(-(len(few) if few is not None else asked.count()) // GROUP))
    asked = asked.withColumn("deal", F.pmod(F.xxhash64("phrases"), F.lit(deals)).cast("int"))
    words = asked.select(F.explode("phrases").alias("phrase")).select(F.explode(F.split("phrase", " ")).alias("term"), F.contains("phrase", F.lit(" ")).alias("long"))
    needed = words.groupBy("term").agg(F.max("long").alias("long"))
    held = (index.postings if index is not None else segment_of(rows, 0)).join(sized(needed), "term").where(F.col("first") | F.col("long"))
    if index is not None and n <= MOST_GONE:
        held = held.join(F.broadcast(rows.select("id")), "id", "left_semi")
    fields = F.create_map(*(F.lit(x) for k, f in enumerate(FIELDS) for x in (f, k)))
    at = F.transform("positions", lambda p: F.shiftleft(fields[F.col("field")].cast("long"), 32) + p)
    if few is not None and not any(" " in p for r in few for p in r["phrases"]):
        at = F.lit(None).cast("array<long>")  # no positions are read
    pieces = packed(held.select("term", block, "id", F.explode_outer(F.when(F.col("long"), at)).alias("at")))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    own = rows.select("id", F.col("date").cast("string").alias("date"), F.col("ts").cast("long").alias("ts"), F.col("value").cast("double").alias("value"), F.coalesce("tags", F.array().cast("array<string>")).alias("own_tags"), block, every(deals).alias("deal"))
    met = answered(asked.withColumn("block", every(blocks)), own.unionByName(pieces.withColumn("deal", every(deals)), allowMissingColumns=True), size)
    w = Window.partitionBy("subscription").orderBy(F.desc("date"), F.desc("ts"), "id")
    newest = F.collect_list(F.when(F.col("place") <= size, F.struct("place", "id")))
    best = met.withColumn("place", F.row_number().over(w)).groupBy("subscription").agg(F.sum("n").alias("total"), F.transform(F.array_sort(newest), lambda x: x["id"]).alias("ids"))
    found = best.join(alike.select(F.col("id").alias("subscription"), "members"), "subscription")
    return found.select(F.explode("members").alias("subscription"), "total", "ids")


def removed(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti")


#: Candidates that one labelling run takes at most; beyond it a run is refused, not cut.
MOST_LABELLED = 50_000


def label_batch(candidates: DataFrame, n: int = 20) -> DataFrame:
    """The n most valuable candidates for labelling."""
    return candidates.orderBy(F.desc("value"), "id").limit(n)


def guarded(candidates: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """``candidates``, or an error if there are more than ``most``."""
    if candidates.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} posts would be labelled: narrow the scope")
    return candidates


def saved_labels(posts: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels (post_id, category, value, ...) with what they replace: orig_category, orig_value. Labels of no post are left out."""
    own = posts.select(F.col("id").alias("post_id"), F.col("category").alias("orig_category"), F.col("value").alias("orig_value"))
    return labels.join(own, "post_id")


def rolled_back(posts: DataFrame, saved: DataFrame) -> DataFrame:
    """Posts that ``labelled`` wrote over, as they were before; the labels stay."""
    back = saved.select("post_id", F.col("orig_category").alias("category"), F.col("orig_value").alias("value"))
    return labelled(posts, back)


def with_hits(subscriptions: DataFrame, hits: DataFrame) -> DataFrame:
    """``subscriptions`` with hit_count grown by the totals of ``subscription_hits``."""
    found = hits.select(F.col("subscription").alias("id"), "total")
    count = F.coalesce("hit_count", F.lit(0)) + F.coalesce("total", F.lit(0))
    return subscriptions.join(found, "id", "left").withColumn("hit_count", count.cast("long")).drop("total")


def tag_counts(favs: DataFrame) -> DataFrame:
    """tag, n of the favourites' own tags; of repeated additions the last holds."""
    rows = last_writer(favs, ["post_id"], "created_at").select(F.explode("tags").alias("tag"))
    return rows.groupBy("tag").agg(F.count("*").alias("n"))
