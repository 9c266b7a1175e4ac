"""Aggregates: facets, histograms, rankings and metrics."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.text import len16, mentions

#: Words after an at sign that are no handles, own hosts, and file hosts.
NOISE = (
    "version", "namespace", "description", "author", "grant", "match", "latest", "gmail", "include", "exclude", "icon", "name", "license", "homepage", "support", "downloadurl", "updateurl", "require",
    "resource", "connect", "run-at", "noframes", "antifeature", "iconurl", "email", "date", "copyright", "website", "docs", "example", "test", "todo", "param", "args", "media", "import", "export", "type",
    "interface", "enum", "struct", "class", "return", "throws", "deprecated", "since", "see", "file", "module", "package", "project", "app", "api", "url", "http", "https", "www", "com", "org", "net",
)
OWN_HOSTS = r"(^|\.)linux\.do$|(^|\.)t\.me$|(^|\.)telegram\.org$|(^|\.)telesco\.pe$|(^|\.)ldstatic\.com$|^127\.0\.0\.1$|(^|\.)telegram\.me$|(^|\.)t\.lg$|^localhost$"
FILE_HOSTS = r"quark\.cn|baidu\.com|lanzou|123pan|aliyundrive|alipan|115\.com|weiyun|ctfile|uguu|mypikpak|lanzoui|lanzoux"


def reps(posts: DataFrame) -> DataFrame:
    return posts.where("is_rep") if "is_rep" in posts.columns else posts


def top(rows: DataFrame, key: str | Column, n: int | None, count: str = "n") -> DataFrame:
    """The n most frequent keys; ties by key. Without n all of them, in no order."""
    counts = rows.groupBy(key).agg(F.count("*").alias(count))
    return counts if n is None else counts.orderBy(F.desc(count), key).limit(n)


def by_category(posts: DataFrame) -> DataFrame:
    return reps(posts).groupBy("category").agg(F.count("*").alias("n"))


def by_channel(posts: DataFrame, n: int = 60) -> DataFrame:
    return top(reps(posts), "channel", n)


def group_stats(posts: DataFrame, n: int = 20) -> DataFrame:
    rows = posts.where("source = 'group'").groupBy("channel").agg(F.count("*").alias("n"), F.max("group_title").alias("group_title"))
    return rows.orderBy(F.desc("n"), "channel").limit(n)


def totals(posts: DataFrame) -> DataFrame:
    """Posts, and those visible after clustering: one row."""
    seen = F.count_if("is_rep") if "is_rep" in posts.columns else F.count("*")
    return posts.agg(F.count("*").alias("n"), seen.alias("visible"))


def tag_histogram(posts: DataFrame, n: int = 40, least: float = 4) -> DataFrame:
    return top(reps(posts).where(F.col("value") >= float(least)).select(F.explode("tags").alias("tag")), "tag", n)


def valuable(posts: DataFrame, least_value: float = 2, least_content: float = 2, least_length: int = 10) -> DataFrame:
    return posts.where((F.col("value") >= float(least_value)) & (F.col("content") >= float(least_content)) & (len16(F.col("text")) >= least_length))


def domain_histogram(domains: DataFrame, n: int = 300, split: bool = False) -> DataFrame:
    """From a column ``domains``; with ``split`` own hosts are left out and file hosts told apart."""
    rows = domains.select(F.explode("domains").alias("domain"))
    if not split:
        return top(rows, "domain", n)
    rows = rows.where(~F.col("domain").rlike(OWN_HOSTS)).withColumn("is_file_host", F.col("domain").rlike(FILE_HOSTS))
    counts = rows.groupBy("is_file_host", "domain").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("is_file_host").orderBy(F.desc("n"), "domain"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def mention_histogram(posts: DataFrame, n: int | None = 200, noise: tuple[str, ...] = NOISE) -> DataFrame:
    """Handles, as they are written, by the number of posts that name them; words of ``noise`` in whatever case aren't any."""
    # the outer form: for the other Spark infers filters on the array and cuts each text again for them
    rows = posts.select(F.explode_outer(mentions(F.col("text"), lower=False)).alias("handle")).where("handle is not null")
    return top(rows.where(~F.lower("handle").isin(*noise)) if noise else rows, "handle", n)


def keyword_heat(posts: DataFrame, words: list[str], text: Column | None = None) -> DataFrame:
    """keyword, n: posts that contain each keyword, in one pass and without a join."""
    hay = F.col("text") if text is None else text
    counts = posts.agg(*(F.count_if(F.contains(hay, F.lit(w))).alias(f"w{i}") for i, w in enumerate(words)))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(w).alias("keyword"), F.col(f"w{i}").alias("n")) for i, w in enumerate(words)))).alias("r")).select("r.*")


def best_per_repository(posts: DataFrame, n: int = 90) -> DataFrame:
    """The most valuable post of each repository linked to, names as they are written; the earliest of equals."""
    rows = posts.select("id", "value", F.explode("links").alias("u")).withColumn("repo", F.regexp_extract("u", r"github\.com/([^/?#]+/[^/?#]+)", 1)).where("repo <> ''")
    rows = rows.withColumn("repo", F.regexp_replace("repo", r"\.git$", ""))
    best = rows.groupBy("repo").agg(F.max(F.struct("value", (-F.col("id")).alias("i"))).alias("b"), F.count_distinct("id").alias("posts"))
    return best.select("repo", F.col("b.value").alias("value"), (-F.col("b.i")).alias("id"), "posts").orderBy(F.desc("value"), "repo").limit(n)


def by_month(posts: DataFrame, width: int = 40) -> DataFrame:
    """month, n and a bar scaled to the fullest month."""
    months = posts.groupBy(F.substring("date", 1, 7).alias("month")).agg(F.count("*").alias("n"))
    most = months.agg(F.max("n").alias("most"))
    return months.join(F.broadcast(most)).select("month", "n", F.floor(F.col("n") * width / F.col("most") + 0.5).cast("int").alias("bar"))


def top_per_category(posts: DataFrame, n: int, order: list[Column] | None = None) -> DataFrame:
    """The n best of each category, by value and time, numbered."""
    by = order or [F.desc("value"), F.desc("ts"), F.asc("id")]
    return posts.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy(*by))).where(F.col("rank") <= n)


def top_posts(posts: DataFrame, n: int = 500) -> DataFrame:
    """The n best by value and views, with a mark where the category changes."""
    best = posts.orderBy(F.desc("value"), F.desc("views"), "id").limit(n)
    w = Window.orderBy(F.desc("value"), F.desc("views"), "id")
    best = best.withColumn("rank", F.row_number().over(w))
    return best.withColumn("breaks", F.coalesce(F.lag("category").over(w) != F.col("category"), F.lit(True)))


#: The order in which categories are shown.
CATEGORY_ORDER = ("羊毛优惠", "项目副业", "实用工具", "开源项目", "AI与科技", "服务器网络", "账号会员", "学习资源", "数码硬件", "资讯热点", "其他")


def category_rank(category: Column, order: tuple[str, ...] = CATEGORY_ORDER) -> Column:
    """Place of a category in the order shown, from 0; 99 for unknown ones."""
    place = F.array_position(F.array(*map(F.lit, order)), category)
    return F.when(place > 0, place - 1).otherwise(99).cast("int")


def free_deals(posts: DataFrame, n: int = 70) -> DataFrame:
    wanted = F.arrays_overlap("tags", F.array(F.lit("免费"), F.lit("限时"))) & ~F.array_contains("tags", "风险") & (len16(F.col("text")) >= 25)
    return posts.where(wanted).orderBy(F.desc("value"), "id").limit(n)


def highlights(posts: DataFrame, after_id: int, n: int = 20, least: float = 7) -> DataFrame:
    """New posts of much value."""
    return reps(posts).where((F.col("id") > after_id) & (F.col("value") >= float(least))).orderBy(F.desc("value"), "id").limit(n)


def throughput(batches: DataFrame, key: str, last: int = 20, order: tuple[str, ...] = ("at", "done"), done: str = "done") -> DataFrame:
    """Items a second over the last batches of each ``key`` (a job), by the times in the first of ``order``."""
    at = order[0]
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(last - 1), 0)
    span = F.max(at).over(w) - F.min(at).over(w)
    return batches.withColumn("rate", F.when(span > 0, F.sum(done).over(w) / span))


#: Words of the key by which an item is looked up, at most; characters of the key of items without inner words.
KEY_WORDS, KEY_CHARACTERS = 4, 3
#: Items that every task may have at hand.
FEW_ITEMS = 10_000


def holding(docs: DataFrame, items: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """``id_col``, _item: which documents hold which of a few items of three words at least, by number. One pass, nothing moves."""
    by: dict = {}
    for number, item in enumerate(items):
        key = tuple(item.split()[1:-1][:KEY_WORDS])
        by.setdefault(key[0], {}).setdefault(len(key), {}).setdefault(key, []).append((number, item))

    def run(batches):
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(batch.column(1)):
                text = text.as_py()
                words, met = text.split(), set()
                for i, w in enumerate(words):
                    if w in by:
                        for k, keys in by[w].items():
                            met.update(keys.get(tuple(words[i : i + k]), ()))
                own = [number for number, item in met if item in text]
                rows += [row] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.int64())], [id_col, "_item"])

    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField("_item", LongType())])
    return docs.select(id_col, F.col(text_col).cast("binary")).mapInArrow(run, schema)


def containing(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``item_col``, ``id_col``: which documents contain an item's whole text (column ``text``), a row for each pair of rows.

    Inner words of an item, which white space bounds in any document that holds it, are the key of an equality
    join: four of them, or as many as there are; few items are looked up in each task instead. Items of one or two words are keyed by their first three characters, which
    are met with the texts' own triples. Only keys of the sizes that items have are made of texts, and only ids and keys move; texts are
    fetched for the hits. Null and empty texts and items take no part; items of one or two characters, of which there are
    few different ones, are tried in every text.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    given = items.where(F.coalesce("text", F.lit("")) != "").select(item_col, F.col("text").alias("item"), words(F.col("text")).alias("w"))
    inner = F.least(F.size("w") - 2, F.lit(KEY_WORDS))
    by_words = given.where(F.size("w") > 2).select(item_col, "item", inner.alias("n"), F.array_join(F.slice("w", F.lit(2), inner), " ").alias("key"))
    rest = given.where(F.size("w") <= 2)
    by_characters = rest.where(F.length("item") >= KEY_CHARACTERS).select(item_col, "item", F.lit(-1).alias("n"), F.substring("item", 1, KEY_CHARACTERS).alias("key"))
    few = by_words.select(item_col, "item", F.col("item").cast("binary").alias("b")).distinct().limit(FEW_ITEMS + 1).collect()
    at_hand = 0 < len(few) <= FEW_ITEMS
    keyed = by_characters if at_hand else by_words.unionByName(by_characters)
    sizes = sorted(r["n"] for r in keyed.select("n").distinct().collect())  # five at most
    text = F.col(text_col)

    def word_grams(k: int) -> Column:
        of = lambda o: F.transform(F.sequence(F.lit(1), F.greatest(F.size(o) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(o, i, F.lit(k)), " "))
        return F.transform(F.array(words(text)), of)[0]

    grams = [word_grams(k) for k in sizes if k > 0]
    if -1 in sizes:
        grams.append(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (KEY_CHARACTERS - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(KEY_CHARACTERS))))
    rows = docs.where(F.coalesce(text, F.lit("")) != "")
    found = items.select(item_col).limit(0).join(docs.select(id_col).limit(0), F.lit(True))
    if at_hand:
        named = docs.sparkSession.createDataFrame([(i, r[item_col]) for i, r in enumerate(few)], StructType([StructField("_item", LongType()), items.schema[item_col]]))
        by_hand = holding(rows, [bytes(r["b"]) for r in few], id_col, text_col).join(F.broadcast(named), "_item").select(item_col, id_col)
    if grams:
        each = rows.select(id_col, F.explode(F.array_distinct(F.concat(*grams))).alias("key"))
        hits = each.join(keyed, "key").select(id_col, item_col, "item").distinct()
        found = rows.select(id_col, text_col).join(hits, id_col).where(F.contains(text_col, F.col("item"))).select(item_col, id_col)
    if at_hand:
        found = found.unionByName(by_hand) if grams else by_hand
    tiny = rest.where(F.length("item") < KEY_CHARACTERS).select(item_col, "item")
    if tiny.isEmpty():
        return found
    return found.unionByName(rows.select(id_col, text_col).join(tiny, F.contains(text_col, F.col("item"))).select(item_col, id_col))


def retrieval_metrics(ranked: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """type, queries, hit_at_k, mrr from ranked (query, id, rank) and expected (query, id, type)."""
    best = expected.join(ranked, ["query", "id"], "left").groupBy("query", "type").agg(F.min("rank").alias("rank"))
    return best.groupBy("type").agg(F.count("*").alias("queries"), F.avg((F.coalesce("rank", F.lit(k + 1)) <= k).cast("double")).alias("hit_at_k"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))


#: What a run over the labelled questions must reach, and by how much it may fall short.
GATE_HIT, GATE_MRR, GATE_SLACK = 0.91, 0.704, (0.01, 0.02)


def gate(ranked: DataFrame, right: DataFrame, k: int = 10) -> DataFrame:
    """queries, hit_at_k, mrr, passed: one row, from ranked (question, id, rank) and right answers (question, id), of which the best placed counts."""
    best = right.join(ranked, ["question", "id"], "left").groupBy("question").agg(F.min("rank").alias("rank"))
    out = best.agg(F.count("*").alias("queries"), F.avg((F.coalesce("rank", F.lit(k + 1)) <= k).cast("double")).alias("hit_at_k"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))
    return out.withColumn("passed", (F.col("hit_at_k") >= GATE_HIT - GATE_SLACK[0]) & (F.col("mrr") >= GATE_MRR - GATE_SLACK[1]))


def judge_metrics(judged: DataFrame) -> DataFrame:
    """Mean directly relevant and related answers of a query, and the share with one at least, from (query, grade 0 to 2)."""
    each = judged.groupBy("query").agg(F.count_if(F.col("grade") == 2).alias("direct"), F.count_if(F.col("grade") >= 1).alias("related"))
    return each.agg(F.avg("direct").alias("direct"), F.avg("related").alias("related"), F.avg((F.col("direct") >= 1).cast("double")).alias("answered"))


def fuzzy(commands: DataFrame, query: str, label: str = "label", n: int = 40) -> DataFrame:
    """Rows whose label begins with the query (0), contains it (1) or has its characters in order (2)."""
    import re

    q, name = query.lower(), F.lower(label)
    inside = ".*".join(map(re.escape, q))
    score = F.when(F.startswith(name, F.lit(q)), 0).when(F.contains(name, F.lit(q)), 1).when(name.rlike(f"(?s){inside}"), 2)
    return commands.withColumn("score", score).where("score is not null").orderBy("score", label).limit(n)
