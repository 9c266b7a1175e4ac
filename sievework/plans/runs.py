"""Registered queries of runs over sources, of candidates, labels, evaluation and of what readers are shown."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..adapter import posts, table
from ..functions import display, text, urls
from ..operators import cluster as K
from ..operators import dedup, discover, facets, hybrid, index, overlays, reports, sync, vectors
from ..sources import imports
from ..sources.versions import Versions
from ..streaming.store import PostStore, numbered
from .queries import AS_OF, FLAT_SQL, HAYS_SQL, HEAT, NOISE_SQL, ONE_LINE_SQL, QUANT_SQL, TOKENS_SQL, C, classify_sql, clustered_posts, previewed, query, shared_root, stored, stored_blocks, stored_posts, web_sql

LABELS_SQL = "labs AS (SELECT doc_id AS post_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'plain' END AS category, CAST(quality * 5 AS DOUBLE) AS value FROM labels)"


def sources(spark, d):
    """Channels as sources, each of a kind."""
    n = F.length("channel") % 3
    kind = F.when(n == 0, "channel").when(n == 1, "web").otherwise("group")
    return posts(spark, d).select("channel").distinct().withColumn("kind", kind)


SOURCES_SQL = "sources AS (SELECT DISTINCT channel, CASE length(channel) % 3 WHEN 0 THEN 'channel' WHEN 1 THEN 'web' ELSE 'group' END AS kind FROM posts)"


# --- runs over sources --------------------------------------------------------------------------------------------


@query("j4_online_clustering", """, k AS (SELECT cluster_key, arg_min(channel, id) AS owner, min(id) AS first FROM posts WHERE cluster_key IS NOT NULL GROUP BY cluster_key),
j AS (SELECT p.id, p.cluster_key, k.first, coalesce(p.channel <> k.owner, FALSE) AS joins FROM posts p LEFT JOIN k ON p.cluster_key = k.cluster_key)
SELECT id, CASE WHEN joins THEN first ELSE id END AS rep_id, NOT joins AS is_rep,
  CAST(CASE WHEN joins THEN 1 + row_number() OVER (PARTITION BY cluster_key, joins ORDER BY id) WHEN id = first THEN 1 + count(*) FILTER (joins) OVER (PARTITION BY cluster_key) ELSE 1 END AS INTEGER) AS cluster_size FROM j""")
def j4_online_clustering(spark, d):
    none = clustered_posts(spark, d).limit(0)
    return K.joined(none, posts(spark, d)).select("id", "rep_id", "cluster_size", "is_rep")


ONLINE_SQL = """, k AS (SELECT cluster_key, arg_min(channel, id) AS owner, min(id) AS first FROM posts WHERE cluster_key IS NOT NULL GROUP BY cluster_key),
j AS (SELECT p.*, k.first, coalesce(p.channel <> k.owner, FALSE) AS joins FROM posts p LEFT JOIN k ON p.cluster_key = k.cluster_key)"""


@query("j4_stored_clusters", ONLINE_SQL + """ SELECT id, CASE WHEN joins THEN first ELSE id END AS rep_id, NOT joins AS is_rep,
  CAST(CASE WHEN joins THEN 1 + row_number() OVER (PARTITION BY cluster_key, joins ORDER BY id) WHEN id = first THEN 1 + count(*) FILTER (joins) OVER (PARTITION BY cluster_key) ELSE 1 END AS INTEGER) AS cluster_size FROM j""")
def j4_stored_clusters(spark, d):
    """The posts in four batches, each on top of the stored ones."""
    return stored(spark, d, "batches").posts().select("id", "rep_id", "is_rep", "cluster_size")


@query("e28_kept_counts", ONLINE_SQL + """ SELECT kind, key, count(*) AS n FROM (
  SELECT 'posts' AS kind, '' AS key FROM j UNION ALL SELECT 'visible', '' FROM j WHERE NOT joins UNION ALL SELECT 'category', category FROM j WHERE NOT joins UNION ALL SELECT 'channel', channel FROM j WHERE NOT joins
  UNION ALL SELECT 'month', substr(date, 1, 7) FROM j UNION ALL SELECT 'eligible', '' FROM j WHERE value >= 4 AND length(text) >= 15 UNION ALL SELECT 'merged', '' FROM j WHERE joins
  UNION ALL SELECT 'tag', unnest(tags) FROM j WHERE NOT joins AND value >= 4) GROUP BY 1, 2""")
def e28_kept_counts(spark, d):
    return stored(spark, d, "batches").counts()


@query("b3_segments", r""", words AS (SELECT *, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM posts WHERE id % 7 <> 3), counted AS (SELECT id, len(t) + 2 * len(tags) + 2 * len(domains) + 1 AS dl,
  8.0 * len(list_filter(range(1, len(t) + 1), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) AS tf0, 8.0 * len(list_filter(t, lambda x: x = 'and')) AS tf1 FROM words),
facts AS (SELECT count(*) AS n, avg(dl) AS mean, count(*) FILTER (tf0 > 0) AS df0, count(*) FILTER (tf1 > 0) AS df1 FROM counted)
SELECT id, round(- greatest(1e-6, ln((n - df0 + 0.5) / (df0 + 0.5))) * tf0 * 2.2 / (tf0 + 1.2 * (0.25 + 0.75 * dl / mean)) - greatest(1e-6, ln((n - df1 + 0.5) / (df1 + 0.5))) * tf1 * 2.2 / (tf1 + 1.2 * (0.25 + 0.75 * dl / mean)), 6) AS rank FROM counted, facts WHERE tf0 > 0 AND tf1 > 0""")
def b3_segments(spark, d):
    """The index of four batches, some replaced, then without every seventh post, then compacted: ranks are those of one build."""
    store = stored(spark, d, "batches")
    versions = Versions(spark, f"{store.versions.root}-{uuid.uuid4().hex}")
    rows = store.posts()
    change = lambda f, *a, **k: versions.commit(versions.current(), *f(versions, versions.current(), *a, **k))
    for r in range(3):
        change(index.added, rows.where(F.col("id") % 3 == r).withColumn("text", F.when(F.col("id") % 15 == 0, "of the and").otherwise(F.col("text"))))
    change(index.added, rows.where(F.col("id") % 15 == 0), replace=True)
    change(index.removed, rows.where(F.col("id") % 7 == 3).select("id"))
    change(index.compacted)
    return index.ranked(index.view(versions), [["of", "the"], ["and"]]).select("id", F.round("rank", 6).alias("rank"))


@query("j26_sync", f""", {SOURCES_SQL}, keys AS (SELECT channel, msg_id, count(*) AS n FROM posts GROUP BY 1, 2),
each AS (SELECT k.channel, sum(n) AS seen, count(*) FILTER (l.doc_id IS NULL) AS added FROM keys k LEFT JOIN labels l ON k.msg_id = l.doc_id GROUP BY 1)
SELECT s.channel, CAST(coalesce(seen, 0) AS BIGINT) AS seen, CAST(coalesce(added, 0) AS BIGINT) AS added, CAST(coalesce(seen - added, 0) AS BIGINT) AS duplicate FROM sources s LEFT JOIN each e ON s.channel = e.channel WHERE kind IN ('channel', 'web')""")
def j26_sync(spark, d):
    p = posts(spark, d)
    stored = p.join(table(spark, d, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi").select("channel", "msg_id")
    return sync.counts(sources(spark, d), p, stored)


@query("c15_syncable", f", {SOURCES_SQL} SELECT kind, count(*) AS n FROM sources WHERE kind IN ('channel', 'web') GROUP BY kind")
def c15_syncable(spark, d):
    return sync.syncable(sources(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


@query("c16_group_messages", "SELECT id FROM posts WHERE source = 'group' AND id % 7 <> 0 AND length(text) >= 8 AND NOT starts_with(text, '/')")
def c16_group_messages(spark, d):
    return posts(spark, d).where(sync.from_group(F.col("source"), F.col("id") % 7 == 0, F.col("text"))).select("id")


@query("e14_high_water", "SELECT CAST(coalesce(max(id), 0) AS BIGINT) AS last_id FROM posts")
def e14_high_water(spark, d):
    return sync.high_water(posts(spark, d))


# --- candidates ---------------------------------------------------------------------------------------------------


@query("d8_candidates", f"SELECT handle, count(*) AS n FROM (SELECT DISTINCT id, unnest(regexp_extract_all(text, '@([A-Za-z][A-Za-z0-9_]{{4,31}})', 1)) AS handle FROM posts) WHERE lower(handle) NOT IN (SELECT lower(channel) FROM posts WHERE channel IS NOT NULL) AND NOT list_contains({NOISE_SQL}, lower(handle)) GROUP BY handle ORDER BY n DESC, handle LIMIT 260")
def d8_candidates(spark, d):
    return discover.candidates(posts(spark, d), posts(spark, d).select(F.col("channel").alias("handle")).distinct())


@query("g13_theme_hits", f"""SELECT page_id, theme_hits, array_to_string(hits[1:6], ',') AS theme FROM (
  SELECT page_id, hits, CAST(len(hits) AS INTEGER) AS theme_hits FROM (SELECT page_id, list_filter([{", ".join(f"'{w}'" for w in discover.THEME)}], lambda w: contains(lower(html || ' ' || url), w)) AS hits FROM pages))""", with_posts=False)
def g13_theme_hits(spark, d):
    probed = table(spark, d, "pages").select("page_id", F.col("html").alias("title"), F.col("url").alias("about"), F.col("url").alias("handle"), F.lit(1).alias("n"), F.lit(1).alias("messages"))
    return discover.ranked(probed).select("page_id", "theme_hits", F.array_join("theme", ",").alias("theme"))


# --- labels, favourites, subscriptions ----------------------------------------------------------------------------


def labels(spark, d):
    return table(spark, d, "labels").select(F.col("doc_id").alias("post_id"), F.when(F.col("toxic") == 1, "toxic").otherwise("plain").alias("category"), (F.col("quality") * 5).cast("double").alias("value"))


@query("j24_saved_labels", f", {LABELS_SQL} SELECT l.post_id, l.category, l.value, p.category AS orig_category, p.value AS orig_value FROM labs l JOIN posts p ON p.id = l.post_id")
def j24_saved_labels(spark, d):
    return overlays.saved_labels(posts(spark, d), labels(spark, d)).select("post_id", "category", "value", "orig_category", "orig_value")


@query("j24_rollback", "SELECT id, category, value FROM posts")
def j24_rollback(spark, d):
    p, given = posts(spark, d), labels(spark, d)
    return overlays.rolled_back(overlays.labelled(p, given), overlays.saved_labels(p, given)).select("id", "category", "value")


@query("g11_label_batch", "SELECT p.id, p.value FROM posts p LEFT JOIN labels l ON p.id = l.doc_id WHERE l.doc_id IS NULL AND length(p.text) >= 40 ORDER BY p.value DESC, p.id LIMIT 20")
def g11_label_batch(spark, d):
    return overlays.label_batch(overlays.unlabelled(posts(spark, d), labels(spark, d))).select("id", "value")


@query("e21_favourite_tags", "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM posts) GROUP BY tag")
def e21_favourite_tags(spark, d):
    favs = posts(spark, d).select(F.col("id").alias("post_id"), "tags", F.col("ts").alias("created_at"))
    return overlays.tag_counts(favs)


@query("o10_hit_counts", f""", words AS (SELECT *, {TOKENS_SQL.format("text")} AS t FROM clustered WHERE is_rep AND ts > 1710000000)
SELECT CAST(1 AS BIGINT) AS id, CAST(3 + count(*) FILTER (list_contains(t, 'onwh')) AS BIGINT) AS hit_count FROM words UNION ALL SELECT 2, 0 UNION ALL SELECT 3, count(*) FILTER (list_contains(t, 'the')) FROM words""", clustered=True)
def o10_hit_counts(spark, d):
    rows = [(1, "onwh", [], 0.0, True, 3), (2, "of", [], 0.0, False, 0), (3, "the", [], 0.0, True, None)]
    subs = spark.createDataFrame(rows, "id long, keyword string, tags array<string>, min_value double, enabled boolean, hit_count long")
    return overlays.with_hits(subs, overlays.subscription_hits(stored_posts(spark, d), subs, 1710000000, index=stored(spark, d).index())).select("id", "hit_count")


# --- evaluation, vectors ------------------------------------------------------------------------------------------


@query("e17_retrieval_metrics", """, ranked AS (SELECT channel, id, row_number() OVER (PARTITION BY channel ORDER BY value DESC, id) AS rank FROM posts), expected AS (SELECT channel, category, arg_max(id, struct_pack(a := views, b := -id)) AS id FROM posts GROUP BY channel, category)
SELECT category AS type, count(*) AS queries, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 8) AS hit_at_k, round(avg(1.0 / rank), 8) AS mrr FROM expected e JOIN ranked r ON e.channel = r.channel AND e.id = r.id GROUP BY category""")
def e17_retrieval_metrics(spark, d):
    p = posts(spark, d)
    ranked = p.select(F.col("channel").alias("query"), "id", F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("value"), "id")).alias("rank"))
    expected = p.groupBy(F.col("channel").alias("query"), F.col("category").alias("type")).agg(F.max_by("id", F.struct("views", -F.col("id"))).alias("id"))
    return facets.retrieval_metrics(ranked, expected).select("type", "queries", F.round("hit_at_k", 8).alias("hit_at_k"), F.round("mrr", 8).alias("mrr"))


@query("e18_judge_metrics", "SELECT round(avg(direct), 8) AS direct, round(avg(related), 8) AS related, round(avg(CASE WHEN direct >= 1 THEN 1.0 ELSE 0.0 END), 8) AS answered FROM (SELECT channel, count(*) FILTER (id % 3 = 2) AS direct, count(*) FILTER (id % 3 >= 1) AS related FROM posts GROUP BY channel)")
def e18_judge_metrics(spark, d):
    judged = posts(spark, d).select(F.col("channel").alias("query"), (F.col("id") % 3).alias("grade"))
    return facets.judge_metrics(judged).select(*(F.round(c, 8).alias(c) for c in ("direct", "related", "answered")))


@query("o11_progress", "SELECT eligible, indexed, eligible - indexed AS \"left\", CAST(CASE WHEN eligible > 0 THEN least(100, indexed * 100 // eligible) ELSE 100 END AS INTEGER) AS percent FROM (SELECT count(*) AS eligible, count(vec_id) AS indexed FROM posts LEFT JOIN embeddings ON id = vec_id WHERE value >= 4 AND length(text) >= 15)")
def o11_progress(spark, d):
    return vectors.progress(posts(spark, d), table(spark, d, "embeddings").select(F.col("vec_id").alias("id")))


@query("j19_reranked", f""", {QUANT_SQL}, near AS (SELECT m.id, list_sum(list_transform(list_zip(m.vec, r.vec), lambda p: p[1] * p[2])) / (m.norm * r.norm) AS score FROM m, (SELECT * FROM m WHERE id = 7) r ORDER BY score DESC, m.id LIMIT 50)
SELECT p.id, round(score, 6) AS score FROM near JOIN posts p ON p.id = near.id ORDER BY len(regexp_extract_all(substr(text, 1, 1200), 'e')) DESC, near.score DESC, p.id LIMIT 10""")
def j19_reranked(spark, d):
    items = vectors.encode(table(spark, d, "embeddings"), id_col="vec_id")
    q = items.where("id = 7").first()
    best, _ = vectors.reranked(posts(spark, d), items, q["vec"], q["norm"], lambda texts: [t.count("e") for t in texts])
    return best.select("id", F.round("score", 6).alias("score"))


# --- what readers are shown ---------------------------------------------------------------------------------------


@query("f5_first_per_category", "SELECT id, category, CAST(rank AS INTEGER) AS rank FROM (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY id) AS rank FROM posts) WHERE rank <= 8")
def f5_first_per_category(spark, d):
    return facets.top_per_category(posts(spark, d), 8, [F.asc("id")]).select("id", "category", "rank")


@query("e16_sections", f""", best AS (SELECT *, {FLAT_SQL} AS flat, row_number() OVER (PARTITION BY category ORDER BY value DESC, ts DESC, id) AS place FROM posts WHERE value >= 2 AND content >= 2 AND length(text) >= 10)
SELECT category, substr(date, 1, 7) AS month, CAST(place AS INTEGER) AS place, md5('- **' || date || '** [' || regexp_replace({ONE_LINE_SQL.format(n=80)}, '[\\[\\]]', ' ', 'g') || '] ' || array_to_string(tags, '/')) AS line FROM best WHERE place <= 1200""")
def e16_sections(spark, d):
    return reports.by_category_sections(posts(spark, d)).select("category", "month", "place", F.md5(F.col("line").cast("binary")).alias("line"))


@query("b9_valuable_sorted", f"""SELECT id, CAST(row_number() OVER (ORDER BY coalesce(list_position([{", ".join(f"'{c}'" for c in facets.CATEGORY_ORDER)}], category) - 1, 99), value DESC, id) AS BIGINT) AS place FROM (SELECT *, 1 FROM posts WHERE value >= 2 AND content >= 2 AND length(text) >= 10)""")
def b9_valuable_sorted(spark, d):
    """The place of each row among all: tasks of the range sort number their own, by how many rows the tasks before have."""
    rows = reports.valuable_sorted(posts(spark, d)).select(F.col("id").alias("post"))
    placed = numbered(rows, Versions(spark, f"{shared_root(spark)}/places-{uuid.uuid4().hex}"), 1)
    return placed.select(F.col("post").alias("id"), F.col("id").cast("long").alias("place"))


@query("i16_hashtags", "SELECT id, array_to_string(regexp_extract_all(text, '#([A-Za-z0-9_一-龥]{1,24})', 1), ',') AS hashtags FROM posts")
def i16_hashtags(spark, d):
    return posts(spark, d).select("id", F.array_join(text.hashtags(F.col("text")), ",").alias("hashtags"))


@query("i18_key_terms", """SELECT id, array_to_string(list_sort(list_distinct(list_concat(
  list_filter(flatten(list_transform(regexp_extract_all(text, '([一-龥]{3,})', 1)[1:4], lambda r: list_transform(range(1, length(r) + 1, 4), lambda i: substr(r, i, 4)))), lambda g: length(g) >= 3)[1:6],
  regexp_extract_all(text, '([A-Za-z][A-Za-z0-9_.-]{2,})', 1)[1:6]))), ',') AS terms FROM posts""")
def i18_key_terms(spark, d):
    return posts(spark, d).select("id", F.array_join(F.array_sort(text.key_terms(F.col("text"))), ",").alias("terms"))


@query("i24_one_line", f"SELECT id, {ONE_LINE_SQL.format(n=120)} AS line FROM (SELECT id, {FLAT_SQL} AS flat FROM posts)")
def i24_one_line(spark, d):
    return posts(spark, d).select("id", text.one_line(F.col("text"), 120).alias("line"))


@query("i25_escape_html", "SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS digest FROM pages", with_posts=False)
def i25_escape_html(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(text.escape_html(F.col("html")).cast("binary")).alias("digest"))


@query("i17_parse_link", r"""SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'web' WHEN 1 THEN 'tme' WHEN 2 THEN 'tme' WHEN 3 THEN 'invite' WHEN 4 THEN 'private' WHEN 5 THEN 'tme' END AS kind, CASE WHEN page_id % 7 IN (1, 2, 5) THEN 'somechan' || (page_id % 9) WHEN page_id % 7 IN (0, 3, 4) THEN '' END AS username,
  CASE WHEN page_id % 7 = 2 THEN page_id ELSE -1 END AS msg_id, CASE page_id % 7 WHEN 0 THEN url WHEN 3 THEN 'https://t.me/+AbC' || page_id WHEN 4 THEN 't.me/c/12345/' || page_id WHEN 6 THEN NULL ELSE 'https://t.me/somechan' || (page_id % 9) END AS url,
  CASE WHEN page_id % 7 = 0 THEN lower(regexp_extract(url, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]+)', 1)) END AS host FROM pages""", with_posts=False)
def i17_parse_link(spark, d):
    n, word = F.col("page_id"), lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    name = word("somechan", n % 9)
    pasted = F.when(n % 7 == 0, F.col("url")).when(n % 7 == 1, word("@", name)).when(n % 7 == 2, word(" https://t.me/s/", name, "/", n)).when(n % 7 == 3, word("https://t.me/+AbC", n))
    link = urls.parse_link(pasted.when(n % 7 == 4, word("t.me/c/12345/", n)).when(n % 7 == 5, word("t.me/", name, "/")).otherwise(word("some words ", n)))
    return table(spark, d, "pages").select("page_id", *(link[c].alias(c) for c in ("kind", "username", "url", "host")), F.coalesce(link["msg_id"], F.lit(-1)).cast("long").alias("msg_id"))


@query("i27_links_in_text", r"SELECT page_id, CAST(least(12, len(list_distinct(u))) AS INTEGER) AS n, array_to_string(list_filter(u, lambda x, i: list_position(u, x) = i)[1:12], ' ') AS links FROM (SELECT page_id, regexp_extract_all(html, '(https?://[^\s\x{0b}<>""''）)】]+)', 1) AS u FROM pages)", with_posts=False)
def i27_links_in_text(spark, d):
    found = urls.links_in(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.size(found).alias("n"), F.array_join(found, " ").alias("links"))


@query("o8_batch_lines", r"SELECT id, CAST(len(l) AS INTEGER) AS n, md5(array_to_string(l, chr(10))) AS digest FROM (SELECT id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\s\x{0b}]+|[\s\x{0b}]+$', '', 'g')), lambda x: x <> '')[1:500] AS l FROM posts)")
def o8_batch_lines(spark, d):
    rows = posts(spark, d).select("id", text.batch_lines(F.col("text")).alias("l"))
    return rows.select("id", F.size("l").alias("n"), F.md5(F.array_join("l", "\n").cast("binary")).alias("digest"))


@query("o12_chat_history", "SELECT conv_id, turn, role, substr(text, 1, 20000) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS p FROM conversations WHERE role IN ('user', 'assistant')) WHERE p <= 30", with_posts=False)
def o12_chat_history(spark, d):
    return hybrid.last_turns(table(spark, d, "conversations"), 30, 20000)


@query("o13_citations", r"SELECT conv_id, turn, array_to_string(regexp_extract_all(text, '\[(\d{1,9})\]', 1), ',') AS cited FROM conversations", with_posts=False)
def o13_citations(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(text.citations(F.col("text")).cast("array<string>"), ",").alias("cited"))


@query("o16_unread", "SELECT count(*) AS unread FROM posts WHERE ts > 1720000000")
def o16_unread(spark, d):
    return posts(spark, d).where(F.col("ts") > 1720000000).agg(F.count("*").alias("unread"))


@query("b11_stats", """, best AS (SELECT * FROM posts WHERE value >= 2 AND content >= 2 AND length(text) >= 10), one AS (SELECT coalesce(category, '') AS k, count(*) AS n FROM best GROUP BY 1), two AS (SELECT coalesce(channel, '') AS k, count(*) AS n FROM best GROUP BY 1)
SELECT (SELECT count(*) FROM posts) AS total, (SELECT count(*) FROM best) AS valuable, (SELECT '{' || string_agg('"' || k || '":' || n, ',' ORDER BY k) || '}' FROM one) AS by_category, (SELECT '{' || string_agg('"' || k || '":' || n, ',' ORDER BY k) || '}' FROM two) AS by_channel""")
def b11_stats(spark, d):
    return reports.stats(posts(spark, d))


DISPOSED_SQL = """, spamming AS (SELECT p.*, p.msg_id % 700 AS key, w.spam >= 4 OR (w.spam >= 3 AND length(p.text) < 80) AS is_spam FROM posts p JOIN worthy w ON p.id = w.id),
firsts AS (SELECT *, row_number() OVER (PARTITION BY channel, key ORDER BY id) > 1 AS dup_id FROM spamming),
texts AS (SELECT *, dup_id = FALSE AND length(text) > 25 AND row_number() OVER (PARTITION BY text, dup_id ORDER BY id) > 1 AS dup_text FROM firsts),
disposed AS (SELECT *, CASE WHEN dup_id THEN 'dup_id' WHEN dup_text THEN 'dup_text' WHEN is_spam THEN 'spam' ELSE 'clean' END AS disposition FROM texts)"""


@query("b7_overview", ", " + classify_sql(HAYS_SQL, DISPOSED_SQL + """, clean AS (SELECT * FROM disposed WHERE disposition = 'clean'), best AS (SELECT * FROM clean WHERE value >= 2 AND content >= 2 AND length(text) >= 10),
ch AS (SELECT coalesce(channel, '') AS k, count(*) AS n, count(*) FILTER (value >= 2 AND content >= 2 AND length(text) >= 10) AS good, max(group_title) AS title FROM clean GROUP BY 1), ca AS (SELECT coalesce(category, '') AS k, count(*) AS n FROM clean GROUP BY 1),
ta AS (SELECT tag AS k, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM best) GROUP BY 1 ORDER BY n DESC, k LIMIT 20), mo AS (SELECT substr(date, 1, 7) AS k, count(*) AS n FROM clean GROUP BY 1)
SELECT 1 AS section, 1 AS place, '| 抓取原始帖子 | ' || format('{:,}', count(*)) || ' 条 |' AS line FROM disposed UNION ALL SELECT 1, 2, '| 重复内容 | ' || format('{:,}', count(*)) || ' 条 |' FROM disposed WHERE disposition IN ('dup_id', 'dup_text')
UNION ALL SELECT 1, 3, '| 广告与垃圾 | ' || format('{:,}', count(*)) || ' 条 |' FROM disposed WHERE disposition = 'spam' UNION ALL SELECT 1, 4, '| 去重清洗后有效帖子 | ' || format('{:,}', count(*)) || ' 条 |' FROM clean
UNION ALL SELECT 1, 5, '| 高价值精选条目 | ' || format('{:,}', count(*)) || ' 条 |' FROM best UNION ALL SELECT 1, 6, '| 时间跨度 | ' || min(date) || ' ~ ' || max(date) || ' |' FROM clean UNION ALL SELECT 1, 7, '| 覆盖频道 | ' || format('{:,}', count(DISTINCT channel)) || ' 个 |' FROM clean
UNION ALL SELECT 2, CAST(row_number() OVER (ORDER BY n DESC, k) AS INTEGER), '| [@' || k || '](https://t.me/' || k || ') | ' || substr(replace(coalesce(title, ''), '|', '/'), 1, 42) || ' | ' || format('{:,}', n) || ' | ' || format('{:,}', good) || ' |' FROM ch
UNION ALL SELECT 3, CAST(row_number() OVER (ORDER BY n DESC, k) AS INTEGER), '| ' || k || ' | ' || format('{:,}', n) || ' |' FROM ca UNION ALL SELECT 4, CAST(row_number() OVER (ORDER BY n DESC, k) AS INTEGER), '| ' || k || ' | ' || format('{:,}', n) || ' |' FROM ta
UNION ALL SELECT 5, CAST(row_number() OVER (ORDER BY k) AS INTEGER), '| ' || k || ' | ' || format('{:,}', n) || ' | ' || repeat('█', CAST(greatest(1, floor(n * 40 / (SELECT max(n) FROM mo) + 0.5)) AS INTEGER)) || ' |' FROM mo"""))
def b7_overview(spark, d):
    """Marked posts are kept, without what the report doesn't read: its sections would each classify all texts again."""
    p = posts(spark, d)
    marks = C.classify(previewed(p), AS_OF).withColumn("msg_id", F.col("msg_id") % 700)
    marks = dedup.dispositions(marks, [F.col("id")]).select("id", "disposition")
    # ten characters tell whether a text has ten
    own = p.select("id", "channel", "category", "date", "value", "content", "tags", "group_title", F.substring("text", 1, 10).alias("text"))
    kept = Versions(spark, f"{shared_root(spark)}/overview-{uuid.uuid4().hex}")
    marked = spark.read.parquet(f"{kept.root}/{kept.write('marked', own.join(marks, 'id'))}")
    return reports.overview(marked.drop("group_title"), marked.select("channel", F.col("group_title").alias("title")))


@query("b7_insight", """, best AS (SELECT * FROM posts WHERE value >= 2 AND content >= 2 AND length(text) >= 10), heat AS (""" + " UNION ALL ".join(f"SELECT '{w}' AS k, count(*) FILTER (contains(text, '{w}')) AS n FROM best" for w in HEAT) + f"""),
deals AS (SELECT *, {FLAT_SQL} AS flat FROM best WHERE (list_contains(tags, '免费') OR list_contains(tags, '限时')) AND NOT list_contains(tags, '风险') AND length(text) >= 25 ORDER BY value DESC, id LIMIT 70),
linked AS (SELECT *, regexp_extract(u, 'github\\.com/([^/?#]+/[^/?#]+)', 1) AS repo FROM (SELECT id, value, unnest(links) AS u FROM best)), repos AS (SELECT repo, max(value) AS value, arg_max(id, struct_pack(a := value, b := -id)) AS id FROM linked WHERE repo <> '' GROUP BY repo ORDER BY value DESC, repo LIMIT 90)
SELECT 1 AS section, CAST(row_number() OVER (ORDER BY n DESC, k) AS INTEGER) AS place, '| ' || k || ' | ' || format('{{:,}}', n) || ' |' AS line FROM heat WHERE n > 0
UNION ALL SELECT 2, CAST(row_number() OVER (ORDER BY value DESC, id) AS INTEGER), '- **' || date || '** ' || {ONE_LINE_SQL.format(n=110)} || CASE WHEN len(links) > 0 THEN ' ' || links[1] ELSE '' END FROM deals
UNION ALL SELECT 3, CAST(row_number() OVER (ORDER BY r.value DESC, repo) AS INTEGER), '- [' || repo || '](https://github.com/' || repo || ') ' || {ONE_LINE_SQL.format(n=110)} FROM repos r JOIN (SELECT id, {FLAT_SQL} AS flat FROM best) b ON b.id = r.id""")
def b7_insight(spark, d):
    return reports.insight(posts(spark, d), HEAT)


@query("j26_run", f""", {SOURCES_SQL}, mine AS (SELECT p.* FROM posts p JOIN sources s ON p.channel = s.channel WHERE kind IN ('channel', 'web')), bound AS (SELECT max(id) AS b FROM posts WHERE id % 2 = 0), new AS (SELECT * FROM mine WHERE id % 2 = 1)
SELECT 'imported' AS what, count(*) AS n FROM new UNION ALL SELECT 'skipped', count(*) FROM mine WHERE id % 2 = 0 UNION ALL SELECT 'scanned', count(*) FROM mine UNION ALL SELECT 'sources', count(*) FROM sources WHERE kind IN ('channel', 'web') UNION ALL SELECT 'runs', 1""")
def j26_run(spark, d):
    """Every second post is stored; a run brings all."""
    store = PostStore(spark, f"{shared_root(spark)}/run-{uuid.uuid4().hex}")
    rows = posts(spark, d)
    store.build(rows.where("id % 2 = 0"))
    came, _ = sync.run(store, sources(spark, d), rows, date="2025-01-01")
    found = spark.createDataFrame([(k, v) for k, v in came.items()], "what string, n long")
    return found.unionByName(sync.runs(store).agg(F.count("*").alias("n")).select(F.lit("runs").alias("what"), "n"))


@query("a10_resolve", """, have AS (SELECT channel, count(*) AS n FROM posts GROUP BY 1), given AS (SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN '@' || source WHEN 1 THEN 'https://t.me/s/' || source || '/' WHEN 2 THEN 'https://example.com/' || doc_id ELSE 'no link' END AS input, source FROM documents)
SELECT id, CASE WHEN id % 4 = 0 AND NOT regexp_matches(source, '^[A-Za-z][A-Za-z0-9_]{3,31}$') THEN NULL WHEN id % 4 IN (0, 1) THEN 'tme' WHEN id % 4 = 2 THEN 'web' END AS kind,
  CAST(CASE WHEN id % 4 = 0 AND NOT regexp_matches(source, '^[A-Za-z][A-Za-z0-9_]{3,31}$') THEN 0 WHEN id % 4 IN (0, 1) THEN coalesce(n, 0) ELSE 0 END AS BIGINT) AS existing FROM given LEFT JOIN have ON source = channel""")
def a10_resolve(spark, d):
    n, name = F.col("doc_id"), F.col("source")
    pasted = F.when(n % 4 == 0, F.concat(F.lit("@"), name)).when(n % 4 == 1, F.concat(F.lit("https://t.me/s/"), name, F.lit("/"))).when(n % 4 == 2, F.concat(F.lit("https://example.com/"), n.cast("string"))).otherwise("no link")
    return sync.resolved(table(spark, d, "documents").select(n.alias("id"), pasted.alias("input")), posts(spark, d)).select("id", "kind", "existing")


@query("j25_context", r""", best AS (SELECT *, row_number() OVER (ORDER BY value DESC, id) AS rank FROM posts ORDER BY value DESC, id LIMIT 14), flat AS (SELECT *, regexp_replace(text, '[\s\x{0b}]+', ' ', 'g') AS f FROM best)
SELECT CAST(rank AS INTEGER) AS rank, '[' || rank || '] 日期:' || date || ' 频道:@' || channel || ' 分类:' || category || ' 热度:' || views || chr(10) || CASE WHEN len(tags) > 0 THEN '标签:' || array_to_string(tags, '/') || chr(10) ELSE '' END || '内容:' || substr(f, 1, 420) || CASE WHEN len(links) > 0 THEN chr(10) || '链接:' || array_to_string(links[1:3], ' , ') ELSE '' END AS line,
  CASE WHEN rank <= 10 THEN '**[' || rank || '] ' || date || ' · @' || channel || ' · ' || category || '**' || chr(10) || substr(f, 1, 300) || CASE WHEN len(links) > 0 THEN chr(10) || '链接：' || links[1] ELSE '' END END AS block FROM flat""")
def j25_context(spark, d):
    best = posts(spark, d).orderBy(F.desc("value"), "id").limit(14)
    best = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("value"), "id")))
    return hybrid.context(best).join(hybrid.extracts(best), "rank", "left")


@query("o6_favourite_tags", """, tagged AS (SELECT id, CASE WHEN id % 4 = 0 THEN tags WHEN list_contains(tags, '免费') AND id % 4 = 2 THEN tags WHEN id % 4 = 2 THEN list_append(tags, '免费') ELSE list_append(tags, substr('a tag that is too long', 1, 12)) END AS t FROM posts)
SELECT id, array_to_string(t, '|') AS tags FROM tagged WHERE list_contains(t, '免费')""")
def o6_favourite_tags(spark, d):
    n = F.col("id")
    more = F.when(n % 4 == 0, F.lit("  ")).when(n % 4 == 2, F.lit(" 免费 ")).otherwise("a tag that is too long ")
    favs = posts(spark, d).select(n.alias("post_id"), overlays.tagged(F.col("tags"), more).alias("tags"), F.lit("").alias("note"), F.col("ts").alias("created_at"))
    return overlays.favourites(favs, posts(spark, d), "免费").select("id", F.array_join("fav_tags", "|").alias("tags"))


@query("b17_vector_blocks", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(max(len(embedding)) AS INTEGER) AS dim FROM embeddings", with_posts=False)
def b17_vector_blocks(spark, d):
    """Writes the blocks, if they aren't there."""
    return stored_blocks(spark, d).agg(F.sum("n").alias("n"), F.max("dim").alias("dim"))


@query("j16_many", f"""WITH {QUANT_SQL} SELECT query, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT r.id AS query, m.id, list_sum(list_transform(list_zip(m.vec, r.vec), lambda p: p[1] * p[2])) / (m.norm * r.norm) AS score,
  row_number() OVER (PARTITION BY r.id ORDER BY list_sum(list_transform(list_zip(m.vec, r.vec), lambda p: p[1] * p[2])) / (m.norm * r.norm) DESC, m.id) AS rank FROM m, (SELECT * FROM m WHERE id % 50 = 7) r) WHERE rank <= 20""", with_posts=False)
def j16_many(spark, d):
    """Stored blocks of vectors, every fiftieth of them a query."""
    items = vectors.encode(table(spark, d, "embeddings"), id_col="vec_id")
    asked = [(r["id"], r["vec"], r["norm"]) for r in items.where("id % 50 = 7").limit(5000).collect()]
    return vectors.nearest_in(stored_blocks(spark, d), asked, 20).select("query", "id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


# --- imports and exports ------------------------------------------------------------------------------------------


def normal_sql(text: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({text}, '[\x{{200b}}\x{{feff}}]', '', 'g'), '[ \t\x{{00a0}}]+', ' ', 'g'), '\n{{2,}}', chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query("a7_web_import", f"""WITH {web_sql("page_id, url")}, named AS (SELECT page_id AS id, url, title, lower(regexp_extract(url, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host, {normal_sql("text")} AS text FROM web WHERE url IS NOT NULL),
{classify_sql("SELECT id, text, [url] AS links, 0 AS views, lower(text) || ' ' AS hay, 1 AS recent FROM named", "")}
SELECT n.id AS page_id, 'web_' || host AS channel, CAST(('0x' || substr(md5(n.url), 1, 15)) AS BIGINT) AS msg_id, coalesce(nullif(n.title, ''), host) AS group_title, '2025-01-01' AS date, md5(n.text) AS digest, "primary" AS category, array_to_string(cats, ',') AS categories, array_to_string(tags, ',') AS tags, value, content, n.url AS links
FROM named n JOIN worthy w ON n.id = w.id JOIN pages p ON p.page_id = n.id WHERE p.html <> ''""", with_posts=False)
def a7_web_import(spark, d):
    rows = imports.web_posts(table(spark, d, "pages"), 1735689600, also=("page_id",))
    return rows.select("page_id", "channel", "msg_id", "group_title", "date", F.md5(F.col("text").cast("binary")).alias("digest"), "category", "categories", "tags", "value", "content", "links")


@query("a8_channel_import", ", " + classify_sql("SELECT id, text, links, views, lower(text) || ' ' AS hay, 0 AS recent FROM posts", """SELECT channel, p.id AS msg_id, 'https://t.me/' || channel || '/' || p.id AS url, date, array_to_string(p.links, ' ') AS links, md5(p.text) AS digest, "primary" AS category, array_to_string(w.tags, ',') AS tags, w.value, w.content
FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY id DESC) AS p FROM posts) p JOIN worthy w ON p.id = w.id WHERE p <= 2000 AND (p.text <> '' OR len(p.links) > 0)"""))
def a8_channel_import(spark, d):
    lp = F.lit(None).cast("array<struct<u:string,s:string,t:string>>")
    messages = posts(spark, d).select("channel", F.col("id").alias("i"), F.col("date").alias("d"), "ts", F.col("views").alias("v"), F.col("text").alias("t"), F.col("links").alias("lk"), lp.alias("lp"))
    return imports.channel_posts(messages).select("channel", "msg_id", "url", "date", "links", F.md5(F.col("text").cast("binary")).alias("digest"), "category", "tags", "value", "content")


@query("b15_export", r"""SELECT CAST(place AS INTEGER) AS place, md5('## ' || place || '. ' || substr(title, 1, 120) || chr(10) || chr(10) || '- 分类：' || coalesce(category, '') || '　价值分：' || format('{:.1f}', value) || '　来源：@' || coalesce(channel, '') || '　日期：' || date || chr(10)
  || CASE WHEN len(links) > 0 THEN '- 链接：' || links[1] || chr(10) ELSE '' END || CASE WHEN len(tags) > 0 THEN '- 标签：' || array_to_string(tags, '、') || chr(10) ELSE '' END
  || CASE WHEN body <> '' THEN chr(10) || substr(body, 1, 1500) || chr(10) ELSE '' END) AS digest
FROM (SELECT *, row_number() OVER (ORDER BY value DESC, id) AS place, split_part(text, chr(10), 1) AS title, regexp_replace(substr(text, length(split_part(text, chr(10), 1)) + 2), '^\s+|\s+$', '', 'g') AS body FROM posts) WHERE place <= 300""")
def b15_export(spark, d):
    return reports.exported(posts(spark, d), F.desc("value"), "id").select("place", F.md5(F.col("block").cast("binary")).alias("digest"))


@query("i26_display", r"""SELECT id, CASE WHEN days <= 0 THEN '今天' WHEN days = 1 THEN '昨天' WHEN days < 30 THEN days || ' 天前' WHEN days < 365 THEN (days // 30) || ' 个月前' ELSE (days // 365) || ' 年前' END AS age,
  CASE WHEN views >= 10000 THEN (((views + 500) // 1000) // 10) || '.' || (((views + 500) // 1000) % 10) || 'w' WHEN views >= 1000 THEN (((views + 50) // 100) // 10) || '.' || (((views + 50) // 100) % 10) || 'k' ELSE CAST(coalesce(views, 0) AS VARCHAR) END AS views,
  md5(CASE WHEN e > 1 AND e <= 90 THEN substr(text, 1, e - 1) ELSE substr(text, 1, 90) END) AS title, md5(CASE WHEN e > 1 AND e <= 90 THEN substr(text, e + 1) ELSE substr(text, 91) END) AS body,
  md5(regexp_replace(text, '(the|de)', '<mark>\1</mark>', 'gi')) AS marked
FROM (SELECT *, date_diff('day', CAST(date AS DATE), DATE '2024-12-31') AS days, instr(text, chr(10)) AS e FROM posts)""")
def i26_display(spark, d):
    t = display.title_and_body(F.col("text"))
    rows = posts(spark, d).select("id", display.age(F.col("date"), "2024-12-31").alias("age"), display.short_number(F.col("views")).alias("views"), t.alias("t"), display.highlighted(F.col("text"), ["the", "de"]).alias("marked"))
    return rows.select("id", "age", "views", *(F.md5(F.col(c).cast("binary")).alias(n) for c, n in (("t.title", "title"), ("t.body", "body"), ("marked", "marked"))))


@query("o14_saved_searches", r"""SELECT id, '{"q":"' || channel || '","cat":"' || category || '"' || CASE WHEN len(tags) > 0 THEN ',"tags":["' || array_to_string(tags, '","') || '"]' ELSE '' END || CASE WHEN id % 3 > 0 THEN ',"days":' || (id % 3 * 7) ELSE '' END || CASE WHEN id % 2 = 1 THEN ',"sort":"date"' ELSE '' END || '}' AS json,
  CASE WHEN id % 2 = 1 THEN 'date' ELSE 'relevance' END AS sort, CAST(id % 3 * 7 AS INTEGER) AS days FROM posts WHERE channel IS NOT NULL AND category IS NOT NULL""")
def o14_saved_searches(spark, d):
    n = F.col("id")
    search = F.struct(F.concat(F.lit(" "), "channel").alias("q"), F.col("category").alias("cat"), "tags", F.lit("").alias("channel"), (n % 3 * 7).cast("int").alias("days"), F.when(n % 2 == 1, "date").otherwise("relevance").alias("sort"), F.lit(0).alias("semantic"))
    rows = posts(spark, d).where("channel is not null and category is not null").select("id", search.alias("s")).select("id", display.captured(F.col("s")).alias("json"))
    back = display.restored(F.col("json"))
    return rows.select("id", "json", back["sort"].alias("sort"), back["days"].alias("days"))
