"""The registered queries of the engine and, where SQL can say the same, their oracles."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..adapter import POSTS_SQL, posts, table
from ..functions import html, text, urls
from ..operators import classify as C
from ..operators import cluster as K
from ..operators import dedup, facets, hybrid, index, overlays, reports, search, vectors
from ..shipping import ship
from ..streaming import ingest
from ..streaming.store import PostStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CLUSTERED_SQL = """
keys AS (SELECT cluster_key, arg_max(id, struct_pack(a := value, b := length(text), c := -id)) AS rep, count(*) AS n FROM posts WHERE cluster_key IS NOT NULL GROUP BY cluster_key HAVING count(DISTINCT channel) > 1),
clustered AS (SELECT p.*, coalesce(k.rep, p.id) AS rep_id, CAST(coalesce(k.n, 1) AS INTEGER) AS cluster_size, coalesce(k.rep, p.id) = p.id AS is_rep FROM posts p LEFT JOIN keys k ON p.cluster_key = k.cluster_key)
"""
TOKENS_SQL = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def query(name: str, sql: str | None = None, with_posts: bool = True, clustered: bool = False):
    """Registers a query; ``sql`` may use the posts of the adapter."""
    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            parts = [POSTS_SQL] * with_posts + [CLUSTERED_SQL] * clustered
            ORACLES[name] = f"WITH {', '.join(parts)} {sql}" if parts else sql
        return f

    return register


_built: dict[tuple, PostStore] = {}


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="sievework-")
    return root.rstrip("/")


def files_of(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(at)))


def stored(spark: SparkSession, sf_dir: str, how: str = "build") -> PostStore:
    """The posts in a store, made once for each application and state of the table's files: as a whole or in batches."""
    key = (spark.sparkContext.applicationId, how, files_of(spark, f"{sf_dir}/documents.parquet"))
    if key not in _built:
        store = PostStore(spark, f"{shared_root(spark)}/posts-{uuid.uuid4().hex}")
        if how == "build":
            store.build(posts(spark, sf_dir))
        else:
            rows = posts(spark, sf_dir)
            cuts = [int(x) for x in rows.approxQuantile("id", [0.5, 0.75, 0.9], 0.01)]
            for k, (a, b) in enumerate(zip([None, *cuts], [*cuts, None])):
                part = rows if a is None else rows.where(F.col("id") > a)
                store.append(part if b is None else part.where(F.col("id") <= b), "batches", k)
        _built[key] = store
    return _built[key]


_blocks: dict[tuple, str] = {}


def stored_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as stored blocks, written once for each application and state of the table's files."""
    key = (spark.sparkContext.applicationId, files_of(spark, f"{sf_dir}/embeddings.parquet"))
    if key not in _blocks:
        path = f"{shared_root(spark)}/blocks-{uuid.uuid4().hex}"
        vectors.blocks_of(vectors.encode(table(spark, sf_dir, "embeddings"), id_col="vec_id")).write.parquet(path)
        _blocks[key] = path
    return spark.read.parquet(_blocks[key])


def stored_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).posts()


def clustered_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.cluster(posts(spark, sf_dir))


# --- filters, orders, pages ---------------------------------------------------------------------------------------


@query("c2_filters", "SELECT id, date, value FROM posts WHERE category = 'en' AND channel = 'src0' AND date >= '2024-02-01' AND date <= '2024-09-30' AND value >= 4 AND list_contains(tags, '免费')")
def c2_filters(spark, d):
    f = search.Filters(category="en", channel="src0", date_from="2024-02-01", date_to="2024-09-30", min_value=4, tags=["免费"])
    return search.filtered(posts(spark, d), f).select("id", "date", "value")


@query("c5_since", "SELECT id, ts FROM posts WHERE ts > 1720000000")
def c5_since(spark, d):
    return search.filtered(posts(spark, d), search.Filters(since=1720000000)).select("id", "ts")


@query("c8_collapse", "SELECT id, rep_id, cluster_size FROM clustered WHERE is_rep", clustered=True)
def c8_collapse(spark, d):
    return search.filtered(stored_posts(spark, d)).select("id", "rep_id", "cluster_size")


@query("c10_like", "SELECT id FROM posts WHERE contains(lower(text), 'the') AND contains(lower(text), 'onwh')")
def c10_like(spark, d):
    return search.contains_all(posts(spark, d), "The onwh").select("id")


@query("c11_label_candidates", "SELECT id, value FROM posts WHERE length(text) >= 40 AND value >= 5 AND channel = 'src1'")
def c11_label_candidates(spark, d):
    none = posts(spark, d).limit(0).select(F.col("id").alias("post_id"))
    return overlays.unlabelled(posts(spark, d), none, "highvalue", channel="src1").select("id", "value")


@query("c12_embedding_eligible", "SELECT count(*) AS n FROM posts WHERE value >= 4 AND length(text) >= 15")
def c12_embedding_eligible(spark, d):
    return vectors.eligible(posts(spark, d)).agg(F.count("*").alias("n"))


@query("c21_point_lookup", "SELECT id, channel, date, value FROM posts WHERE id = 42")
def c21_point_lookup(spark, d):
    return posts(spark, d).where("id = 42").select("id", "channel", "date", "value")


@query("a12_valuable", "SELECT id, value, content FROM posts WHERE value >= 2 AND content >= 2 AND length(text) >= 10")
def a12_valuable(spark, d):
    return facets.valuable(posts(spark, d)).select("id", "value", "content")


def _paged(sort: str, page: int) -> Query:
    return lambda spark, d: search.search(stored_posts(spark, d), "", sort=sort, page=page, size=25).items.select("id", "date", "views", "value")


for _sort, _by in (("date", "date DESC, ts DESC, id"), ("views", "views DESC, id"), ("value", "value DESC, ts DESC, id")):
    query(f"g_browse_by_{_sort}", f"SELECT id, date, views, value FROM clustered WHERE is_rep ORDER BY {_by} LIMIT 25 OFFSET 50", clustered=True)(_paged(_sort, 3))


# --- joins --------------------------------------------------------------------------------------------------------


@query("d1_favourites", "SELECT p.id, p.value, l.quality AS note FROM posts p JOIN labels l ON p.id = l.doc_id")
def d1_favourites(spark, d):
    favs = table(spark, d, "labels").select(F.col("doc_id").alias("post_id"), F.array(F.lit("t")).alias("tags"), F.col("quality").alias("note"), F.col("doc_id").alias("created_at"))
    return overlays.favourites(favs, posts(spark, d)).select("id", "value", "note")


@query("d2_unlabelled", "SELECT p.id FROM posts p LEFT JOIN labels l ON p.id = l.doc_id WHERE l.doc_id IS NULL AND length(p.text) >= 40")
def d2_unlabelled(spark, d):
    return overlays.unlabelled(posts(spark, d), table(spark, d, "labels").select(F.col("doc_id").alias("post_id"))).select("id")


@query("d3_embedding_queue", "SELECT p.id, p.value FROM posts p LEFT JOIN embeddings e ON p.id = e.vec_id WHERE e.vec_id IS NULL AND p.value >= 4 AND length(p.text) >= 15 ORDER BY p.value DESC, p.id LIMIT 100")
def d3_embedding_queue(spark, d):
    return vectors.queue(posts(spark, d), table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), 100).select("id", "value")


@query("d6_cluster_members", "SELECT id, rep_id FROM clustered WHERE rep_id IN (SELECT rep_id FROM clustered WHERE cluster_size > 1 AND is_rep)", clustered=True)
def d6_cluster_members(spark, d):
    rows = clustered_posts(spark, d)
    return rows.join(rows.where("cluster_size > 1 and is_rep").select("rep_id"), "rep_id", "left_semi").select("id", "rep_id")


@query("d11_label_overlay", "SELECT p.id, CASE WHEN l.toxic = 1 THEN 'toxic' ELSE p.category END AS category, CASE WHEN l.doc_id IS NOT NULL THEN CAST(l.quality * 5 AS DOUBLE) ELSE p.value END AS value FROM posts p LEFT JOIN labels l ON p.id = l.doc_id")
def d11_label_overlay(spark, d):
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("post_id"), F.when(F.col("toxic") == 1, "toxic").alias("category"), (F.col("quality") * 5).cast("double").alias("value"))
    return overlays.labelled(posts(spark, d), labels).select("id", "category", "value")


@query("d_revenue_by_nation", """
SELECT n_name, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue, count(*) AS lines, count(DISTINCT o_orderkey) AS orders
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""", with_posts=False)
def d_revenue_by_nation(spark, d):
    t = lambda n: table(spark, d, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).cast("double").alias("revenue"), F.count("*").alias("lines"), F.count_distinct("o_orderkey").alias("orders"))


# --- aggregates ---------------------------------------------------------------------------------------------------


@query("e1_totals", "SELECT count(*) AS n, count(*) FILTER (is_rep) AS visible FROM clustered", clustered=True)
def e1_totals(spark, d):
    return stored(spark, d).totals()


@query("e3_by_category", "SELECT category, count(*) AS n FROM clustered WHERE is_rep GROUP BY category", clustered=True)
def e3_by_category(spark, d):
    return stored(spark, d).facet("category", "category")


@query("e4_by_channel", "SELECT channel, count(*) AS n FROM clustered WHERE is_rep GROUP BY channel ORDER BY n DESC, channel LIMIT 60", clustered=True)
def e4_by_channel(spark, d):
    return stored(spark, d).facet("channel", "channel", 60)


@query("e5_group_stats", "SELECT channel, count(*) AS n, max(group_title) AS group_title FROM posts WHERE source = 'group' GROUP BY channel ORDER BY n DESC, channel LIMIT 20")
def e5_group_stats(spark, d):
    return facets.group_stats(posts(spark, d))


@query("e7_tags", "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM clustered WHERE is_rep AND value >= 4) GROUP BY tag ORDER BY n DESC, tag LIMIT 40", clustered=True)
def e7_tags(spark, d):
    return stored(spark, d).facet("tag", "tag", 40)


@query("e8_domains", r"SELECT domain, count(*) AS n FROM (SELECT regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]+)', 1)), '^www\.', '') AS domain FROM pages) GROUP BY domain ORDER BY n DESC, domain LIMIT 300", with_posts=False)
def e8_domains(spark, d):
    return facets.domain_histogram(table(spark, d, "pages").select(F.array(urls.domain_of(F.col("url"))).alias("domains")))


NOISE_SQL = "['version', 'namespace', 'description', 'author', 'grant', 'match', 'latest', 'gmail', 'include', 'exclude', 'icon', 'name', 'license', 'homepage', 'support', 'downloadurl', 'updateurl', 'require', 'resource', 'connect', 'run-at', 'noframes', 'antifeature', 'iconurl', 'email', 'date', 'copyright', 'website', 'docs', 'example', 'test', 'todo', 'param', 'args', 'media', 'import', 'export', 'type', 'interface', 'enum', 'struct', 'class', 'return', 'throws', 'deprecated', 'since', 'see', 'file', 'module', 'package', 'project', 'app', 'api', 'url', 'http', 'https', 'www', 'com', 'org', 'net']"


@query("e9_mentions", f"SELECT handle, count(*) AS n FROM (SELECT DISTINCT id, unnest(regexp_extract_all(text, '@([A-Za-z][A-Za-z0-9_]{{4,31}})', 1)) AS handle FROM posts) WHERE NOT list_contains({NOISE_SQL}, lower(handle)) GROUP BY handle ORDER BY n DESC, handle LIMIT 200")
def e9_mentions(spark, d):
    return facets.mention_histogram(posts(spark, d))


@query("c17_hosts", r"""SELECT is_file_host, domain, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY is_file_host ORDER BY n DESC, domain) AS rank FROM (
  SELECT regexp_matches(domain, 'quark\.cn|baidu\.com|lanzou|123pan|aliyundrive|alipan|115\.com|weiyun|ctfile|uguu|mypikpak|lanzoui|lanzoux') AS is_file_host, domain, count(*) AS n FROM (
    SELECT page_id, unnest(list_distinct([page, other])) AS domain FROM (
      SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]+)', 1)), '^www\.', '') AS page, ['t.me', 'pan.baidu.com', 'www.lanzoux.com', 'linux.do', 'notlinux.do', 'localhost', 'a.b.115.com'][page_id % 7 + 1] AS other FROM pages))
  WHERE domain <> '' AND NOT regexp_matches(domain, '(^|\.)linux\.do$|(^|\.)t\.me$|(^|\.)telegram\.org$|(^|\.)telesco\.pe$|(^|\.)ldstatic\.com$|^127\.0\.0\.1$|(^|\.)telegram\.me$|(^|\.)t\.lg$|^localhost$') GROUP BY 1, 2)) WHERE rank <= 300""", with_posts=False)
def c17_hosts(spark, d):
    others = F.array(*map(F.lit, ("t.me", "pan.baidu.com", "www.lanzoux.com", "linux.do", "notlinux.do", "localhost", "a.b.115.com")))
    rows = table(spark, d, "pages").select(F.array_distinct(F.array(urls.domain_of(F.col("url")), others[(F.col("page_id") % 7).cast("int")])).alias("domains"))
    return facets.domain_histogram(rows, split=True).where("domain <> ''").select("is_file_host", "domain", "n", F.col("rank").cast("int").alias("rank"))


@query("e10_valuable_by_channel", "SELECT channel, count(*) AS n FROM posts WHERE value >= 2 AND content >= 2 AND length(text) >= 10 GROUP BY channel")
def e10_valuable_by_channel(spark, d):
    return facets.valuable(posts(spark, d)).groupBy("channel").agg(F.count("*").alias("n"))


HEAT = ["the", "License", "idiot", "token", "oi", "und", "password"]


@query("e11_keyword_heat", " UNION ALL ".join(f"SELECT '{w}' AS keyword, count(*) FILTER (contains(text, '{w}')) AS n FROM posts" for w in HEAT))
def e11_keyword_heat(spark, d):
    return facets.keyword_heat(posts(spark, d), HEAT)


@query("e12_best_per_repository", "SELECT repo, max(value) AS value, arg_max(id, struct_pack(a := value, b := -id)) AS id, count(DISTINCT id) AS posts FROM (SELECT id, value, regexp_extract(u, 'github\\.com/([^/?#]+/[^/?#]+)', 1) AS repo FROM (SELECT id, value, unnest(links) AS u FROM posts)) WHERE repo <> '' GROUP BY repo")
def e12_best_per_repository(spark, d):
    return facets.best_per_repository(posts(spark, d))


@query("e17_known_items", """
SELECT b.item_id, count(p.id) AS found, min(p.id) AS first FROM benchmark b JOIN documents d ON contains(d.text, b.text) JOIN posts p ON p.id = d.doc_id GROUP BY b.item_id""")
def e17_known_items(spark, d):
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    return facets.containing(docs, items).groupBy("item_id").agg(F.count_distinct("doc_id").alias("found"), F.min("doc_id").alias("first"))


@query("e19_cluster_stats", "SELECT count(cluster_key) AS keyed, count(DISTINCT cluster_key) AS keys, count(*) FILTER (NOT is_rep) AS merged, count(*) FILTER (is_rep AND cluster_size > 1) AS clusters FROM clustered", clustered=True)
def e19_cluster_stats(spark, d):
    return K.cluster_stats(clustered_posts(spark, d))


@query("e20_months", "SELECT month, n, CAST(floor(n * 40 / max(n) OVER () + 0.5) AS INTEGER) AS bar FROM (SELECT substr(date, 1, 7) AS month, count(*) AS n FROM posts GROUP BY 1)")
def e20_months(spark, d):
    return facets.by_month(posts(spark, d))


# --- windows and top-k --------------------------------------------------------------------------------------------


@query("f1_clusters", "SELECT id, rep_id, cluster_size, is_rep FROM clustered", clustered=True)
def f1_clusters(spark, d):
    return clustered_posts(spark, d).select("id", "rep_id", "cluster_size", "is_rep")


@query("f3_dispositions", """,
texts AS (SELECT id, length(text) > 25 AND row_number() OVER (PARTITION BY text ORDER BY id) > 1 AS dup FROM posts) SELECT id, CASE WHEN dup THEN 'dup_text' ELSE 'clean' END AS disposition FROM texts""")
def f3_dispositions(spark, d):
    return dedup.dispositions(posts(spark, d), [F.col("id")], spam_col=None).select("id", "disposition")


@query("f7_throughput", "SELECT event_id, CASE WHEN span > 0 THEN round(total / span, 4) END AS rate FROM (SELECT event_id, sum(1) OVER w AS total, max(epoch_us(ts)) OVER w / 1e6 - min(epoch_us(ts)) OVER w / 1e6 AS span FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) / 1e6, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))", with_posts=False)
def f7_throughput(spark, d):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    batches = table(spark, d, "events").select("user_id", "event_id", at.alias("at"), F.lit(1).alias("done"))
    return facets.throughput(batches, order=("at", "event_id"), key="user_id").select("event_id", F.round("rate", 4).alias("rate"))


@query("g6_top_per_category", "SELECT id, category, CAST(rank AS INTEGER) AS rank FROM (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY value DESC, ts DESC, id) AS rank FROM posts) WHERE rank <= 20")
def g6_top_per_category(spark, d):
    return facets.top_per_category(posts(spark, d), 20).select("id", "category", "rank")


@query("g7_top_500", """,
best AS (SELECT id, category, value, views FROM posts ORDER BY value DESC, views DESC, id LIMIT 500)
SELECT id, CAST(row_number() OVER w AS INTEGER) AS rank, coalesce(lag(category) OVER w <> category, TRUE) AS breaks FROM best WINDOW w AS (ORDER BY value DESC, views DESC, id)""")
def g7_top_500(spark, d):
    return facets.top_posts(posts(spark, d)).select("id", "rank", "breaks")


@query("g9_highlights", "SELECT id, value FROM clustered WHERE is_rep AND id > 100 AND value >= 7 ORDER BY value DESC, id LIMIT 20", clustered=True)
def g9_highlights(spark, d):
    return facets.highlights(stored_posts(spark, d), 100).select("id", "value")


@query("g10_free_deals", "SELECT id, value FROM posts WHERE (list_contains(tags, '免费') OR list_contains(tags, '限时')) AND NOT list_contains(tags, '风险') AND length(text) >= 25 ORDER BY value DESC, id LIMIT 70")
def g10_free_deals(spark, d):
    return facets.free_deals(posts(spark, d)).select("id", "value")


@query("g15_fuzzy", "SELECT p_partkey, score FROM (SELECT p_partkey, p_name, CASE WHEN starts_with(lower(p_name), 'al') THEN 0 WHEN contains(lower(p_name), 'al') THEN 1 WHEN regexp_matches(lower(p_name), 'a.*l', 's') THEN 2 END AS score FROM part) WHERE score IS NOT NULL ORDER BY score, p_name, p_partkey LIMIT 40", with_posts=False)
def g15_fuzzy(spark, d):
    rows = table(spark, d, "part").withColumn("label", F.concat("p_name", F.lit(" "), F.lpad(F.col("p_partkey").cast("string"), 12, "0")))
    return facets.fuzzy(rows.withColumn("label", F.col("label")), "al").select("p_partkey", "score")


# --- functions ----------------------------------------------------------------------------------------------------


NAMED_SQL = "replace(replace(replace(replace(replace(replace(replace(replace({}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&#039;', ''''), '&apos;', ''''), '&amp;', '&')"


def strip_sql(html: str) -> str:
    bare = rf"regexp_replace(regexp_replace(regexp_replace({html}, '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(p|div|blockquote|li|tr|h[1-6])>', chr(10), 'g'), '<[^>]*>', '', 'g')"
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({NAMED_SQL.format(bare)}, '[ \t\x{{00a0}}]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '')"


@query("i2_strip_tags", f"SELECT page_id, md5({strip_sql('html')}) AS digest FROM pages", with_posts=False)
def i2_strip_tags(spark, d):
    """Some letters come as numeric entities, which give the same text."""
    page = F.replace(F.replace(F.col("html"), F.lit("é"), F.lit("&#xE9;")), F.lit("w"), F.lit("&#119;"))
    return table(spark, d, "pages").select("page_id", F.md5(text.strip_tags(page).cast("binary")).alias("digest"))


@query("i3_normalize_text", "SELECT id, length(text) AS n, md5(text) AS digest FROM posts")
def i3_normalize_text(spark, d):
    return posts(spark, d).select("id", F.length("text").cast("long").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("i5_domain_of", r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]+)', 1)), '^www\.', '') AS domain FROM pages", with_posts=False)
def i5_domain_of(spark, d):
    return table(spark, d, "pages").select("page_id", urls.domain_of(F.col("url")).alias("domain"))


@query("i6_terms", "SELECT id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(text, '[，。！？、；：\"''（）【】《》,.!?;:()\\[\\]{}<>|\\\\/]', ' ', 'g'), '\\s+'), lambda x: x <> ''), ' ') AS terms FROM posts")
def i6_terms(spark, d):
    return posts(spark, d).select("id", F.array_join(text.split_terms(F.col("text")), " ").alias("terms"))


def web_sql(keep: str = "page_id") -> str:
    """``web``: ``keep``, title and text of each page."""
    cell = lambda pattern: rf"nullif(regexp_replace({NAMED_SQL.format(f'regexp_extract(html, {pattern}, 1)')}, '^\s+|\s+$', '', 'g'), '')"
    meta = lambda attribute, name: rf"""'(?is)<meta[^>]+{attribute}=["'']{name}["''][^>]+content=["'']([^"'']*)["'']'"""
    body = "html"
    for tag in ("script", "style", "noscript", "nav", "footer", "header"):
        body = f"regexp_replace({body}, '(?is)<{tag}.*?</{tag}>', ' ', 'g')"
    title = f"coalesce({cell(meta('property', 'og:title'))}, {cell(chr(39) + '(?is)<title[^>]*>(.*?)</title>' + chr(39))}, '')"
    about = f"coalesce({cell(meta('property', 'og:description'))}, {cell(meta('name', 'description'))}, '')"
    return rf"""cut AS (SELECT {keep}, html, {title} AS title, {about} AS about, regexp_replace({strip_sql(body)}, '[ \t]{{2,}}', ' ', 'g') AS plain FROM pages),
    web AS (SELECT {keep}, title, substr(CASE WHEN title <> '' THEN title || chr(10) ELSE '' END || CASE WHEN about <> '' THEN about || chr(10) ELSE '' END || plain, 1, 6000) AS text FROM cut)"""


@query("i12_extract_web", f"WITH {web_sql()} SELECT page_id, title, md5(text) AS digest, length(text) AS n FROM web", with_posts=False)
def i12_extract_web(spark, d):
    page = html.extract_web(F.col("html"))
    rows = table(spark, d, "pages").select("page_id", page.alias("p"))
    return rows.select("page_id", "p.title", F.md5(F.col("p.text").cast("binary")).alias("digest"), F.length("p.text").cast("long").alias("n"))


@query("i13_normalize_url", r"""
SELECT page_id, CASE WHEN len(segs) >= 2 OR q <> '' THEN host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS url FROM (
  SELECT page_id, host, path, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(ref|utm_[^=]*|from|source)='))), '&') AS q
  FROM (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '://([^/?#:]+)', 1)), '^www\.', '') AS host, regexp_replace(lower(regexp_extract(url, '://[^/?#]+([^?#]*)', 1)), '/+$', '') AS path FROM pages))""", with_posts=False)
def i13_normalize_url(spark, d):
    return table(spark, d, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("url"))


@query("i14_cluster_key", "SELECT id, cluster_key FROM posts")
def i14_cluster_key(spark, d):
    return posts(spark, d).select("id", "cluster_key")


@query("i14_topics", """SELECT id, CASE id % 5 WHEN 0 THEN 'topic:' || (id % 13) WHEN 1 THEN CASE WHEN id % 13 = id % 11 THEN 'topic:' || (id % 13) END WHEN 2 THEN 'link:github.com/a/b' || (id % 3) WHEN 3 THEN 'topic:' || (id % 13) END AS cluster_key FROM posts""")
def i14_topics(spark, d):
    """Links to one topic, to two, to a page beside a profile, to a topic twice, and to none that tells."""
    n = F.col("id")
    topic = lambda k, tail="": F.concat(F.lit("https://linux.do/t/topic/"), (n % k).cast("string"), F.lit(tail))
    profile = F.lit("https://t.me/someuser")
    links = F.when(n % 5 == 0, F.array(profile, topic(13, "/21"))).when(n % 5 == 1, F.array(topic(13), topic(11))).when(n % 5 == 2, F.array(profile, F.concat(F.lit("https://github.com/a/b"), (n % 3).cast("string"))))
    links = links.when(n % 5 == 3, F.array(topic(13), F.lit(None), topic(13, "/1"))).otherwise(F.array(F.lit("https://t.me/chan/12"), F.lit("https://example.com")))
    return posts(spark, d).select("id", urls.cluster_key(links).alias("cluster_key"))


@query("i21_recency", "SELECT id, round(pow(2.0, -greatest(0, date_diff('day', CAST(date AS DATE), DATE '2024-12-31')) / 10.0), 8) AS decay FROM posts")
def i21_recency(spark, d):
    return posts(spark, d).select("id", F.round(hybrid.recency_decay(F.col("date"), "2024-12-31"), 8).alias("decay"))


@query("i23_popularity", "SELECT id, round(least(2.0, log10(1 + views) * 0.7), 8) AS popularity FROM posts")
def i23_popularity(spark, d):
    return posts(spark, d).select("id", F.round(C.popularity(F.col("views")), 8).alias("popularity"))


@query("i29_json", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events", with_posts=False)
def i29_json(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


# --- classification -----------------------------------------------------------------------------------------------


def classify_sql(hays: str, tail: str) -> str:
    """``worthy``: the classification of ``hays`` (id, text, links, views, hay, and 1 or 0 in recent)."""
    def listed(words):
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    scores = ", ".join(f"coalesce(list_sum(list_transform(list_filter({listed(w)}, lambda k: contains(hay, k)), lambda k: CASE WHEN length(k) >= 4 THEN 1.6 ELSE 1.0 END)), 0) AS s{i}" for i, w in enumerate(C.CATEGORIES.values()))
    names = list(C.CATEGORIES)
    best = "greatest(" + ", ".join(f"s{i}" for i in range(len(names))) + ")"
    primary = "CASE WHEN top = 0 THEN '其他' " + " ".join(f"WHEN s{i} = top THEN '{n}'" for i, n in enumerate(names)) + " END"
    cats = "list_transform(list_sort(list_filter([" + ", ".join(f"struct_pack(k := -s{i}, i := {i}, n := '{n}')" for i, n in enumerate(names)) + "], lambda x: x.k <= -1.5))[1:4], lambda x: x.n)"
    spam = " + ".join(f"{w} * len(list_filter({listed(words)}, lambda k: contains(hay, k)))" for w, words in C.SPAM.items())
    tags = ", ".join(f"CASE WHEN len(list_filter({listed(words)}, lambda k: contains(hay, k))) > 0 THEN '{t}' END" for t, words in C.TAGS.items())
    worth = "CASE \"primary\" " + " ".join(f"WHEN '{n}' THEN {w}" for n, w in C.WORTH.items()) + " ELSE 0 END"
    has = lambda t: f"list_contains(tags, '{t}')::INT"
    hits = " || ".join(f"list_filter({listed(words)}, lambda k: contains(hay, k))" for words in C.SPAM.values())
    return f"""hays AS ({hays}), scored AS (SELECT *, {scores} FROM hays), topped AS (SELECT *, {best} AS top FROM scored),
    marked AS (SELECT *, {primary} AS "primary", {cats} AS cats, list_filter([{tags}], lambda t: t IS NOT NULL) AS tags, {spam} AS spam_words, {hits} AS hits FROM topped),
    valued AS (SELECT *, {worth} + {has("免费")} + 0.5 * {has("限时")} + 0.5 * {has("教程")} + 0.5 * {has("开源")} + (len(list_filter(links, lambda u: contains(u, 'github.com'))) > 0)::INT - 3 * {has("风险")} - 2 * (length(text) < 8 AND len(links) = 0)::INT AS content,
      spam_words + 2 * (length(text) < 12 AND len(links) > 0 AND NOT list_contains(tags, '免费'))::INT AS spam FROM marked),
    worthy AS (SELECT id, "primary", CASE WHEN len(cats) > 0 THEN cats ELSE ['其他'] END AS cats, tags, regexp_extract_all(text, '#([A-Za-z0-9_一-龥]{{1,24}})', 1) AS hashtags, CAST(spam AS DOUBLE) AS spam, hits AS spam_hits, CAST(content AS DOUBLE) AS content,
      CAST(round(content + least(2.0, log10(1 + coalesce(views, 0)) * 0.7) + 0.5 * recent, 2) AS DOUBLE) AS value, links, text,
      list_sort(list_distinct(list_transform(links, lambda u: regexp_replace(lower(regexp_extract(u, '://([^/?#:]+)', 1)), '^www\\.', '')))) AS domains FROM valued) {tail}"""


#: Previews of every second post, some of whose words tell; a time from which posts of half a year are recent.
PREVIEW_WORDS, AS_OF = ("限时 教程", "GitHub", "", "博彩 平台", "广告位"), 1725148800
PREVIEW_SQL = f"CASE WHEN id % 2 = 0 THEN lower([{', '.join(f"'{w}'" for w in PREVIEW_WORDS)}][id % 5 + 1] || ' ' || coalesce(channel, '')) ELSE '' END"


def previewed(rows: DataFrame) -> DataFrame:
    """Posts as raw messages, with previews."""
    n = F.col("id")
    words = F.array(*map(F.lit, PREVIEW_WORDS))[(n % 5).cast("int")]
    own = F.array(F.struct(F.concat(F.lit("https://www.example.org/p/"), (n % 5).cast("string")).alias("u"), F.col("channel").alias("s"), words.alias("t")))
    return rows.select("id", "channel", "msg_id", F.col("text").alias("t"), F.col("links").alias("lk"), F.when(n % 2 == 0, own).alias("lp"), F.col("views").alias("v"), "ts")


HAYS_SQL = f"SELECT id, channel, msg_id, text, CASE WHEN id % 2 = 0 THEN list_append(links, 'https://www.example.org/p/' || (id % 5)) ELSE links END AS links, views, lower(text) || ' ' || {PREVIEW_SQL} AS hay, (({AS_OF} - ts) < 180 * 86400)::INT AS recent FROM posts"


@query("j6_classify", ", " + classify_sql(HAYS_SQL, """SELECT id, "primary", array_to_string(cats, ',') AS cats, array_to_string(tags, ',') AS tags, array_to_string(hashtags, ',') AS hashtags, spam, array_to_string(spam_hits, ',') AS spam_hits, content, value, array_to_string(links, ' ') AS links, array_to_string(domains, ' ') AS domains FROM worthy"""))
def j6_classify(spark, d):
    out = C.classify(previewed(posts(spark, d)), AS_OF)
    shown = ("cats", "tags", "hashtags", "spam_hits")
    return out.select("id", "primary", "spam", "content", "value", *(F.array_join(c, ",").alias(c) for c in shown), F.array_join("links", " ").alias("links"), F.array_join(F.array_sort("domains"), " ").alias("domains"))


@query("e15_build_stats", ", " + classify_sql(HAYS_SQL, """, spamming AS (SELECT p.id, p.channel, p.msg_id % 700 AS key, p.text, w.spam >= 4 OR (w.spam >= 3 AND length(p.text) < 80) AS is_spam FROM posts p JOIN worthy w ON p.id = w.id),
firsts AS (SELECT *, row_number() OVER (PARTITION BY channel, key ORDER BY id) > 1 AS dup_id FROM spamming),
texts AS (SELECT *, dup_id = FALSE AND length(text) > 25 AND row_number() OVER (PARTITION BY text, dup_id ORDER BY id) > 1 AS dup_text FROM firsts)
SELECT channel, count(*) AS raw, count(*) FILTER (dup_id) AS dup_id, count(*) FILTER (NOT dup_id AND dup_text) AS dup_text, count(*) FILTER (NOT dup_id AND NOT dup_text AND is_spam) AS spam,
  count(*) FILTER (NOT dup_id AND NOT dup_text AND NOT is_spam) AS clean FROM texts GROUP BY channel"""))
def e15_build_stats(spark, d):
    rows = C.classify(previewed(posts(spark, d)), AS_OF).withColumn("msg_id", F.col("msg_id") % 700)
    return dedup.build_stats(dedup.dispositions(rows, [F.col("id")]))


# --- search and retrieval -----------------------------------------------------------------------------------------


def _bm25_sql(phrases: list[list[str]], tail: str) -> str:
    tf = lambda p: "8.0 * len(list_filter(range(1, len(t) + 1), lambda i: " + " AND ".join(f"t[i + {k}] = '{w}'" for k, w in enumerate(p)) + "))"
    tfs = ", ".join(f"{tf(p)} AS tf{i}" for i, p in enumerate(phrases))
    dfs = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(phrases)))
    part = " ".join(f"- greatest(1e-6, ln((n - df{i} + 0.5) / (df{i} + 0.5))) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / mean))" for i in range(len(phrases)))
    hit = " AND ".join(f"tf{i} > 0" for i in range(len(phrases)))
    return f""", words AS (SELECT *, {TOKENS_SQL.format("text")} AS t FROM clustered), counted AS (SELECT *, len(t) + 2 * len(tags) + 2 * len(domains) + 1 AS dl, {tfs} FROM words),
    facts AS (SELECT count(*) AS n, avg(dl) AS mean, {dfs} FROM counted), ranked AS (SELECT *, 0.0 {part} AS rank FROM counted, facts WHERE {hit}) {tail}"""


@query("j3_bm25", _bm25_sql([["the", "of"], ["and"]], "SELECT id, round(rank, 6) AS rank FROM ranked"), clustered=True)
def j3_bm25(spark, d):
    rows = search.bm25(stored_posts(spark, d), [["the", "of"], ["and"]], index=stored(spark, d).index())
    return rows.select("id", F.round("rank", 6).alias("rank"))


@query("j3_bm25_fields", r""", counted AS (
  SELECT id, len(t) + 2 * len(tags) + 2 * len(domains) + 1 AS dl, 8.0 * len(list_filter(t, lambda x: x = 'example')) + 2.0 * list_contains(domains, 'example.com')::INT AS tf0,
    8.0 * len(list_filter(t, lambda x: x = 'src1')) + (channel = 'src1')::INT AS tf1,
    8.0 * len(list_filter(range(1, len(t) + 1), lambda i: t[i] = '免' AND t[i + 1] = '费')) + 3.0 * list_contains(tags, '免费')::INT AS tf2
  FROM (SELECT *, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM posts)),
facts AS (SELECT count(*) AS n, avg(dl) AS mean, count(*) FILTER (tf0 > 0) AS df0, count(*) FILTER (tf1 > 0) AS df1, count(*) FILTER (tf2 > 0) AS df2 FROM counted)
SELECT id, round(- greatest(1e-6, ln((n - df0 + 0.5) / (df0 + 0.5))) * tf0 * 2.2 / (tf0 + 1.2 * (0.25 + 0.75 * dl / mean)) - greatest(1e-6, ln((n - df1 + 0.5) / (df1 + 0.5))) * tf1 * 2.2 / (tf1 + 1.2 * (0.25 + 0.75 * dl / mean))
  - greatest(1e-6, ln((n - df2 + 0.5) / (df2 + 0.5))) * tf2 * 2.2 / (tf2 + 1.2 * (0.25 + 0.75 * dl / mean)), 6) AS rank FROM counted, facts WHERE tf0 > 0 OR tf1 > 0 OR tf2 > 0""")
def j3_bm25_fields(spark, d):
    return index.ranked(stored(spark, d).index(), [["example"], ["src1"], ["免", "费"]], every=False).select("id", F.round("rank", 6).alias("rank"))


@query("b3_index", r"""SELECT term, field, count(*) AS posts, CAST(sum(n) AS BIGINT) AS places FROM (
  SELECT id, field, term, count(*) AS n FROM (
    SELECT id, 'text' AS field, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM posts
    UNION ALL SELECT id, 'channel', channel FROM posts UNION ALL SELECT id, 'domains', unnest(string_split(domains[1], '.')) FROM posts WHERE len(domains) > 0
    UNION ALL SELECT id, 'tags', unnest(string_split(array_to_string(tags, ''), '')) FROM posts WHERE len(tags) > 0) GROUP BY 1, 2, 3)
GROUP BY term, field""")
def b3_index(spark, d):
    rows = stored(spark, d).index().postings
    return rows.groupBy("term", "field").agg(F.count("*").alias("posts"), F.sum("n").cast("long").alias("places"))


@query("b1_store_build", """, words AS (SELECT *, {0} AS t FROM clustered) SELECT count(*) AS posts, CAST(sum(len(t) + 2 * len(tags) + 2 * len(domains) + 1) AS BIGINT) AS words, count(*) FILTER (is_rep) AS visible FROM words""".replace("{0}", TOKENS_SQL.format("text")), clustered=True)
def b1_store_build(spark, d):
    store = stored(spark, d)
    facts = store.versions.current().facts
    return store.totals().select(F.lit(facts["posts"]).cast("long").alias("posts"), F.lit(facts["words"]).cast("long").alias("words"), "visible")


@query("j10_search", _bm25_sql([["the"], ["and"]], "SELECT id, round(rank - 0.5 * value, 6) AS score FROM ranked WHERE is_rep AND value >= 2 ORDER BY rank - 0.5 * value, id LIMIT 30"), clustered=True)
def j10_search(spark, d):
    found = search.search(stored_posts(spark, d), "The, and!", search.Filters(min_value=2), index=stored(spark, d).index())
    return found.items.select("id", F.round(F.col("rank") - 0.5 * F.col("value"), 6).alias("score"))


@query("j5_clustering", "SELECT cluster_key, min(rep_id) AS rep_id, max(cluster_size) AS cluster_size, count(*) AS n FROM clustered WHERE cluster_key IS NOT NULL GROUP BY cluster_key", clustered=True)
def j5_clustering(spark, d):
    rows = clustered_posts(spark, d).where("cluster_key is not null")
    return rows.groupBy("cluster_key").agg(F.min("rep_id").alias("rep_id"), F.max("cluster_size").alias("cluster_size"), F.count("*").alias("n"))


def _questions_sql(questions: str, tail: str) -> str:
    """Questions (question, text) of lower-case words: the searches of each, their hits, scores and ranks."""
    return f""", words AS (SELECT *, {TOKENS_SQL.format("text")} AS t FROM clustered), sized AS (SELECT *, len(t) + 2 * len(tags) + 2 * len(domains) + 1 AS dl FROM words), facts AS (SELECT count(*) AS n, avg(dl) AS mean FROM sized),
    questions AS ({questions}), asked AS (SELECT question, list_filter(regexp_split_to_array(trim(regexp_replace(text, '[?]', ' ', 'g')), '\\s+'), lambda x: x <> '') AS w FROM questions),
    uses AS (SELECT question, 'whole' AS key, 1.4 AS weight, 12 AS hits, FALSE AS damped, unnest(w) AS term FROM asked UNION ALL
      SELECT DISTINCT question, 't:' || term, 1.0, 8, TRUE, term FROM (SELECT question, unnest(list_filter(w, lambda x: length(x) >= 2)[1:6]) AS term FROM asked)),
    parts AS (SELECT question, key, count(*) AS parts FROM uses GROUP BY 1, 2),
    tok AS (SELECT id, 8.0 AS w, unnest(t) AS term FROM sized UNION ALL SELECT id, 2.0, unnest(string_split(domains[1], '.')) FROM sized WHERE len(domains) > 0 UNION ALL SELECT id, 1.0, channel FROM sized),
    tf AS (SELECT id, term, CAST(sum(w) AS DOUBLE) AS tf FROM tok WHERE term IN (SELECT term FROM uses) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    found AS (SELECT question, key, weight, hits, damped, s.id, sum(-greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) - 0.5 * any_value(value) AS rank, count(*) AS there
      FROM uses JOIN tf USING (term) JOIN df USING (term) JOIN sized s ON s.id = tf.id, facts WHERE is_rep GROUP BY 1, 2, 3, 4, 5, 6),
    hit AS (SELECT f.*, count(*) OVER (PARTITION BY f.question, f.key) AS total, row_number() OVER (PARTITION BY f.question, f.key ORDER BY round(rank, 9), id) AS place FROM found f JOIN parts p ON f.question = p.question AND f.key = p.key AND f.there = p.parts),
    tops AS (SELECT question, id, max(weight * CASE WHEN damped AND total > 200 THEN 1 / (1 + log10(total / 200.0) * 0.8) ELSE 1.0 END) AS w, count(*) AS keys FROM hit WHERE place <= hits GROUP BY 1, 2),
    scored AS (SELECT question, s.id, round(w * (1 + keys * 0.7 - 0.7) * (1 + value / 4) * CASE WHEN date > '2026-04' THEN 1.18 ELSE 1 END * CASE WHEN list_contains(tags, '免费') OR list_contains(tags, '限时') THEN 1.3 ELSE 1 END * CASE WHEN len(links) > 0 THEN 1.15 ELSE 1 END
      * CASE WHEN list_contains(tags, '风险') THEN 0.5 ELSE 1 END * CASE WHEN regexp_matches(substr(text, 1, 80), '\\?$') THEN 0.6 ELSE 1 END * CASE WHEN length(text) < 45 THEN 0.55 ELSE 1 END, 9) AS score FROM tops JOIN sized s ON s.id = tops.id),
    answers AS (SELECT question, id, score, CAST(row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS INTEGER) AS rank FROM scored) {tail}"""


@query("j11_keyword_rank", _questions_sql("SELECT 0 AS question, 'the onwh of and tion?' AS text", "SELECT id, round(score, 6) AS score, rank FROM answers WHERE rank <= 40"), clustered=True)
def j11_keyword_rank(spark, d):
    found = hybrid.keyword_rank(stored_posts(spark, d), "the onwh of and tion?", index=stored(spark, d).index())
    return found.select("id", F.round("score", 6).alias("score"), "rank")


#: Questions: the first eight plain words of each passage of the benchmark.
ASKED_SQL = "SELECT CAST(item_id AS BIGINT) AS question, array_to_string(list_filter(string_split(text, ' '), lambda x: regexp_full_match(x, '[a-z]{2,}'))[1:8], ' ') AS text FROM benchmark"


def asked(spark, d):
    words = F.slice(F.filter(F.split("text", " "), lambda x: x.rlike("^[a-z]{2,}$")), 1, 8)
    return table(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("question"), F.array_join(words, " ").alias("text"))


@query("j27_questions", _questions_sql(ASKED_SQL, "SELECT question, id, round(score, 6) AS score, rank FROM answers WHERE rank <= 10"), clustered=True)
def j27_questions(spark, d):
    found = hybrid.keyword_ranks(stored_posts(spark, d), asked(spark, d), stored(spark, d).index(), limit=10)
    return found.select("question", "id", F.round("score", 6).alias("score"), "rank")


@query("j27_gate", _questions_sql(ASKED_SQL, """, expected AS (SELECT CAST(b.item_id AS BIGINT) AS question, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text) JOIN clustered c ON c.id = d.doc_id AND c.is_rep),
    best AS (SELECT e.question, min(a.rank) AS rank FROM expected e LEFT JOIN answers a ON a.question = e.question AND a.id = e.id AND a.rank <= 40 GROUP BY 1)
    SELECT count(*) AS queries, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 8) AS hit_at_k, round(avg(coalesce(1.0 / rank, 0)), 8) AS mrr, avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END) >= 0.91 - 0.01 AND avg(coalesce(1.0 / rank, 0)) >= 0.704 - 0.02 AS passed FROM best"""), clustered=True)
def j27_gate(spark, d):
    """The benchmark's passages as labelled questions: any visible document that holds the passage is right."""
    rows = stored_posts(spark, d)
    ranked = hybrid.keyword_ranks(rows, asked(spark, d), stored(spark, d).index(), limit=40)
    right = facets.containing(table(spark, d, "documents"), table(spark, d, "benchmark")).select(F.col("item_id").cast("long").alias("question"), F.col("doc_id").alias("id")).distinct()
    return facets.gate(ranked, right.join(rows.where("is_rep").select("id"), "id", "left_semi")).select("queries", F.round("hit_at_k", 8).alias("hit_at_k"), F.round("mrr", 8).alias("mrr"), "passed")


@query("j12_fusion", """, a AS (SELECT id, row_number() OVER (ORDER BY value DESC, id) AS rank FROM posts), b AS (SELECT id, row_number() OVER (ORDER BY views DESC, id) AS rank FROM posts),
lists AS (SELECT id, rank FROM a WHERE rank <= 100 UNION ALL SELECT id, rank FROM b WHERE rank <= 100) SELECT id, round(sum(1.0 / (60 + rank)), 8) AS score FROM lists GROUP BY id""")
def j12_fusion(spark, d):
    p = posts(spark, d)
    ranked = lambda c: p.select("id", c).orderBy(F.desc(c), "id").limit(100).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(c), "id")))
    return hybrid.fuse([ranked("value"), ranked("views")]).select("id", F.round("score", 8).alias("score"))


QUANT_SQL = """
v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS l FROM v),
q AS (SELECT id, list_transform(e, lambda x: CAST(greatest(-127, least(127, floor(x / l * 127 + 0.5))) AS INTEGER)) AS vec FROM n),
m AS (SELECT id, vec, sqrt(CAST(list_sum(list_transform(vec, lambda x: x * x)) AS DOUBLE)) AS norm FROM q)
"""


@query("j14_retrieve", _questions_sql("SELECT 0 AS question, 'the onwh and' AS text", f""", {QUANT_SQL}, near AS (SELECT m.id, row_number() OVER (ORDER BY list_sum(list_transform(list_zip(m.vec, r.vec), lambda p: p[1] * p[2])) / (m.norm * r.norm) DESC, m.id) AS rank
  FROM m JOIN clustered c ON c.id = m.id AND c.is_rep, (SELECT * FROM m WHERE id = 7) r),
  lists AS (SELECT id, rank, 0 AS list FROM answers WHERE rank <= 42 UNION ALL SELECT id, rank, 1 FROM near WHERE rank <= 42), fused AS (SELECT id, round(sum(1.0 / (60 + rank)), 12) AS score, min(list * 1000 + rank) AS first FROM lists GROUP BY id)
  SELECT id, CAST(row_number() OVER (ORDER BY score DESC, first, id) AS INTEGER) AS rank FROM fused ORDER BY rank LIMIT 14"""), clustered=True)
def j14_retrieve(spark, d):
    items = vectors.encode(table(spark, d, "embeddings"), id_col="vec_id")
    q = items.where("id = 7").first()
    return hybrid.retrieve(stored_posts(spark, d), "the onwh and", items, q["vec"], q["norm"], k=14, index=stored(spark, d).index()).select("id", "rank")


@query("j15_codec", f"WITH {QUANT_SQL} SELECT id, round(norm, 6) AS norm, array_to_string(vec, ',') AS vec FROM m", with_posts=False)
def j15_codec(spark, d):
    items = vectors.encode(table(spark, d, "embeddings"), id_col="vec_id")
    return items.select("id", F.round("norm", 6).alias("norm"), F.array_join(F.col("vec").cast("array<string>"), ",").alias("vec"))


@query("j16_vector_top_k", f"WITH {QUANT_SQL} SELECT m.id, round(list_sum(list_transform(list_zip(m.vec, r.vec), lambda p: p[1] * p[2])) / (m.norm * r.norm), 6) AS score FROM m, (SELECT * FROM m WHERE id = 7) r ORDER BY list_sum(list_transform(list_zip(m.vec, r.vec), lambda p: p[1] * p[2])) / (m.norm * r.norm) DESC, m.id LIMIT 50", with_posts=False)
def j16_vector_top_k(spark, d):
    q = vectors.encode(table(spark, d, "embeddings").where("vec_id = 7"), id_col="vec_id").first()
    return vectors.nearest_in(stored_blocks(spark, d), [(7, q["vec"], q["norm"])], 50).select("id", F.round("score", 6).alias("score"))


@query("j17_similar", f"WITH {QUANT_SQL} SELECT m.id FROM m, (SELECT * FROM m WHERE id = 11) r WHERE m.id <> 11 ORDER BY list_sum(list_transform(list_zip(m.vec, r.vec), lambda p: p[1] * p[2])) / (m.norm * r.norm) DESC, m.id LIMIT 8", with_posts=False)
def j17_similar(spark, d):
    return vectors.nearest_to(vectors.encode(table(spark, d, "embeddings"), id_col="vec_id"), 11).select("id")


@query("j18_related", f""", words AS (SELECT *, {TOKENS_SQL.format("text")} AS t FROM posts), sized AS (SELECT *, len(t) + 2 * len(tags) + 2 * len(domains) + 1 AS dl FROM words), facts AS (SELECT count(*) AS n, avg(dl) AS mean FROM sized),
keys AS (SELECT lower(unnest(list_distinct(regexp_extract_all(text, '([A-Za-z][A-Za-z0-9_.-]{{2,}})', 1)[1:6]))) AS k FROM posts WHERE id = 3), phrases AS (SELECT k, list_filter(regexp_split_to_array(k, '[^a-z0-9]+'), lambda x: x <> '') AS p FROM keys),
tf AS (SELECT k, id, dl, 8.0 * CASE WHEN len(p) = 1 THEN len(list_filter(t, lambda x: x = p[1])) ELSE len(list_filter(range(1, len(t) + 1), lambda i: t[i:i + len(p) - 1] = p)) END + 2.0 * CASE WHEN len(p) = 1 AND len(domains) > 0 THEN len(list_filter(string_split(domains[1], '.'), lambda x: x = p[1])) ELSE 0 END + 1.0 * (len(p) = 1 AND channel = p[1])::INT AS tf FROM phrases, sized),
df AS (SELECT k, count(*) AS df FROM tf WHERE tf > 0 GROUP BY k)
SELECT id, round(sum(-greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS rank FROM tf JOIN df USING (k), facts WHERE tf > 0 AND id <> 3 GROUP BY id ORDER BY rank, id LIMIT 8""")
def j18_related(spark, d):
    return search.related(stored_posts(spark, d), 3, index=stored(spark, d).index()).select("id", F.round("rank", 6).alias("rank"))


@query("j22_digest", "SELECT id, value FROM clustered WHERE is_rep AND list_contains(tags, '免费') AND date >= '2024-11-01' AND value >= 6 AND id % 3 <> 0 ORDER BY value DESC, id LIMIT 12", clustered=True)
def j22_digest(spark, d):
    rows = stored_posts(spark, d)
    return overlays.digest(rows, rows.where("id % 3 = 0").select("id"), ["免费"], "2024-12-01", days=30).select("id", "value")


@query("j23_subscriptions", f""", words AS (SELECT *, {TOKENS_SQL.format("text")} AS t FROM clustered WHERE is_rep AND ts > 1710000000),
hits AS (SELECT 1 AS subscription, id FROM words WHERE list_contains(t, 'onwh') UNION ALL SELECT 2, id FROM words WHERE list_contains(t, 'the') AND list_contains(tags, '限时') AND value >= 5)
SELECT CAST(subscription AS BIGINT) AS subscription, count(*) AS total, array_to_string(list(h.id ORDER BY date DESC, ts DESC, h.id)[1:5], ',') AS ids FROM hits h JOIN posts p ON p.id = h.id GROUP BY subscription""", clustered=True)
def j23_subscriptions(spark, d):
    subs = spark.createDataFrame([(1, "onwh", [], 0.0, True), (2, "the", ["限时"], 5.0, True), (3, "of", [], 0.0, False)], "id long, keyword string, tags array<string>, min_value double, enabled boolean")
    return overlays.subscription_hits(stored_posts(spark, d), subs, 1710000000, index=stored(spark, d).index()).select("subscription", "total", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("j23_many", f""", words AS (SELECT *, {TOKENS_SQL.format("text")} AS t FROM clustered), subs AS (SELECT id AS subscription, list_filter(string_split(text, ' '), lambda x: regexp_full_match(x, '[a-z]{{4,}}'))[2:3] AS w, tags[1:1] AS tags, id % 5 AS least FROM posts WHERE id % 4 = 0),
hits AS (SELECT s.subscription, c.id, c.date, c.ts FROM subs s JOIN words c ON is_rep AND ts > 1704067200 AND value >= least AND len(list_filter(s.w, lambda x: NOT list_contains(t, x))) = 0 AND len(list_filter(s.tags, lambda x: NOT list_contains(c.tags, x))) = 0)
SELECT subscription, count(*) AS total, array_to_string(list(id ORDER BY date DESC, ts DESC, id)[1:5], ',') AS ids FROM hits GROUP BY 1""", clustered=True)
def j23_many(spark, d):
    """A subscription of every fourth post: two of its words, one of its tags."""
    words = F.slice(F.filter(F.split("text", " "), lambda x: x.rlike(r"^[a-z]{4,}\z")), 2, 2)
    subs = stored_posts(spark, d).where("id % 4 = 0").select("id", F.array_join(words, " ").alias("keyword"), F.slice("tags", 1, 1).alias("tags"), (F.col("id") % 5).alias("min_value"), F.lit(True).alias("enabled"))
    return overlays.subscription_hits(stored_posts(spark, d), subs, 1704067200, index=stored(spark, d).index()).select("subscription", "total", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("j25_last_turns", "SELECT conv_id, turn, role, substr(text, 1, 4000) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS p FROM conversations WHERE role IN ('user', 'assistant')) WHERE p <= 6", with_posts=False)
def j25_last_turns(spark, d):
    return hybrid.last_turns(table(spark, d, "conversations"))


# --- reports, streams ---------------------------------------------------------------------------------------------


@query("o5_badges", "SELECT id, array_to_string(list_filter(['免费', '限时', '风险', '开源'], lambda x: list_contains(tags, x))[1:3], '/') AS badges FROM posts")
def o5_badges(spark, d):
    return reports.badges(posts(spark, d)).select("id", F.array_join("badges", "/").alias("badges"))


FLAT_SQL = r"trim(regexp_replace(text, '[\s\x{0b}]+', ' ', 'g'))"
ONE_LINE_SQL = "(CASE WHEN length(flat) > {n} THEN substr(flat, 1, {n}) || '…' ELSE flat END)"


@query("b6_csv_rows", f"SELECT id, date, channel, category, CAST(value AS VARCHAR) AS value, CAST(views AS VARCHAR) AS views, array_to_string(tags, ',') AS tags, {ONE_LINE_SQL.format(n=500)} AS text, array_to_string(links, ' ') AS links FROM (SELECT *, {FLAT_SQL} AS flat FROM posts)")
def b6_csv_rows(spark, d):
    return reports.csv_rows(posts(spark, d)).select("id", "date", "channel", "category", "value", "views", "tags", "text", "links")


@query("b8_dashboard", f"SELECT id, to_json([CAST(id AS VARCHAR), date, coalesce(channel, ''), coalesce(category, ''), CAST(value AS VARCHAR), coalesce(CAST(views AS VARCHAR), ''), {ONE_LINE_SQL.format(n=120)}])::VARCHAR AS json FROM (SELECT *, {FLAT_SQL} AS flat FROM posts WHERE value >= 2 AND content >= 2 AND length(text) >= 10 ORDER BY value DESC, id LIMIT 30000)")
def b8_dashboard(spark, d):
    return reports.dashboard(posts(spark, d))


@query("k5_new_since", "SELECT event_id FROM events WHERE epoch_us(ts) > (SELECT min(epoch_us(ts)) + 86400000000 FROM events)", with_posts=False)
def k5_new_since(spark, d):
    events = table(spark, d, "events")
    least = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0] or 0
    return ingest.new_since(events.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts")), least + 86400000000).select("event_id")


@query("k_event_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2", with_posts=False)
def k_event_counts(spark, d):
    return ingest.event_counts(table(spark, d, "events")).withColumn("total", F.round("total", 3))


@query("b16_last_writer", "SELECT user_id, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS event_id FROM events GROUP BY user_id", with_posts=False)
def b16_last_writer(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"))
    return dedup.last_writer(rows, ["user_id"], "at").select("user_id", "event_id")


from . import runs  # noqa: E402, F401  registers more queries with the decorator above
