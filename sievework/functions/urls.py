"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query names that track, how others begin, search paths and names, hosts that aren't content.
TRACKING = (
    "si", "ref", "from", "spm", "share_source", "share_medium", "share_plat", "share_session_id", "share_tag", "timestamp", "unique_k", "vd_source",
    "feature", "src", "source", "fbclid", "gclid", "yclid", "igshid", "mc_cid", "mc_eid", "_ga", "ref_src", "ref_url",
)
TRACKING_START = r"(?i)^(utm_|share_|spm_|_hs|pk_)"
SEARCH_PATH = r"(?i)/(search|query|so|s)(/|$)"
SEARCH_NAME = r"(?i)^(q|query|keyword|kw|wd|search|word)$"
NOISE_HOST = r"(?i)telegram\.org|telesco\.pe|cdn.*telegram"
OWN_POST = r"(?i)^https?://t\.me/"
PROFILE = r"(?i)^https?://t\.me/[^/]+/?$"
TOPIC = r"linux\.do/t/(?:[^/]+/)?(\d+)"
PARTS = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::\d*)?([^?#]*)(?:\?([^#]*))?"


def absolute(u: Column) -> Column:
    return F.when(F.startswith(u, F.lit("//")), F.concat(F.lit("https:"), u)).otherwise(u)


def host_of(u: Column) -> Column:
    """Lower-case host; null for what isn't a URL."""
    return F.nullif(F.lower(F.regexp_extract(absolute(u), PARTS, 1)), F.lit(""))


def domain_of(u: Column) -> Column:
    """The host without a leading ``www.``."""
    return F.regexp_replace(host_of(u), r"^www\.", "")


def query_pairs(u: Column) -> Column:
    """array<struct<k, v>> of a URL's decoded query."""
    raw = F.filter(F.split(F.regexp_extract(absolute(u), PARTS, 3), "&"), lambda p: p != "")
    plain = lambda c: F.coalesce(F.try_url_decode(c), c)
    return F.transform(raw, lambda p: F.struct(plain(F.substring_index(p, "=", 1)).alias("k"), F.when(F.contains(p, F.lit("=")), plain(F.substring(p, F.instr(p, "=") + 1, F.length(p)))).otherwise("").alias("v")))


def normalize_url(u: Column) -> Column:
    """Host, path and the query that says what the page is; null for search pages and for pages of no own path."""
    host, path = domain_of(u), F.regexp_extract(absolute(u), PARTS, 2)
    pairs = query_pairs(u)
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING) & ~p["k"].rlike(TRACKING_START))
    query = F.array_join(F.array_sort(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"]))), "&")
    short = F.lower(F.regexp_replace(path, "/+$", ""))
    segments = F.size(F.filter(F.split(short, "/"), lambda s: s != ""))
    searches = path.rlike(SEARCH_PATH) | F.exists(pairs, lambda p: p["k"].rlike(SEARCH_NAME))
    whole = F.concat(host, short, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(host.isNotNull() & ~searches & ((segments >= 2) | (F.size(kept) > 0)), whole)


def cluster_key(links: Column) -> Column:
    """``topic:<id>`` for links to exactly one forum topic, null for several; else ``link:`` and the first content page."""
    links = F.filter(F.coalesce(links, F.array().cast("array<string>")), lambda u: u.isNotNull() & (u != ""))
    topics = F.array_distinct(F.filter(F.transform(links, lambda u: F.regexp_extract(u, TOPIC, 1)), lambda t: t != ""))
    pages = F.filter(links, lambda u: ~u.rlike(OWN_POST) & ~u.rlike(NOISE_HOST))
    first = F.filter(F.transform(pages, normalize_url), lambda n: n.isNotNull())
    return F.when(F.size(topics) == 1, F.concat(F.lit("topic:"), topics[0])).when(F.size(topics) == 0, F.concat(F.lit("link:"), F.try_element_at(first, F.lit(1))))


def is_profile_link(u: Column) -> Column:
    return u.rlike(PROFILE)


def parse_link(text: Column) -> Column:
    """struct<kind, username, msg_id, url, host> of a pasted link: tme, invite, private or web; null for other text."""
    raw = F.trim(text)
    handle = F.regexp_extract(raw, "^@([A-Za-z][A-Za-z0-9_]{3,31})$", 1)
    rest = F.regexp_extract(raw, r"(?i)^(?:https?://)?(?:www\.)?(?:t\.me|telegram\.me|telegram\.dog)/(.+)$", 1)
    parts = F.split(F.regexp_replace(F.regexp_replace(rest, "(?i)^s/", ""), "/+$", ""), "/")
    name = parts[0]
    number = F.when(F.try_element_at(parts, F.lit(2)).rlike(r"^\d+$"), F.try_element_at(parts, F.lit(2)).try_cast("long"))
    made = lambda kind, user, msg, url, host: F.struct(F.lit(kind).alias("kind"), user.alias("username"), msg.cast("long").alias("msg_id"), url.alias("url"), host.cast("string").alias("host"))
    none, empty = F.lit(None), F.lit("")
    return (
        F.when(handle != "", made("tme", handle, none, F.concat(F.lit("https://t.me/"), handle), none))
        .when((rest != "") & name.rlike(r"(?i)^\+|^joinchat$"), made("invite", empty, none, raw, none))
        .when((rest != "") & (F.lower(name) == "c"), made("private", empty, none, raw, none))
        .when(rest != "", made("tme", name, number, F.concat(F.lit("https://t.me/"), name), none))
        .when(raw.rlike("(?i)^https?://") & host_of(raw).isNotNull(), made("web", empty, none, raw, host_of(raw)))
    )


def links_in(text: Column, marked: Column | None = None, most: int = 12) -> Column:
    """Links of a group's message: marked ones first, then those written out; distinct, ``most`` at most."""
    plain = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(https?://[^\\s<>\"'）)】]+)"), 1)
    given = F.filter(F.coalesce(marked, F.array().cast("array<string>")), lambda u: u.rlike("(?i)^https?:")) if marked is not None else F.array().cast("array<string>")
    return F.slice(F.array_distinct(F.concat(given, plain)), 1, most)
