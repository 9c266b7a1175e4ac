"""Imports of pages and channels, and the stream of numbered updates, on small tables."""

import json

from pyspark.sql import functions as F

from sievework.functions import display
from sievework.sources import imports

MESSAGE = "channel string, i long, d string, ts long, v long, t string, lp array<struct<u:string,s:string,t:string>>, lk array<string>"


def updates_from(offset):
    """Stands in for a service: seven updates, three at a time."""
    return [(i, f'{{"update_id": {i}}}') for i in range(10, 17) if i >= offset][:3]


def test_web_posts(spark):
    pages = spark.createDataFrame([("https://A.example.com/x", "<title>One &amp; two</title><p>hello</p>"), ("https://b.example.com/", "<p>bare</p>"), ("https://c.example.com/", None), (None, "<p>x</p>")], "url string, html string")
    rows = {r["url"]: r for r in imports.web_posts(pages, 86400).collect()}
    assert set(rows) == {"https://A.example.com/x", "https://b.example.com/"}
    one, bare = rows["https://A.example.com/x"], rows["https://b.example.com/"]
    assert (one["channel"], one["group_title"], one["date"], one["ts"], one["source"]) == ("web_a.example.com", "One & two", "1970-01-02", 86400, "web")
    assert bare["group_title"] == "b.example.com" and bare["links"] == "https://b.example.com/" and "bare" in bare["text"]
    assert one["msg_id"] != bare["msg_id"] and all(0 <= r["msg_id"] < 1 << 60 for r in rows.values())
    assert sorted(rows.values()) == sorted(imports.web_posts(pages, 86400).collect())
    assert imports.web_posts(pages.limit(0), 1).count() == 0


def test_pages_of_one_host_have_numbers_of_their_own(spark):
    urls = spark.range(200_000).select(F.concat(F.lit("https://example.com/page/"), "id").alias("url"))
    assert urls.select(imports.page_number(F.col("url")).alias("n")).distinct().count() == 200_000


def test_channel_posts_reads_the_newest(spark):
    data = [("a", i, "2024-05-06T07:08:09+00:00", 5, 1, f"text {i}", None, None) for i in range(1, 9)]
    data += [("b", 1, None, None, None, None, None, None), ("b", 2, None, None, None, " ", None, ["https://example.org/a"]), ("b", 3, None, None, None, "z", [("https://example.net/q", "s", "t")], [])]
    rows = imports.channel_posts(spark.createDataFrame(data, MESSAGE), most=3).orderBy("channel", "msg_id").collect()
    assert [(r["channel"], r["msg_id"]) for r in rows] == [("a", 6), ("a", 7), ("a", 8), ("b", 2), ("b", 3)]
    assert rows[0]["url"] == "https://t.me/a/6" and rows[0]["date"] == "2024-05-06" and rows[3]["date"] == "" and rows[3]["ts"] == 0
    assert rows[3]["links"] == "https://example.org/a" and rows[4]["links"] == "https://example.net/q" and rows[4]["domains"] == "example.net"


def test_updates_come_once_over_restarts(spark, tmp_path):
    spark.dataSource.register(imports.Updates)
    out, seen = str(tmp_path / "out"), []
    for _ in range(2):
        stream = spark.readStream.format("numbered_updates").option("fetcher", "tests.test_imports:updates_from").load()
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).start(out)
        query.processAllAvailable()
        query.stop()
        seen.append([r["update_id"] for r in spark.read.parquet(out).orderBy("update_id").select(F.col("update_id")).collect()])
    assert seen == [list(range(10, 17))] * 2


def test_group_posts(spark):
    chat = {"id": -5, "type": "supergroup", "title": "T"}
    person = {"is_bot": False, "first_name": "A", "last_name": "B"}
    told = lambda **m: (json.dumps({"update_id": 1, "message": {"message_id": 7, "date": 86400, "chat": chat, "from": person, **m}}),)
    url = {"type": "text_link", "offset": 0, "length": 4, "url": "https://example.net/z"}
    data = [
        told(text="look at https://example.org/a now", entities=[url]), told(text="short"), told(text="/start with me"), told(text="from a machine", **{"from": {"is_bot": True}}),
        told(caption="a caption of a picture", chat={**chat, "username": "room"}, message_id=8, **{"from": {"username": "u"}}), told(text="a private message", chat={**chat, "type": "private"}), ("no json",), (None,)]
    one, two = imports.group_posts(spark.createDataFrame(data, "json string")).orderBy("msg_id").collect()
    assert (one["channel"], one["url"], one["author"], one["date"], one["ts"]) == ("group_-5", "https://t.me/c/-5/7", "A B", "1970-01-02", 86400)
    assert one["links"] == "https://example.net/z https://example.org/a" and one["domains"] == "example.net example.org" and one["source"] == "group"
    assert (two["channel"], two["url"], two["author"], two["group_title"], two["links"]) == ("g_room", "https://t.me/room/8", "u", "T", "")


def test_display(spark):
    rows = spark.createDataFrame([("2024-12-31", 12349), (None, None), ("soon", 999), ("2023-01-01", 1050)], "d string, n long")
    got = [tuple(r) for r in rows.select(display.age(F.col("d"), "2024-12-31"), display.short_number(F.col("n"))).collect()]
    assert got == [("今天", "1.2w"), ("", "0"), ("soon", "999"), ("2 年前", "1.1k")]
    nothing = spark.sql("select named_struct('q', ' ', 'cat', null, 'tags', array(), 'channel', '', 'days', 0, 'sort', 'relevance', 'semantic', 0) s")
    json_, back = nothing.select(display.captured(F.col("s")).alias("j")).select("j", display.restored(F.col("j"))).first()
    assert json_ is None and tuple(back) == ("", "", [], "", 0, "relevance", 0)
