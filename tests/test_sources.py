"""Sources that are read in parts, exact order of lines, outside calls and blocks of vectors."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.functions.html import parse_messages
from sievework.operators import dedup, vectors
from sievework.operators.ledger import Ledger
from sievework.shipping import ship
from sievework.sources import imports, readers
from tests import fetchers


def test_lines_are_numbered_alike_for_any_split(spark, tmp_path):
    for channel, n in (("a", 400), ("b", 3), ("_skip", 2)):
        (tmp_path / "raw" / channel).mkdir(parents=True)
        lines = [json.dumps({"i": k % 150, "t": f"text number {k % 90} of some length, again and again"}) for k in range(n)]
        lines[1:1] = ["not json", ""]
        (tmp_path / "raw" / channel / "0.jsonl").write_text("\n".join(lines) + "\n")
    seen = []
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "1k", "313"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = readers.channel_order(readers.raw_messages(spark, str(tmp_path / "raw")), ["b"])
            marked = dedup.dispositions(rows, [F.col("input_order")], key=["channel", "i"], text_col="t", spam_col=None)
            seen.append(sorted((r["channel"], r["line"], r["i"], r["disposition"]) for r in marked.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 403
    # the blank line counts as a line of the file
    assert [r[1] for r in seen[0] if r[0] == "b"] == [1, 4, 5] and ("a", 1, 0, "dup_text") in seen[0] and ("b", 1, 0, "clean") in seen[0]


def test_lists_skip_unwanted_lines(spark, tmp_path):
    (tmp_path / "list.md").write_text("- [a](https://t.me/Good_chan) tools\n- @sexy_things\n- t.me/s/another1 群组 bot\n@good_chan again\n- 博彩 @badbadbad\n")
    got = {(r["handle"], r["line"]) for r in readers.listed_sources(spark, str(tmp_path / "list.md")).collect()}
    assert got == {("good_chan", 1), ("another1", 3)}


def history(spark, tmp_path, most):
    ship(spark)
    spark.dataSource.register(readers.HistorySource)
    return spark.readStream.format("channel_history").options(channels="c1,c2", fetcher="tests.fetchers:page", newest="tests.fetchers:newest", plans=str(tmp_path / "plans"), most=str(most), span="7").load()


def test_history_stream_brings_each_message_once(spark, tmp_path):
    fetchers.set_newest(tmp_path, c1=40, c2=5)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def start(fail_at=None):
        def each(batch, number):
            rows = readers.in_segment(parse_messages(batch)).select("channel", "i")
            if number == fail_at:
                raise RuntimeError("killed")
            rows.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

        return history(spark, tmp_path, 15).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()

    q = start(fail_at=1)
    with pytest.raises(Exception, match="killed"):
        q.processAllAvailable()
    fetchers.set_newest(tmp_path, c1=43, c2=9)
    q = start()
    q.processAllAvailable()
    q.stop()
    q = start()
    q.processAllAvailable()
    q.stop()
    rows = spark.read.parquet(out).collect()
    got = sorted((r["channel"], r["i"]) for r in rows)
    assert got == [("c1", i) for i in range(1, 44)] + [("c2", i) for i in range(1, 10)]
    by_batch = {(r["batch"], r["channel"]): 0 for r in rows}
    for r in rows:
        by_batch[r["batch"], r["channel"]] += 1
    assert max(by_batch.values()) <= 30 and len({b for b, _ in by_batch}) >= 3


def test_updates_take_what_a_trigger_may(spark, tmp_path):
    ship(spark)
    reader = imports.UpdateReader("tests.fetchers:updates", rows=3)
    rows, end = reader.read(reader.initialOffset())
    assert [i for i, _ in rows] == [0, 1, 2] and end == {"offset": 3}
    assert [i for i, _ in reader.readBetweenOffsets({"offset": 0}, end)] == [0, 1, 2]
    rows, end = reader.read({"offset": 9})
    assert [i for i, _ in rows] == [9] and reader.read(end)[1] == end
    small = imports.UpdateReader("tests.fetchers:updates", size=1)
    assert [i for i, _ in small.read({"offset": 4})[0]] == [4]


def test_tailed_files_come_in_turn(spark, tmp_path):
    for k in range(5):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"i": k}))
    sizes = []
    q = readers.tailed(spark, str(tmp_path / "in"), "i long", files=2).writeStream.foreachBatch(lambda b, _: sizes.append(b.count())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sizes == [2, 2, 1]


def test_a_labeller_that_fails_is_asked_once_for_each_batch_that_came_through(spark, tmp_path):
    ship(spark)
    items = spark.range(23).select("id", F.concat(F.lit("t"), "id").alias("text")).repartition(3)
    log = tmp_path / "log"
    log.mkdir()
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.run(lambda texts: "") == {"batches": 0, "answered": 0, "failed": 0, "open": 0}
    n = ledger.claim(items, 5)
    assert ledger.claim(items.union(items), 5) == n >= 5
    rounds = []
    state = ledger.run(fetchers.Labeller(str(log), bad={"t7"}), at_once=2, tries=1, stop=lambda: len(rounds) >= 2 or rounds.append(1))
    assert state["answered"] + state["failed"] == 4
    state = Ledger(spark, ledger.versions.root).run(fetchers.Labeller(str(log), bad={"t7"}), at_once=2, tries=1)
    assert state == {"batches": n, "answered": n - 1, "failed": 1, "open": 1}
    asked = [p.read_text() for p in log.iterdir()]
    assert len(asked) == n and sorted(x for a in asked for x in a.split(",")) == sorted(f"t{i}" for i in range(23))
    state = ledger.run(fetchers.Labeller(str(log), bad=set()), tries=2)
    assert state["answered"] == n and len(list(log.iterdir())) == n + 1
    assert ledger.claim(spark.createDataFrame([(99, "new"), (None, "x"), (3, "old")], "id long, text string")) == n + 1
    ledger.clear()
    assert ledger.state()["batches"] == 0


def test_blocks_find_what_a_scan_finds(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)] + [(300, None), (301, [0.0] * 6), (302, [1.0, 2.0])]
    items = vectors.encode(spark.createDataFrame(rows, "id long, embedding array<double>"))
    path = str(tmp_path / "blocks")
    vectors.blocks_of(items, 64).write.parquet(path)
    blocks = spark.read.parquet(path)
    assert blocks.agg(F.sum("n")).first()[0] == 302
    asked = [(r["id"], r["vec"], r["norm"]) for r in items.where("id in (3, 77, 302)").collect()]
    got = {(r["query"], r["rank"]): (r["id"], r["score"]) for r in vectors.nearest_in(blocks, asked, 9).collect()}
    for number, vec, norm in asked:
        want = [(r["id"], r["score"]) for r in vectors.nearest(items, vec, norm, 9).collect()]
        assert [got[number, k] for k in range(1, len(want) + 1)] == want
    few = vectors.nearest_in(blocks, asked[:1], 5, within=spark.range(10))
    assert {r["id"] for r in few.collect()} <= set(range(10)) and few.count() == 5
    assert vectors.nearest_in(blocks.limit(0), asked, 5).count() == 0
