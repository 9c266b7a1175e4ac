"""Runs over sources, online clusters, labels and reranking on small tables, held against what one would do by hand."""

import pytest
from pyspark.sql import functions as F

from sievework.functions import text, urls
from sievework.operators import cluster, discover, facets, overlays, sync, vectors
from sievework.streaming import ingest

POST = "id long, channel string, cluster_key string, value double, text string"


def one_by_one(stored, batch):
    """Each post in turn: it joins another channel's representative of its key, or stands for itself."""
    rows = {r["id"]: r.asDict() for r in stored}
    for i, channel, key, *_ in sorted(batch):
        other = min((r["id"] for r in rows.values() if key and r["cluster_key"] == key and r["is_rep"] and r["channel"] != channel), default=None)
        if other is not None:
            rows[other]["cluster_size"] += 1
        rows[i] = {"id": i, "channel": channel, "cluster_key": key, "rep_id": i if other is None else other, "cluster_size": rows[other]["cluster_size"] if other is not None else 1, "is_rep": other is None}
    return {i: (r["rep_id"], r["cluster_size"], r["is_rep"]) for i, r in rows.items()}


def test_online_clusters_as_if_one_by_one(spark):
    early = [(i, "abc"[i % 3], [None, "k", "m", "h"][i * i % 4], 1.0, "x") for i in range(1, 20)]
    late = [(i, "cab"[i % 3], ["k", "h", "h", "n", None][i * 7 % 5], 1.0, "x") for i in range(20, 300)]
    none = cluster.cluster(spark.createDataFrame([], POST))
    first = cluster.joined(none, spark.createDataFrame(early, POST))
    stored = first.collect()
    told = lambda rows: {r["id"]: (r["rep_id"], r["cluster_size"], r["is_rep"]) for r in rows}
    assert told(stored) == one_by_one([], early)
    first = spark.createDataFrame(stored, first.schema)
    came = cluster.joined(first, spark.createDataFrame(late, POST))
    assert told(came.collect() + cluster.grown(first, came).collect()) == one_by_one(stored, late)


def test_online_clusters_of_empty_tables(spark):
    none = cluster.cluster(spark.createDataFrame([], POST))
    assert cluster.joined(none, none).count() == 0
    assert cluster.grown(none, none).count() == 0


def test_sync_counts_repeated_and_stored_keys_once(spark):
    sources = spark.createDataFrame([("a", "channel"), ("b", "web"), ("g", "group"), ("z", "channel")], "channel string, kind string")
    key = "channel string, msg_id long"
    got = sync.counts(sources, spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 5), ("g", 1)], key), spark.createDataFrame([("a", 2), ("a", 9)], key))
    assert {tuple(r) for r in got.collect()} == {("a", 3, 1, 2), ("b", 1, 1, 0), ("z", 0, 0, 0)}
    assert sync.high_water(spark.createDataFrame([], POST)).first()["last_id"] == 0


def test_labels_roll_back(spark):
    posts = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id long, category string, value double")
    labels = spark.createDataFrame([(1, "x", 9.0), (7, "x", 9.0)], "post_id long, category string, value double")
    saved, over = overlays.saved_labels(posts, labels), overlays.labelled(posts, labels)
    assert {tuple(r) for r in over.collect()} == {(1, "x", 9.0), (2, "b", 2.0)}
    assert {tuple(r) for r in overlays.rolled_back(over, saved).collect()} == {(1, "a", 1.0), (2, "b", 2.0)}
    assert overlays.guarded(posts, 2).count() == 2
    with pytest.raises(ValueError):
        overlays.guarded(posts, 1)


def test_judged_answers(spark):
    judged = spark.createDataFrame([("p", 2), ("p", 1), ("p", 0), ("q", 0)], "query string, grade int")
    assert tuple(facets.judge_metrics(judged).first()) == (0.5, 1.0, 0.5)


def test_rerank_falls_back(spark):
    posts = spark.createDataFrame([(1, "a"), (2, "bbb"), (3, "cc")], "id long, text string")
    items = vectors.encode(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id long, embedding array<double>"))
    ids = lambda scorer: [r["id"] for r in vectors.reranked(posts, items, [127, 0], 127.0, scorer, k=2)[0].orderBy("rank").collect()]
    assert ids(lambda texts: [len(t) for t in texts]) == [2, 3]
    assert ids(lambda texts: [1 / 0]) == [1, 3]
    assert vectors.reranked(posts, items, [127, 0], 127.0, lambda texts: [1.0])[1] != ""


def test_candidates_without_known_ones(spark):
    posts = spark.createDataFrame([(1, "a", None, 1.0, "@Alpha_one @beta_two"), (2, "a", None, 1.0, "@beta_two @beta_two")], POST)
    known = spark.createDataFrame([("ALPHA_ONE",)], "handle string")
    assert [tuple(r) for r in discover.candidates(posts, known).collect()] == [("beta_two", 2)]
    probed = spark.createDataFrame([("p", 9, "none", None, 0), ("q", 1, "Free GPT", "python VPS", 3)], "handle string, n long, title string, about string, messages int")
    assert [(r["handle"], r["theme_hits"], r["theme"], r["status"]) for r in discover.ranked(probed).collect()] == [("q", 3, ["gpt", "vps", "python"], "scrapable"), ("p", 0, [], "no-preview")]


def test_small_functions(spark):
    row = spark.createDataFrame([("see https://a.b/c) and https://a.b/c [2][10]\n\n x ", ["HTTP://m.n/", "tg://x"])], "t string, m array<string>")
    got = row.select(urls.links_in(F.col("t"), F.col("m")).alias("u"), text.citations(F.col("t")).alias("c"), text.batch_lines(F.col("t")).alias("l")).first()
    assert got["u"] == ["HTTP://m.n/", "https://a.b/c"] and got["c"] == [2, 10] and len(got["l"]) == 2


def test_containing_finds_items_of_any_length(spark):
    texts = ["one two three four five six seven eight", "a one two three, b", "xone twox", "", None, "ab", "é𝒳z end", "one  two\tthree four five six"]
    items = ["two three four five six seven", "one two three", "one two", "e", "ab", "é𝒳z", "", None, "three", "two three four five", "one two three four five", "x", "missing words of an item here", "five six seven eight"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["item_id"], r["doc_id"]) for r in facets.containing(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect())
    assert got == sorted((k, i) for k, item in enumerate(items) for i, t in enumerate(texts) if item and t and item in t)
    assert facets.containing(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_appended_twice_adds_once(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y")], "channel string, msg_id long, text string")
    for _ in range(2):
        ingest.appended(spark, rows, path)
    assert spark.read.parquet(path).count() == 2


def test_places_of_valuable_posts_are_those_among_all(spark):
    from sievework.plans.queries import QUERIES
    from tests.conftest import SMALL

    got = QUERIES["b9_valuable_sorted"](spark, SMALL).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, len(got) + 1)) and len(got) > 1


def test_no_task_of_a_segment_sorts_all_its_posts(spark):
    from sievework.operators import index

    rows = spark.createDataFrame([(i, f"b{i} a the the") for i in range(300)], "id long, text string")
    made = index.segment_of(rows.coalesce(1), 1)
    assert "Sort" not in made._jdf.queryExecution().toString()
    held = made.where("term = 'the'").collect()
    assert len(held) == 300 and all(r["positions"] == [2, 3] and r["n"] == 2 and r["length"] == 4 and r["first"] for r in held)


def test_texts_are_not_sorted_or_shuffled_for_places_of_few(spark):
    """Of the best posts only ids meet in one task."""
    from pyspark.sql import functions as F
    from sievework.operators import dedup, reports

    rows = spark.range(50).select("id", F.lit("2024-01-01").alias("date"), F.lit("c").alias("channel"), F.lit("k").alias("category"), F.lit(3.0).alias("value"), F.lit(3.0).alias("content"), F.lit(1).alias("views"), F.col("id").alias("ts"), F.array(F.lit("t")).alias("tags"), F.repeat(F.lit("text "), 100).alias("text"))
    assert [r["id"] for r in reports.dashboard(rows, 3).orderBy("id").collect()] == [0, 1, 2]
    assert [r["place"] for r in reports.by_category_sections(rows, 4).orderBy("place").collect()] == [1, 2, 3, 4]
    marked = dedup.dispositions(rows.withColumn("msg_id", F.col("id")), [F.col("id")], spam_col=None)
    assert {r["disposition"]: r["count"] for r in marked.groupBy("disposition").count().collect()} == {"clean": 1, "dup_text": 49}


def test_words_of_wide_characters_are_found_beside_long_runs_of_others(spark):
    from pyspark.sql import functions as F
    from sievework.operators import classify as C

    hays = ["x" * 40 + "24小时" + "y" * 40, "github " + "a" * 50 + "加qq" + "b" * 50 + "pro号", "免费" + "z" * 9 + "教程", "0 元 stable diffusion"]
    got = spark.createDataFrame([(h,) for h in hays], "h string").select("h", C.known_words(F.col("h")).alias("k")).collect()
    for r in got:
        assert sorted(r["k"]) == sorted(w for w in C.WORDS if w in r["h"])


def test_equal_subscriptions_are_answered_once(spark):
    from pyspark.sql import functions as F
    from sievework.operators import overlays

    rows = spark.createDataFrame([(i, "2024-01-01", 10 + i, 5.0, ["t"], "rare word common" if i < 3 else "common word") for i in range(6)], "id long, date string, ts long, value double, tags array<string>, text string")
    subs = spark.range(40).select("id", F.lit("rare common").alias("keyword"), F.array(F.lit("t")).alias("tags"), F.lit(1.0).alias("min_value"), F.lit(True).alias("enabled"))
    found = overlays.subscription_hits(rows, subs, 0)
    assert sorted((r["subscription"], r["total"], tuple(r["ids"])) for r in found.collect()) == [(i, 3, (2, 1, 0)) for i in range(40)]
    assert "explode(members" in found._jdf.queryExecution().toString()


def test_tasks_keep_the_best_hits_of_each_search(spark):
    """Hits of a search aren't sorted in one task: each task gives its best ones and how many there were."""
    from sievework.operators import hybrid

    hits = spark.range(0, 1_200_000, 1, 2).select(F.concat(F.lit("s"), F.col("id") % 3).alias("search"), F.lit(4).alias("most"), "id", (-F.floor(F.col("id") / 6)).cast("double").alias("rank"))
    got = hybrid.kept_best(hits).collect()
    assert len(got) == 2 * 3 * 4
    for s in range(3):
        own = [r for r in got if r["search"] == f"s{s}"]
        assert sum(r["n"] for r in own) == 400_000
        best = sorted((r["rank"], r["id"]) for r in own)[:4]
        assert best == [(-199_999.0, 1_199_994 + s), (-199_999.0, 1_199_997 + s), (-199_998.0, 1_199_988 + s), (-199_998.0, 1_199_991 + s)]


def test_equal_searches_of_many_questions_are_made_once(spark, tmp_path):
    from sievework.operators import hybrid, index

    rows = spark.createDataFrame([(i, "common word" + " rare" * (i % 10 == 0), float(i % 7)) for i in range(300)], "id long, text string, value double").withColumns({"date": F.lit("2024-01-01"), "tags": F.array().cast("array<string>"), "links": F.array().cast("array<string>")})
    made = index.build(rows, str(tmp_path / "i"))
    asked = spark.createDataFrame([(i, "common rare rare") for i in range(20)] + [(20, "rare"), (21, "absent")], "question long, text string")
    found = hybrid.keyword_ranks(rows, asked, made, limit=5)
    assert "MapInPandas" in found._jdf.queryExecution().toString()
    of = {}
    for r in found.orderBy("question", "rank").collect():
        of.setdefault(r["question"], []).append((r["id"], r["score"]))
    assert all(of[i] == of[0] for i in range(20)) and len(of[21]) == 5
    assert [i for i, _ in of[0]] == [i for i, _ in of[20]] and all(i % 10 == 0 for i, _ in of[0])
    alone = hybrid.keyword_rank(rows, "common rare rare", limit=5, index=made).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in alone] == of[0]


def test_posts_without_a_key_are_not_one_tasks_work(spark, tmp_path):
    """Neither clusters nor repeated keys of a batch move texts, so that no task holds all posts without a key."""
    from sievework.streaming.store import PostStore

    batch = spark.range(0, 400, 1, 4).select("id", F.concat(F.lit("c"), F.col("id") % 3).alias("channel"), (F.col("id") % 390).alias("msg_id"), F.when(F.col("id") % 10 == 0, "k").alias("cluster_key"), F.lit("some words").alias("text"), F.lit(1.0).alias("value"))
    none = batch.limit(0).withColumns({"cluster_size": F.lit(1), "is_rep": F.lit(True)})
    plan = cluster.joined(none, batch)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join LeftOuter" in line and "cluster_key" in line]
    store = PostStore(spark, str(tmp_path / "s"))
    store.append(batch.withColumns({"date": F.lit("2024-01-01"), "tags": F.array().cast("array<string>"), "category": F.lit("x")}))
    # of 0 and 390 (c0), 1 and 391 (c1) and so on one stays
    got = store.posts().collect()
    assert len(got) == 390 and len({(r["channel"], r["msg_id"]) for r in got}) == 390
    want = one_by_one([], [(r["id"], r["channel"], r["cluster_key"]) for r in got])
    assert {r["id"]: (r["rep_id"], r["cluster_size"], r["is_rep"]) for r in got} == want


def test_few_items_are_found_without_moving_texts(spark, monkeypatch):
    texts = ["x the cat sat on a mat y", "cat sat on", "xcat sat on the mats", "the  cat sat", "é cat sat on a matt", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = ["cat sat on", "at sat on a ma", "the  cat sat", "a b c d e f g", "cat sat", "the cat sat on a mat", None]
    items = spark.createDataFrame(list(enumerate(wanted)), "item_id long, text string")
    want = sorted((i, d) for i, w in enumerate(wanted) for d, t in enumerate(texts) if w and t and w in t)
    found = facets.containing(docs, items.where("item_id <> 4"))
    assert sorted(map(tuple, found.collect())) == [p for p in want if p[0] != 4]
    assert "Generate explode" not in found._jdf.queryExecution().toString()
    for most in (10_000, 0):
        monkeypatch.setattr(facets, "FEW_ITEMS", most)
        assert sorted(map(tuple, facets.containing(docs, items).collect())) == want


@pytest.mark.parametrize("own", [
    "Shore the lane The pier", "the The", "Harbour harbour. lane", "see lane.pier-road lane_pier", "go example.com lane", "the and", "lane ... pier.",
])
def test_related_posts_are_those_of_the_sql(spark, tmp_path, own):
    """Key terms that differ in case, hold inner signs or are in most posts; ranks that differ beyond the sixth digit."""
    import duckdb
    from sievework.plans.queries import ORACLES, QUERIES

    texts = ["the and", "the and lane", "Lane.pier road and the", "lane pier", "harbour the shore", "example com the", "the lane pier " + "the and " * 40, "pier lane and the " + "and the " * 41]
    rows = [(i, own if i == 3 else f"{texts[i % 8]} w{i % 4}", "en", f"src{i % 3}", 10) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    plain = lambda found: [(i, str(round(float(r), 6))) for i, r in found]
    assert plain(tuple(r) for r in QUERIES["j18_related"](spark, str(tmp_path)).collect()) == plain(con.execute(ORACLES["j18_related"]).fetchall())


@pytest.mark.parametrize("stored", [False, True])
def test_subscriptions_meet_blocks_of_posts(spark, tmp_path, monkeypatch, stored):
    """Phrases, tags and values in several blocks and groups; no row is made for a subscription and a post."""
    import random
    from sievework.operators import index

    monkeypatch.setattr(overlays, "BLOCK", 60)
    monkeypatch.setattr(overlays, "GROUP", 40)
    monkeypatch.setattr(overlays, "PACKED", 500)
    rng = random.Random(5)
    vocabulary = ["ash", "bay", "cob", "dew", "elm", "fig", "gum"]
    posts = [(i, f"2024-01-{i % 9 + 1:02}" if i % 31 else None, i % 13, [None, 2.0, float("nan"), 7.0][i % 4], [t for t in ("x", "y", "z") if rng.random() < 0.6] if i % 17 else None, " ".join(rng.choices(vocabulary, k=rng.randint(0, 9))), rng.choice(vocabulary), i % 19 > 0) for i in range(300)]
    rows = spark.createDataFrame(posts, "id long, date string, ts long, value double, tags array<string>, text string, channel string, is_rep boolean").repartition(3)
    asked = [(i, " ".join(rng.choice(["", "-"]).join(rng.choices(vocabulary + ["yew"] * (i % 30 == 0), k=rng.randint(1, 2)) if rng.random() < 0.5 else rng.choices(vocabulary, k=1)) for _ in range(rng.randint(0, 3))), rng.choice([[], ["x"], ["z", "x"], None]), rng.choice([0.0, 2.5, None]), i % 23 > 0) for i in range(150)]
    subs = spark.createDataFrame(asked, "id long, keyword string, tags array<string>, min_value double, enabled boolean")
    want = {}
    for own, keyword, tags, least, enabled in asked:
        phrases = [k.split("-") for k in keyword.split()]
        hits = []
        for i, date, ts, value, mine, words, channel, rep in posts:
            holds = lambda p: any(f[k : k + len(p)] == p for f in (words.split(), [channel], mine or []) for k in range(len(f)))
            if rep and ts > 1 and value is not None and not value < (least or 0) and set(tags or []) <= set(mine or []) and all(map(holds, phrases)):
                hits.append((date or "", ts, -i))
        if enabled and hits:
            want[own] = (len(hits), [-i for _, _, i in sorted(hits, reverse=True)[:5]])
    made = index.build(rows, str(tmp_path / "i")) if stored else None
    found = overlays.subscription_hits(rows, subs, 1, index=made)
    assert {r["subscription"]: (r["total"], r["ids"]) for r in found.collect()} == want and len(want) > 40
    pairs = overlays.answered(*cells(spark, subscriptions=30, posts=200), 5).collect()
    assert len(pairs) == 30 * 5 and sum(r["n"] for r in pairs) == 30 * 200


def cells(spark, subscriptions, posts):
    """One group of subscriptions to a word and one block of posts that all hold it."""
    both = {"deal": F.lit(0), "block": F.lit(0)}
    asked = spark.range(subscriptions).select(F.col("id").alias("subscription"), F.lit(0.0).alias("min_value"), F.array().cast("array<string>").alias("tags"), F.array(F.lit("ash")).alias("phrases"))
    own = spark.range(posts).select("id", F.lit("2024-01-01").alias("date"), F.col("id").alias("ts"), F.lit(1.0).alias("value"), F.array().cast("array<string>").alias("own_tags"))
    held = overlays.packed(spark.range(posts).select(F.lit("ash").alias("term"), F.lit(0).alias("block"), "id", F.lit(None).cast("long").alias("at")))
    return asked.withColumns(both), own.withColumns(both).unionByName(held.withColumn("deal", F.lit(0)), allowMissingColumns=True)
