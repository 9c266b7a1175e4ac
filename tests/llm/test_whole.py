"""Operators do the whole job: nothing of a text, url or table is left out."""

import random

from sievework.llm import registry, toxicity, url_rules
from tests.conftest import SMALL


def held_out(spark, rows):
    """Rows of (id, text, toxic) with their predictions, those that trained nothing."""
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.classify(docs, labels).where("held_out").collect()}
    return [(toxic, got[i]) for i, _, toxic in rows if i in got]


def test_toxicity_reads_whole_words(spark):
    rnd = random.Random(3)
    word = lambda end="": "international" + "".join(rnd.choices("aeinrst", k=5)) + end
    rows = [(i, " ".join(word("zqxwv" if i % 2 and j == 7 else "") for j in range(20)), i % 2) for i in range(400)]
    got = held_out(spark, rows)
    assert len(got) > 40 and sum(a == b for a, b in got) > 0.95 * len(got)


def test_toxicity_reads_unspaced_text(spark):
    rnd = random.Random(4)
    run = lambda n: "".join(chr(rnd.randrange(0x4E00, 0x4E80)) for _ in range(n))
    rows = [(i, run(rnd.randrange(20, 40)) + ("笨蛋垃圾" if i % 2 else run(4)) + run(20), i % 2) for i in range(400)]
    got = held_out(spark, rows)
    assert len(got) > 40 and sum(a == b for a, b in got) > 0.95 * len(got)


def judged(spark, urls):
    """(verdict, mined rule) of each url."""
    rows = url_rules.judge(spark.createDataFrame([(u,) for u in urls], "url string")).collect()
    return {r["url"]: (r["verdict"], r["by_rule"]) for r in rows}


def test_urls_without_a_fixed_rule_are_judged_by_their_tokens(spark):
    fixed = [f"http://h{i}.net/ads/{i}" for i in range(20)] + [f"http://h{i}.org/fr/{i}" for i in range(20)]
    left = [f"http://h{i}.io/ads/{i}" for i in range(60)]
    got = judged(spark, fixed + left)
    assert {got[u] for u in left} == {("block", "path:ads")}


def test_mined_rules_decide_most_urls_that_are_left(spark):
    got = registry.queries()["op3_url_rules"](spark, f"{SMALL}/../sf0.01").where("rule is null")
    left, mined = got.count(), got.where("by_rule is not null").count()
    print(f"mined rules decide {mined} of {left} urls")
    assert mined > 0.5 * left


def test_every_part_of_a_url_is_a_token(spark):
    shapes = ["http://h{i}.{top}/{i}/{i}/{word}/x", "http://h{i}.{top}/{i}?a=1&b=2&c=3&{word}=4", "http://a{i}.{word}.b{i}.c{i}.{top}/", "http://h{i}.{top}/2024.1/{word}"]
    made = lambda top, word, n: [(s, shape.format(i=i, top=top, word=f"{word}{s}").replace("/en//", "/en/")) for s, shape in enumerate(shapes) for i in range(n)]
    left = made("io", "zads", 10)
    got = judged(spark, [u for _, u in made("net", "zads", 10) + made("example.net/en/", "znews", 10) + left])
    assert all(got[u][0] == "block" and f"zads{s}" in got[u][1] for s, u in left)
