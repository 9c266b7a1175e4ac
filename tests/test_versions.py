import pytest
from pyspark.sql import functions as F

from sievework.sources.versions import Conflict, Version, Versions


@pytest.fixture
def store(spark, tmp_path):
    return Versions(spark, str(tmp_path / "store"))


def put(store, rows, base=None):
    base = base or store.current()
    folder = store.write("posts", store.spark.range(rows))
    return store.commit(base, {"posts": [*base.tables.get("posts", []), folder]}, {"posts": base.facts.get("posts", 0) + rows})


def test_versions_grow(store):
    assert store.current() == Version() and store.read(store.current(), "posts") is None
    put(store, 2)
    new = put(store, 3)
    assert (new.number, new.facts["posts"], store.read(new, "posts").count()) == (2, 5, 5)
    assert store.current() == new


def test_a_failed_write_changes_nothing(store):
    put(store, 2)
    bad = store.spark.range(3).select(F.raise_error(F.lit("stop")).cast("string").alias("id"))
    with pytest.raises(Exception, match="stop"):
        store.write("posts", bad)
    assert store.read(store.current(), "posts").count() == 2 and store.current().number == 1


def test_the_second_of_two_writers_fails(store):
    base = put(store, 1)
    put(store, 2, base)
    with pytest.raises(Conflict):
        put(store, 4, base)
    assert store.read(store.current(), "posts").count() == 3


def test_a_snapshot_is_listed_whole(store):
    put(store, 2)
    made = store.snapshot("a label " * 20, rows=2, configs={"settings.json": "{}"})
    listed = next(s for s in store.snapshots() if s["id"] == made)
    assert listed["rows"] == 2 and listed["label"] == ("a label " * 20)[:60] and listed["configs"] == ["settings.json"] and listed["bytes"] > 0


def test_restore_swaps_the_pointer(store):
    put(store, 2)
    made = store.snapshot("first", 2, {"bot.json": "x"})
    put(store, 5)
    store.clean()
    version, configs = store.restore(made)
    assert configs == {"bot.json": "x"} and store.read(store.current(), "posts").count() == 2 and store.current() == version
    with pytest.raises(ValueError):
        store.restore("2001-01-01T00-00-00")


def test_bad_names_are_refused_and_forgetting_works_once(store):
    put(store, 1)
    with pytest.raises(ValueError):
        store.forget("../etc")
    made, other = store.snapshot("to go"), store.snapshot("stays")
    assert made != other and store.forget(made) is True and store.forget(made) is False
    assert [s["id"] for s in store.snapshots()] == [other]


def test_clean_keeps_what_is_named(store):
    put(store, 1)
    made = store.snapshot()
    base = store.current()
    store.commit(base, {"posts": [store.write("posts", store.spark.range(7))]}, {})
    store.write("posts", store.spark.range(9))
    assert store.clean() == 1
    assert store.read(store.current(), "posts").count() == 7
    store.restore(made)
    assert store.read(store.current(), "posts").count() == 1
