"""Snapshots, commits and races."""

import hashlib
import threading

import pytest
from pyspark.sql import functions as F

from orefold.sources import store as stores

ROWS = "path string, text string"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


@pytest.fixture
def store(spark, tmp_path):
    return stores.Store(spark, f"file://{tmp_path}/store")


def files(spark, **texts):
    return spark.createDataFrame([(p.replace("_", "/"), t) for p, t in texts.items()], ROWS)


def test_snapshots_are_named_by_their_content(spark, store, tmp_path):
    a = spark.createDataFrame([("./a//x", "one"), ("b", None), (None, "lost"), ("c", "same"), ("d", "same")], ROWS)
    b = spark.createDataFrame([("d", "same"), ("c", "same"), ("b", ""), ("a/x", "one"), ("a/x", "one")], ROWS)
    name = store.put(a)
    assert store.put(b.repartition(3)) == name and store.put(a.withColumn("text", F.lit("other"))) != name
    assert sorted(map(tuple, store.files(name).collect())) == [("a/x", sha("one"), "one"), ("b", sha(""), ""), ("c", sha("same"), "same"), ("d", sha("same"), "same")]
    assert store._blobs().count() == 4  # one, same, empty, other: each once
    empty = store.put(a.limit(0))
    assert store.files(empty).collect() == [] and empty != name
    assert store.head("main") == (0, None)


def test_changes_say_what_they_replace(spark, store):
    n, first = store.commit("main", 0, files(spark, a="1", b="2", c="3"))
    shape = "path string, text string, before string"
    change = spark.createDataFrame([("a", "one", sha("1")), ("b", None, sha("2")), ("d", "4", None)], shape)
    n, second = store.change("main", n, change, "more")
    assert store.head("main") == (2, second) and sorted((r.path, r.text) for r in store.files(second).collect()) == [("a", "one"), ("c", "3"), ("d", "4")]
    assert sorted((r.path, r.text) for r in store.files(first).collect()) == [("a", "1"), ("b", "2"), ("c", "3")]
    for bad in (change, spark.createDataFrame([("c", "x", None)], shape), spark.createDataFrame([("c", "x", sha("3")), ("./c", "y", sha("3"))], shape)):
        with pytest.raises(stores.Conflict):
            store.change("main", 2, bad)
    with pytest.raises(stores.Conflict):
        store.commit("main", 1, files(spark, z="9"))
    assert store.head("main") == (2, second) and store.drop_unused(1) and store.files(second).count() == 3


def test_of_two_writers_one_wins(spark, store):
    """Both find the same newest commit and write their snapshots; the next number goes to one, and readers see its files whole."""
    base, _ = store.commit("main", 0, files(spark, a="0"))
    ready, out = threading.Barrier(2), {}
    publish = store._publish

    def together(*args):
        ready.wait(120)
        return publish(*args)

    store._publish = together

    def write(who):
        try:
            out[who] = store.commit("main", base, files(spark, a=who, b=who))
        except stores.Conflict as e:
            out[who] = e

    threads = [threading.Thread(target=write, args=(w,)) for w in ("x", "y")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    won = [w for w in out if not isinstance(out[w], Exception)]
    assert len(won) == 1 and store.head("main") == out[won[0]]
    assert sorted((r.path, r.text) for r in store.files(store.head("main")[1]).collect()) == [("a", won[0]), ("b", won[0])]
