import pytest
from pyspark.sql import functions as F

from driftlog.operators import kv


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([(i, f"v{i}") for i in range(6)], "k long, v string")


@pytest.fixture(scope="module")
def updates(spark):
    return spark.createDataFrame([(4, "new"), (9, "nine")], "k long, v string")


def rows(d):
    return {r.k: r.v for r in d.collect()}


def test_ranges_are_half_open_both_ways(base):
    assert [r.k for r in kv.scan_range(base, "k", 1, 4).collect()] == [1, 2, 3]
    assert [r.k for r in kv.scan_range(base, "k", 1, 4, reverse=True).collect()] == [3, 2, 1]
    assert kv.first(base, "k").first().k == 0 and kv.last(base, "k").first().k == 5


def test_puts(base, updates):
    assert rows(kv.put(base, updates, "k"))[4] == "new" and len(rows(kv.put(base, updates, "k"))) == 7
    assert rows(kv.put_if_absent(base, updates, "k"))[4] == "v4"
    assert rows(kv.inserted(base, updates, "k")) == {9: "nine"}
    assert {r.k: r.previous_v for r in kv.replace(base, updates, "k").collect()} == {4: "v4", 9: None}


def test_deletes(base, updates):
    assert 4 not in rows(kv.delete(base, updates, "k"))
    assert [r.k for r in kv.deleted(base, updates, "k").collect()] == [4]
    assert kv.clear(base).isEmpty()


def test_update_truth_table(base, spark):
    want = spark.createDataFrame([(1,), (2,), (8,), (7,)], "k long")
    change = lambda old: F.when(F.col("k").isNull() & (F.col("_want") == 8), "made").when(old == "v1", "changed")
    got = rows(kv.update(base, want, "k", "v", change))
    assert got == {0: "v0", 1: "changed", 3: "v3", 4: "v4", 5: "v5", 8: "made"}


def test_last_write_wins_in_bulk(base, spark):
    u = spark.createDataFrame([(1, "a", 0), (1, "b", 2), (1, "c", 1)], "k long, v string, at long")
    assert rows(kv.bulk_put(base, u, "k", "at"))[1] == "b"


def test_overlays_agree_and_size_matches(base, updates):
    a, b = kv.overlay(base, updates, "k"), kv.overlay_unordered(base, updates, "k")
    assert rows(a) == rows(b) and kv.overlay_size(base, updates, "k").first().size == a.count() == 7
    assert {r.k: r.found for r in kv.contains(base, updates, "k").collect()} == {4: True, 9: False}


def test_bounded_states_take_known_keys_only_when_full(base, updates):
    assert kv.put_bounded(base, updates.filter("k = 4"), "k", 6).count() == 6
    with pytest.raises(kv.CapacityExceeded):
        kv.put_bounded(base, updates, "k", 6)


def test_updates_leave_other_rows_alone(spark):
    t = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, None)], "k long, v string")
    want = spark.createDataFrame([(1,), (3,), (4,), (5,)], "k long")
    got = kv.update(t, want, "k", "v", lambda old: F.when(old == "a", "A").when(old.isNull(), F.lit(None)))
    assert {(r.k, r.v) for r in got.collect()} == {(1, "A"), (2, None)}


def test_of_several_new_rows_the_first_is_put(spark):
    t = spark.createDataFrame([(1, "a", 0)], "k long, v string, at long")
    u = spark.createDataFrame([(1, "x", 1), (2, "late", 9), (2, "early", 3), (2, "later", 12)], "k long, v string, at long")
    assert {(r.k, r.v) for r in kv.put_if_absent(t, u, "k", "at").collect()} == {(1, "a"), (2, "early")}
    assert {(r.k, r.v) for r in kv.put_if_absent(t, u, "k").collect()} == {(1, "a"), (2, "early")}


def test_fragmentation_and_triggers(spark):
    log = spark.createDataFrame([(1, 0, False), (1, 1, False), (2, 2, False), (2, 3, True)], "k long, offset long, gone boolean")
    told = kv.fragmentation(log, "k", F.col("gone"))
    assert tuple(told.first()) == (4, 1, 0.75) and kv.fragmentation(log.limit(0), "k").first().ratio == 0
    assert kv.needs_compaction(told, 0.75) and not kv.needs_compaction(told, 0.8) and kv.needs_compaction(told, 0) and not kv.needs_compaction(told, 1)
