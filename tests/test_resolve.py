import itertools

from driftlog.operators import nested, resolve

LOG = "offset long, pk string, op string, value long, H string, dev string, sync boolean"


def h(ms):
    return f"{ms:012x}{0:020x}"


def events(spark, rows):
    return spark.createDataFrame([(i, pk, op, v, h(ms), dev, sync) for i, (pk, op, v, ms, dev, sync) in enumerate(rows)], LOG)


def rep(pk, v, ms, dev="0"):
    return (pk, "replace", v, ms, dev, None)


def dele(pk, ms, dev="0"):
    return (pk, "delete", None, ms, dev, None)


def test_older_write_changes_nothing(spark):
    e = events(spark, [rep("a", 1, 200), rep("a", 2, 100)])
    assert [(r.value, r.H) for r in resolve.resolve(e, ["value"]).collect()] == [(1, h(200))]
    assert resolve.change_feed(e, ["value"]).count() == 1


def test_equal_clocks_keep_the_first_arrival(spark):
    e = events(spark, [rep("a", 1, 100), rep("a", 2, 100)])
    assert resolve.resolve(e, ["value"]).first().value == 1


def test_delete_leaves_a_tombstone_that_no_older_write_revives(spark):
    e = events(spark, [rep("a", 1, 100), dele("a", 200), rep("a", 3, 150)])
    row = resolve.resolve(e, ["value"]).first()
    assert row.tombstone and row.value is None
    assert resolve.live(resolve.resolve(e, ["value"])).isEmpty()


def test_feed_carries_previous(spark):
    e = events(spark, [rep("a", 1, 100), rep("a", 1, 100), rep("a", 2, 110), dele("a", 120), rep("a", 4, 130)])
    f = resolve.change_feed(e, ["value"]).orderBy("offset").collect()
    assert [(r.current.value, r.current.tombstone, r.has_previous) for r in f] == [(1, False, False), (2, False, True), (None, True, True), (4, False, True)]
    assert f[3].previous.tombstone and f[3].previous.value is None


def test_set_sync_moves_the_clock_and_keeps_the_value(spark):
    e = events(spark, [rep("a", 1, 100), ("a", "set_sync", None, 300, "0", True), rep("a", 2, 200)])
    row = resolve.resolve_with_sync(e, ["value"]).first()
    assert (row.value, row.sync, row.H) == (1, True, h(300))
    feed = resolve.change_feed(e, ["value"]).orderBy("offset").collect()
    assert [r.current.value for r in feed] == [1, 1]


def test_remote_events_need_sync(spark):
    e = events(spark, [rep("a", 1, 100), rep("a", 2, 200, "9"), ("a", "set_sync", None, 300, "9", True)])
    assert [r.op for r in resolve.accept_remote(e, "0").orderBy("offset").collect()] == ["replace", "set_sync"]


def test_resolution_does_not_depend_on_delivery(spark):
    rows = [rep("a", 1, 100), dele("a", 150), rep("a", 3, 120), rep("a", 4, 170)]
    got = {tuple((r.value, r.H) for r in resolve.resolve(events(spark, p), ["value"]).collect()) for p in itertools.islice(itertools.permutations(rows), 0, 24, 5)}
    assert got == {((4, h(170)),)}


def test_types_heal_only_to_newer_events(spark):
    rows = [(0, "a", "Counter", h(100)), (1, "a", "Set", h(50)), (2, "a", "Counter", h(60)), (3, "a", "Set", h(200)), (4, "a", "Counter", h(150))]
    t = resolve.heal_types(spark.createDataFrame(rows, "offset long, pk string, tag string, H string")).orderBy("offset").collect()
    assert [(r.accepted, r.healed, r.type_after) for r in t] == [(True, False, "Counter"), (False, False, "Counter"), (True, False, "Counter"), (True, True, "Set"), (False, False, "Set")]


def test_merge_keeps_the_newer_cell_and_the_local_flag(spark):
    shape = "pk string, tombstone boolean, value long, sync boolean, H string"
    a = spark.createDataFrame([("a", False, 1, True, h(100)), ("b", False, 2, None, h(100))], shape)
    b = spark.createDataFrame([("a", True, None, False, h(200)), ("b", False, 9, True, h(100)), ("c", False, 3, True, h(1))], shape)
    got = {r.pk: tuple(r)[1:] for r in resolve.merge_cells(a, b, ["value"]).collect()}
    assert got == {"a": (True, None, True, h(200)), "b": (False, 2, None, h(100)), "c": (False, 3, True, h(1))}


def test_nearest_flag_wins(spark):
    flags = spark.createDataFrame([("a", [], True), ("a", ["x"], False)], "pk string, path array<string>, sync boolean")
    paths = spark.createDataFrame([("a", []), ("a", ["x", "y"]), ("a", ["z"]), ("b", [])], "pk string, path array<string>")
    got = {(r.pk, tuple(r.path)): r.synced for r in resolve.nearest_flag(paths, flags).collect()}
    assert got == {("a", ()): True, ("a", ("x", "y")): False, ("a", ("z",)): True, ("b", ()): False}


def fold(spark, rows):
    d = spark.createDataFrame([(i, "r", p, op, v, h(ms)) for i, (p, op, v, ms) in enumerate(rows)], "offset long, pk string, path array<string>, op string, value string, H string")
    return {(r.path, r.value) for r in nested.fold(d).collect()}


def test_ancestors_compare_their_own_clock_only(spark):
    child, parent = (["x"], "replace", "c", 20), ([], "replace", "p", 15)
    assert fold(spark, [child, parent]) == {("", "p")}
    assert fold(spark, [parent, child]) == {("x", "c")}


def test_tombstones_as_old_as_the_watermark_go(spark):
    rows = resolve.resolve(events(spark, [dele("a", 100), dele("b", 300), rep("c", 1, 1)]), ["value"])
    assert {r.pk for r in resolve.collect_tombstones(rows, h(200)).collect()} == {"b", "c"}
