import random

from driftlog.operators import crdt, sequence


def h(n):
    return f"{n:032x}"


def test_counter_sides_and_merge(spark):
    ops = spark.createDataFrame([("a", 1, 5), ("a", 1, -2), ("a", 2, -7), ("a", 2, 1)], "pk string, dev long, delta long")
    c = crdt.counter_components(ops)
    assert {(r.dev, int(r.pos), int(r.neg)) for r in c.collect()} == {(1, 5, 2), (2, 1, 7)}
    assert int(crdt.counter_value(crdt.counter_merge(c.unionByName(c))).first().value) == -3


def test_set_needs_a_newer_addition(spark):
    ops = spark.createDataFrame([("a", "x", True, h(5)), ("a", "x", False, h(5)), ("a", "y", True, h(6)), ("a", "y", False, h(5)), ("a", "z", False, h(9)), ("a", "z", True, h(3))], "pk string, elem string, add boolean, H string")
    assert {r.elem for r in crdt.set_members(crdt.set_state(ops)).collect()} == {"y"}
    kept = {r.elem for r in crdt.set_compact(crdt.set_state(ops), h(7)).collect()}
    assert kept == {"y", "z"}


def test_orset_concurrent_addition_survives(spark):
    adds = spark.createDataFrame([("a", "x", h(1)), ("a", "x", h(3)), ("a", "y", h(2))], "pk string, elem string, tag string")
    removes = spark.createDataFrame([("a", "x", h(4), [h(1)]), ("a", "y", h(5), [h(2)])], "pk string, elem string, H string, observed array<string>")
    r = crdt.orset_removals(removes)
    assert {x.elem for x in crdt.orset_members(adds, r).collect()} == {"x"}
    a, b = crdt.orset_compact(adds, r, h(4))
    assert {x.tag for x in a.collect()} == {h(3), h(2)} and {x.tag for x in b.collect()} == {h(2)}


def test_register_keeps_concurrent_values(spark):
    a = spark.createDataFrame([("a", h(1), "u", []), ("a", h(2), "v", [h(1)]), ("a", h(3), "w", [h(1)])], "pk string, id string, value string, replaces array<string>")
    assert {r.value for r in crdt.mv_values(a, crdt.mv_removals(a)).collect()} == {"v", "w"}


def test_queue_order_ties_and_stale_pops(spark):
    push = spark.createDataFrame([("a", h(3), 1), ("a", h(2), 1), ("a", h(1), 0)], "pk string, id string, priority long")
    pop = spark.createDataFrame([("a", h(1), h(9)), ("a", h(3), h(2))], "pk string, id string, H string")
    live = crdt.pq_live(push, pop)
    assert [r.id for r in crdt.pq_order(live).orderBy("place").collect()] == [h(2), h(3)]
    assert crdt.pq_head(live).first().id == h(2)


def test_walk_orders_siblings_newest_first_and_hides_orphans():
    ids, after = ["1", "2", "3", "4", "9"], [None, None, "1", "1", "missing"]
    assert [ids[i] for i in sequence.walk(ids, after)] == ["2", "1", "4", "3"]


def test_walk_is_order_free():
    ids = [f"{i:04}" for i in range(60)]
    rng = random.Random(1)
    after = [None if i == 0 else rng.choice([None, *ids[:i]]) for i in range(60)]
    want = [ids[i] for i in sequence.walk(ids, after)]
    for seed in range(5):
        p = list(range(60))
        random.Random(seed).shuffle(p)
        assert [ids[p[i]] for i in sequence.walk([ids[i] for i in p], [after[i] for i in p])] == want


def test_deep_chains_do_not_recurse():
    n = 50_000
    ids = [f"{i:08}" for i in range(n)]
    assert sequence.walk(ids, [None, *ids[:-1]]) == list(range(n))


def test_text_insert_delete_format(spark):
    shape = "pk string, H string, after string, text string"
    ins = spark.createDataFrame([("t", "0001", None, "hallo"), ("t", "0002", "000100000004", " w😀"), ("n", "0001", None, "")], shape)
    c = sequence.text_inserts(ins)
    dels = spark.createDataFrame([("t", "000100000001", "0003")], "pk string, id string, H string")
    assert [r.text for r in sequence.text_string(c, dels).collect()] == ["hllo w😀"]
    stale = spark.createDataFrame([("t", "000100000001", "0000")], "pk string, id string, H string")
    assert [r.text for r in sequence.text_string(c, stale).collect()] == ["hallo w😀"]
    f = spark.createDataFrame([("t", ["a", "b"], "bold", "on", "1"), ("t", ["b"], "bold", None, "2")], "pk string, ids array<string>, attr string, value string, H string")
    got = {(r.id, r.value) for r in sequence.text_format(f).collect()}
    assert got == {("a", "on"), ("b", None)}
    assert {r.id for r in sequence.text_compact(sequence.text_format(f), "2").collect()} == {"a"}


def test_list_compaction_keeps_anchors(spark):
    e = spark.createDataFrame([("l", "1", None, "1z"), ("l", "2", "1", None), ("l", "3", "2", "3z"), ("l", "4", "3", "4z")], "pk string, id string, after string, deleted_at string")
    assert {r.id for r in sequence.list_compact(e, "zz").collect()} == {"1", "2"}
    assert {r.id for r in sequence.list_compact(e, "").collect()} == {"1", "2", "3", "4"}


def test_builders_and_conflicts(spark):
    shown = spark.createDataFrame([("t", c, i) for i, c in enumerate("abcd")], "pk string, id string, position long")
    op = sequence.format_range(shown, 1, 3, "bold", "on", "5")
    assert op.first().ids == ["b", "c"] and sequence.id_at(shown, 2).first().id == "c"
    attrs = sequence.text_format(op)
    assert [tuple(r) for r in sequence.format_at(shown, attrs, 1).collect()] == [("t", "bold", "on")]
    assert sequence.format_at(shown, attrs, 3).isEmpty()
    values = spark.createDataFrame([("a", "2", "v"), ("a", "1", "w")], "pk string, id string, value string")
    assert crdt.mv_observe(values).first().replaces == ["1", "2"]
    two = spark.createDataFrame([("a", "1", "x"), ("a", "1", "y"), ("a", "2", "x"), ("a", "2", "x")], "pk string, id string, value string")
    assert [r.id for r in crdt.conflicts(two, ["pk", "id"], ["value"]).collect()] == ["1"]
