"""The fold of mixed logs, by the fixtures' cases and against replicas in any order."""

import itertools
import json

import pytest

from driftlog.operators import fold as f


def event(op, h, path=None, tag=None, arg=None, sync=None, dev="0"):
    return {"op": op, "H": h, "path": path, "tag": tag, "arg": arg, "sync": sync, "dev": dev}


def made(*events, **policy):
    c = f.dummy()
    return c, [f.apply(c, e, **policy) for e in events]


def test_newest_clock_decides_and_tombstones_stay():
    c, said = made(event("replace", "200", tag="Int", arg=1), event("replace", "100", tag="Int", arg=2), event("delete", "200"), event("delete", "300"), event("replace", "250", tag="Int", arg=3))
    assert said == [True, False, False, True, False] and c == {"tag": None, "value": None, "h": "300", "sync": None}


def test_sync_flags_move_the_clock_and_keep_the_value():
    c, said = made(event("replace", "1", tag="String", arg="v1"), event("set_sync", "2", sync=True), event("replace", "15", tag="String", arg="late"))
    assert said == [True, True, False] and (c["value"], c["sync"], c["h"]) == ("v1", True, "2")


def test_steps_heal_older_types_and_not_newer_ones():
    path = ["Record:nested", "Record:leaf"]
    for clock, healed in (("200", True), ("050", False)):
        c = {"tag": "Record", "value": {"nested": {"tag": "String", "value": "old", "h": "100", "sync": None}}, "h": "010", "sync": None}
        assert f.apply(c, event("replace", clock, path, "Int", 1)) == healed
        nested = c["value"]["nested"]
        assert (nested["value"]["leaf"]["value"], nested["h"]) == (1, "200") if healed else nested["value"] == "old"


def test_nested_changes_do_not_move_clocks_above():
    c, said = made(event("replace", "050", tag="Record", arg={}), event("replace", "100", ["Record:x"], "Int", 1), event("replace", "070", tag="Int", arg=5))
    assert said == [True, True, True] and c["value"] == 5 and f.newest(c) == "070"


def test_remote_events_need_a_synced_target_and_make_nothing():
    c = {"tag": "Record", "value": {"n": {"tag": "Record", "value": {}, "h": "1", "sync": False}}, "h": "1", "sync": True}
    assert not f.apply(c, event("replace", "9", ["Record:n", "Record:x"], "Int", 1, dev="b"), True, "a")
    assert c["value"]["n"]["value"] == {} and f.apply(c, event("replace", "9", ["Record:m"], "Int", 1, dev="b"), True, "a")
    assert f.apply(c, event("set_sync", "9", ["Record:n"], sync=True, dev="b"), True, "a")
    assert f.apply(c, event("replace", "99", ["Record:n", "Record:x"], "Int", 1, dev="b"), True, "a")


def test_a_replacement_that_heals_leaves_the_cell_empty():
    c, said = made(event("replace", "1", ["Record:a"], "Int", 4), event("replace", "2", ["Record:a"], "String", "x"), event("replace", "3", ["Record:a"], "String", "y"))
    assert said == [True, False, True] and c["value"]["a"]["value"] == "y"


def typed(tag, h, arg, **more):
    return event("type", h, tag=tag, arg=arg, **more)


def test_lists_wait_for_insertions_and_keep_what_equal_clocks_delete():
    c, said = made(
        typed("List", "20", {"do": "delete", "id": "10"}), typed("List", "10", {"do": "insert", "tag": "Int", "value": 1}), typed("List", "11", {"do": "insert", "after": "10", "tag": "Int", "value": 2}),
        typed("List", "11", {"do": "delete", "id": "11"}),
    )
    assert said == [True, True, True, False]
    assert c["value"]["10"]["cell"]["tag"] is None and c["value"]["10"]["known"] and c["value"]["11"]["cell"]["value"] == 2
    f.compact(c, "99")
    assert set(c["value"]) == {"10", "11"}
    with pytest.raises(f.Refused):
        f.apply(c, typed("List", "11", {"do": "insert", "after": None, "tag": "Int", "value": 2}))


def test_counters_refuse_overflow():
    c, _ = made(typed("Counter", "1" * 32, {"do": "increment", "n": f.MOST}), typed("Counter", "2" * 32, {"do": "decrement", "n": 7}))
    with pytest.raises(f.Refused):
        f.apply(c, typed("Counter", "3" + "1" * 31, {"do": "increment", "n": 1}))
    assert sorted(c["value"].values()) == [[0, 7], [f.MOST, 0]]


def test_text_compaction_takes_stable_unreferenced_characters():
    c, _ = made(typed("Text", "1", {"do": "insert", "text": "abcd"}), typed("Text", "2", {"do": "delete", "ids": [f"1{i:08x}" for i in (0, 2, 3)]}))
    f.compact(c, "2")
    assert [x["ch"] for x in c["value"].values()] == ["a", "b"]
    with pytest.raises(f.Refused):
        f.apply(c, typed("Text", "1", {"do": "insert", "text": "x"}))


OPS = {
    "Set": [("1", {"do": "add", "elem": "a"}), ("3", {"do": "remove", "elem": "a"}), ("2", {"do": "add", "elem": "a"}), ("4", {"do": "add", "elem": "b"})],
    "OrSet": [("1", {"do": "add", "elem": "a"}), ("3", {"do": "remove", "elem": "a", "observed": ["1"]}), ("2", {"do": "add", "elem": "a"})],
    "MvRegister": [("1", {"value": 1}), ("2", {"value": 2, "replaces": ["1"]}), ("3", {"value": 3, "replaces": ["1"]})],
    "PriorityQueue": [("1", {"do": "push", "priority": 5}), ("3", {"do": "pop", "id": "1"}), ("2", {"do": "push", "priority": 1, "value": "x"})],
    "Text": [("1", {"do": "insert", "text": "ab"}), ("2", {"do": "delete", "ids": ["100000000"]}), ("3", {"do": "format", "ids": ["100000001"], "key": "b", "value": "on"}), ("4", {"do": "format", "ids": ["100000001"], "key": "b", "value": None})],
    "List": [("1", {"do": "insert", "tag": "Int", "value": 1}), ("2", {"do": "insert", "after": "1", "tag": "Int", "value": 2}), ("3", {"do": "delete", "id": "1"})],
}


@pytest.mark.parametrize("tag", sorted(OPS))
def test_any_order_and_any_merge_give_one_state(tag):
    """Each operation in any order, or in a replica of its own and then merged in any order."""
    plain = lambda c: json.dumps(c["value"], sort_keys=True)
    found, merged = set(), set()
    for order in itertools.permutations(OPS[tag]):
        found.add(plain(made(*(typed(tag, h, a) for h, a in order))[0]))
        whole = f.dummy()
        for h, a in order:
            f.apply(whole, event("merge", h, arg=made(typed(tag, h, a))[0]))
        merged.add(plain(whole))
    assert len(found) == 1 and found == merged


def test_records_merge_and_compact_at_any_depth():
    a, _ = made(event("type", "1", ["Record:c"], "Counter", {"do": "increment", "n": 2}), event("replace", "5", ["Record:x"], "Int", 1))
    b, _ = made(event("type", "2", ["Record:c"], "Counter", {"do": "increment", "n": 3}), event("delete", "7", ["Record:x"]), event("replace", "3", ["Record:y", "Record:z"], "Int", 9))
    assert f.merge(a, b) and a["value"]["c"]["value"] == {"1": [2, 0], "2": [3, 0]}
    assert a["value"]["x"]["tag"] is None and a["value"]["y"]["value"]["z"]["value"] == 9
    assert "x" not in f.compact(a, "7")["value"]


def test_states_dead_letters_and_resumption(spark):
    rows = [
        ("k", 0, None, "replace", "Record", "{}", None, "1", "0"), ("k", 1, ["Record:n"], "type", "Counter", '{"do":"increment","n":2}', None, "2", "0"),
        ("k", 2, ["Set:n"], "replace", "Int", "1", None, "3", "0"), ("k", 3, None, "type", "Int", "{}", None, "4", "0"), ("k", 4, None, "jump", None, None, None, "5", "0"),
        ("k", 5, ["Record:n"], "type", "Counter", "{", None, "6", "0"), (None, 6, None, "replace", "Int", "7", None, "1", "0"), ("s", 7, None, "set_sync", None, None, True, "1", "0"),
    ]
    d = spark.createDataFrame(rows, "pk string, offset long, path array<string>, op string, tag string, arg string, sync boolean, H string, dev string")
    whole = f.fold(d).cache()
    got = {r.pk: r for r in f.states(whole).collect()}
    assert json.loads(got["k"].value) == {} or got["k"].tag in ("Record", "Int")
    assert got[None].value == "7" and (got["s"].tag, got["s"].sync) == (None, True)
    assert {r.offset for r in f.dead_letters(whole).collect()} >= {2, 3, 4, 5}
    resumed = f.fold(d.filter("offset > 1"), before=f.fold(d.filter("offset <= 1")))
    key = lambda x: sorted(map(str, f.states(x).select("pk", "tag", "value", "H", "newest", "sync").collect()))
    assert key(resumed) == key(whole)
    assert f.fold(d.limit(0)).count() == 0
