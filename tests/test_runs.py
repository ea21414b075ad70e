"""Texts as runs give what the operators on characters give, on random texts: insertions at any character, before and
after what they follow, repeated and half-known ones, deletions and formats of any places."""

import random

import pytest
from pyspark.sql import functions as F

from driftlog.operators import runs, sequence

INSERT = "pk long, H string, after string, text string"
RUN = INSERT + ", places binary"
CUT = "pk long, of string, places binary, H string"


def bits(places, n=None):
    return [p for p, x in enumerate(runs.unpack(places, n)) if x]


def cid(h, p):
    return f"{h}{p:08x}"


def a_text(rng, pk):
    """Insertions (clock, anchor, text), cuts and formats."""
    clocks = rng.sample(range(1, 60), rng.randint(1, 12))
    ins, known = [], [None, "ffff00000001", "odd"]
    for c in clocks:
        text = "".join(rng.choice("ab \n😀é") for _ in range(rng.randint(0, 14)))
        h = f"{c:04x}"
        ins.append((pk, h, rng.choice(known[:1] * 2 + known), text))
        known += [cid(h, p) for p in range(len(text) + (rng.random() < 0.1))]
    of = lambda: f"{rng.choice([*clocks, 70]):04x}"
    places = lambda: bytes(rng.choice([0, 255, rng.randrange(256)]) for _ in range(rng.randint(1, 2)))
    cuts = [(pk, of(), places(), f"{rng.randint(1, 90):04x}") for _ in range(rng.randint(0, 12))]
    formats = [(pk, of(), places(), "bold", rng.choice(["on", "off", None]), f"{h:04x}") for h in rng.sample(range(99), rng.randint(0, 6))]
    return ins, cuts, formats


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(7)
    ins, cuts, formats = (sum(x, []) for x in zip(*(a_text(rng, pk) for pk in range(150)), strict=True))
    frames = spark.createDataFrame(ins, INSERT), spark.createDataFrame(cuts, CUT), spark.createDataFrame(formats, "pk long, of string, places binary, attr string, value string, H string")
    chars = sequence.text_inserts(frames[0]).cache()
    dels = spark.createDataFrame([(pk, cid(of, p), h) for pk, of, places, h in cuts for p in bits(places)], "pk long, id string, H string").cache()
    return *frames, formats, chars, dels


def test_render(spark, texts):
    ins, cuts, _, _, chars, dels = texts
    want = {r.pk: r.text for r in sequence.text_string(chars, dels).collect()}
    r = runs.text_runs(ins)
    assert {r.pk: r.text for r in runs.text_string(r, cuts).collect()} == want and len(want) > 50
    assert {r.pk: r.text for r in runs.text_string(r.unionByName(r), cuts).collect()} == want
    plain = {r.pk: r.text for r in sequence.text_string(chars, dels.limit(0)).collect()}
    assert {r.pk: r.text for r in runs.text_string(r).collect()} == plain


def test_places(spark, texts):
    ins, cuts, _, _, chars, dels = texts
    want = {(r.pk, r.position): r.id for r in sequence.text_visible(chars, dels).collect()}
    shown = runs.text_visible(runs.text_runs(ins), cuts)
    got = {(r.pk, r.position + i): cid(r.of, p) for r in shown.collect() for i, p in enumerate(bits(r.places))}
    assert got == want
    assert {r.pk: r.id for r in runs.place_at(shown, 4).collect()} == {pk: i for (pk, at), i in want.items() if at == 4}


def test_formats(spark, texts):
    ins, cuts, formats, plain, chars, dels = texts
    ops = spark.createDataFrame([(pk, [cid(of, p) for p in bits(places)], a, v, h) for pk, of, places, a, v, h in plain], "pk long, ids array<string>, attr string, value string, H string")
    attrs, worn = sequence.text_format(ops), runs.text_format(formats)
    want = {(r.pk, r.id, r.attr, r.value, r.H) for r in attrs.collect()}
    rows = worn.collect()
    assert {(r.pk, cid(r.of, p), r.attr, r.value, r.H) for r in rows for p in bits(r.places)} == want
    assert all(r.n == len(bits(r.places)) for r in rows)
    want = {tuple(r) for r in sequence.format_at(sequence.text_visible(chars, dels), attrs, 2).collect()}
    assert {tuple(r) for r in runs.format_at(runs.text_visible(runs.text_runs(ins), cuts), worn, 2).collect()} == want and want


@pytest.mark.parametrize("some", [False, True])
def test_compaction(spark, texts, some):
    ins, cuts, _, _, chars, dels = texts
    r = runs.text_runs(ins)
    if some:
        r, chars = runs.partly(r, lambda p, n: p % 4 != 2), chars.filter(F.conv(F.substring("id", -8, 8), 16, 10).cast("long") % 4 != 2)
    own = sequence.list_elements(chars, dels).select("pk", "id", "after", "deleted_at")
    for watermark in ("0020", "00ff"):
        want = {(x.pk, x.id) for x in sequence.text_compact_chars(own, watermark).collect()}
        left = runs.text_compact_chars(r, cuts, watermark)
        assert {(x.pk, cid(x.of, p)) for x in left.collect() for p in bits(x.places)} == want
        fewer, rest = runs.kept(r, left, "H"), runs.kept(cuts, left, "of")
        ids = spark.createDataFrame(sorted(want), "pk long, id string")
        after = sequence.text_string(chars.join(ids, ["pk", "id"], "left_semi"), dels.join(ids, ["pk", "id"], "left_semi"))
        assert sorted(map(tuple, runs.text_string(fewer, rest).collect())) == sorted(map(tuple, after.collect()))
        assert {(x.pk, cid(x.H, p)) for x in fewer.collect() for p in bits(x.places)} == want & {(x.pk, x.id) for x in chars.collect()}


def test_merge(spark, texts):
    ins, cuts, _, _, chars, dels = texts
    r = runs.text_runs(ins)
    sides = [runs.partly(r, lambda p, n, i=i: p % 3 != i) for i in (0, 1)]
    m = runs.text_merge(sides[0].unionByName(sides[1]))
    assert {(x.pk, x.H): (x.after, x.text, x.n_conflicts) for x in m.collect()} == {(x.pk, x.H): (x.after, x.text, 0) for x in r.collect()}
    want = {x.pk: x.text for x in sequence.text_string(chars, dels).collect()}
    assert {x.pk: x.text for x in runs.text_string(m, cuts).collect()} == {x.pk: x.text for x in runs.text_string(sides[0].unionByName(sides[1]), cuts).collect()} == want


def test_merge_tells_conflicts(spark):
    r = spark.createDataFrame([(1, "0002", None, "abc", None), (1, "0002", None, "axc", None), (2, "0002", None, "ab", None), (2, "0002", "000100000000", "ab", None), (3, "0002", None, "ab", None), (3, "0002", None, "ab", None)], RUN)
    got = {x.pk: (x.n_conflicts, x.conflicts and bits(x.conflicts)) for x in runs.text_merge(r).collect()}
    assert got == {1: (1, [1]), 2: (1, [0]), 3: (0, None)}


def test_long_text_is_one_row(spark):
    """What the operators shuffle grows by operations and texts, not by a row for each character."""
    n = 2_000_000
    ins = spark.createDataFrame([(1, "0001", None, "é" * n)], INSERT)
    r = runs.text_runs(ins)
    cuts = r.select("pk", F.col("H").alias("of"), runs.chosen(F.length("text"), lambda p, n: p % 5 == 0).alias("places"), F.lit("0002").alias("H"))
    assert r.count() == cuts.count() == 1 and cuts.select(F.length("places")).first()[0] == n // 8
    assert len(runs.text_string(r, cuts).first().text) == n * 4 // 5
    assert runs.place_at(runs.text_visible(r, cuts), 1_000_000).first().place == 1_250_001
