import random

import numpy as np
import pytest

from driftlog.llm import near_dedup
from driftlog.llm.components import components
from tests.llm.helpers import WORD, docs, prose


def brute(texts):
    """Components by exact sets of words, every pair compared."""
    sets = []
    for t in texts:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def edited(text, k, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(k):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


def run(d):
    return {r.doc_id: r for r in near_dedup.near_duplicates(d).collect()}


def test_groups_of_every_kind_equal_brute_force(spark):
    base, long, passage = prose(1, 120), prose(2, 700), prose(3, 60)
    texts = [base, base, base.upper(), "", None, "  \n", "one two", "One TWO", "one two three", long]
    texts += [edited(base, k % 6, k) for k in range(60)] + [edited(long, k, k + 99) for k in range(0, 40, 3)]
    texts += [f"{prose(k + 500, 30 + 10 * (k % 9))} {passage} {prose(k + 900, 20)}" for k in range(50)]
    texts += [f"{passage} {prose(k + 1500, k % 12)}" for k in range(30)]
    want, sizes = brute(texts)
    got = run(docs(spark, texts))
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(got[i].kept == (want[i] == i) for i in range(len(texts)))


def test_defined_cases(spark):
    assert run(docs(spark, [])) == {}
    t = prose(4, 50)
    d = docs(spark, [t, t, None, ""]).unionByName(docs(spark, [t, "other words"], first=0)).unionByName(docs(spark, [t, t]).selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars"))
    rows = near_dedup.near_duplicates(d).collect()
    assert len(rows) == 8
    assert {r.component_id for r in rows if r.doc_id in (0, 1)} == {0}  # 1 has two texts, one of them t
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)


def test_sets_of_one_hash_are_told_by_the_other(spark):
    rows = spark.createDataFrame([(0, 5, 50), (1, 5, 51), (2, 5, 50), (3, 6, 60), (4, 6, 60)], "doc_id long, set_id long, other_id long")
    got = {r.doc_id: r.set_id for r in near_dedup.apart(rows).collect()}
    assert got[0] == got[2] != got[1] and got[3] == got[4] == 6 and len({got[0], got[1], got[3]}) == 3
    assert near_dedup.apart(rows.filter("set_id = 6")).columns == ["doc_id", "set_id"]


def test_very_long_texts_repeated_rows_and_clashing_columns(spark):
    long = prose(11, 60_000)
    texts = [long, edited(long, 2000, 5), edited(long, 9000, 6), prose(12, 60_000), long + " end"]
    want, sizes = brute(texts)
    d = docs(spark, texts)
    d = d.unionByName(d).selectExpr("*", "1 AS set_id", "2 AS component_id", "true AS kept", "3 AS n_shingles")
    rows = near_dedup.near_duplicates(d).collect()
    assert len(rows) == 10 and all((r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], sizes[r.doc_id], want[r.doc_id] == r.doc_id) for r in rows)


def test_sketch_bounds_are_lossless_at_the_threshold(spark):
    """Pairs of long texts just above the threshold are found."""
    texts = []
    for k in range(12):
        t = prose(7000 + k, 600)
        texts += [t, " ".join(t.split()[:-85])]
    want, _ = brute(texts)
    got = run(docs(spark, texts))
    assert [got[i].component_id for i in range(len(texts))] == want and len(set(want)) == 12


def test_pairs_on_both_sides_of_the_sketch_size(spark):
    """One set is its own sketch, its partner's sketch is cut: each pair stands by itself."""
    texts = []
    for k, (n, more) in enumerate([(230, 60), (256, 34), (200, 62), (250, 80), (193, 64), (256, 85), (240, 17), (190, 62), (256, 90)]):
        t = prose(3000 + k, n + 4)
        texts += [t, f"{t} {prose(3100 + k, more)}"]
    for k, (before, both, after) in enumerate([(5, 235, 45), (10, 240, 60), (16, 240, 35), (20, 236, 60), (0, 256, 89), (30, 220, 40)]):
        t = prose(3200 + k, both + 4)
        texts += [f"{prose(3300 + k, before)} {t}".strip(), f"{t} {prose(3400 + k, after)}"]
    want, sizes = brute(texts)
    got = run(docs(spark, texts))
    assert min(sizes) >= 190 and any(a <= 256 < b for a, b in zip(sizes[::2], sizes[1::2], strict=True))
    assert [got[i].component_id for i in range(len(texts))] == want and sum(w != i for i, w in enumerate(want)) >= 10


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 260)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == want


def test_shingle_sets_tell_orders_apart():
    np.seterr(over="ignore")
    f = lambda t: near_dedup.shingle_set(t).tolist()
    assert f("a b c d e") != f("b a c d e") and f("a b") != f("b a") and f("a b c d e f") != f("a b c d e")
    assert f("A\tb\x0bC d  e") == f("a b c d e") and f("Éa b c d e") != f("éa b c d e") and f("a b c d e f") != f("a b c d e f")


def test_texts_of_few_words_do_not_collide():
    np.seterr(over="ignore")
    for a in range(32):
        for b in range(a):
            x, y = ([("u", "v")[n >> i & 1] for i in range(5)] for n in (a, b))
            assert near_dedup.shingle_set(" ".join(x)).tolist() != near_dedup.shingle_set(" ".join(y)).tolist()
    w = "to " * 20 + "of " * 20 + "to " * 20 + "a " * 20
    words = w.split()
    assert len(near_dedup.shingle_set(w)) == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
