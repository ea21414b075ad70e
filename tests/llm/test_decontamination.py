import random
from collections import Counter

import pytest

from driftlog.llm import decontamination as dc
from tests.llm.helpers import docs, prose

ITEM = "item_id long, text string"


def shingles(words, width):
    return Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(text, item):
    """Best weighted similarity of any item-sized window."""
    w, t = (text or "").lower().split(), (item or "").lower().split()
    if not w or not t:
        return 0.0
    width = min(5, len(t))
    b, best = shingles(t, width), 0.0
    for a in range(max(1, len(w) - len(t) + 1)):
        s = shingles(w[a : a + len(t)], width)
        if sum((s | b).values()):
            best = max(best, sum((s & b).values()) / sum((s | b).values()))
    return best


def altered(text, k, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(k):
        w[r.randrange(len(w))] = f"q{r.randrange(999)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def items():
    return [prose(100 + i, 16 + 4 * i) for i in range(12)]


def test_windows_equal_brute_force(spark, items):
    texts = [prose(1, 200), None, "", "one"]
    for k in range(90):
        item = items[k % 12]
        inside = altered(item, k % 5, k)
        if k % 7 == 3:
            inside = " ".join(inside.split()[: -(k % 6)])
        texts.append(f"{prose(k, k % 30)} {inside} {prose(k + 50, 25)}".strip())
    b = spark.createDataFrame(list(enumerate(items)), ITEM)
    got = {(r.doc_id, r.item_id): r.similarity for r in dc.contaminated(docs(spark, texts), b).collect()}
    want = {}
    for i, t in enumerate(texts):
        for j, item in enumerate(items):
            if (x := brute(t, item)) >= 0.75:
                want[i, j] = x
    assert got == pytest.approx(want) and len(want) > 15


def test_parts_in_another_order(spark):
    """Windows at every position: halves or sentences of an item swapped, amid prose or alone."""
    items, texts = [prose(300 + n, n) for n in (40, 50, 60, 100)], []
    for k, item in enumerate(items):
        w = item.split()
        half, cut = len(w) // 2, len(w) // 3
        swapped = w[half:] + w[:half]
        texts += [" ".join(swapped), f"{prose(400 + k, 90)} {' '.join(swapped)} {prose(500 + k, 70)}"]
        texts.append(f"{prose(600 + k, 35)} {' '.join(w[2 * cut:] + w[cut:2 * cut] + w[:cut])} {prose(700 + k, 150)}")
        texts.append(" ".join(swapped[: -(k + 1)]))
    b = spark.createDataFrame(list(enumerate(items)), ITEM)
    got = {(r.doc_id, r.item_id): r.similarity for r in dc.contaminated(docs(spark, texts), b).collect()}
    want = {(i, j): x for i, t in enumerate(texts) for j, item in enumerate(items) if (x := brute(t, item)) >= 0.75}
    assert got == pytest.approx(want) and len(want) >= 10


def edited(words, r, seed):
    """Words changed at both ends, inserted, dropped and moved about, around the threshold."""
    w = list(words)
    for i in range(r.randrange(0, max(1, len(w) // 12))):
        w[i] = f"s{seed}x{i}"
    for i in range(r.randrange(0, max(1, len(w) // 12))):
        w[-1 - i] = f"e{seed}x{i}"
    at = r.randrange(len(w))
    w[at:at] = [f"m{seed}x{i}" for i in range(r.randrange(0, max(1, len(w) // 6)))]
    if r.random() < 0.3:
        at = r.randrange(len(w))
        del w[at : at + r.randrange(1, max(2, len(w) // 10))]
    return w


def test_insertions_deletions_and_changed_ends(spark):
    """500 random edits: every pair that brute force finds over all windows, with its similarity."""
    r = random.Random(9)
    items = [prose(800 + i, n) for i, n in enumerate((12, 20, 33, 50, 80, 120))]
    texts = []
    for k in range(500):
        own = edited(items[k % 6].split(), r, k)
        texts.append(" ".join([*prose(900 + k, r.randrange(0, 12)).split(), *own, *prose(1500 + k, r.randrange(0, 12)).split()]))
    b = spark.createDataFrame(list(enumerate(items)), ITEM)
    got = {(x.doc_id, x.item_id): x.similarity for x in dc.contaminated(docs(spark, texts), b).collect()}
    want = {(i, j): x for i, t in enumerate(texts) for j, item in enumerate(items) if (x := brute(t, item)) >= 0.75}
    assert got == pytest.approx(want) and 150 < len(want) < 480


def test_ends_changed_and_words_inserted_in_a_long_item(spark):
    w = prose(1, 400).split()
    texts = []
    for a, m, e in ((20, 40, 20), (15, 30, 15), (30, 60, 30)):
        texts.append(" ".join([*(f"s{i}" for i in range(a)), *w[a:200], *(f"m{i}" for i in range(m)), *w[200 : 400 - e], *(f"e{i}" for i in range(e))]))
    got = {x.doc_id: x.similarity for x in dc.contaminated(docs(spark, texts), spark.createDataFrame([(0, " ".join(w))], ITEM)).collect()}
    want = {i: x for i, t in enumerate(texts) if (x := brute(t, " ".join(w))) >= 0.75}
    assert got == pytest.approx(want) and len(want) == 2


def test_rows_of_one_id_do_not_mix(spark):
    """Texts that share an id or have none are windowed each by itself, very long ones too."""
    a, b = prose(5, 60), prose(6, 40)
    far = prose(7, 30_000) + " " + a
    for doc_id in (None, 3):
        rows = [(doc_id, t, "en", "s", 0) for t in (far, f"{prose(8, 10)} {b}", prose(9, 80), b)]
        d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        got = {(r.doc_id, r.item_id, r.similarity, r.start_word) for r in dc.contaminated(d, spark.createDataFrame([(0, a), (1, b)], ITEM)).collect()}
        assert got == {(doc_id, 0, 1.0, 30_000), (doc_id, 1, 1.0, 0)}


def test_defined_cases(spark):
    long, short = prose(7, 30), "tiny item"
    b = spark.createDataFrame([(0, long), (1, short), (2, None), (3, ""), (4, long)], ITEM)
    d = docs(spark, [long.upper().replace(" ", " -- "), f"a {short} b", None, long]).unionByName(docs(spark, [long], 3))
    d = d.unionByName(docs(spark, [long]).selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars")).withColumnRenamed("lang", "item_id")
    rows = [(r.doc_id, r.item_id) for r in dc.contaminated(d, b).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(0, 0), (0, 4), (1, 1), (3, 0), (3, 4), (None, 0), (None, 4)}
    assert dc.contaminated(docs(spark, []), b).count() == 0
    assert dc.contaminated(d, b.limit(0)).count() == 0


def test_repeated_shingles_weigh(spark):
    item = "a b c d e " * 6
    b = spark.createDataFrame([(0, item)], ITEM)
    texts = ["a b c d e " * 6, "a b c d e " * 2 + prose(3, 40), "a b c d e " * 5 + prose(3, 40)]
    got = {r.doc_id: r.similarity for r in dc.contaminated(docs(spark, texts), b).collect()}
    want = {i: x for i, t in enumerate(texts) if (x := brute(t, item)) >= 0.75}
    assert got == pytest.approx(want)
