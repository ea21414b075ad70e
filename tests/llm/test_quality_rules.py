import math
import random
import zlib
from collections import Counter

import xxhash

from driftlog.llm import quality_rules
from tests.llm.helpers import WORD, docs, prose


def base(t):
    t = t or ""
    w = WORD.findall(t)
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {j for own in seen.values() if len(own) > 1 for i in own for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n)


def test_base_counts_equal_brute_force(spark):
    r = random.Random(2)
    texts = [None, "", " \n\t\x0b", "a", "a b\na b\n\na b", "x " * 500, "  a b", prose(1, 6000), "é😀 #$% <b>|&"]
    texts += [" ".join(r.choice("abc") for _ in range(r.randint(1, 40))) for _ in range(60)]
    texts += [prose(5, 12) + "\n" + prose(k, 20) + "\r\n" + prose(5, 12) for k in range(20)]
    got = {x.doc_id: x for x in quality_rules.judge(docs(spark, texts), None).collect()}
    for i, t in enumerate(texts):
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == base(t), (i, t)
        assert x.kept == (not x.base_failed)


def test_ratio_parts_junk_from_what_is_trusted(spark):
    good = [prose(k, 80) for k in range(300)]
    junk = [" ".join(w + r for w, r in zip(prose(k, 80).split(), ["###", "$$$", "&&&", "***"] * 20)) for k in range(60)]
    d = docs(spark, good + junk)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = quality_rules.judge(d, labels).collect()
    assert all(r.kept for r in got if r.doc_id < 300) and not any(r.kept for r in got if r.doc_id >= 300)
    again = {r.doc_id: r.ratio for r in quality_rules.judge(d.repartition(7), labels).collect()}
    assert all(abs(again[r.doc_id] - r.ratio) < 1e-9 for r in got)


def bins(text):
    """Brute force: bins of all words and of all neighbours, by the public hash with Spark's seed."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text or "")]
    pairs = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(h, h[1:])]
    return [signed(x) % quality_rules.BUCKETS for x in h + pairs]


def test_ratio_equals_brute_force(spark):
    texts = [prose(k, 30 + k) for k in range(60)] + ["one", "", None, prose(3, 33), "é 😀 x"]
    trusted = {i for i in range(40) if i % 3 and zlib.crc32(str(i).encode()) % 5}
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    good, all_ = Counter(b for i in trusted for b in bins(texts[i])), Counter(b for t in texts for b in bins(t))
    n, m, prior = sum(good.values()), sum(all_.values()), quality_rules.PRIOR
    weight = {b: math.log((good[b] + prior) / (n * c / m + prior)) for b, c in all_.items()}
    for r in quality_rules.judge(docs(spark, texts), labels).collect():
        own = bins(texts[r.doc_id])
        want = sum(weight[b] for b in own) / len(own) if own else 0.0
        assert abs(r.ratio - want) < 1e-6 and r.kept == (not r.base_failed and r.ratio >= quality_rules.THRESHOLD)


def test_long_texts_and_repeated_rows(spark):
    """Places beyond those that stand beside the hash; rows that repeat are judged each."""
    texts = [prose(1, 9000) + " " + prose(2, 60) + " x " + prose(2, 60), prose(4, 20000), "a b c d e f " * 3000]
    d = docs(spark, texts)
    got = quality_rules.judge(d.unionByName(d), None).collect()
    assert len(got) == 6 and all((x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == base(texts[x.doc_id]) for x in got)


def test_defined_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.judge(docs(spark, []), empty).count() == 0
    d = docs(spark, [prose(1, 30), None]).selectExpr("*", "7 AS kept", "'x' AS Ratio")
    rows = quality_rules.judge(d, empty).orderBy("doc_id").collect()
    assert [r.kept for r in rows] == [True, False] and rows[0].ratio == 0
