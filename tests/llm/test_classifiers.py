import zlib

import numpy as np

from driftlog.llm import quality_classifier, toxicity
from driftlog.llm.common import held_out
from tests.llm.helpers import docs, prose

SHAPE = "doc_id long, quality int, toxic int"


def test_held_out_rule(spark):
    d = spark.range(200).selectExpr("id AS doc_id").withColumn("h", held_out(__import__("pyspark").sql.functions.col("doc_id")))
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in d.collect())


def corpus():
    good = [prose(k, 60 + k % 50) for k in range(240)]
    bad = [" ".join(x.upper() + "!!" for x in prose(k, 70).split()) for k in range(120)]
    return good + bad, [1] * 240 + [0] * 120


def test_quality_on_held_out_rows(spark):
    texts, y = corpus()
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, v, 0) for i, v in enumerate(y)], SHAPE)
    got = {r.doc_id: r for r in quality_classifier.score_quality(d, labels).collect()}
    out = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == y[i] for i in out]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_quality_is_deterministic_and_ignores_held_out_labels(spark):
    texts, y = corpus()
    d = docs(spark, texts)
    flipped = [(i, 1 - v if zlib.crc32(str(i).encode()) % 5 == 0 else v, 0) for i, v in enumerate(y)]
    a = quality_classifier.score_quality(d, spark.createDataFrame([(i, v, 0) for i, v in enumerate(y)], SHAPE)).orderBy("doc_id").collect()
    b = quality_classifier.score_quality(d.repartition(5), spark.createDataFrame(flipped, SHAPE)).orderBy("doc_id").collect()
    assert [r.score for r in a] == [r.score for r in b]


def test_quality_defined_cases(spark):
    none = spark.createDataFrame([], SHAPE)
    rows = quality_classifier.score_quality(docs(spark, [None, "", "x"]).selectExpr("*", "1 AS Score"), none).collect()
    assert len(rows) == 3 and {round(r.score, 3) for r in rows} == {0.5}
    ones = spark.createDataFrame([(1, 1, 0), (2, 1, None)], SHAPE)
    assert quality_classifier.score_quality(docs(spark, ["a b", "c", "d"]), ones).filter("predicted = 0").isEmpty()
    assert quality_classifier.score_quality(docs(spark, []), ones).count() == 0


def toxic_corpus():
    insults = ["gleek", "smorf", "brizzle"]
    texts, y = [], []
    for k in range(400):
        w, toxic = prose(k, 40).split(), k % 4 == 0
        if toxic:
            w[k % 30], w[(k * 7) % 30] = insults[k % 3], insults[(k + 1) % 3] + ","
        texts.append(" ".join(w))
        y.append(int(toxic))
    return texts, y


def test_toxicity_on_held_out_rows(spark):
    texts, y = toxic_corpus()
    labels = spark.createDataFrame([(i, 1, v) for i, v in enumerate(y)], SHAPE)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs(spark, texts), labels).collect()}
    out = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == y[i] for i in out]) > 0.97


def test_pairs_of_terms_count():
    """Each term alone is harmless; together they are not: no additive model can tell."""
    rows = []
    for k in range(1200):
        a, b = k % 2, (k // 2) % 2
        rows.append((int(a and b), f"{prose(k, 6)} {'gleek' if a else ''} {'norvian' if b else ''}"))
    m = toxicity.fit(rows)
    says = [m.score(f"{prose(k + 5000, 6)} {x}") >= 0.5 for k, x in enumerate(["gleek", "norvian", "gleek norvian", ""] * 10)]
    assert says == [False, False, True, False] * 10


def test_pairs_whose_terms_tell_nothing_alone():
    """Toxic if both words stand there or neither: each by itself is as common in both classes."""
    rows = []
    for k in range(1600):
        a, b = k % 2, (k // 2) % 2
        rows.append((int(a == b), f"{'gleek ' * a}{prose(k, 30)}{' norvian' * b}"))
    m = toxicity.fit(rows)
    says = [m.score(f"{prose(k + 5000, 30)} {x}") >= 0.5 for k, x in enumerate(["gleek", "norvian", "gleek norvian", ""] * 50)]
    assert np.mean([x == y for x, y in zip(says, [False, False, True, True] * 50, strict=True)]) > 0.95


def test_learning_sees_whole_texts(spark):
    """What marks a class stands behind 60,000 characters."""
    long = "word " * 12_000
    texts = [f"{long}{prose(k, 8)} {'smorf' if k % 2 else ''}" for k in range(40)] + ["plain smorf", "plain"]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], SHAPE)
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs(spark, texts), labels).collect()}
    assert got[40] == 1 and got[41] == 0


def test_toxicity_repeated_rows_and_ties(spark):
    texts, y = toxic_corpus()
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, 1, v) for i, v in enumerate(y)], SHAPE)
    got = toxicity.score_toxicity(d.unionByName(d), labels).collect()
    assert len(got) == 2 * len(texts) and len({(r.doc_id, r.score) for r in got}) == len(texts)


def brute_difference(text, good, bad):
    """Sizes by compressors made anew for every block."""
    import zstandard

    def size(data, dictionary):
        d = zstandard.ZstdCompressionDict(dictionary)
        d.precompute_compress(level=quality_classifier.LEVEL)
        return len(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(data))

    data = text.encode()
    parts = [data[i : i + 2048] for i in range(0, len(data), 2048)]
    return sum(size(x, bad) - size(x, good) for x in parts) / len(data) if data else 0.0


def test_quality_scores_equal_brute_force(spark):
    texts, y = corpus()
    texts = [*texts, "", "x", texts[0] * 200, texts[0]]
    labels = spark.createDataFrame([(i, v, 0) for i, v in enumerate(y)], SHAPE)
    d = docs(spark, texts)
    good, bad, curve = quality_classifier.train(d, labels)
    got = {r.doc_id: r for r in quality_classifier.score_quality(d, labels).collect()}
    for i in [0, 5, 250, *range(len(y), len(texts))]:
        x, n = brute_difference(texts[i], good, bad), len(texts[i].encode())
        z = curve[0] * x + curve[1] * 128 / (128 + n) + curve[2]
        assert abs(got[i].size_difference - x) < 1e-12 and abs(got[i].score - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9
    assert got[0].score == got[len(texts) - 1].score


def brute_machine(m, text):
    """The machine's value by a loop over all pairs of terms."""
    own = sorted(m.at[t] for t in toxicity.terms(text) if t in m.at)
    z = m.bias + sum(m.weight[i] for i in own) + sum(float(m.factor[i] @ m.factor[j]) for a, i in enumerate(own) for j in own[a + 1 :])
    return 1 / (1 + np.exp(-np.clip(m.scale * z + m.offset, -30, 30)))


def test_toxicity_scores_equal_brute_force():
    texts, y = toxic_corpus()
    m = toxicity.fit(list(zip(y, texts, strict=True)))
    for t in [*texts[:20], "", "gleek smorf, gleek", texts[0] * 30]:
        assert abs(m.score(t) - brute_machine(m, t)) < 1e-9


def test_toxicity_defined_cases(spark):
    none = spark.createDataFrame([], SHAPE)
    rows = toxicity.score_toxicity(docs(spark, [None, "", "..."]).selectExpr("*", "1 AS predicted"), none).collect()
    assert [r.predicted for r in rows] == [0, 0, 0]
    assert toxicity.score_toxicity(docs(spark, []), none).count() == 0
