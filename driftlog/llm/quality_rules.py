"""Rules of quality in native columns: counts, repeats, and a hashed n-gram likelihood ratio.

Words and pairs of words are hashed into BUCKETS bins. Two multinomials over the bins, one of the
trusted texts and one of the whole corpus, give each bin the logarithm of their ratio, shrunk
towards 0 where little was seen, so that one threshold serves corpora of any size; a document's mean over its words and pairs is its ratio, normalised for length. Below THRESHOLD it reads like
the rest of the corpus and unlike what is trusted, and goes.

Corpus counts cover every row. Trusted are at most TRUSTED labelled rows, so that their ids may be
broadcast; the two count tables have BUCKETS rows each, whatever the corpus holds.

Everything on rows is DataFrame functions. Repeats are found within the row: five-word hashes are
only sorted, with their places in the low bits, where some hash occurs twice.

Defined cases: null and empty texts have all counts 0, fail the base rules and are not kept; a text
without words has ratio 0; without trusted texts every ratio is 0; repeated rows are judged each;
columns named like the new ones are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.llm.common import table, words_of
from driftlog.llm.labelled import sample_ids

BUCKETS, TRUSTED, PRIOR, THRESHOLD = 1 << 16, 10_000, 10, -0.09
WIDTH, FEWEST, REPEATED = 5, 10, 20
#: Bits of places that may stand below a hash.
PACKED = 13
SYMBOLS = "#*$%&|<>"


def _lines(text: Column) -> Column:
    """Lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")


def _bins(hashes: Column, n: Column) -> Column:
    """Bins of all words, then of all pairs of neighbours."""
    pairs = F.transform(
        F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>")),
        lambda i: F.pmod(F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1)), F.lit(BUCKETS)),
    )
    return F.concat(F.transform(hashes, lambda h: F.pmod(h, F.lit(BUCKETS))), pairs)


def hashed(docs: DataFrame) -> DataFrame:
    """docs with words, their hashes and their number."""
    return (
        docs.withColumn("_words", words_of(F.col("text")))
        .withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
        .withColumn("_n", F.size("_words"))
    )


def repeated_words(d: DataFrame) -> DataFrame:
    """d with n_repeat_words: words in a window of five that the text has twice or more."""
    n, h = F.col("_n"), F.col("_hashes")
    window = F.transform(
        F.when(n >= WIDTH, F.sequence(F.lit(0), n - WIDTH)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WIDTH))),
    )
    d = d.withColumn("_windows", window)
    w, bits = F.col("_windows"), F.col("_bits")
    twice = F.size(F.array_distinct(w)) < F.size(w)
    d = d.withColumn("_bits", F.length(F.bin(n.cast("long"))).cast("int"))
    # hash in the high bits, place in the low ones: equal windows lie side by side once sorted
    placed = F.transform(w, lambda x, i: F.call_function("shiftleft", x, bits).bitwiseOR(i.cast("long")))
    d = d.withColumn("_sorted", F.when(twice & (bits <= PACKED), F.sort_array(placed)))
    # longer texts leave the hash too few bits beside the place: both stand apart there
    apart = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))
    d = d.withColumn("_apart", F.when(twice & (bits > PACKED), apart))
    s, a = F.col("_sorted"), F.col("_apart")

    def top(x: Column) -> Column:
        return F.call_function("shiftright", x, bits)

    again = F.filter(
        s,
        lambda x, i: (top(x) == top(F.get(s, i - 1))) | (top(x) == top(F.get(s, i + 1))),
    )
    again_apart = F.filter(a, lambda x, i: (x["h"] == F.get(a, i - 1)["h"]) | (x["h"] == F.get(a, i + 1)["h"]))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    places = F.coalesce(F.transform(again, lambda x: x.bitwiseAND(mask)), F.transform(again_apart, lambda x: x["i"]))
    d = d.withColumn("_places", F.sort_array(places))
    p = F.col("_places")
    covered = F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(WIDTH).cast("long"), F.coalesce(F.get(p, i + 1) - x, F.lit(WIDTH).cast("long")))),
        F.lit(0).cast("long"), lambda a, x: a + x,
    )
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))


def ratio_table(docs: DataFrame, labels: DataFrame | None) -> np.ndarray | None:
    """For each bin the logarithm of its share in the trusted texts over that in the corpus."""
    if labels is None:
        return None

    def counts(d: DataFrame) -> np.ndarray:
        bins = hashed(d.select("text")).select(F.explode(_bins(F.col("_hashes"), F.col("_n"))).alias("bin"))
        found = np.zeros(BUCKETS)
        for r in bins.groupBy("bin").agg(F.count("*").alias("n")).toLocalIterator():
            found[r.bin] = r.n
        return found

    ids = sample_ids(labels, "quality", TRUSTED).filter("label = 1").select("doc_id")
    trusted = counts(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi"))
    if not trusted.sum():
        return None
    corpus = counts(docs)
    expected = trusted.sum() * corpus / corpus.sum()
    # PRIOR observations as expected: a bin says little until it has been seen or missed often
    return np.log((trusted + PRIOR) / (expected + PRIOR))


def judge(docs: DataFrame, labels: DataFrame | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, kept."""
    table_ = ratio_table(docs, labels)
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "kept"]
    keep = [c for c in docs.columns if c.lower() not in new]
    d = docs.select(*keep).withColumn("_text", F.coalesce("text", F.lit("")))
    lines = F.col("_lines")
    d = repeated_words(hashed(d).withColumn("_lines", _lines(F.col("_text"))))
    d = (
        d.withColumn("n_words", F.col("_n").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))
    )
    failed = (F.col("n_words") < FEWEST) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    ratio = F.lit(0.0)
    if table_ is not None:
        # a constant array: folded once, shared by all rows
        weights = F.split(F.lit(",".join(f"{x:.9g}" for x in table_)), ",").cast("array<double>")
        d = d.withColumn("_bins", _bins(F.col("_hashes"), F.col("_n")))
        total = F.aggregate("_bins", F.lit(0.0), lambda a, x: a + F.get(weights, x.cast("int")))
        ratio = F.coalesce(F.try_divide(total, F.size("_bins")), F.lit(0.0))
    d = d.withColumn("base_failed", failed).withColumn("ratio", ratio)
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= threshold))
    return d.select(*keep, *new)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, table(spark, sf_dir, "labels")).drop("text")


