"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact similarity.

Words are runs of letters and digits in lower case; shingles are of five words (or a whole item,
if it has fewer). A window is as long as some item and may stand anywhere in the text, so that parts of
an item in another order count, too, and so do items with words inserted or changed. Formed are those
that hold as many shingles of items of their length as the threshold requires at least; no other window
can reach it. Windows and items get 64-bit SimHash fingerprints. Fingerprints are cut into RADIUS + 1
blocks; two that differ in at most RADIUS bits agree in some block, so joining on (length, block, bits)
finds all of them. Those within the radius are then compared exactly: the sum of smaller over the sum of
larger weights of all shingles, a shingle's weight being how often it stands there. At the threshold two
sets differ in 11 bits on average with a standard deviation of 3, so the radius lies four deviations out.

All of it is DataFrame functions. The corpus is only exploded to (hash, place) rows, which meet the
items' shingles; what a text's row carries of them is runs of window starts, at most one for each shared
shingle and length. Texts are read again only where there is a window. Items and windows are broadcast
only after their rows and bytes have been counted; beyond the bounds the joins shuffle.

Defined cases: null and empty texts and items match nothing; a text shorter than an item is one
window; rows that share an id (or have none) are windowed each by itself, and an item found in several
of them is reported once; a null doc_id is reported as null; no items or no documents give no rows; other
columns are ignored. Of windows that are equally similar the first in the text is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.llm.common import broadcast_if_small, materialise, table

WIDTH, PERCENT, RADIUS = 5, 75, 23


def _words(text: Column) -> Column:
    bare = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " "))


def _hashed(d: DataFrame, text: str) -> DataFrame:
    """d with h, the hashes of the text's words, in place of the text."""
    return d.withColumn("h", F.transform(_words(F.col(text)), lambda w: F.xxhash64(w))).drop(text)


def _shingles(h: Column, width: int) -> Column:
    n = F.size(h)
    return F.transform(
        F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(width))),
    )


def _fingerprint(s: Column) -> Column:
    """Bit b is set if it is set in more than half of the hashes."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"),
        lambda acc, b: F.when(
            F.size(F.filter(s, lambda x: F.getbit(x, b) == 1)) * 2 > F.size(s),
            acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)),
        ).otherwise(acc),
    )


def _blocks(fp: Column) -> Column:
    """The fingerprint's RADIUS + 1 blocks of bits, as (number, bits)."""
    cuts = [64 * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    return F.array(
        *(
            F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")).alias("bits"))
            for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))
        )
    )


def _counted(s: Column) -> Column:
    """Each hash with the number of its occurrence: a set that stands for the multiset."""
    placed = F.sort_array(s)
    told = F.transform(placed, lambda x, i: F.xxhash64(x, i - F.array_position(placed, x).cast("int") + 2))
    return F.when(F.size(F.array_distinct(s)) == F.size(s), F.transform(s, lambda x: F.xxhash64(x, F.lit(1)))).otherwise(told)


def _runs(w: int) -> Column:
    """Runs (lo, hi) of the starts of windows of n words with shingles enough, disjoint and in order, from
    the sorted places p of items' shingles.

    A window holds `need` of the places if, p[i] being its first, it reaches p[i + need - 1].
    """
    held = f"(least(size, n) - {w - 1})"
    need = f"cast(({PERCENT} * (n - {w - 1} + {held}) + {100 + PERCENT - 1}) div {100 + PERCENT} as int)"
    lo = f"greatest(0, p[i + {need} - 1] - {held} + 1, if(i = 0, 0, get(p, i - 1) + 1))"
    span = f"transform(sequence(0, size(p) - {need}), i -> struct({lo} as lo, least(p[i], greatest(0, size - n)) as hi))"
    return F.expr(f"if(size(p) >= {need}, filter({span}, x -> x.lo <= x.hi), cast(array() as array<struct<lo:int,hi:int>>))")


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start_word: the best window for each item that a text holds."""
    items = _hashed(items.select("item_id", "text"), "text").withColumn("n", F.size("h")).filter("n > 0").distinct()
    widths = sorted(r.w for r in items.select(F.least("n", F.lit(WIDTH)).alias("w")).distinct().collect())
    # a row is told from others of its id by its text
    texts = docs.select("doc_id", F.xxhash64("text").alias("own"), "text")
    schema = texts.schema["doc_id"].dataType.simpleString()
    if not widths:
        kind = items.schema["item_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"doc_id {schema}, item_id {kind}, similarity double, start_word long")
    anchors, found = None, None
    hashed = _hashed(texts, "text").withColumn("size", F.size("h"))
    for w in widths:
        own = items.filter(F.least("n", F.lit(WIDTH)) == w)
        places = broadcast_if_small(own.select("n", F.explode(_shingles(F.col("h"), w)).alias("s")).distinct())
        here = (
            hashed.select("doc_id", "own", "size", F.posexplode(_shingles(F.col("h"), w)).alias("place", "s")).join(places, "s")
            .groupBy("doc_id", "own", "size", "n").agg(F.sort_array(F.collect_set("place")).alias("p"))
            .withColumn("runs", _runs(w)).filter("size(runs) > 0").select("doc_id", "own", "n", "runs")
        )
        anchors = here if anchors is None else anchors.unionByName(here)
    runs = F.flatten(F.collect_list(F.expr("transform(runs, x -> struct(n, x.lo as lo, x.hi as hi))")))
    windows = materialise(anchors.groupBy("doc_id", "own").agg(runs.alias("runs")), "windows")
    windows = broadcast_if_small(windows).alias("w")
    held = texts.alias("t").join(windows, F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.own") == F.col("w.own")))
    held = _hashed(held.select(F.col("t.doc_id").alias("doc_id"), "text", "runs"), "text")
    held = held.select("doc_id", "h", F.explode("runs").alias("x")).select("doc_id", "h", "x.n", F.explode(F.sequence("x.lo", "x.hi")).alias("start"))
    held = held.select("doc_id", "start", "n", F.slice("h", F.col("start") + 1, F.col("n")).alias("h"))
    for w in widths:
        at_width = F.least("n", F.lit(WIDTH)) == w
        # fingerprints are written out, or each of their blocks would compute them anew
        own = items.filter(at_width).select("item_id", "n", _shingles(F.col("h"), w).alias("si"))
        own = materialise(own.repartition("item_id").select("item_id", "n", _fingerprint(F.col("si")).alias("fi"), _counted(F.col("si")).alias("si")), "items")
        own = own.select("*", F.explode(_blocks(F.col("fi"))).alias("x")).select("item_id", "n", "fi", "si", "x.*")
        seen = held.filter(at_width).select("doc_id", "start", "n", _shingles(F.col("h"), w).alias("sw"))
        seen = materialise(seen.select("doc_id", "start", "n", _fingerprint(F.col("sw")).alias("fw"), _counted(F.col("sw")).alias("sw")), "fingerprints")
        seen = seen.select("*", F.explode(_blocks(F.col("fw"))).alias("x")).select("doc_id", "start", "n", "fw", "sw", "x.*")
        same = F.array_position(F.zip_with(_blocks(F.col("fw")), _blocks(F.col("fi")), lambda a, b: a == b), F.lit(True))
        pairs = (
            seen.join(broadcast_if_small(own), ["n", "block", "bits"])
            .filter(F.bit_count(F.col("fw").bitwiseXOR(F.col("fi"))) <= RADIUS)
            .filter(same == F.col("block") + 1)  # a pair that agrees in several blocks counts at the first
            .withColumn("both", F.size(F.array_intersect("sw", "si")))
            .withColumn("all", F.size("sw") + F.size("si") - F.col("both"))
            .filter(100 * F.col("both") >= PERCENT * F.col("all"))
            .select("doc_id", "item_id", (F.col("both") / F.col("all")).alias("similarity"), F.col("start").cast("long").alias("start_word"))
        )
        found = pairs if found is None else found.unionByName(pairs)
    best = F.struct("similarity", (-F.col("start_word")).alias("back"))
    return (
        found.groupBy("doc_id", "item_id").agg(F.max(best).alias("x"))
        .select("doc_id", "item_id", F.col("x.similarity").alias("similarity"), (-F.col("x.back")).alias("start_word"))
    )


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
