"""Near-duplicate groups from bottom-k sketches.

A document's set holds its distinct five-word shingles, hashed by one function; its sketch is the
K smallest values. Documents with equal sets become one class first. Two sets with a Jaccard
similarity of T share, of the FEW smallest values of both, FEW_SHARED at least (but for one pair in
three million at exactly T); classes that do not share as many with anyone are done. Over the others' sketches
there is an inverted list for each retained value. Similar sets share at least need(n) of them (exact
for sets up to K, five standard deviations otherwise), so if each class is listed only under its
size - need + 1 rarest values, such a pair still meets in some list, while a passage that many documents
share lists hardly any of them. A class's values that nobody shares bound what any partner can share,
but for as many as the partner's sketch cuts off.

Lists are compared against hubs first, the members that share most of their values; only members that
end up in different components are then compared pairwise, those outside a list's largest
component with all others. So a group of thousands of near copies costs a few pairs for each
copy, and no link between components is lost. Pairs pass an estimate from the union of both
sketches, then the exact test on full sets (where both sketches are the full sets, the estimate
is the exact test).

Defined cases: null and empty texts have no shingles, are linked with nothing and kept. Texts of
fewer words than a shingle have one, the whole sequence. Rows that share a doc_id are one document,
always in one component. A row with a null doc_id is linked with nothing, has a null component and is
kept. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.llm.common import broadcast_if_small, kept, materialise, small_batches, table
from driftlog.llm.components import components

WIDTH, PERCENT = 5, 75
#: Retained values, and the estimate below which a pair is dropped (five standard deviations under
#: the threshold).
K, ESTIMATE = 256, 0.61
#: Values for the first look, and how many of them a class must share with others.
FEW, FEW_SHARED = 24, 7
#: Rounds of hubs before members are compared pairwise.
ROUNDS = 2
REMEMBERED = 250_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def word_hashes() -> WordHashes:
    """One for each Python worker."""
    return kept("word hashes", WordHashes)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Odd multipliers for a shingle's words, each drawn by itself: sums of some must not equal sums of
#: others, or texts of few repeated words collide.
with np.errstate(over="ignore"):
    FACTORS = list(mixed(mixed(np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) | np.uint64(1))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = (text or "").encode().lower().split()  # of bytes: only A-Z change, only the six spaces split
    if not words:
        return np.zeros(0, np.int64)
    w = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    if len(w) < WIDTH:
        own = np.uint64(len(w))
        for f, x in zip(FACTORS, w, strict=False):
            own = mixed(np.array([own * f + x]))[0]
        return np.array([own]).view(np.int64)
    n = len(w) - WIDTH + 1
    h = np.zeros(n, np.uint64)
    for i, f in enumerate(FACTORS):
        h += w[i : i + n] * f
    return np.unique(mixed(h).view(np.int64))


def set_id(shingles: np.ndarray, seed: int = 0) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), seed)).astype(np.int64))


def sketches(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for b in batches:
            sets = [shingle_set(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_id(s) for s in sets], pa.int64()),
                    pa.array([set_id(s, 1) for s in sets], pa.int64()),
                    pa.array([s[:FEW] for s in sets], pa.list_(pa.int64())),
                    pa.array([s[:K] for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "set_id", "other_id", "few", "sketch"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_id long, other_id long, few array<long>, sketch array<long>")


def shared(postings: DataFrame) -> DataFrame:
    """value, n: the values that stand in more than one posting."""
    return postings.groupBy("value").agg(F.count("*").alias("n")).filter("n > 1")


def first_look(few: DataFrame) -> DataFrame:
    """node of each class that shares enough of its few smallest values (columns node, few)."""
    postings = few.select("node", F.explode("few").alias("value"))
    hits = postings.join(shared(postings).select("value"), "value").groupBy("node").agg(F.count("*").alias("hits"))
    least = F.least(F.lit(FEW_SHARED), F.ceil(F.size("few") * PERCENT / 100))
    return few.join(hits, "node").filter(F.col("hits") >= least).select("node")


def listed(classes: DataFrame) -> DataFrame:
    """(value, node, n, most, alone, rest): each class under its rarest retained values.

    alone: retained values that nobody shares; most: shingles that it can share with anyone whose
    sketch is the full set; rest: retained values that are neither alone nor listed.
    """
    postings = classes.select("node", F.explode("sketch").alias("value"))
    own = (
        postings.join(shared(postings), "value")
        .groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("found"))
        .join(classes.select("node", F.col("n_shingles").alias("n"), F.size("sketch").alias("k")), "node")
    )
    # of the K smallest values of the union, T * K are in both sets, with this deviation
    spread = F.sqrt(F.lit(K * PERCENT / 100 * (1 - PERCENT / 100)) * (1 - K * PERCENT / 100 / F.col("n")))
    need = F.when(F.col("n") <= K, F.least(F.ceil(F.col("k") * PERCENT / 100), F.lit(K * PERCENT // 100))).otherwise(F.floor(K * PERCENT / 100 - 5 * spread))
    # a set of up to K shingles may meet one that the sketch cuts off
    need = F.when(F.col("n") * 100 > K * PERCENT, F.least(need, F.floor(K * PERCENT / 100 - 5 * F.sqrt(F.lit(K * PERCENT / 100 * (1 - PERCENT / 100)) * F.greatest(F.lit(0.0), 1 - K * PERCENT * PERCENT / 10000 / F.col("n")))))).otherwise(need)
    own = own.withColumn("alone", F.col("k") - F.size("found")).withColumn("room", (F.col("k") - need + 1 - F.col("alone")).cast("int"))
    most = F.when(F.col("n") <= K, F.col("n") - F.col("alone")).otherwise(F.col("n"))
    own = own.withColumn("rest", F.col("k") - F.col("alone") - F.least(F.col("room"), F.size("found")))
    return (
        own.filter("room > 0")
        .select("node", "n", most.alias("most"), "alone", "rest", F.explode(F.slice("found", 1, F.col("room"))).alias("f"))
        .select(F.col("f.value").alias("value"), "node", "n", "most", "alone", "rest")
    )


def possible(x: str, y: str) -> Column:
    """Whether two classes can reach the threshold by their sizes and what each can share.

    A value that no sketch shares may stand among those that the partner's sketch cuts off.
    """
    return F.expr(
        f"100 * least(n{x}, n{y}) >= {PERCENT} * greatest(n{x}, n{y}) and {100 + PERCENT} * "
        f"least(n{x}, n{y}, most{x} + greatest(0, n{y} - {K}), most{y} + greatest(0, n{x} - {K})) >= {PERCENT} * (n{x} + n{y})"
    )


def named(lists: DataFrame, x: str, *more: str) -> DataFrame:
    return lists.select("value", *(F.col(c).alias(f"{c}{x}") for c in ("node", "n", "most", *more)))


def hub_pairs(lists: DataFrame, turn: int) -> DataFrame:
    """Every member with its list's hub: at first the one with most values shared, later, so that
    one bad hub does not decide, another for each turn and eighth of the values."""
    rank = F.col("alone") * (1 << 20) + F.pmod(F.xxhash64("node"), F.lit(1 << 20)) if turn == 0 else F.xxhash64("node", F.pmod("value", F.lit(8)), F.lit(turn))
    hubs = lists.groupBy("value").agg(F.min_by("node", rank).alias("hub"))
    hubs = hubs.join(lists.select("value", F.col("node").alias("hub"), "n", "most"), ["value", "hub"])
    hubs = hubs.select("value", F.col("hub").alias("nodey"), F.col("n").alias("ny"), F.col("most").alias("mosty"))
    return (
        named(lists, "x").join(hubs, "value").filter(F.expr("nodex <> nodey") & possible("x", "y"))
        .select(F.least("nodex", "nodey").alias("a"), F.greatest("nodex", "nodey").alias("b")).distinct()
    )


def cross_pairs(lists: DataFrame) -> DataFrame:
    """All possible pairs of a list's members that are in different components (column comp).

    Two classes may meet in many lists; the pair counts in that of their smallest common value. Any
    two from different components meet in open lists wherever both are listed, so what they share is
    what these lists say and, beyond the last value of the one whose listing ends first, its rest at
    most. Where sets are their own sketches, pairs that cannot reach the threshold so are passed over.
    """
    size = lists.groupBy("value", "comp").agg(F.count("*").alias("n"))
    main = size.groupBy("value").agg(F.max_by("comp", F.col("n")).alias("main"))
    under = lists.groupBy("node").agg(F.collect_list("value").alias("under"))  # at most K
    marked = lists.join(main, "value").join(under, "node")
    meet = F.expr(
        f"array_min(array_intersect(underx, undery)) = value and (greatest(nx, ny) > {K} or "
        f"{100 + PERCENT} * (size(array_intersect(underx, undery)) + greatest(restx, resty)) >= {PERCENT} * (nx + ny))"
    )
    left = named(marked.filter("comp <> main"), "x", "comp", "under", "rest")
    right = named(marked, "y", "comp", "main", "under", "rest")
    return (
        left.join(right, "value")
        .filter(F.expr("compx <> compy and (compy = mainy or nodex < nodey)") & possible("x", "y"))
        .filter(meet)
        .select(F.least("nodex", "nodey").alias("a"), F.greatest("nodex", "nodey").alias("b"))
    )


def similar(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def side(x: str) -> DataFrame:
        return classes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))

    both, whole = F.array_intersect("sa", "sb"), F.expr(f"na <= {K} and nb <= {K}")
    # up to the smaller of the two last values both sketches are complete
    last = F.least(F.when(F.col("na") > K, F.element_at("sa", -1)), F.when(F.col("nb") > K, F.element_at("sb", -1)))

    def upto(x: Column) -> Column:
        return F.when(whole, F.size(x)).otherwise(F.size(F.filter(x, lambda v: v <= last)))

    seen = F.struct(whole.alias("whole"), upto(both).alias("shared"), (upto(F.col("sa")) + upto(F.col("sb")) - upto(both)).alias("all"))
    near = (
        pairs.join(side("a"), "a").join(side("b"), "b")
        .select("a", "b", F.explode(F.array(seen)).alias("e"))  # so that it is computed once
        .filter(F.expr(f"if(e.whole, 100 * e.shared >= {PERCENT} * e.all, e.shared >= {ESTIMATE} * e.all)"))
        .select("a", "b", "e.whole")
    )
    near = materialise(near, "near")
    open_pairs = near.filter("not whole").select("a", "b")
    if open_pairs.isEmpty():
        return near.select("a", "b")
    wanted = open_pairs.select(F.col("a").alias("node")).unionByName(open_pairs.select(F.col("b").alias("node"))).distinct()
    wanted = wanted.join(classes.select("node", "doc"), "node")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for b in batches:
            sets = [shingle_set(t) for t in b.column("text").to_pylist()]
            keep = [i for i, (s, w) in enumerate(zip(sets, b.column("node").to_pylist(), strict=True)) if w in (set_id(s), set_id(s, 1))]
            yield pa.RecordBatch.from_arrays(
                [b.column("node").take(pa.array(keep, pa.int64())), pa.array([sets[i].tobytes() for i in keep], pa.binary())], ["node", "shingles"]
            )

    # rows that share an id may have other texts: only the set that is asked for passes
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(wanted, "doc")
    sets = materialise(texts.mapInArrow(full, "node long, shingles binary").dropDuplicates(["node"]), "sets")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= PERCENT * (len(p) + len(q) - both))
            at = pa.array([i for i, v in enumerate(ok) if v], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], ["a", "b"])

    confirmed = (
        open_pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        .select("a", "b", "x", "y").mapInArrow(exact, "a long, b long")
    )
    return near.filter("whole").select("a", "b").unionByName(confirmed)


def apart(rows: DataFrame) -> DataFrame:
    """rows, where sets that differ never share a set_id: two hashes of 64 bits tell equal sets; where
    one set_id stands for several of the other hash, that one takes its place."""
    mixed_up = rows.groupBy("set_id").agg(F.min("other_id").alias("lo"), F.max("other_id").alias("hi")).filter("lo < hi").select("set_id")
    mixed_up = materialise(mixed_up, "mixed-up")
    if not mixed_up.isEmpty():
        told = mixed_up.withColumn("several", F.lit(True))
        rows = rows.join(broadcast_if_small(told), "set_id", "left").withColumn("set_id", F.when(F.col("several"), F.col("other_id")).otherwise(F.col("set_id"))).drop("several")
    return rows.drop("other_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    rows = apart(materialise(sketches(docs), "sketches"))
    full = rows.filter("n_shingles > 0 and doc_id is not null")
    nodes = full.groupBy(F.col("set_id").alias("node")).agg(F.min("doc_id").alias("doc"))
    # by both columns: a set that very many documents have does not meet in one place
    one = full.select(F.col("set_id").alias("node"), F.col("doc_id").alias("doc"), "n_shingles", "few", "sketch")
    few = one.select("node", "doc", "few").join(nodes, ["node", "doc"]).dropDuplicates(["node", "doc"])
    live = materialise(first_look(few.select("node", "few")), "live")
    classes = materialise(
        one.drop("few").join(nodes.join(live, "node"), ["node", "doc"]).dropDuplicates(["node", "doc"]), "classes"
    )
    lists = materialise(listed(classes), "lists")
    lists = materialise(lists.join(shared(lists).select("value"), "value"), "lists")
    # a document that has two sets (rows that share an id) ties its classes
    same = full.select("doc_id", F.col("set_id").alias("node")).distinct()
    ties = same.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("node").alias("a")).filter("n > 1")
    found = materialise(same.join(ties, "doc_id").filter("node <> a").select("a", F.col("node").alias("b")), "links")
    parts, asked = components(found, "a", "b"), None
    for turn in range(ROUNDS + 1):
        placed = lists.join(parts, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
        still = placed.groupBy("value").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("value")
        open_lists = materialise(placed.join(still, "value"), "open")
        if open_lists.isEmpty():
            break
        pairs = cross_pairs(open_lists) if turn == ROUNDS else hub_pairs(open_lists, turn)
        if asked is not None:
            pairs = pairs.join(asked, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        asked = pairs if asked is None else asked.unionByName(pairs)
        links = similar(pairs, classes, docs)
        found = parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)
        parts = components(found, "a", "b")
    # the smallest id of each component of several classes
    placed = nodes.join(parts, "node")
    least = placed.groupBy("component").agg(F.min("doc").alias("least"))
    group = nodes.join(placed.join(least, "component").select("node", "least"), "node", "left").select(F.col("node").alias("set_id"), F.coalesce("least", "doc").alias("group"))
    out = rows.select("doc_id", "n_shingles", "set_id").join(group, "set_id", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("group", "doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
