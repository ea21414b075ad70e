"""Hash trees over keyed rows: leaves in order of the key, nodes of at most FANOUT children.

Each level hashes what lies below it in key ranges of equal width, so every group is bounded, all
levels but the first are small, and two replicas differ exactly in the ranges whose nodes differ.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FANOUT = 1024


def leaves(rows: DataFrame, key: str, parts: Sequence[Column]) -> DataFrame:
    """key, hash: SHA-256 of the row's key and parts."""
    return rows.select(F.col(key).alias("key"), F.sha2(told([F.col(key), *parts]), 256).alias("hash"))


def told(parts: Sequence[Column]) -> Column:
    """Parts as one text that no other parts have: each with its length before it, null as a mark."""
    each = (p.cast("string") for p in parts)
    return F.concat(*(F.when(p.isNull(), "-").otherwise(F.concat(F.length(p).cast("string"), F.lit(":"), p)) for p in each))


def level(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The nodes above: key is the range's number, hash that of its children's hashes in order."""
    own = F.array_sort(F.collect_list(F.struct("key", "hash")))
    grouped = nodes.groupBy(F.floor(F.col("key") / fanout).cast("long").alias("range")).agg(own.alias("own"))
    return grouped.select(F.col("range").alias("key"), F.sha2(F.array_join(F.transform("own", lambda x: x["hash"]), ""), 256).alias("hash"))


def root(nodes: DataFrame, fanout: int = FANOUT, levels: int | None = None) -> DataFrame:
    """The tree's top (no row without leaves): as many levels as the range of the keys needs, however many
    keys there are. Keys on both sides of 0 meet in a last node. With levels given, the top is above so many,
    whatever the keys, and null without leaves: trees of one depth can be compared as their keys grow."""
    if levels is not None:
        for _ in range(levels):
            nodes = level(nodes, fanout)
        return top(nodes)
    lo, hi = nodes.agg(F.min("key"), F.max("key")).first()
    if lo is None:
        return nodes
    while lo != hi and (lo, hi) != (-1, 0):
        nodes, lo, hi = level(nodes, fanout), lo // fanout, hi // fanout
    return top(nodes)


def top(nodes: DataFrame) -> DataFrame:
    """One node above all."""
    own = nodes.agg(F.array_sort(F.collect_list(F.struct("key", "hash"))).alias("own"))
    hashes = F.when(F.size("own") > 0, F.array_join(F.transform("own", lambda x: x["hash"]), ""))
    return own.select(F.lit(0).cast("long").alias("key"), F.sha2(hashes, 256).alias("hash"))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys of nodes that two replicas do not share."""
    both = a.select("key", F.col("hash").alias("a")).join(b.select("key", F.col("hash").alias("b")), "key", "full_outer")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("key")
