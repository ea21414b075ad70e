"""Keyed tables as DataFrames: scans, point reads, writes, and the overlay of pending rows.

Writes return the new state; on storage a new state is a new version (see sources.catalog). Each is
one join on the key. Updates may be few against a large base: adaptive execution then broadcasts
them by their measured size, and nothing here forces it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entries(table: DataFrame) -> DataFrame:
    return table


def keys(table: DataFrame, key: str) -> DataFrame:
    return table.select(key)


def values(table: DataFrame, key: str) -> DataFrame:
    return table.drop(key)


def scan_range(table: DataFrame, key: str, start: object, end: object, reverse: bool = False) -> DataFrame:
    """[start, end) in order of the key."""
    own = table.filter((F.col(key) >= F.lit(start)) & (F.col(key) < F.lit(end)))
    return own.orderBy(F.desc(key) if reverse else F.asc(key))


def scan_reverse(table: DataFrame, key: str) -> DataFrame:
    return table.orderBy(F.desc(key))


def first(table: DataFrame, key: str) -> DataFrame:
    return table.orderBy(key).limit(1)


def last(table: DataFrame, key: str) -> DataFrame:
    return table.orderBy(F.desc(key)).limit(1)


def get(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of all wanted keys."""
    return table.join(wanted.select(key).distinct(), key, "left_semi")


def contains(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """wanted keys, each with whether the table has it; no value is read."""
    have = table.select(F.col(key).alias("_have")).distinct()
    return wanted.join(have, F.col(key) == F.col("_have"), "left").select(key, F.col("_have").isNotNull().alias("found"))


def size(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("size"))


def put(table: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    return table.join(updates.select(key), key, "left_anti").unionByName(updates)


def put_if_absent(table: DataFrame, updates: DataFrame, key: str, order: str | None = None) -> DataFrame:
    return table.unionByName(inserted(table, updates, key, order).select(*table.columns))


class CapacityExceeded(ValueError):
    """A bounded state has no room for the new keys."""


def put_bounded(table: DataFrame, updates: DataFrame, key: str, most: int) -> DataFrame:
    """As put, for a state of at most `most` entries: updates of known keys always fit."""
    after = put(table, updates, key)
    if after.select(key).distinct().limit(most + 1).count() > most:
        raise CapacityExceeded(f"more than {most} entries")
    return after


def inserted(table: DataFrame, updates: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The updates that put_if_absent takes: of several of one key the first in order, without an order the
    smallest row."""
    rest = [c for c in updates.columns if c != key]
    first = F.min_by(F.struct(*rest), order) if order else F.min(F.struct(*rest))
    own = updates.join(table.select(key), key, "left_anti").groupBy(key).agg(first.alias("_row"))
    return own.select(key, *(F.col(f"_row.{c}").alias(c) for c in rest))


def replace(table: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """The previous row of each update (nulls if none), beside the update's key."""
    cols = [c for c in table.columns if c != key]
    old = table.select(F.col(key).alias("_key"), *(F.col(c).alias(f"previous_{c}") for c in cols))
    return updates.select(key).join(old, F.col(key) == F.col("_key"), "left").select(key, *(f"previous_{c}" for c in cols))


def delete(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key), key, "left_anti")


def deleted(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Keys of rows that delete removes."""
    return table.select(key).join(gone.select(key), key, "left_semi")


def update(table: DataFrame, wanted: DataFrame, key: str, value: str, change: Callable[[Column], Column]) -> DataFrame:
    """Read, change and write the value of each wanted key. change gets the old value (null if
    there is none) and returns the new one; null removes the row or leaves it out. Rows of other keys
    stay as they are, null values too."""
    want = wanted.select(F.col(key).alias("_want")).distinct()
    both = table.join(want, F.col(key) == F.col("_want"), "full_outer")
    new = F.when(F.col("_want").isNotNull(), change(F.col(value))).otherwise(F.col(value))
    own = both.withColumn(value, new).withColumn(key, F.coalesce(key, "_want"))
    return own.filter(F.col("_want").isNull() | F.col(value).isNotNull()).drop("_want")


def last_writes(updates: DataFrame, key: str, order: str) -> DataFrame:
    """Of several updates of a key the last in order: a partial aggregation, no window."""
    rest = [c for c in updates.columns if c != key]
    own = updates.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return own.select(key, *(F.col(f"_row.{c}").alias(c) for c in rest))


def bulk_put(table: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    return put(table, last_writes(updates, key, order).select(*table.columns), key)


def bulk_put_sorted(table: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    """As bulk_put; the new state comes in ranges of the key and sorted in each, as it is to be stored."""
    return bulk_put(table, updates, key, order).repartitionByRange(key).sortWithinPartitions(key)


def fragmentation(log: DataFrame, key: str, removed: Column | None = None) -> DataFrame:
    """records, live and ratio (share of records that a compaction drops) of a log of writes: all but the
    last of each key, and the last where it is a removal."""
    gone = F.lit(False) if removed is None else removed
    own = log.groupBy(key).agg(F.count("*").alias("n"), F.max_by(gone, "offset").alias("gone"))
    told = own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count(F.when(~F.col("gone"), 1)).alias("live"))
    return told.withColumn("ratio", F.coalesce(F.try_divide(F.col("records") - F.col("live"), F.col("records")), F.lit(0.0)))


def needs_compaction(told: DataFrame, threshold: float) -> bool:
    """Whether a log's fragmentation has reached the threshold: 0 always compacts, 1 and more never."""
    return threshold < 1 and (threshold == 0 or told.first().ratio >= threshold)


def clear(table: DataFrame) -> DataFrame:
    return table.limit(0)


def overlay(state: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Pending rows over stored ones, by one full outer join that keeps the key's partitioning."""
    cols = [c for c in state.columns if c != key]
    a = state.select(key, F.struct(*cols).alias("_a"))
    b = cache.select(key, F.struct(*cols).alias("_b"))
    both = a.join(b, key, "full_outer").withColumn("_c", F.coalesce("_b", "_a"))
    return both.select(key, *(F.col(f"_c.{c}").alias(c) for c in cols))


def overlay_unordered(state: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return put(state, cache.select(*state.columns), key)


def overlay_size(state: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Stored rows and those pending rows that are new."""
    novel = cache.select(key).join(state.select(key), key, "left_anti")
    return state.select(key).unionByName(novel).agg(F.count("*").alias("size"))


def positions(table: DataFrame, order: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Rows numbered from 0 in order, for each group."""
    return table.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
