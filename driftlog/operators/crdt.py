"""Closed forms of the replicated types, over all keys at once.

Each holds for a cell that has its type throughout (see resolve.heal_types for changes of type). All
are aggregations or anti-joins on (key, element), so replicas may be merged in any order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlog.functions.clock import ZERO

KEY = ("pk",)


# counters: rows (key, dev, delta), components (key, dev, pos, neg)


def counter_components(ops: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Sums of increments and of decrements for each device; a negative increment is a decrement."""
    d = F.col("delta").cast("decimal(20,0)")
    return ops.groupBy(*key, "dev").agg(
        F.coalesce(F.sum(F.when(d >= 0, d)), F.lit(0)).alias("pos"), F.coalesce(F.sum(F.when(d < 0, -d)), F.lit(0)).alias("neg")
    )


def counter_merge(replicas: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Components of all replicas' states: the larger of each."""
    return replicas.groupBy(*key, "dev").agg(F.max("pos").alias("pos"), F.max("neg").alias("neg"))


def counter_value(components: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    wide = "decimal(38,0)"
    return components.groupBy(*key).agg((F.sum(F.col("pos").cast(wide)) - F.sum(F.col("neg").cast(wide))).alias("value"))


# sets: rows (key, elem, add, H), states (key, elem, updated, deleted)


def set_state(ops: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return ops.groupBy(*key, "elem").agg(F.max(F.when(F.col("add"), F.col("H"))).alias("updated"), F.max(F.when(~F.col("add"), F.col("H"))).alias("deleted"))


def set_merge(replicas: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return replicas.groupBy(*key, "elem").agg(F.max("updated").alias("updated"), F.max("deleted").alias("deleted"))


def set_members(state: DataFrame) -> DataFrame:
    """Elements whose last addition is newer than their last removal; a tie is out."""
    return state.filter(F.col("updated") > F.coalesce("deleted", F.lit(ZERO)))


def set_compact(state: DataFrame, watermark: str) -> DataFrame:
    """Without dead elements that every replica knows to be dead."""
    return state.filter((F.coalesce("updated", F.lit(ZERO)) > F.coalesce("deleted", F.lit(ZERO))) | (F.coalesce("deleted", F.lit(ZERO)) > watermark))


# observed-remove sets: adds (key, elem, tag), removes (key, elem, H, observed array of tags)


def orset_removals(removes: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """(key, elem, tag, removed): each killed tag with the newest clock that killed it."""
    each = removes.select(*key, "elem", "H", F.explode("observed").alias("tag"))
    return each.groupBy(*key, "elem", "tag").agg(F.max("H").alias("removed"))


def orset_live_tags(adds: DataFrame, removals: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return adds.join(removals.select(*key, "elem", "tag"), [*key, "elem", "tag"], "left_anti")


def orset_members(adds: DataFrame, removals: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return orset_live_tags(adds, removals, key).select(*key, "elem").distinct()


def orset_observe(adds: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """What a removal issued now must list: all tags of the element, dead ones too."""
    return adds.groupBy(*key, "elem").agg(F.array_sort(F.collect_set("tag")).alias("observed"))


def orset_compact(adds: DataFrame, removals: DataFrame, watermark: str, key: Sequence[str] = KEY) -> tuple[DataFrame, DataFrame]:
    """Both sides without tags that every replica has seen added and removed."""
    stable = removals.filter((F.col("tag") <= watermark) & (F.col("removed") <= watermark)).select(*key, "elem", "tag")
    on = [*key, "elem", "tag"]
    return adds.join(stable, on, "left_anti"), removals.join(stable, on, "left_anti")


# registers of concurrent values: assigns (key, id, value, replaces array of ids)


def mv_removals(assigns: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    each = assigns.select(*key, F.col("id").alias("by"), F.explode("replaces").alias("id"))
    return each.groupBy(*key, "id").agg(F.max("by").alias("removed"))


def mv_values(assigns: DataFrame, removals: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return assigns.join(removals.select(*key, "id"), [*key, "id"], "left_anti")


def mv_observe(values: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """What an assignment issued now replaces: the ids of all current values."""
    return values.groupBy(*key).agg(F.array_sort(F.collect_set("id")).alias("replaces"))


def mv_compact(removals: DataFrame, watermark: str) -> DataFrame:
    return removals.filter((F.col("id") > watermark) | (F.col("removed") > watermark))


# priority queues: pushes (key, id, priority, ...), pops (key, id, H)


def pq_pops(pops: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The newest effective pop of each entry; a pop no newer than the entry does nothing."""
    return pops.filter(F.col("H") > F.col("id")).groupBy(*key, "id").agg(F.max("H").alias("deleted"))


def pq_live(pushes: DataFrame, pops: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return pushes.join(pq_pops(pops, key).select(*key, "id"), [*key, "id"], "left_anti")


def pq_order(live: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Entries with their place: smallest priority first, then oldest."""
    return live.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("priority", "id")))


def pq_head(live: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """What a pop takes next, by partial aggregation."""
    rest = [c for c in live.columns if c not in key]
    own = live.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("priority", "id")).alias("_head"))
    return own.select(*key, *(F.col(f"_head.{c}").alias(c) for c in rest))


def pq_compact(pushes: DataFrame, pops: DataFrame, watermark: str, key: Sequence[str] = KEY) -> DataFrame:
    stable = pq_pops(pops, key).filter(F.col("deleted") <= watermark)
    return pushes.join(stable.select(*key, "id"), [*key, "id"], "left_anti")


# replicas that disagree


def conflicts(replicas: DataFrame, identity: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Identities whose immutable payload differs between replicas: a merge must refuse them."""
    own = replicas.groupBy(*identity).agg(F.countDistinct(F.to_json(F.struct(*payload))).alias("_n"))
    return own.filter("_n > 1").select(*identity)


# records: cells (key, field, tombstone, value, H)


def record_summary(cells: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Number of fields (tombstones count) and names of the live ones in order."""
    live = F.array_sort(F.collect_set(F.when(~F.col("tombstone"), F.col("field"))))
    return cells.groupBy(*key).agg(F.count("*").alias("n_fields"), F.array_join(live, ",").alias("live_fields"))
