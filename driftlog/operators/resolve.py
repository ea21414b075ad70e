"""Resolution of an event log into rows.

An event log has the key columns, `offset` (arrival), `op` (replace, delete or set_sync), `H` (clock),
and value columns. Arrival decides order, the clock decides conflicts: an event takes effect if its
clock is newer than every earlier arrival's for the same row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlog.functions.clock import ZERO, beats

KEY = ("pk",)


def _before(key: Sequence[str]):
    return Window.partitionBy(*key).orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)


def _until(key: Sequence[str]):
    return Window.partitionBy(*key).orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)


def gate(events: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """events with eff: whether the event changes its row."""
    return events.withColumn("eff", beats(F.col("H"), F.max("H").over(_before(key))))


def gate_by_stretches(events: DataFrame, key: Sequence[str] = KEY, stretch: int = 1 << 16) -> DataFrame:
    """As gate, for logs where one key may hold a large share of all events: no task needs more than
    a stretch of offsets of a key. The newest clock before a stretch comes from the stretches' own
    maxima, which are as many as there are stretches, not events."""
    own = [*key, "_stretch"]
    e = events.withColumn("_stretch", F.floor(F.col("offset") / stretch))
    newest = e.groupBy(*own).agg(F.max("H").alias("_newest"))
    order = Window.partitionBy(*key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = newest.select(*own, F.max("_newest").over(order).alias("_before"))
    within = F.max("H").over(Window.partitionBy(*own).orderBy("offset").rowsBetween(Window.unboundedPreceding, -1))
    known = F.greatest(F.coalesce(within, F.lit(ZERO)), F.coalesce("_before", F.lit(ZERO)))
    return e.join(before, own).withColumn("eff", beats(F.col("H"), known)).drop("_stretch", "_before")


def accept_remote(events: DataFrame, local_device: str, synced: Column | None = None) -> DataFrame:
    """Without remote devices' events, unless their target is synced; set_sync always passes."""
    passes = (F.col("op") == "set_sync") | (F.col("dev") == local_device)
    return events.filter(passes | F.coalesce(synced, F.lit(False)) if synced is not None else passes)


def change_feed(events: DataFrame, values: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """One row for each effective event: current and previous cell (tombstone, clock and values).

    set_sync moves the clock and keeps the value; delete leaves a tombstone, which is a cell. Gate,
    current and previous share one sort of each key's rows.
    """
    cell = F.struct((F.col("op") == "delete").alias("tombstone"), *(F.when(F.col("op") != "delete", F.col(v)).alias(v) for v in values))
    effective = gate(events, key).filter("eff")
    current = F.last(F.when(F.col("op") != "set_sync", cell), ignorenulls=True).over(_until(key))
    shown = effective.withColumn("current", current)
    order = Window.partitionBy(*key).orderBy("offset")
    return (
        shown.withColumn("has_previous", F.lag(F.lit(True)).over(order).isNotNull())
        .withColumn("previous", F.lag("current").over(order))
        .withColumn("previous_H", F.lag("H").over(order))
        .drop("eff")
    )


def resolve(events: DataFrame, values: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """key, tombstone, values and H of every row, in one partial aggregation.

    Of equal clocks the first arrival wins. Where there is no set_sync the last effective event is
    the one with the newest clock, so no window is needed; set_sync only moves the clock.
    """
    rank = F.struct("H", (-F.col("offset")).alias("first"))
    cell = F.struct((F.col("op") == "delete").alias("tombstone"), *(F.col(v) for v in values))
    own = events.groupBy(*key).agg(F.max_by(cell, rank).alias("cell"), F.max("H").alias("H"))
    return own.select(*key, F.col("cell.tombstone").alias("tombstone"), *(F.when(~F.col("cell.tombstone"), F.col(f"cell.{v}")).alias(v) for v in values), "H")


def replay(snapshot: DataFrame, events: DataFrame, values: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """Rows after events that arrived since a snapshot of resolved rows: what recovery does. The
    snapshot's cells count as arrivals before all others. With a column sync in both, sync flags take part."""
    sync = ["sync"] if "sync" in snapshot.columns and "sync" in events.columns else []
    before = snapshot.select(*key, F.lit(-1).cast("long").alias("offset"), F.when(F.col("tombstone"), "delete").otherwise("replace").alias("op"), *values, *sync, "H")
    both = before.unionByName(events.select(*key, "offset", "op", *values, *sync, "H"))
    return resolve_with_sync(both, values, key) if sync else resolve(both, values, key)


def resolve_with_sync(events: DataFrame, values: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """As resolve, where set_sync events (column sync) take part: sync flag, value and clock. Events
    with negative offsets are a snapshot's cells, which bring their flags."""
    cell = F.struct((F.col("op") == "delete").alias("tombstone"), *(F.col(v) for v in values))
    effective = gate(events, key).filter("eff")
    own = effective.groupBy(*key).agg(
        F.max_by(F.when(F.col("op") != "set_sync", cell), F.when(F.col("op") != "set_sync", F.col("offset"))).alias("cell"),
        F.max_by(F.struct("sync"), F.when((F.col("op") == "set_sync") | (F.col("offset") < 0), F.col("offset"))).alias("flag"),
        F.max("H").alias("H"),
    )
    tomb = F.coalesce(F.col("cell.tombstone"), F.lit(True))
    return own.select(*key, tomb.alias("tombstone"), *(F.when(~tomb, F.col(f"cell.{v}")).alias(v) for v in values), F.col("flag.sync").alias("sync"), "H")


def live(rows: DataFrame) -> DataFrame:
    """Rows that are no tombstones. A tombstone is a row all the same: counts include it."""
    return rows.filter(~F.col("tombstone"))


def max_clock(events: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return events.groupBy(*key).agg(F.max("H").alias("H"))


def heal_types(events: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Typed events (column tag) with type after the event, whether it was accepted, and the number
    of the stretch of one type it belongs to.

    An event of another type replaces the cell if its clock is the newest so far; of the same type
    it always applies. Rejected events never have the newest clock, so the newest clock of all
    earlier arrivals is the cell's.
    """
    newest = events.withColumn("newest", beats(F.col("H"), F.max("H").over(_before(key))))
    typed = newest.withColumn("type_after", F.last(F.when(F.col("newest"), F.col("tag")), ignorenulls=True).over(_until(key)))
    order = Window.partitionBy(*key).orderBy("offset")
    typed = typed.withColumn("type_before", F.lag("type_after").over(order))
    healed = F.col("newest") & F.col("type_before").isNotNull() & (F.col("tag") != F.col("type_before"))
    return (
        typed.withColumn("accepted", F.col("newest") | F.coalesce(F.col("tag") == F.col("type_before"), F.lit(False)))
        .withColumn("healed", F.coalesce(healed, F.lit(False)))
        .withColumn("stretch", F.sum(F.col("healed").cast("long")).over(_until(key)))
    )


def merge_cells(local: DataFrame, remote: DataFrame, values: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """State merge of two replicas' rows (tombstone, values, sync, H): the newer clock's cell, the
    local one if they tie; a local row keeps its own sync flag."""
    cols = ["tombstone", *values, "sync", "H"]
    a = local.select(*key, F.struct(*cols).alias("a"))
    b = remote.select(*key, F.struct(*cols).alias("b"))
    newer = F.when(F.col("b.H") > F.coalesce(F.col("a.H"), F.lit(ZERO)), F.col("b")).otherwise(F.coalesce("a", "b"))
    joined = a.join(b, list(key), "full_outer").withColumn("c", newer)
    sync = F.when(F.col("a").isNotNull(), F.col("a.sync")).otherwise(F.col("b.sync"))
    return joined.select(*key, F.col("c.tombstone").alias("tombstone"), *(F.col(f"c.{v}").alias(v) for v in values), sync.alias("sync"), F.col("c.H").alias("H"))


def collect_tombstones(rows: DataFrame, watermark: str) -> DataFrame:
    """Rows without the tombstones that are as old as the watermark."""
    return rows.filter(~F.col("tombstone") | (F.col("H") > watermark))


def nearest_flag(paths: DataFrame, flags: DataFrame, path: str = "path", sync: str = "sync", inherited: bool = False) -> DataFrame:
    """paths (pk, path array) with the sync flag of the nearest ancestor-or-self that has one."""
    at = F.transform(F.sequence(F.lit(0), F.size(path)), lambda n: F.struct(n.alias("depth"), F.slice(path, 1, n).alias("prefix")))
    asked = paths.withColumn("x", F.explode(at)).select(*paths.columns, "x.*")
    own = flags.filter(F.col(sync).isNotNull()).select(F.col("pk").alias("fpk"), F.col(path).alias("prefix"), F.col(sync).alias("flag"))
    joined = asked.join(own, (F.col("pk") == F.col("fpk")) & (asked["prefix"] == own["prefix"]), "left")
    return joined.groupBy(*paths.columns).agg(F.coalesce(F.max_by("flag", F.when(F.col("flag").isNotNull(), F.col("depth"))), F.lit(inherited)).alias("synced"))
