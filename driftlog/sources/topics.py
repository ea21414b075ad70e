"""Topics: append-only logs of records with offsets, and named consumers that commit theirs.

A topic is a folder of Parquet files; the records' offset column gives the order. Segments are ranges
of offsets. Consumers' committed offsets live in a small catalog beside the records.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlog.sources.storage import Catalog, Storage

SEGMENT = 1000
#: Segments that are put in order at a time.
RANGE = 4096


def segments(log: DataFrame, width: int = SEGMENT) -> DataFrame:
    """segment, base, records, next_base: the end of a segment is the next one's base."""
    own = log.groupBy(F.floor(F.col("offset") / width).cast("long").alias("segment")).agg(F.min("offset").alias("base"), F.count("*").alias("records"))
    # segments are put in order in ranges of RANGE; only the ranges' first bases meet in one place
    own = own.withColumn("_range", F.floor(F.col("segment") / RANGE))
    within = F.lead("base").over(Window.partitionBy("_range").orderBy("segment"))
    ranges = own.groupBy("_range").agg(F.min("base").alias("_first"))
    ranges = ranges.select("_range", F.lead("_first").over(Window.orderBy("_range")).alias("_next"))
    return own.withColumn("next_base", within).join(ranges, "_range").withColumn("next_base", F.coalesce("next_base", "_next")).drop("_range", "_next")


def segment_name(base: Column) -> Column:
    """A segment's name: its first offset in twenty digits, so that names order like offsets."""
    return F.lpad(base.cast("string"), 20, "0")


def stats(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("records"), F.min("offset").alias("earliest"), (F.max("offset") + 1).alias("next_offset"))


def read_from(log: DataFrame, offset: int) -> DataFrame:
    return log.filter(F.col("offset") >= offset)


def lag(log: DataFrame, consumers: DataFrame) -> DataFrame:
    """name, committed, lag: records that each consumer (name, committed) has yet to read. Consumers
    are a handful of registered names."""
    counts = log.select("offset").join(F.broadcast(consumers), F.col("offset") >= F.col("committed")).groupBy("name").agg(F.count("*").alias("lag"))
    return consumers.join(counts, "name", "left").select("name", "committed", F.coalesce("lag", F.lit(0)).alias("lag"))


def retained(log: DataFrame, least_committed: int, width: int = SEGMENT) -> DataFrame:
    """Records left after whole segments below the smallest committed offset are dropped."""
    return log.filter(F.floor(F.col("offset") / width) >= least_committed // width)


class Topic:
    """A topic on storage. Appends give consecutive offsets; a new consumer starts at the tail."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.storage = Storage(spark)
        self.records = f"{self.path}/records"
        self.cursors = Catalog(self.storage, f"{self.path}/consumers")
        self.offsets = Catalog(self.storage, f"{self.path}/offsets")
        self.active: set[str] = set()

    def read(self) -> DataFrame:
        if not self.storage.exists(self.records):
            return self.spark.createDataFrame([], f"offset long, {self.schema}")
        return self.spark.read.schema(f"offset long, {self.schema}").parquet(self.records)

    def next_offset(self) -> int:
        last = self.read().agg(F.max("offset")).first()[0]
        return 0 if last is None else last + 1

    def append(self, rows: DataFrame, order: str | None = None) -> int:
        """Writes rows in the given order and returns the first offset. Numbering takes counts by
        partition, not one sorted pass over all rows. Offsets are reserved in a catalog before they are
        written, so that two writers never share any; a writer that dies leaves a gap."""
        if order is not None:
            rows = rows.orderBy(order)
        # places within partitions, then the partitions' first places: no global sort by row number
        marked = rows.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
        staged = f"{self.path}/staged-{uuid.uuid4().hex}"
        marked.write.mode("overwrite").parquet(staged)
        marked = self.spark.read.parquet(staged)
        counts = marked.groupBy("_part").agg(F.count("*").alias("n"), F.min("_id").alias("low"))
        before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        firsts = counts.select("_part", "low", before.alias("before"))
        first = self._reserve(marked.count())
        numbered = marked.join(firsts, "_part").select((F.col("_id") - F.col("low") + F.col("before") + first).alias("offset"), *rows.columns)
        numbered.write.mode("append").parquet(self.records)
        self.storage.drop(staged)
        return first

    def _reserve(self, n: int) -> int:
        """The first of n offsets that no one else gets."""
        first = 0

        def take(own: dict) -> dict:
            nonlocal first
            first = max(own.get("next", 0), self.next_offset())
            return {"next": first + n}

        self.offsets.change(take)
        return first

    def consumer(self, name: str) -> Consumer:
        if name in self.active:
            raise ValueError(f"consumer {name} is already open")
        if name not in self.cursors.read():
            self.cursors.put(name, self.next_offset())
        self.active.add(name)
        return Consumer(self, name)

    def compact(self, width: int = SEGMENT) -> int:
        """Drops whole segments that every consumer has committed; returns how many records."""
        cursors = self.cursors.read()
        if not cursors:
            return 0
        before = self.read().count()
        kept = retained(self.read(), min(cursors.values()), width)
        kept.write.mode("overwrite").parquet(self.records + ".new")
        after = self.spark.read.parquet(self.records + ".new").count()
        self.storage.move(self.records, self.records + ".old")
        self.storage.move(self.records + ".new", self.records)
        self.storage.drop(self.records + ".old")
        return before - after


class Consumer:
    """A volatile position and a committed one."""

    def __init__(self, topic: Topic, name: str):
        self.topic, self.name = topic, name
        self.position = topic.cursors.read()[name]

    def poll(self, most: int | None = None) -> DataFrame:
        """Records from the position on, in order; the position moves past them."""
        rows = read_from(self.topic.read(), self.position).orderBy("offset")
        rows = rows.limit(most) if most is not None else rows
        last = rows.agg(F.max("offset")).first()[0]
        got = rows.filter(F.col("offset") <= (last if last is not None else -1))
        if last is not None:
            self.position = last + 1
        return got

    def commit(self) -> None:
        self.topic.cursors.put(self.name, self.position)

    def reset(self) -> None:
        self.position = self.topic.cursors.read()[self.name]

    def seek(self, offset: int) -> None:
        self.position = offset

    def close(self) -> None:
        self.topic.active.discard(self.name)

    def delete(self) -> None:
        self.topic.cursors.drop(self.name)
        self.close()
