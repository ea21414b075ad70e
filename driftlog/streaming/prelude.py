"""Operators that every database knows: full-text index, hash tree, scripts; and two that the
tests' pipeline uses, an indexer and an archiver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlog.operators import fulltext, merkle
from driftlog.streaming.engine import CONTINUE, FINISH, Operator, register

POSTING = "token string, table_id string, pk string"


def last_changes(changes: DataFrame) -> DataFrame:
    """First previous and last current value of each row in a batch."""
    return changes.groupBy("table_id", "pk").agg(
        F.min_by(F.struct("previous.value"), "offset").alias("p"), F.max_by(F.struct("current.value", "current.tombstone", "H"), "offset").alias("c")
    ).select("table_id", "pk", F.col("p.value").alias("before"), F.col("c.value").alias("after"), F.col("c.tombstone").alias("tombstone"), F.col("c.H").alias("H"))


@register("full_text")
class FullText(Operator):
    """Index of the rows' values: tokens of the previous value go, those of the current one come."""

    def process(self, changes: DataFrame, batch: int) -> str:
        state = self.context.state(self.context.config.settings.get("state", self.context.name + "_index"), POSTING)
        least = self.context.config.settings.get("min_token_len", 2)
        own = last_changes(changes)
        touched = own.select("table_id", "pk")
        fresh = own.select(F.explode(fulltext.tokens(F.col("after"), least)).alias("token"), "table_id", "pk")
        state.replace(["table_id", "pk"], touched, fresh)
        return CONTINUE


LEAF = "table_id string, pk string, hash string"


@register("merkle")
class Merkle(Operator):
    """A leaf for each row, tombstones too, and the root over leaves in order of their keys.

    Keys are text, so the lowest level groups leaves by the hash of their key; the levels above are
    as in operators.merkle."""

    def process(self, changes: DataFrame, batch: int) -> str:
        state = self.context.state(self.context.config.settings.get("state", self.context.name + "_leaves"), LEAF)
        own = last_changes(changes)
        fresh = own.select("table_id", "pk", F.sha2(merkle.told([F.col("pk"), F.col("after"), F.col("tombstone"), F.col("H")]), 256).alias("hash"))
        state.replace(["table_id", "pk"], own, fresh)
        return CONTINUE

    def root(self) -> str | None:
        return root_of(self.context.state(self.context.config.settings.get("state", self.context.name + "_leaves"), LEAF).read())


def root_of(leaves: DataFrame, buckets: int = 1 << 20) -> str | None:
    name = merkle.told([F.col("table_id"), F.col("pk")])
    own = leaves.groupBy(F.pmod(F.xxhash64(name), F.lit(buckets)).alias("key")).agg(F.array_sort(F.collect_list(F.struct(name.alias("name"), "hash"))).alias("own"))
    nodes = own.select("key", F.sha2(F.array_join(F.transform("own", lambda x: F.concat(x["name"], x["hash"])), ""), 256).alias("hash"))
    row = merkle.root(nodes).first()
    return row.hash if row else None


@register("script")
class Script(Operator):
    """Runs a SQL script over the batch (view `changes`); its first value is the directive.

    null, false, "continue" and "Continue" go on; true, "finish" and "Finish" end. Other words are errors.
    """

    def process(self, changes: DataFrame, batch: int) -> str:
        flat = changes.select(
            "table_id", "pk", "op", "H", F.col("previous.value").alias("previous"), F.col("current.value").alias("current"), "offset"
        )
        flat.createOrReplaceTempView("changes")
        row = changes.sparkSession.sql(self.context.config.settings["script"]).first()
        return directive(row[0] if row is not None else None)


def directive(value: object) -> str:
    if value is None or value is False:
        return CONTINUE
    if value is True:
        return FINISH
    known = {w: d for d in (CONTINUE, FINISH) for w in (d, d.capitalize())}
    if value not in known:
        raise ValueError(f"unknown directive {value}")
    return known[value]


@register("indexer")
class Indexer(Operator):
    """Postings only grow until a row is deleted; word counts keep the largest version's."""

    def process(self, changes: DataFrame, batch: int) -> str:
        index = self.context.state(self.context.name + "_index", POSTING)
        stats = self.context.state(self.context.name + "_stats", "table_id string, pk string, words long")
        own = changes.select("table_id", "pk", F.col("current.value").alias("value"), F.col("current.tombstone").alias("tombstone"), "offset")
        last = own.groupBy("table_id", "pk").agg(F.max_by("tombstone", "offset").alias("gone"), F.max(F.when(F.col("tombstone"), F.col("offset"))).alias("cut"))
        dead = last.filter(F.col("cut").isNotNull()).select("table_id", "pk")
        kept = own.join(last.select("table_id", "pk", "cut"), ["table_id", "pk"]).filter(~F.col("tombstone") & (F.col("offset") > F.coalesce("cut", F.lit(-1))))
        fresh = kept.select(F.explode(fulltext.tokens(F.col("value"))).alias("token"), "table_id", "pk").distinct()
        index.write(index.read().join(dead, ["table_id", "pk"], "left_anti").unionByName(fresh).distinct())
        counted = kept.select("table_id", "pk", F.size(fulltext.words(F.col("value"))).cast("long").alias("words"))
        merged = stats.read().join(dead, ["table_id", "pk"], "left_anti").unionByName(counted)
        stats.write(merged.groupBy("table_id", "pk").agg(F.max("words").alias("words")))
        return CONTINUE


@register("archiver")
class Archiver(Operator):
    """Writes a report at every timer until it has written max_reports."""

    STEP_MS = 50

    def opened(self) -> None:
        self.context.register_timer(self.context.database.now() + self.STEP_MS, {"n": 1})

    def timer(self, payload: object) -> str:
        n, spark = payload["n"], self.context.database.spark
        settings = self.context.config.settings
        stats = self.context.state(settings["stats"], "table_id string, pk string, words long").read()
        line = fulltext.report(stats).first().report
        clock = f"{self.context.database.now():012x}{n:04x}{0:016x}"
        row = spark.createDataFrame([(f"report_{n}", "replace", line, clock, "0" * 16)], "pk string, op string, value string, H string, dev string")
        self.context.table(settings.get("reports", "reports")).insert(row)
        if n >= settings["max_reports"]:
            return FINISH
        self.context.register_timer(self.context.database.now() + self.STEP_MS, {"n": n + 1})
        return CONTINUE
