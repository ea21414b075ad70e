"""A database of event-log tables, private states and operators that follow tables' changes.

Tables are append-only Parquet logs; what they resolve to is a view. Operators are Structured Streaming
queries over the logs of all tables that their patterns match: each micro-batch's changes go to the
operator's `process`, and the checkpoint commits only when it returns, so a batch that fails is
delivered again (handlers must be idempotent by batch). Phases, configurations and timers are kept
in JSON catalogs of numbered versions. All of it lies on the storage that the root's path names.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.functions.globs import matches_name
from driftlog.functions.retry import RetryConfig, backoff_ms
from driftlog.operators import fold, kv, resolve
from driftlog.sources import topics
from driftlog.sources.storage import Catalog, Storage

#: value is a row's plain value or, with a tag, the JSON that operators.fold takes as arg.
EVENT = "offset long, pk string, path array<string>, op string, tag string, value string, sync boolean, H string, dev string"
EVENT_COLUMNS = ["offset", "pk", "path", "op", "tag", "value", "sync", "H", "dev"]
CONTINUE, FINISH = "continue", "finish"
ACTIVE, FINISHED, FAILED = "active", "finished", "failed"


class NotConnected(RuntimeError):
    """The database that a handle belongs to was closed."""


@dataclass
class TableConfig:
    sync: bool = False
    local_device: str = "0" * 16


@dataclass
class OperatorConfig:
    kind: str
    patterns: list[str] = field(default_factory=list)
    poll_files: int = 128
    retry: dict = field(default_factory=lambda: asdict(RetryConfig()))
    settings: dict = field(default_factory=dict)


class Table:
    """A handle on one table's log."""

    def __init__(self, database: Database, name: str):
        self.database, self.name = database, name

    def _open(self) -> Database:
        if not self.database.open:
            raise NotConnected(self.name)
        return self.database

    @property
    def path(self) -> str:
        return f"{self._open().root}/tables/{self.name}"

    @property
    def config(self) -> TableConfig:
        return TableConfig(**self._open().tables.read()[self.name])

    def events(self) -> DataFrame:
        log = self._open().spark.read.schema(EVENT).parquet(self.path)
        return log if self.config.sync else resolve.accept_remote(log, self.config.local_device)

    def insert(self, events: DataFrame) -> None:
        """Appends events (pk, op, value, H, dev, and path, tag, sync where they need them) in the order of
        their column offset, if they have one."""
        db = self._open()
        first = self.size_of_log()
        if "offset" not in events.columns:
            events = events.withColumn("offset", F.monotonically_increasing_id())
        # batches are of one writer and small; a bulk load numbers with sources.topics instead
        rows = events.orderBy("offset").coalesce(1).withColumn("offset", F.monotonically_increasing_id() + first)
        none = {"path": "array<string>", "tag": "string", "sync": "boolean"}
        rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast(none[c]).alias(c) for c in EVENT_COLUMNS)).write.mode("append").parquet(self.path)
        db.spark.catalog.clearCache()

    def size_of_log(self) -> int:
        return self._open().spark.read.schema(EVENT).parquet(self.path).count()

    def plain(self) -> DataFrame:
        """The events on whole rows that replace, delete or set a sync flag."""
        return self.events().filter(F.col("op").isin("replace", "delete", "set_sync") & (F.coalesce(F.size("path"), F.lit(0)) <= 0))

    def rows(self) -> DataFrame:
        """pk, tombstone, value, H and, if the log ever sets a sync flag, sync. What rows hold inside is in cells()."""
        own = self.plain()
        if own.filter("op = 'set_sync'").isEmpty():
            return resolve.resolve(own, ["value"])
        return resolve.resolve_with_sync(own, ["value"])

    def cells(self, watermark: str | None = None) -> DataFrame:
        """The fold of all events, of every operation and path: states and dead letters (see operators.fold)."""
        db = self._open()
        log = db.spark.read.schema(EVENT).parquet(self.path)
        listed = F.to_json(F.array("value"))  # JSON of one value is that of a list without its brackets
        plain = F.substr(listed, F.lit(2), F.length(listed) - 2)
        arg = F.when(F.col("tag").isNull() & (F.col("op") == "replace"), plain).otherwise(F.col("value"))
        tag = F.when(F.col("op") == "replace", F.coalesce("tag", F.lit("String"))).otherwise(F.col("tag"))
        return fold.fold(log.withColumn("arg", arg).withColumn("tag", tag), self.config.sync, self.config.local_device, watermark=watermark)

    def dead_letters(self) -> DataFrame:
        """pk, offset and error of the events that their types refused."""
        return fold.dead_letters(self.cells())

    def changes(self) -> DataFrame:
        return resolve.change_feed(self.plain(), ["value"])

    def fragmentation(self) -> DataFrame:
        """Share of the log's records that later ones have overwritten."""
        return kv.fragmentation(self._open().spark.read.schema(EVENT).parquet(self.path), "pk", F.col("op") == "delete")

    def maybe_compact(self, threshold: float = 0.5) -> bool:
        """Compacts the log if its fragmentation has reached the threshold; a followed log is left alone."""
        db = self._open()
        if any(db.phase(op) == ACTIVE and self.name in db.inputs(op) for op in db.operators.read()):
            return False
        if not kv.needs_compaction(self.fragmentation(), threshold):
            return False
        self.compact()
        return True

    def stats(self) -> DataFrame:
        """Records of the log, first and next offset, rows (tombstones count)."""
        return topics.stats(self._open().spark.read.schema(EVENT).parquet(self.path)).withColumn("rows", F.lit(self.rows().count()))

    def compact(self) -> None:
        """Rewrites the log's small files as few, in order of arrival. A stream would take the new
        files for new events, so no active operator may follow the table."""
        db = self._open()
        if any(db.phase(op) == ACTIVE and self.name in db.inputs(op) for op in db.operators.read()):
            raise RuntimeError(f"an operator follows {self.name}")
        log = db.spark.read.schema(EVENT).parquet(self.path)
        fresh = self.path + ".compact"
        log.repartitionByRange("offset").sortWithinPartitions("offset").write.mode("overwrite").parquet(fresh)
        old = self.path + ".old"
        db.storage.move(self.path, old)
        db.storage.move(fresh, self.path)
        db.storage.drop(old)

    def snapshot(self, path: str) -> None:
        """The resolved rows in order of the key, as a version on its own."""
        self.rows().repartitionByRange("pk").sortWithinPartitions("pk").write.mode("overwrite").parquet(path)


class Operator:
    """What an operator may do. Subclasses override what they need; all run on the driver and
    express their work on DataFrames."""

    def __init__(self, context: Context):
        self.context = context

    def opened(self) -> None: ...
    def process(self, changes: DataFrame, batch: int) -> str:
        return CONTINUE

    def input_opened(self, table: str) -> None: ...
    def input_closed(self, table: str) -> None: ...
    def timer(self, payload: object) -> str:
        return CONTINUE

    def finish(self) -> None: ...


class Context:
    """Capabilities that an operator gets."""

    def __init__(self, database: Database, name: str, config: OperatorConfig):
        self.database, self.name, self.config = database, name, config

    def table(self, name: str, config: TableConfig | None = None) -> Table:
        return self.database.table(name, config)

    def state(self, name: str, schema: str) -> State:
        return self.database.state(name, schema)

    def operator(self, name: str, config: OperatorConfig) -> None:
        self.database.operator(name, config)

    def register_timer(self, fire_at_ms: int, payload: object) -> None:
        self.database.register_timer(self.name, fire_at_ms, payload)

    def cancel_timer(self, fire_at_ms: int) -> None:
        self.database.cancel_timer(self.name, fire_at_ms)


#: Batches of changes that a state keeps beside its base before it is written anew.
DELTAS = 16


class State:
    """A private keyed state on storage: a base, the batches of changes since, and a pointer to both."""

    def __init__(self, database: Database, name: str):
        self.database, self.name = database, name
        self.path = f"{database.root}/states/{name}"

    def _entry(self) -> dict:
        return {"base": 0, "deltas": [], "keys": []} | self.database.states.read()[self.name]

    @property
    def schema(self) -> str:
        return self.database.states.read()[self.name]["schema"]

    def read(self) -> DataFrame:
        if not self.database.open:
            raise NotConnected(self.name)
        own, spark = self._entry(), self.database.spark
        base = spark.read.schema(self.schema).parquet(f"{self.path}/v{own['base']}") if own["base"] else spark.createDataFrame([], self.schema)
        if not own["deltas"]:
            return base
        changes = spark.read.schema(f"{self.schema}, _turn long, _gone boolean").parquet(*(f"{self.path}/v{v}" for v in own["deltas"]))
        newest = changes.groupBy(*own["keys"]).agg(F.max("_turn").alias("_turn"))
        fresh = changes.join(newest, [*own["keys"], "_turn"], "left_semi").filter("not _gone").drop("_turn", "_gone")
        return base.join(newest, own["keys"], "left_anti").unionByName(fresh)

    def write(self, rows: DataFrame) -> None:
        """The new version stands when the pointer moves; what it stands for is kept for readers until the next."""
        own = self._entry()
        v = own["version"] + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/v{v}")
        self.database.states.put(self.name, {"schema": self.schema, "version": v, "base": v, "deltas": [], "keys": [], "old": [own["base"], *own["deltas"]]})
        for old in own.get("old", ()):
            self.database.storage.drop(f"{self.path}/v{old}")

    def replace(self, keys: list[str], touched: DataFrame, rows: DataFrame) -> None:
        """All rows of the touched keys are these rows now. Only they are written; after DELTAS such
        batches the whole state is written anew."""
        own = self._entry()
        if own["deltas"] and own["keys"] != keys:
            self.write(self.read())
            own = self._entry()
        v = own["version"] + 1
        gone = touched.select(*keys).distinct().join(rows, keys, "left_anti")
        both = rows.withColumn("_gone", F.lit(False)).unionByName(gone.withColumn("_gone", F.lit(True)), allowMissingColumns=True)
        both.withColumn("_turn", F.lit(v).cast("long")).write.mode("overwrite").parquet(f"{self.path}/v{v}")
        self.database.states.put(self.name, own | {"version": v, "deltas": [*own["deltas"], v], "keys": keys})
        if len(own["deltas"]) + 1 >= DELTAS:
            self.write(self.read())


REGISTRY: dict[str, type[Operator]] = {}


def register(kind: str) -> Callable[[type[Operator]], type[Operator]]:
    """Makes an operator class known by its kind."""

    def keep(cls: type[Operator]) -> type[Operator]:
        REGISTRY[kind] = cls
        return cls

    return keep


class Database:
    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], int] | None = None, sleep: Callable[[float], None] = time.sleep):
        self.spark, self.root, self.sleep = spark, root.rstrip("/"), sleep
        self.storage = Storage(spark)
        self.now = clock or (lambda: int(time.time() * 1000))
        for d in ("tables", "states", "checkpoints"):
            self.storage.make(f"{self.root}/{d}")
        self.tables, self.states, self.operators, self.timers = (Catalog(self.storage, f"{self.root}/catalog/{n}") for n in ("tables", "states", "operators", "timers"))
        self.open = True
        self.running: dict[str, Operator] = {}
        self.handles: set[str] = set()

    def close(self) -> None:
        self.open = False
        self.running.clear()
        self.handles.clear()

    # tables and states

    def table(self, name: str, config: TableConfig | None = None) -> Table:
        """Opens or makes a table; a different configuration is stored. Operators that follow it learn of it."""
        known = self.tables.read()
        if name not in known or (config and asdict(config) != known[name]):
            self.tables.put(name, asdict(config or TableConfig()))
        self.storage.make(f"{self.root}/tables/{name}")
        self.handles.add(name)
        if name not in known:
            for op, own in self.running.items():
                if any(matches_name(p, name) for p in self._config(op).patterns):
                    own.input_opened(name)
        return Table(self, name)

    def drop_table(self, name: str) -> None:
        for op, own in self.running.items():
            if any(matches_name(p, name) for p in self._config(op).patterns):
                own.input_closed(name)
        self.tables.drop(name)
        self.handles.discard(name)
        self.storage.drop(f"{self.root}/tables/{name}")

    def state(self, name: str, schema: str) -> State:
        known = self.states.read()
        if name in known and known[name]["schema"] != schema:
            raise ValueError(f"state {name} has another type")
        if name not in known:
            self.states.put(name, {"schema": schema, "version": 0, "base": 0, "deltas": [], "keys": []})
        return State(self, name)

    # operators

    def _config(self, name: str) -> OperatorConfig:
        return OperatorConfig(**self.operators.read()[name]["config"])

    def phase(self, name: str) -> str | None:
        return self.operators.read().get(name, {}).get("phase")

    def operator(self, name: str, config: OperatorConfig) -> None:
        """Registers or reopens an operator; finished and failed ones never start again."""
        known = self.operators.read().get(name)
        if known and known["phase"] != ACTIVE:
            return
        if name in self.running:  # keeps the configuration that it runs with
            return
        if config.kind not in REGISTRY:
            raise ValueError(f"no operator of kind {config.kind}")
        self.operators.put(name, {"config": asdict(config), "phase": ACTIVE})
        own = REGISTRY[config.kind](Context(self, name, config))
        self.running[name] = own
        own.opened()

    def inputs(self, name: str) -> list[str]:
        return sorted(t for t in self.tables.read() if any(matches_name(p, t) for p in self._config(name).patterns))

    def run_once(self, name: str) -> None:
        """Due timers, then all changes that have arrived, with retries; then the phase is stored."""
        own = self.running.get(name)
        if own is None or self.phase(name) != ACTIVE:
            return
        config = self._config(name)
        retry, attempt = RetryConfig(**config.retry), 0
        while True:
            try:
                if self._fire(name, own) == FINISH or self._drain(name, own, config) == FINISH:
                    self.retire(name, FINISHED)
                return
            except Exception as e:  # the operator's own failure, whatever it is
                attempt += 1
                if retry.exhausted(attempt):
                    self.retire(name, FAILED, str(e))
                    return
                self.sleep(backoff_ms(retry, attempt) / 1000)

    def run_all(self) -> None:
        for name in list(self.running):
            self.run_once(name)

    def _drain(self, name: str, own: Operator, config: OperatorConfig) -> str:
        """One query for each input, to the end of what has arrived."""
        said = CONTINUE
        for table in self.inputs(name):
            if not any(f.endswith(".parquet") for f in self.storage.names(f"{self.root}/tables/{table}")):
                continue
            answers: list[str] = []

            def each(rows: DataFrame, batch: int, table: str = table, answers: list[str] = answers) -> None:
                answers.append(own.process(self._changes(table, rows), batch))

            stream = (
                self.spark.readStream.schema(EVENT).option("maxFilesPerTrigger", config.poll_files)
                .parquet(f"{self.root}/tables/{table}").writeStream.foreachBatch(each)
                .option("checkpointLocation", f"{self.root}/checkpoints/{name}/{table}")
                .trigger(availableNow=True).start()
            )
            stream.awaitTermination()
            if FINISH in answers:
                said = FINISH
        return said

    def _changes(self, table: str, rows: DataFrame) -> DataFrame:
        """The batch's part of the table's change feed: only the keys that it touches are resolved."""
        log = Table(self, table).plain()
        touched = log.join(rows.select("pk").distinct(), "pk", "left_semi")
        feed = resolve.change_feed(touched, ["value"]).join(rows.select("offset"), "offset", "left_semi")
        return feed.withColumn("table_id", F.lit(table))

    def retire(self, name: str, phase: str, error: str | None = None) -> None:
        """finish(), then no cursor and no timer of the operator is left."""
        own = self.running.pop(name, None)
        if own is not None:
            own.finish()
        self.storage.drop(f"{self.root}/checkpoints/{name}")
        for key in [k for k in self.timers.read() if k.partition(":")[2] == name]:
            self.timers.drop(key)
        self.operators.put(name, {"config": self.operators.read()[name]["config"], "phase": phase, "error": error})

    # introspection

    def contains_table(self, name: str) -> bool:
        return name in self.tables.read()

    def contains_operator(self, name: str) -> bool:
        return name in self.operators.read()

    def is_table_open(self, name: str) -> bool:
        return name in self.handles

    def list_open_tables(self) -> list[str]:
        return sorted(self.handles)

    def close_table(self, name: str) -> None:
        """No handle of it is held any more; its log stays."""
        self.handles.discard(name)

    def is_operator_open(self, name: str) -> bool:
        return name in self.running

    def list_tables(self) -> list[str]:
        return sorted(self.tables.read())

    def list_states(self) -> list[str]:
        return sorted(self.states.read())

    def list_operators(self) -> list[str]:
        return sorted(self.operators.read())

    def list_open_operators(self) -> list[str]:
        return sorted(self.running)

    def table_config(self, name: str) -> TableConfig | None:
        own = self.tables.read().get(name)
        return TableConfig(**own) if own else None

    def operator_config(self, name: str) -> OperatorConfig | None:
        return self._config(name) if self.contains_operator(name) else None

    def operator_error(self, name: str) -> str | None:
        return self.operators.read().get(name, {}).get("error")

    # timers: one for each time and operator, the last payload counts; delivered until handled

    def register_timer(self, name: str, fire_at_ms: int, payload: object) -> None:
        self.timers.put(f"{fire_at_ms:020d}:{name}", payload)

    def cancel_timer(self, name: str, fire_at_ms: int) -> None:
        self.timers.drop(f"{fire_at_ms:020d}:{name}")

    def due(self, name: str) -> list[tuple[int, object]]:
        found = ((k.partition(":"), v) for k, v in sorted(self.timers.read().items()))
        return [(int(k[0]), v) for k, v in found if k[2] == name and int(k[0]) <= self.now()]

    def next_due(self) -> int | None:
        """When the next timer of a loaded operator is due that is not due yet."""
        later = ((int(k[:20]), k.partition(":")[2]) for k in sorted(self.timers.read()))
        return next((at for at, name in later if at > self.now() and name in self.running), None)

    def run_scheduler(self, until: Callable[[], bool], most_ms: int = 60_000) -> None:
        """Runs all operators, then sleeps until the next timer is due, `most_ms` at most, again and again
        until `until` says so, the database is closed or no operator is left."""
        while self.open and self.running and not until():
            self.run_all()
            due = self.next_due()
            if self.open and self.running and not until():
                self.sleep(min(most_ms, most_ms if due is None else max(0, due - self.now())) / 1000)

    def _fire(self, name: str, own: Operator) -> str:
        for at, payload in self.due(name):
            if own.timer(payload) == FINISH:
                return FINISH
            self.cancel_timer(name, at)
        return CONTINUE
