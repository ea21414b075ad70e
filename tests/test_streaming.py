import pytest
from pyspark.sql import functions as F

from driftlog.operators import fold, fulltext, merkle, resolve
from driftlog.sources.storage import Catalog, Storage
from driftlog.sources.topics import Topic
from driftlog.streaming import engine, prelude
from driftlog.streaming.engine import ACTIVE, FAILED, FINISHED, Database, NotConnected, Operator, OperatorConfig, TableConfig, register

SHAPE = "pk string, op string, value string, H string, dev string"


def h(ms):
    return f"{ms:012x}{0:020x}"


def rows(spark, *own):
    return spark.createDataFrame([(pk, "delete" if v is None else "replace", v, h(ms), "0" * 16) for pk, v, ms in own], SHAPE)


class Time:
    def __init__(self):
        self.ms, self.slept = 1000, []

    def __call__(self):
        return self.ms

    def sleep(self, s):
        self.slept.append(round(s * 1000))


@pytest.fixture
def db(spark, tmp_path):
    t = Time()
    d = Database(spark, str(tmp_path / "db"), t, t.sleep)
    d.time = t
    yield d
    d.close()


def postings(db, name):
    found = {}
    for r in db.state(name, prelude.POSTING).read().collect():
        found.setdefault(r.token, set()).add(r.pk)
    return found


def test_index_pipeline_incremental_and_delete(spark, db):
    docs = db.table("documents")
    docs.insert(rows(spark, ("d1", "The quick brown fox", 100), ("d2", "jumps over the lazy dog", 110), ("d3", "The quick brown fox jumps again", 120)))
    db.operator("idx", OperatorConfig("indexer", ["doc*"]))
    db.operator("ft", OperatorConfig("full_text", ["documents"]))
    db.run_all()
    assert postings(db, "idx_index")["quick"] == {"d1", "d3"} and postings(db, "ft_index")["dog"] == {"d2"}
    stats = {r.pk: r.words for r in db.state("idx_stats", "table_id string, pk string, words long").read().collect()}
    assert stats == {"d1": 4, "d2": 5, "d3": 6}
    docs.insert(rows(spark, ("d4", "quick fox", 200), ("d1", None, 210), ("d2", "stale", 50)))
    db.run_all()
    assert postings(db, "idx_index")["quick"] == {"d3", "d4"} and postings(db, "ft_index")["quick"] == {"d3", "d4"}
    assert "stale" not in postings(db, "ft_index") and db.phase("idx") == ACTIVE


def test_merkle_root_ignores_order_and_sees_changes(spark, db):
    a, b = [("a", "one", 1), ("b", "two", 2)], [("b", "two", 2), ("a", "one", 1)]
    roots = []
    for name, own in (("x", a), ("y", b), ("z", [*a[:1], ("b", "new", 3)])):
        db.table("t").insert(rows(spark))
        leaves = spark.createDataFrame([("t", pk, f"{pk}{v}{ms}") for pk, v, ms in own], prelude.LEAF)
        roots.append(prelude.root_of(leaves))
    assert roots[0] == roots[1] != roots[2]


def test_scripts_direct(spark, db):
    assert [prelude.directive(x) for x in (None, False, True, "Finish", "continue")] == ["continue", "continue", "finish", "finish", "continue"]
    with pytest.raises(ValueError):
        prelude.directive("stop")
    db.table("u").insert(rows(spark, ("a", "1", 1)))
    db.operator("s", OperatorConfig("script", ["u"], settings={"script": "SELECT IF(count(*) > 0, 'finish', 'continue') FROM changes"}))
    db.run_all()
    assert db.phase("s") == FINISHED
    db.operator("s", OperatorConfig("script", ["u"]))
    assert "s" not in db.running


@register("flaky")
class Flaky(Operator):
    def opened(self):
        self.seen, self.fails = [], self.context.config.settings["fails"]

    def process(self, changes, batch):
        own = sorted(r.pk for r in changes.select("pk").collect())
        if self.fails:
            self.fails -= 1
            raise RuntimeError("not yet")
        self.seen.append(own)
        return "continue"


def test_failed_batches_come_again_and_delays_follow_the_schedule(spark, db):
    db.table("users").insert(rows(spark, ("u1", "1", 100), ("u2", "2", 110)))
    db.operator("f", OperatorConfig("flaky", ["users"], settings={"fails": 2}))
    db.run_all()
    assert db.running["f"].seen == [["u1", "u2"]] and db.time.slept == [110, 217]
    db.run_all()
    assert db.running["f"].seen == [["u1", "u2"]]


def test_exhausted_operators_fail(spark, db):
    db.table("users").insert(rows(spark, ("u1", "1", 100)))
    db.operator("f", OperatorConfig("flaky", ["users"], settings={"fails": 99}, retry={"max_attempts": 2, "initial_ms": 1, "max_ms": 1, "jitter": 0}))
    db.run_all()
    assert db.phase("f") == FAILED and "f" not in db.running


def test_archiver_reports_by_timers_then_leaves_nothing(spark, db):
    db.state("st", "table_id string, pk string, words long").write(spark.createDataFrame([("d", "d1", 4), ("d", "d2", 5)], "table_id string, pk string, words long"))
    db.operator("arc", OperatorConfig("archiver", [], settings={"stats": "st", "max_reports": 2}))
    db.run_all()
    assert not db.table("reports").path.endswith("x") and db.phase("arc") == ACTIVE
    for _ in range(2):
        db.time.ms += 50
        db.run_all()
    assert db.phase("arc") == FINISHED and db.timers.read() == {}
    assert sorted((r.pk, r.value) for r in db.table("reports").rows().collect()) == [("report_1", "docs=2 total_words=9"), ("report_2", "docs=2 total_words=9")]


def test_catalogs_types_and_handles(spark, db):
    t = db.table("a", TableConfig(sync=True))
    assert t.config.sync and db.tables.read()["a"]["sync"]
    db.state("s", "k long")
    with pytest.raises(ValueError):
        db.state("s", "k string")
    again = Database(spark, db.root)
    assert "a" in again.tables.read()
    db.drop_table("a")
    assert "a" not in db.tables.read()
    db.close()
    with pytest.raises(NotConnected):
        t.path  # noqa: B018


def test_introspection_stats_and_compaction(spark, db):
    t = db.table("users")
    for ms in (100, 50, 120):
        t.insert(rows(spark, ("u1", str(ms), ms)))
    db.operator("f", OperatorConfig("flaky", ["nothing"], settings={"fails": 0}))
    assert db.list_tables() == ["users"] and db.contains_table("users") and not db.contains_table("x") and db.table_config("x") is None
    assert db.list_operators() == db.list_open_operators() == ["f"] and db.is_operator_open("f") and db.operator_config("f").kind == "flaky"
    before = t.rows().collect()
    t.compact()
    assert t.rows().collect() == before
    s = t.stats().first()
    assert (s.records, s.earliest, s.next_offset, s.rows) == (3, 0, 3, 1)


def test_topics_register_at_tail_reset_seek_and_compact(spark, tmp_path):
    t = Topic(spark, str(tmp_path / "t"), "v long")
    make = lambda a, b: spark.createDataFrame([(i,) for i in range(a, b)], "v long")
    assert t.append(make(0, 5), "v") == 0
    c = t.consumer("c")
    assert c.poll().count() == 0
    assert t.append(make(5, 9), "v") == 5
    assert [(r.offset, r.v) for r in c.poll(2).collect()] == [(5, 5), (6, 6)]
    c.reset()
    assert c.poll().count() == 4
    with pytest.raises(ValueError):
        t.consumer("c")
    c.commit()
    assert t.compact(width=4) == 8 and [r.offset for r in t.read().collect()] == [8]
    c.seek(8)
    assert [r.v for r in c.poll().collect()] == [8]
    c.delete()
    assert t.cursors.read() == {}


def test_index_changes(spark):
    d = spark.createDataFrame([(1, "a1 b1", "b1 c1"), (2, None, "d1")], "k long, old string, new string")
    got = {(r.token, r.k, r.added) for r in fulltext.index_changes(d, "k", "old", "new").collect()}
    assert got == {("a1", 1, False), ("c1", 1, True), ("d1", 2, True)}
    base = fulltext.postings(d, "k", "old")
    after = fulltext.apply_changes(base, fulltext.index_changes(d, "k", "old", "new"), "k")
    assert {(r.token, r.k) for r in after.collect()} == {(r.token, r.k) for r in fulltext.postings(d, "k", "new").collect()}


def test_merkle_levels(spark):
    from pyspark.sql import functions as F

    d = spark.range(3000).select(F.col("id").alias("k"), F.col("id").alias("v"))
    a = merkle.leaves(d, "k", [F.col("v")])
    b = merkle.leaves(d.withColumn("v", F.when(F.col("k") == 1500, -1).otherwise(F.col("v"))), "k", [F.col("v")])
    assert [r.key for r in merkle.differing(merkle.level(a), merkle.level(b)).collect()] == [1]
    assert merkle.root(a, 2).count() == 1 and merkle.root(a, 2).first().hash != merkle.root(b, 2).first().hash


def test_registry_knows_the_prelude():
    assert {"full_text", "merkle", "script", "indexer", "archiver"} <= set(engine.REGISTRY)


def test_sync_flags_keep_values_in_rows_and_snapshots(spark, db, tmp_path):
    t = db.table("users", TableConfig(sync=True))
    own = rows(spark, ("a", "v1", 1), ("b", "w", 1)).withColumn("sync", F.lit(None).cast("boolean"))
    flag = spark.createDataFrame([("a", "set_sync", None, h(2), "0" * 16, False)], SHAPE + ", sync boolean")
    t.insert(own)
    t.insert(flag)
    assert {(r.pk, r.value, r.sync, r.H) for r in t.rows().collect()} == {("a", "v1", False, h(2)), ("b", "w", None, h(1))}
    t.snapshot(str(tmp_path / "snap"))
    again = resolve.replay(spark.read.parquet(str(tmp_path / "snap")), t.plain().limit(0), ["value"])
    assert {(r.pk, r.value, r.sync, r.H) for r in again.collect()} == {("a", "v1", False, h(2)), ("b", "w", None, h(1))}


def test_tables_hold_all_types_and_report_what_they_refuse(spark, db):
    t = db.table("carts", TableConfig(sync=True))
    made = [("a", ["Record:n"], "type", "Counter", '{"do":"increment","n":2}', 1), ("a", ["Record:n"], "type", "Counter", '{"do":"decrement","n":5}', 2), ("a", None, "jump", None, None, 3), ("b", None, "replace", None, 'say "hi"', 1)]
    t.insert(spark.createDataFrame([(pk, p, op, tag, v, h(ms), "0" * 16) for pk, p, op, tag, v, ms in made], "pk string, path array<string>, op string, tag string, value string, H string, dev string"))
    cells = {r.pk: r for r in fold.states(t.cells()).collect()}
    assert cells["a"].value.count("[2,5]") == 1 and cells["b"].value == '"say \\"hi\\""'
    assert [(r.pk, r.offset) for r in t.dead_letters().collect()] == [("a", 2)]


def test_logs_compact_when_they_are_fragmented(spark, db):
    t = db.table("users", TableConfig(sync=True))
    for n in range(3):
        t.insert(rows(spark, ("a", f"v{n}", n + 1)))
    assert not t.maybe_compact(0.9) and t.maybe_compact(0.5) and t.rows().first().value == "v2"


def test_the_scheduler_sleeps_until_timers_are_due(spark, db):
    db.table("t")
    fired = []

    @register("sleeper")
    class Sleeper(Operator):
        def timer(self, payload):
            fired.append((payload, db.time.ms))
            return engine.FINISH if payload == "last" else engine.CONTINUE

    def sleep(s):
        db.time.slept.append(round(s * 1000))
        db.time.ms += max(1, round(s * 1000))

    db.sleep = sleep
    db.operator("s", OperatorConfig("sleeper"))
    db.register_timer("s", 1400, "first")
    db.register_timer("s", 99_000, "last")
    db.register_timer("nobody", 1100, "x")
    assert db.next_due() == 1400 and db.is_table_open("t") and db.list_open_tables() == ["t"]
    db.run_scheduler(lambda: False)
    assert fired == [("first", 1400), ("last", 99_000)] and db.time.slept == [400, 60_000, 37_600] and db.phase("s") == FINISHED
    db.close_table("t")
    assert not db.is_table_open("t") and db.contains_table("t")


def test_hash_tree_leaves_are_injective_and_roots_single(spark):
    told = lambda *own: [r.hash for r in merkle.leaves(spark.createDataFrame([(1, *x) for x in own], "k long, a string, b string"), "k", [F.col("a"), F.col("b")]).collect()]
    assert len(set(told(("a|b", "c"), ("a", "b|c"), (None, "x"), ("", "x"), ("-", "x"), ("1:a", "x")))) == 6
    wide = spark.createDataFrame([(k, f"{k}") for k in (-5, 0, 7, 1 << 40, (1 << 62) + 3)], "key long, hash string")
    assert merkle.root(wide).count() == 1 and merkle.root(wide.limit(0)).count() == 0


def test_directives_have_four_spellings():
    assert [prelude.directive(x) for x in (None, False, "continue", "Continue", True, "finish", "Finish")] == ["continue"] * 4 + ["finish"] * 3
    for word in ("FINISH", "stop", "cOntinue"):
        with pytest.raises(ValueError):
            prelude.directive(word)


def test_catalogs_keep_versions_and_settle_what_writers_left(spark, tmp_path):
    at = Storage(spark)
    a, b = Catalog(at, f"file://{tmp_path}/c"), Catalog(at, f"file://{tmp_path}/c")
    assert a.read() == {} and at.names(f"{tmp_path}/none") == []
    for n in range(6):
        (a, b)[n % 2].put(f"k{n}", n)
    assert a.read() == b.read() == {f"k{n}": n for n in range(6)} and len([x for x in at.names(a.path) if x.endswith(".json")]) == Catalog.KEPT
    at.create(f"{a.path}/7.json", "{")  # a writer that has died
    a.drop("k0")
    at.create(f"{a.path}/8.json", '{"whole": 1}')  # another, before its mark
    b.put("last", 2)
    assert a.read() == {"whole": 1, "last": 2} and not at.create(f"{a.path}/9.json", "x")
