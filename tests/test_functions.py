from pyspark.sql import functions as F

from driftlog.functions import clock, globs
from driftlog.functions.retry import RetryConfig, backoff_ms
from driftlog.functions.text import tokens, words


def test_clock_orders_by_ms_then_logical_then_device(spark):
    rows = [(5, 1, 0), (5, 0, 9), (4, 9, 9), (5, 1, 1)]
    d = spark.createDataFrame(rows, "ms long, lg long, dev long").withColumn("H", clock.clock(F.col("ms"), F.col("lg"), F.col("dev")))
    assert [(r.ms, r.lg, r.dev) for r in d.orderBy("H").collect()] == sorted(rows)
    assert d.filter(F.length("H") != 32).isEmpty()


def test_clock_parts_and_bounds(spark):
    d = spark.createDataFrame([(123, 7, 255), (1 << 48, 0, 0)], "ms long, lg long, dev long").withColumn("H", clock.clock(F.col("ms"), F.col("lg"), F.col("dev")))
    a, b = d.select(clock.ms_of(F.col("H")), clock.logical_of(F.col("H")), clock.shown(F.col("H")), "H").collect()
    assert (a[0], a[1], a[2]) == (123, 7, "Hlc(123:7:00000000000000ff)")
    assert b.H is None


def test_globs():
    for pattern, name, says in [
        ("users", "users", True), ("users", "users2", False), ("wiki-*", "wiki-en", True), ("wiki-*", "a-wiki-", False), ("*-log", "db-log", True),
        ("*-log", "log", False), ("user-*-data", "user-7-data", True), ("user-*-data", "user-data", False), ("*", "anything", True), ("a*a", "a", False), ("a.c", "abc", False),
    ]:
        assert globs.matches_name(pattern, name) is says, (pattern, name)


def test_glob_columns_agree_with_names(spark):
    names = ["users", "wiki-en", "db-log", "user-7-data", "a", "aa", "a.c"]
    d = spark.createDataFrame([(n,) for n in names], "table_id string")
    for p in ["users", "wiki-*", "*-log", "user-*-data", "*", "a*a", "a.c"]:
        got = {r.table_id for r in d.filter(globs.matches(F.col("table_id"), p)).collect()}
        assert got == {n for n in names if globs.matches_name(p, n)}, p
    assert globs.subscribed(d, []).isEmpty()


def test_tokens(spark):
    d = spark.createDataFrame([("Hello, HELLO db-v2 x",), (None,), ("é x",)], "t string")
    assert [r[0] for r in d.select(tokens(F.col("t"))).collect()] == [["db", "hello", "v2"], [], ["é"]]
    assert d.select(words(F.col("t"))).first()[0] == ["hello", "hello", "db", "v2"]


def test_backoff_schedule():
    assert [backoff_ms(RetryConfig(), n) for n in range(1, 12)] == [110, 217, 401, 838, 1745, 3228, 6734, 14026, 25978, 31745, 33039]
    assert RetryConfig().exhausted(5) and not RetryConfig(max_attempts=0).exhausted(10**6)
