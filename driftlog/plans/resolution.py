"""Queries on event resolution: rows, clocks, change feeds, policies, types, merges, nesting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.operators import fold, nested, resolve
from driftlog.sources.eventlog import LOG_SQL, log, table


def writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signup replaces a row's value, error deletes it."""
    e = log(spark, sf_dir).filter(F.col("event_type").isin("signup", "error"))
    return e.withColumn("op", F.when(F.col("event_type") == "signup", "replace").otherwise("delete"))


def with_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, where every eleventh event sets the sync flag instead."""
    is_sync = F.col("offset") % 11 == 0
    return writes(spark, sf_dir).withColumn("op", F.when(is_sync, "set_sync").otherwise(F.col("op"))).withColumn(
        "sync", F.when(is_sync, F.col("offset") % 2 == 0)
    )


WRITES = LOG_SQL + """, w AS (SELECT *, CASE WHEN event_type='signup' THEN 'replace' ELSE 'delete' END AS op
  FROM log WHERE event_type IN ('signup','error'))"""
SYNCED = WRITES + """, s AS (SELECT * EXCLUDE (op), CASE WHEN "offset"%11=0 THEN 'set_sync' ELSE op END AS op,
  CASE WHEN "offset"%11=0 THEN "offset"%2=0 END AS sync FROM w)"""
#: Independent of the windows: an event takes effect if no earlier arrival has a clock as new.
EFFECTIVE = """, e AS (SELECT x.* FROM s x WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.pk=x.pk AND y."offset"<x."offset" AND y.H>=x.H))"""


def lww_root_resolve(spark, sf_dir):
    return resolve.resolve(writes(spark, sf_dir), ["value"]).select("pk", "tombstone", "value", "H")


def lww_root_live(spark, sf_dir):
    return resolve.live(resolve.resolve(writes(spark, sf_dir), ["value"])).select("pk", "value")


def snapshot_replay(spark, sf_dir):
    """A snapshot of the log's first half, then the rest replayed over it."""
    e = writes(spark, sf_dir)
    half = e.agg(F.max("offset")).first()[0] // 2
    base = resolve.resolve(e.filter(F.col("offset") <= half), ["value"])
    return resolve.replay(base, e.filter(F.col("offset") > half), ["value"]).select("pk", "tombstone", "value", "H")


def lww_cell_clock(spark, sf_dir):
    return resolve.max_clock(log(spark, sf_dir))


def lww_change_feed(spark, sf_dir):
    f = resolve.change_feed(writes(spark, sf_dir), ["value"])
    return f.select("pk", "offset", "H", F.col("current.tombstone").alias("tombstone"), F.col("current.value").alias("value"), "previous_H", F.col("previous.value").alias("previous_value"), "has_previous")


def lww_gate_by_stretches(spark, sf_dir):
    """Effective events, by stretches of a thousand offsets."""
    return resolve.gate_by_stretches(writes(spark, sf_dir), stretch=1000).filter("eff").select("pk", "offset", "op", "H")


def set_sync_gate(spark, sf_dir):
    return resolve.resolve_with_sync(with_sync(spark, sf_dir), ["value"]).select("pk", "tombstone", "value", "sync", "H")


def set_sync_feed(spark, sf_dir):
    f = resolve.change_feed(with_sync(spark, sf_dir), ["value"])
    return f.select("pk", "offset", "op", F.col("current.tombstone").alias("tombstone"), F.col("current.value").alias("value"), F.col("previous.value").alias("previous_value"))


def remote_origin_filter(spark, sf_dir):
    own = resolve.accept_remote(with_sync(spark, sf_dir), "1")
    return own.groupBy("pk", "op").agg(F.count("*").alias("n"))


def _paths(e: DataFrame) -> DataFrame:
    a, b = F.concat(F.lit("f"), (F.col("offset") % 3).cast("string")), F.concat(F.lit("g"), (F.col("k") % 3).cast("string"))
    depth = F.col("offset") % 3
    return e.withColumn("path", F.when(depth == 0, F.array().cast("array<string>")).when(depth == 1, F.array(a)).otherwise(F.array(a, b)))


def nested_sync_policy(spark, sf_dir):
    e = log(spark, sf_dir)
    flags = _paths(e.filter("event_type = 'click'")).groupBy("pk", "path").agg(F.max_by(F.col("offset") % 2 == 0, "H").alias("sync"))
    paths = _paths(e.filter("event_type = 'view'")).select("pk", "path").distinct()
    return resolve.nearest_flag(paths, flags).select("pk", F.array_join("path", "/").alias("path"), "synced")


def type_heal_root(spark, sf_dir):
    e = log(spark, sf_dir).filter(F.col("event_type").isin("view", "click", "purchase")).withColumnRenamed("event_type", "tag")
    t = resolve.heal_types(e)
    return t.groupBy("pk").agg(
        F.max_by("type_after", "offset").alias("type_tag"), F.sum(F.col("accepted").cast("long")).alias("accepted"), F.sum(F.col("healed").cast("long")).alias("healed")
    )


def _replicas(spark, sf_dir):
    e = writes(spark, sf_dir)
    rows = [resolve.resolve(e.filter(F.col("offset") % 2 == i), ["value"]).withColumn("sync", F.lit(i == 0)) for i in (0, 1)]
    return rows


def cell_merge_tombstone(spark, sf_dir):
    return resolve.merge_cells(*_replicas(spark, sf_dir), ["value"]).select("pk", "tombstone", "value", "sync", "H")


def scalar_merge_replicas(spark, sf_dir):
    e = log(spark, sf_dir).filter("event_type = 'signup'").withColumn("op", F.lit("replace"))
    rows = [resolve.resolve(e.filter(F.col("dev") == i), ["k"]).withColumn("sync", F.lit(None).cast("boolean")) for i in range(4)]
    own = rows[0]
    for r in rows[1:]:
        own = resolve.merge_cells(own, r, ["k"])
    return own.select("pk", "k", "H")


def watermark(spark, sf_dir) -> str:
    """The clock of the event half way through the log: one row."""
    e = log(spark, sf_dir)
    half = e.agg(F.max("offset")).first()[0] // 2
    return e.filter(F.col("offset") == half).first().H


WM = """, wm AS (SELECT H AS wm FROM log WHERE "offset" = (SELECT max("offset")//2 FROM log))"""


def tombstone_gc(spark, sf_dir):
    rows = resolve.resolve(writes(spark, sf_dir), ["value"])
    return resolve.collect_tombstones(rows, watermark(spark, sf_dir)).select("pk", "tombstone", "H")


def subtree_max_clock(spark, sf_dir):
    e = _paths(log(spark, sf_dir)).withColumn("top", F.coalesce(F.get("path", 0), F.lit("")))
    return resolve.max_clock(e, ("pk", "top"))


def nested_path_fold(spark, sf_dir):
    e = _paths(log(spark, sf_dir)).withColumn("op", F.when(F.col("event_type") == "error", "delete").otherwise("replace")).withColumn("value", F.col("k").cast("string"))
    return nested.fold(e)


def mixed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log of all kinds of operations, each on its field of the row's record: views count, clicks add to
    and remove from a set, signups replace a name. Errors are of a type that does not exist."""
    e, kind, even = log(spark, sf_dir).filter("event_type <> 'purchase'"), F.col("event_type"), F.col("offset") % 2 == 0
    name = F.when(kind == "view", "views").when(kind == "click", "likes").otherwise("name")
    n, elem = F.col("k").cast("string"), F.concat(F.lit('"'), F.col("k").cast("string"), F.lit('"'))
    arg = F.when(kind == "view", F.concat(F.lit('{"do":"'), F.when(even, "increment").otherwise("decrement"), F.lit('","n":'), n, F.lit("}")))
    arg = arg.when(kind == "click", F.concat(F.lit('{"do":"'), F.when(even, "add").otherwise("remove"), F.lit('","elem":'), elem, F.lit("}"))).otherwise(elem)
    return e.select(
        "pk", "offset", F.array(F.concat(F.lit("Record:"), name)).alias("path"), F.when(kind == "signup", "replace").otherwise("type").alias("op"),
        F.when(kind == "view", "Counter").when(kind == "click", "Set").when(kind == "signup", "String").otherwise("Nothing").alias("tag"),
        arg.alias("arg"), "H", F.col("dev").cast("string").alias("dev"),
    )


def _mixed_told(folded: DataFrame) -> DataFrame:
    value = F.col("value")
    views = F.from_json(F.get_json_object(value, "$.views.value"), "map<string,array<long>>")
    likes = F.from_json(F.get_json_object(value, "$.likes.value"), "map<string,struct<updated:string,deleted:string>>")
    none = F.lit(0).cast("long")
    return fold.states(folded).select(
        "pk", F.coalesce(F.aggregate(F.map_values(views), none, lambda a, x: a + x[0] - x[1]), none).alias("views"),
        F.size(F.filter(F.coalesce(F.map_values(likes), F.array().cast("array<struct<updated:string,deleted:string>>")), lambda x: F.coalesce(x["updated"], F.lit("")) > F.coalesce(x["deleted"], F.lit("")))).cast("long").alias("likes"),
        F.get_json_object(value, "$.name.value").alias("name"),
    )


def mixed_log_fold(spark, sf_dir):
    return _mixed_told(fold.fold(mixed_log(spark, sf_dir)))


def mixed_log_dead_letters(spark, sf_dir):
    return fold.dead_letters(fold.fold(mixed_log(spark, sf_dir)))


def mixed_log_resumed(spark, sf_dir):
    """The log's first half folded, and the second half folded on from these states."""
    e = mixed_log(spark, sf_dir)
    half = e.agg(F.max("offset")).first()[0] // 2
    return _mixed_told(fold.fold(e.filter(F.col("offset") > half), before=fold.fold(e.filter(F.col("offset") <= half))))


def mixed_log_merge(spark, sf_dir):
    """Replicas that have each seen some devices' events, merged by merge operations into empty rows."""
    e = mixed_log(spark, sf_dir)
    sides = [fold.states(fold.fold(e.filter(F.col("dev").isin(*own)))) for own in (["0", "1"], ["2", "3"])]
    cell = F.concat(F.lit('{"tag":"Record","value":'), F.col("value"), F.lit(',"h":"'), F.col("H"), F.lit('","sync":null}'))
    ops = [s.filter("tag = 'Record'").select("pk", F.lit(i).cast("long").alias("offset"), F.lit("merge").alias("op"), cell.alias("arg"), F.col("H"), F.lit("0").alias("dev")) for i, s in enumerate(sides)]
    merged = _mixed_told(fold.fold(ops[0].unionByName(ops[1])))
    return merged


def mixed_log_compact(spark, sf_dir):
    """Elements that the sets still know of after a compaction."""
    folded = fold.states(fold.fold(mixed_log(spark, sf_dir), watermark=watermark(spark, sf_dir)))
    likes = F.from_json(F.get_json_object("value", "$.likes.value"), "map<string,struct<updated:string,deleted:string>>")
    return folded.select("pk", F.coalesce(F.size(F.map_keys(likes)), F.lit(0)).cast("long").alias("elements")).filter("elements > 0")


def nested_projection(spark, sf_dir):
    """Of cells folded at paths, those at or below the field f1: all have been written."""
    e = _paths(log(spark, sf_dir)).filter("size(path) = 2").withColumn("op", F.lit("replace")).withColumn("value", F.col("k").cast("string"))
    return nested.project(nested.fold(e), "f2").select("pk", "path", "H")


QUERIES = {
    f.__name__: f
    for f in (
        lww_root_resolve, lww_root_live, snapshot_replay, lww_cell_clock, lww_change_feed, lww_gate_by_stretches, set_sync_gate, set_sync_feed, remote_origin_filter, nested_sync_policy,
        type_heal_root, cell_merge_tombstone, scalar_merge_replicas, tombstone_gc, subtree_max_clock, nested_path_fold, mixed_log_fold, mixed_log_dead_letters, mixed_log_resumed, mixed_log_merge,
        mixed_log_compact, nested_projection,
    )
}

RESOLVED = """, r AS (SELECT pk, op='delete' AS tombstone, CASE WHEN op='replace' THEN value END AS value, H FROM w x
  WHERE NOT EXISTS (SELECT 1 FROM w y WHERE y.pk=x.pk AND (y.H>x.H OR (y.H=x.H AND y."offset"<x."offset"))))"""
PATHS = """, p AS (SELECT *, CASE "offset"%3 WHEN 0 THEN '' WHEN 1 THEN 'f'||("offset"%3) ELSE 'f'||("offset"%3)||'/g'||(k%3) END AS path FROM log)"""

MIXED = LOG_SQL + """, t AS (SELECT pk, elem, max(CASE WHEN add THEN H END) AS u, max(CASE WHEN NOT add THEN H END) AS d FROM (SELECT pk, k AS elem, "offset"%2=0 AS add, H FROM log WHERE event_type='click') GROUP BY ALL),
v AS (SELECT pk, sum(CASE WHEN "offset"%2=0 THEN k ELSE -k END) AS views FROM log WHERE event_type='view' GROUP BY pk),
l AS (SELECT pk, count(*) FILTER (coalesce(u,'') > coalesce(d,'')) AS likes FROM t GROUP BY pk),
s AS (SELECT pk, arg_max(CAST(k AS VARCHAR), H) AS name FROM log WHERE event_type='signup' GROUP BY pk),
pks AS (SELECT DISTINCT pk FROM log WHERE event_type <> 'purchase'), seen AS (SELECT DISTINCT pk FROM log WHERE event_type IN ('view','click','signup'))"""
MIXED_ROWS = "SELECT pk, CAST(coalesce(views,0) AS BIGINT) AS views, CAST(coalesce(likes,0) AS BIGINT) AS likes, name FROM {} LEFT JOIN v USING (pk) LEFT JOIN l USING (pk) LEFT JOIN s USING (pk)"

SQL = {
    "mixed_log_fold": f"WITH {MIXED} {MIXED_ROWS.format('pks')}",
    "mixed_log_resumed": f"WITH {MIXED} {MIXED_ROWS.format('pks')}",
    "mixed_log_merge": f"WITH {MIXED} {MIXED_ROWS.format('seen')}",
    "mixed_log_dead_letters": f"WITH {LOG_SQL} SELECT pk, \"offset\", 'Refused: no type Nothing' AS error FROM log WHERE event_type='error'",
    "mixed_log_compact": f"WITH {MIXED}{WM} SELECT pk, count(*) AS elements FROM t, wm WHERE coalesce(u,'')>coalesce(d,'') OR coalesce(d,'')>wm GROUP BY pk",
    "nested_projection": f"WITH {LOG_SQL}{PATHS} SELECT pk, path, max(H) AS H FROM p WHERE \"offset\"%3=2 GROUP BY ALL",
    "lww_root_resolve": f"WITH {WRITES}{RESOLVED} SELECT pk, tombstone, value, H FROM r",
    "lww_root_live": f"WITH {WRITES}{RESOLVED} SELECT pk, value FROM r WHERE NOT tombstone",
    "snapshot_replay": f"WITH {WRITES}{RESOLVED} SELECT pk, tombstone, value, H FROM r",
    "lww_cell_clock": f"WITH {LOG_SQL} SELECT pk, max(H) AS H FROM log GROUP BY pk",
    "lww_change_feed": f"""WITH {WRITES}, s AS (SELECT * FROM w){EFFECTIVE}, f AS (SELECT pk, "offset", H, op='delete' AS tombstone,
  CASE WHEN op='replace' THEN value END AS value FROM e)
SELECT pk, "offset", H, tombstone, value, lag(H) OVER o AS previous_H, lag(value) OVER o AS previous_value, lag(1) OVER o IS NOT NULL AS has_previous
FROM f WINDOW o AS (PARTITION BY pk ORDER BY "offset")""",
    "lww_gate_by_stretches": f"""WITH {WRITES}, s AS (SELECT * FROM w){EFFECTIVE} SELECT pk, "offset", op, H FROM e""",
    "set_sync_gate": f"""WITH {SYNCED}{EFFECTIVE} SELECT pk, coalesce(arg_max(op='delete', "offset") FILTER (op<>'set_sync'), true) AS tombstone,
  last(CASE WHEN op='replace' THEN value END ORDER BY "offset") FILTER (op<>'set_sync') AS value,
  arg_max(sync, "offset") FILTER (op='set_sync') AS sync, max(H) AS H FROM e GROUP BY pk""",
    "set_sync_feed": f"""WITH {SYNCED}{EFFECTIVE}, f AS (SELECT pk, "offset", op, (SELECT y."offset" FROM e y WHERE y.pk=x.pk AND y."offset"<=x."offset" AND y.op<>'set_sync' ORDER BY y."offset" DESC LIMIT 1) AS src FROM e x),
g AS (SELECT f.pk, f."offset", f.op, y.op='delete' AS tombstone, CASE WHEN y.op='replace' THEN y.value END AS value FROM f LEFT JOIN e y ON y.pk=f.pk AND y."offset"=f.src)
SELECT *, lag(value) OVER (PARTITION BY pk ORDER BY "offset") AS previous_value FROM g""",
    "remote_origin_filter": f"WITH {SYNCED} SELECT pk, op, count(*) AS n FROM s WHERE op='set_sync' OR dev=1 GROUP BY pk, op",
    "nested_sync_policy": f"""WITH {LOG_SQL}{PATHS}, fl AS (SELECT pk, path, arg_max("offset"%2=0, H) AS sync FROM p WHERE event_type='click' GROUP BY pk, path),
q AS (SELECT DISTINCT pk, path FROM p WHERE event_type='view')
SELECT pk, path, coalesce((SELECT sync FROM fl WHERE fl.pk=q.pk AND (fl.path='' OR fl.path=q.path OR starts_with(q.path, fl.path||'/')) ORDER BY length(fl.path) DESC LIMIT 1), false) AS synced FROM q""",
    "type_heal_root": f"""WITH {LOG_SQL}, t AS (SELECT *, event_type AS tag FROM log WHERE event_type IN ('view','click','purchase')),
n AS (SELECT x.*, NOT EXISTS (SELECT 1 FROM t y WHERE y.pk=x.pk AND y."offset"<x."offset" AND y.H>=x.H) AS newest FROM t x),
b AS (SELECT n.*, (SELECT y.tag FROM n y WHERE y.pk=n.pk AND y."offset"<n."offset" AND y.newest ORDER BY y."offset" DESC LIMIT 1) AS before FROM n)
SELECT pk, arg_max(tag, "offset") FILTER (newest) AS type_tag, CAST(count(*) FILTER (newest OR tag=before) AS BIGINT) AS accepted,
  CAST(count(*) FILTER (newest AND before IS NOT NULL AND tag<>before) AS BIGINT) AS healed FROM b GROUP BY pk""",
    "cell_merge_tombstone": f"""WITH {WRITES}{RESOLVED}, has AS (SELECT pk, bool_or("offset"%2=0) AS local FROM w GROUP BY pk) SELECT pk, tombstone, value, local AS sync, H FROM r JOIN has USING (pk)""",
    "scalar_merge_replicas": f"WITH {LOG_SQL} SELECT pk, arg_max(k, H) AS k, max(H) AS H FROM log WHERE event_type='signup' GROUP BY pk",
    "tombstone_gc": f"WITH {WRITES}{RESOLVED}{WM} SELECT pk, tombstone, H FROM r, wm WHERE NOT tombstone OR H > wm",
    "subtree_max_clock": f"WITH {LOG_SQL}{PATHS} SELECT pk, split_part(path,'/',1) AS top, max(H) AS H FROM p GROUP BY ALL",
}
