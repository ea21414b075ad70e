"""Queries on keyed tables: reads, scans, writes and overlays, over `orders` by its key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.operators import kv
from driftlog.sources.eventlog import table

KEY = "o_orderkey"


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders, for reads that need no second table."""
    return table(spark, sf_dir, "orders").select(KEY, "o_totalprice", "o_orderstatus")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three orders, so that updates find keys that are missing; every seventh has no status."""
    status = F.when(F.col(KEY) % 7 != 0, F.col("o_orderstatus")).alias("o_orderstatus")
    return table(spark, sf_dir, "orders").filter(F.col(KEY) % 3 != 0).select(KEY, "o_totalprice", status)


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates: every fifth order, with a new status."""
    return table(spark, sf_dir, "orders").filter(F.col(KEY) % 5 == 0).select(KEY, "o_totalprice", F.lit("U").alias("o_orderstatus"))


STORED = "b AS (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders)"
BASE = "b AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey%7<>0 THEN o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey%3<>0)"
PENDING = "u AS (SELECT o_orderkey, o_totalprice, 'U' AS o_orderstatus FROM orders WHERE o_orderkey%5=0)"
BOTH = f"WITH {BASE}, {PENDING}"


def _bounds(spark, sf_dir):
    n = table(spark, sf_dir, "orders").agg(F.max(KEY)).first()[0]
    return n // 4, 3 * n // 4


def scan_entries(spark, sf_dir):
    return kv.entries(stored(spark, sf_dir))


def scan_keys(spark, sf_dir):
    return kv.keys(stored(spark, sf_dir), KEY)


def scan_values(spark, sf_dir):
    return kv.values(stored(spark, sf_dir), KEY)


def scan_range(spark, sf_dir):
    return kv.scan_range(stored(spark, sf_dir), KEY, *_bounds(spark, sf_dir))


def scan_range_rev(spark, sf_dir):
    return kv.scan_range(stored(spark, sf_dir), KEY, *_bounds(spark, sf_dir), reverse=True)


def scan_rev(spark, sf_dir):
    return kv.scan_reverse(stored(spark, sf_dir), KEY)


def endpoints(spark, sf_dir):
    b = stored(spark, sf_dir)
    return kv.first(b, KEY).withColumn("place", F.lit("first")).unionByName(kv.last(b, KEY).withColumn("place", F.lit("last")))


def size_live(spark, sf_dir):
    return kv.size(stored(spark, sf_dir))


def kv_get(spark, sf_dir):
    return kv.get(base(spark, sf_dir), pending(spark, sf_dir), KEY)


def kv_contains(spark, sf_dir):
    return kv.contains(base(spark, sf_dir), pending(spark, sf_dir), KEY)


def kv_put(spark, sf_dir):
    return kv.put(base(spark, sf_dir), pending(spark, sf_dir), KEY)


def kv_put_if_absent(spark, sf_dir):
    return kv.put_if_absent(base(spark, sf_dir), pending(spark, sf_dir), KEY)


def kv_put_if_absent_first(spark, sf_dir):
    """Four updates of a key: the first to arrive, where the key is new."""
    return kv.put_if_absent(base(spark, sf_dir), _churn(spark, sf_dir), KEY, "arrival")


def kv_inserted(spark, sf_dir):
    return kv.inserted(base(spark, sf_dir), pending(spark, sf_dir), KEY)


def kv_replace(spark, sf_dir):
    return kv.replace(base(spark, sf_dir), pending(spark, sf_dir), KEY)


def kv_update(spark, sf_dir):
    """Doubles every fifth order's status, inserts it where there is none, removes those of status F."""
    change = lambda old: F.when(old.isNull(), F.lit("new")).when(old != "F", F.concat(old, old))  # noqa: E731, rows that nobody asked for keep their nulls
    return kv.update(base(spark, sf_dir).select(KEY, "o_orderstatus"), pending(spark, sf_dir), KEY, "o_orderstatus", change)


def kv_delete(spark, sf_dir):
    return kv.delete(base(spark, sf_dir), pending(spark, sf_dir), KEY)


def kv_bulk_delete(spark, sf_dir):
    return kv.deleted(base(spark, sf_dir), pending(spark, sf_dir), KEY).agg(F.count("*").alias("removed"))


def _churn(spark, sf_dir):
    """Four updates of each of the keys that are divisible by four, by arrival."""
    o = table(spark, sf_dir, "orders")
    return o.select((F.col(KEY) - F.col(KEY) % 4).alias(KEY), "o_totalprice", "o_orderstatus", F.col(KEY).alias("arrival"))


CHURN = 'c AS (SELECT o_orderkey - o_orderkey%4 AS o_orderkey, o_totalprice, o_orderstatus, o_orderkey AS arrival FROM orders)'
LAST = "l AS (SELECT o_orderkey, o_totalprice, o_orderstatus FROM c x WHERE arrival=(SELECT max(arrival) FROM c y WHERE y.o_orderkey=x.o_orderkey))"


def kv_bulk_put(spark, sf_dir):
    return kv.bulk_put(base(spark, sf_dir), _churn(spark, sf_dir), KEY, "arrival")


def kv_bulk_put_sorted(spark, sf_dir):
    return kv.bulk_put_sorted(base(spark, sf_dir), _churn(spark, sf_dir), KEY, "arrival")


def kv_fragmentation(spark, sf_dir):
    """What a compaction drops of the churned log, where orders of status F are removals."""
    return kv.fragmentation(_churn(spark, sf_dir).withColumnRenamed("arrival", "offset"), KEY, F.col("o_orderstatus") == "F")


def kv_put_bounded(spark, sf_dir):
    """A state with room for as many entries as there are orders."""
    return kv.put_bounded(base(spark, sf_dir), pending(spark, sf_dir), KEY, table(spark, sf_dir, "orders").count())


def kv_churn_last(spark, sf_dir):
    return kv.last_writes(_churn(spark, sf_dir), KEY, "arrival").select(KEY, "o_totalprice", "o_orderstatus")


def kv_clear(spark, sf_dir):
    return kv.clear(stored(spark, sf_dir))


def overlay_ordered(spark, sf_dir):
    return kv.overlay(base(spark, sf_dir), pending(spark, sf_dir), KEY)


def overlay_unordered(spark, sf_dir):
    return kv.overlay_unordered(base(spark, sf_dir), pending(spark, sf_dir), KEY)


def overlay_size(spark, sf_dir):
    return kv.overlay_size(base(spark, sf_dir), pending(spark, sf_dir), KEY)


def label_overlay(spark, sf_dir):
    """Documents' languages under pending toxicity labels, by id; labels have documents only."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("toxic="), F.col("toxic").cast("string")).alias("lang"))
    return kv.overlay(docs, labels, "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        scan_entries, scan_keys, scan_values, scan_range, scan_range_rev, scan_rev, endpoints, size_live, kv_get, kv_contains, kv_put, kv_put_if_absent,
        kv_put_if_absent_first, kv_bulk_put_sorted, kv_fragmentation, kv_put_bounded, kv_inserted, kv_replace, kv_update, kv_delete, kv_bulk_delete, kv_bulk_put, kv_churn_last, kv_clear, overlay_ordered, overlay_unordered,
        overlay_size, label_overlay,
    )
}

RANGE = f"WITH {STORED}, m AS (SELECT max(o_orderkey) AS n FROM orders) SELECT b.* FROM b, m WHERE o_orderkey >= n//4 AND o_orderkey < 3*n//4"
MERGED = f"{BOTH} SELECT * FROM u UNION ALL SELECT * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM u)"

SQL = {
    "scan_entries": f"WITH {STORED} SELECT * FROM b",
    "scan_keys": f"WITH {STORED} SELECT o_orderkey FROM b",
    "scan_values": f"WITH {STORED} SELECT o_totalprice, o_orderstatus FROM b",
    "scan_range": RANGE + " ORDER BY o_orderkey",
    "scan_range_rev": RANGE + " ORDER BY o_orderkey DESC",
    "scan_rev": f"WITH {STORED} SELECT * FROM b ORDER BY o_orderkey DESC",
    "endpoints": f"WITH {STORED} SELECT b.*, 'first' AS place FROM b WHERE o_orderkey=(SELECT min(o_orderkey) FROM b) UNION ALL SELECT b.*, 'last' FROM b WHERE o_orderkey=(SELECT max(o_orderkey) FROM b)",
    "size_live": f"WITH {STORED} SELECT count(*) AS size FROM b",
    "kv_get": f"{BOTH} SELECT * FROM b WHERE o_orderkey IN (SELECT o_orderkey FROM u)",
    "kv_contains": f"{BOTH} SELECT o_orderkey, o_orderkey IN (SELECT o_orderkey FROM b) AS found FROM u",
    "kv_put": f"{BOTH} SELECT * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM u) UNION ALL SELECT * FROM u",
    "kv_put_if_absent": f"{BOTH} SELECT * FROM b UNION ALL SELECT * FROM u WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)",
    "kv_inserted": f"{BOTH} SELECT * FROM u WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)",
    "kv_replace": f"{BOTH} SELECT u.o_orderkey, b.o_totalprice AS previous_o_totalprice, b.o_orderstatus AS previous_o_orderstatus FROM u LEFT JOIN b USING (o_orderkey)",
    "kv_update": f"""{BOTH} SELECT o_orderkey, o_orderstatus FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM u)
UNION ALL SELECT o_orderkey, o_orderstatus||o_orderstatus FROM b WHERE o_orderkey IN (SELECT o_orderkey FROM u) AND o_orderstatus<>'F'
UNION ALL SELECT o_orderkey, 'new' FROM u WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b WHERE o_orderstatus IS NOT NULL)""",
    "kv_delete": f"{BOTH} SELECT * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM u)",
    "kv_bulk_delete": f"{BOTH} SELECT count(*) AS removed FROM b WHERE o_orderkey IN (SELECT o_orderkey FROM u)",
    "kv_bulk_put": f"WITH {BASE}, {CHURN}, {LAST} SELECT * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM l) UNION ALL SELECT * FROM l",
    "kv_put_if_absent_first": f"WITH {BASE}, {CHURN} SELECT * FROM b UNION ALL SELECT o_orderkey, o_totalprice, o_orderstatus FROM c x WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b) AND arrival=(SELECT min(arrival) FROM c y WHERE y.o_orderkey=x.o_orderkey)",
    "kv_bulk_put_sorted": f"WITH {BASE}, {CHURN}, {LAST} SELECT * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM l) UNION ALL SELECT * FROM l",
    "kv_fragmentation": f"WITH {CHURN}, {LAST}, n AS (SELECT (SELECT count(*) FROM c) AS records, (SELECT count(*) FROM l WHERE o_orderstatus<>'F') AS live) SELECT records, live, CAST(records - live AS DOUBLE) / CAST(records AS DOUBLE) AS ratio FROM n",
    "kv_put_bounded": f"{BOTH} SELECT * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM u) UNION ALL SELECT * FROM u",
    "kv_churn_last": f"WITH {CHURN}, {LAST} SELECT * FROM l",
    "kv_clear": f"WITH {STORED} SELECT * FROM b WHERE false",
    "overlay_ordered": MERGED,
    "overlay_unordered": MERGED,
    "overlay_size": f"{BOTH} SELECT count(*) AS size FROM (SELECT o_orderkey FROM b UNION SELECT o_orderkey FROM u)",
    "label_overlay": "SELECT d.doc_id, coalesce('toxic=' || CAST(l.toxic AS VARCHAR), d.lang) AS lang FROM documents d LEFT JOIN labels l USING (doc_id)",
}
