"""An event log derived from the `events` table: clocks up to five days off arrival, four devices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.functions.clock import clock

DAY_SPREAD = 864_000_001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """offset, pk, event_type, value, k, dev (number), H."""
    e = table(spark, sf_dir, "events")
    offset = F.col("event_id")
    ms = F.unix_millis(F.col("ts").cast("timestamp")) + (offset * 2654435761 % DAY_SPREAD) - 432_000_000
    return e.select(
        offset.alias("offset"), F.col("user_id").alias("pk"), "event_type", "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"), (offset % 4).alias("dev"), clock(ms, offset % 65536, offset % 4).alias("H"),
    )


#: The same log in DuckDB.
LOG_SQL = """log AS (
  SELECT event_id AS "offset", user_id AS pk, event_type, value, CAST(props->>'$.k' AS BIGINT) AS k, event_id % 4 AS dev,
    lpad(lower(to_hex(epoch_us(ts)//1000 + (event_id*2654435761 % 864000001) - 432000000)), 12, '0')
    || lpad(lower(to_hex(event_id % 65536)), 4, '0') || lpad(lower(to_hex(event_id % 4)), 16, '0') AS H
  FROM events)"""
