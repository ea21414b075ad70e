"""All queries over the test tables, with the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftlog.plans import keyed, replicated, resolution, streams

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {k: v for m in (resolution, keyed, replicated, streams) for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in (resolution, keyed, replicated, streams) for k, v in m.SQL.items()}
