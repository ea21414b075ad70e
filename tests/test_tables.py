"""Queries on tables as larger inputs have them: folders of files, keys of any range."""

import duckdb
import pytest

from driftlog.plans import registry


def both(spark, at, name, table):
    rows = registry.queries()[name](spark, at)
    con = duckdb.connect()
    con.execute(f"SET TimeZone='UTC'; CREATE VIEW {table} AS SELECT * FROM '{at}/{table}.parquet/*.parquet'")
    return sorted(map(tuple, rows.collect()), key=str), sorted(con.execute(f"SELECT {', '.join(rows.columns)} FROM ({registry.oracle_sql()[name]})").fetchall(), key=str)


@pytest.mark.parametrize("name, table", [("stream_fulltext", "documents"), ("stream_changes", "events"), ("stream_resolve", "events")])
def test_streams_read_folders(name, table, spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    got, want = both(spark, str(tmp_path), name, table)
    assert got == want and got


@pytest.mark.parametrize("keys", [[0, 5], [1, 3_000_000], [*range(1020, 1030), 1_048_575, 1_048_576, 9_000_000], []])
def test_merkle_root_of_any_range(keys, spark, tmp_path):
    rows = [(k, k + 0.25, "FOP"[k % 3]) for k in keys]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    got, want = both(spark, str(tmp_path), "merkle_root", "orders")
    assert got == want and len(got) == 1
