"""The two queries that SQL can express agree with DuckDB at sf0.001."""

import duckdb
import pytest

from driftlog.llm.oracles import SQL
from driftlog.llm.queries import queries


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want, got = con.execute(SQL[name]).df(), queries()[name](spark, sf).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda d: sorted(tuple(map(str, r)) for r in d[cols].itertuples(index=False))
    assert rows(got) == rows(want)
    con.close()
