"""Every query with an oracle agrees with DuckDB at sf0.001."""

import duckdb
import pandas as pd
import pytest

from driftlog.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    yield con
    con.close()


def plain(frame):
    def text(v):
        if pd.isna(v):
            return "null"
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    cols = sorted(frame.columns)
    return sorted("|".join(text(v) for v in row) for row in frame[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, sf, duck):
    got = registry.queries()[name](spark, sf).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
