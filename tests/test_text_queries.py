"""Queries on texts of any length, down to none: as their SQL has them, and without a row for each character."""

import duckdb
import pytest

from driftlog.plans import registry

TEXTS = [None, "", "a", "ab", "é😀c", "abcd", "abcde", "hello 😀 world, and more", "x" * 1001, "yé" * 50_000]
QUERIES = ["text_delete", "text_format_at", "text_id_at", "text_render", "text_compact_chars", "text_equal_clocks", "text_merge", "text_compact", "text_format_lww"]


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2).write.parquet(f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize("name", QUERIES)
def test_rows_are_operations(name, spark, texts):
    rows = registry.queries()[name](spark, texts)
    assert "Generate" not in rows._jdf.queryExecution().optimizedPlan().toString()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{texts}/documents.parquet/*.parquet'")
    cols = ", ".join(rows.columns)
    assert sorted(map(tuple, rows.collect())) == sorted(con.execute(f"SELECT {cols} FROM ({registry.oracle_sql()[name]})").fetchall())
