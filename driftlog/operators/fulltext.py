"""Inverted full-text index over a table's rows, whole or by changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlog.functions.text import MIN_BYTES, tokens, words


def postings(rows: DataFrame, key: str, text: str, least: int = MIN_BYTES) -> DataFrame:
    """(token, key): one row for each distinct token of each row. This flat form is the index to
    store: a frequent token is many rows, never one."""
    return rows.select(F.explode(tokens(F.col(text), least)).alias("token"), F.col(key))


def index_summary(index: DataFrame, key: str) -> DataFrame:
    """token, n_docs, first_doc, last_doc, by partial aggregation."""
    return index.groupBy("token").agg(F.count("*").alias("n_docs"), F.min(key).alias("first_doc"), F.max(key).alias("last_doc"))


def lookup(index: DataFrame, wanted: list[str], key: str) -> DataFrame:
    """Rows that hold all wanted tokens."""
    n = len(set(wanted))
    return index.filter(F.col("token").isin(*wanted)).groupBy(key).agg(F.countDistinct("token").alias("n")).filter(F.col("n") == n).select(key)


def index_changes(changes: DataFrame, key: str, before: str, after: str, least: int = MIN_BYTES) -> DataFrame:
    """(token, key, added): what a change of a row's text adds to the index and takes from it."""
    old, new = tokens(F.col(before), least), tokens(F.col(after), least)
    each = F.concat(
        F.transform(F.array_except(old, new), lambda t: F.struct(t.alias("token"), F.lit(False).alias("added"))),
        F.transform(F.array_except(new, old), lambda t: F.struct(t.alias("token"), F.lit(True).alias("added"))),
    )
    return changes.select(F.explode(each).alias("x"), F.col(key)).select("x.token", key, "x.added")


def apply_changes(index: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    gone = delta.filter(~F.col("added")).select("token", key)
    return index.join(gone, ["token", key], "left_anti").unionByName(delta.filter("added").select("token", key))


def remove_rows(index: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The index without all postings of these rows."""
    return index.join(gone.select(key), key, "left_anti")


def word_stats(rows: DataFrame, key: str, text: str, least: int = MIN_BYTES) -> DataFrame:
    """key, words: the largest number of words that any version of the row had."""
    return rows.groupBy(key).agg(F.max(F.size(words(F.col(text), least)).cast("long")).alias("words"))


def report(stats: DataFrame) -> DataFrame:
    """docs, total_words and the report's line."""
    own = stats.agg(F.count("*").alias("docs"), F.coalesce(F.sum("words"), F.lit(0)).alias("total_words"))
    return own.withColumn("report", F.format_string("docs=%d total_words=%d", "docs", "total_words"))
