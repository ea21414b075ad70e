"""Bounded, deterministic samples of labelled rows, from which classifiers learn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlog.llm.common import held_out


def counts(labels: DataFrame, label: str) -> tuple[int, int]:
    """Rows with label 0 and 1 among those that may be learnt from."""
    found = dict(
        labels.filter(~held_out(F.col("doc_id")) & F.col(label).isin(0, 1))
        .groupBy(label).count().collect()
    )
    return found.get(0, 0), found.get(1, 0)


def sample_ids(labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id and label of at most `most` rows of each class: those whose hashed ids are smallest.

    Null ids or labels and held-out rows are left out. Of an id labelled twice the larger label counts.
    """
    own = (
        labels.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col(label).isin(0, 1))
        .groupBy("doc_id").agg(F.max(label).alias("label"))
    )
    by_hash = [F.xxhash64("doc_id", F.lit(label)), F.col("doc_id")]
    return own.filter("label = 0").orderBy(*by_hash).limit(most).unionByName(
        own.filter("label = 1").orderBy(*by_hash).limit(most)
    )


def sampled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text and label of the sample's rows, whole texts. The ids are at most 2 * most, so they
    are broadcast."""
    ids = F.broadcast(sample_ids(labels, label, most))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids, "doc_id")


def sample_texts(docs: DataFrame, labels: DataFrame, label: str, most: int) -> list[tuple[int, str]]:
    """(label, text) of the sample in order of the ids."""
    rows = sampled(docs, labels, label, most).collect()
    return [(r.label, r.text) for r in sorted(rows, key=lambda r: (r.doc_id, r.text))]
