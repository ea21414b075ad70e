"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents; between stages the rows are written as Parquet and read again, so
a lost executor never costs more than the stage that runs.

Rows with a null text or id pass through the filtering stages unless a stage's operator says
otherwise; of rows that share an id, the near-duplicate stage keeps one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.llm import best_fit_packing, decontamination, near_dedup, pii, quality_classifier
from driftlog.llm.common import broadcast_if_small, materialise, table

#: SQL has no compression, sketches or vocabularies; the pipeline is tested against brute force.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scored = quality_classifier.score_quality(docs, table(spark, sf_dir, "labels"))
    return scored.filter("predicted = 1").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    found = near_dedup.near_duplicates(docs)
    dropped = materialise(found.filter("not kept").select("doc_id").distinct(), "dropped")
    kept = docs.join(broadcast_if_small(dropped), "doc_id", "left_anti").select(*docs.columns)
    repeated = materialise(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    # of the rows of one id the first by text, so that a stage that runs again keeps the same
    rest = [c for c in docs.columns if c != "doc_id"]
    first = F.min_by(F.struct(*rest), F.struct(F.coalesce("text", F.lit("")), F.xxhash64(*rest))).alias("row")
    several = kept.join(broadcast_if_small(repeated), "doc_id", "left_semi").groupBy("doc_id").agg(first)
    one = several.select("doc_id", *(F.col(f"row.{c}").alias(c) for c in rest)).select(*docs.columns)
    return kept.join(broadcast_if_small(repeated), "doc_id", "left_anti").unionByName(one)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaks = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    leaks = materialise(leaks.select(F.col("doc_id").alias("leak_id")).distinct(), "leaks")
    return docs.join(broadcast_if_small(leaks), F.col("doc_id").eqNullSafe(F.col("leak_id")), "left_anti")


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(pii.find_pii(docs)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with their places in sequences."""
    return best_fit_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("near duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("personal data", redact_pii),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
