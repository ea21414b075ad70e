"""Quality by compression: which of two zstandard dictionaries makes a text smaller.

One dictionary is built from good and one from bad labelled texts. A text is compressed in blocks,
so that the dictionaries weigh as much at the end of a long text as at its start, and all of it
counts. The difference of the two sizes over the text's bytes is turned into a score by a logistic
curve fitted on labelled rows that the dictionaries have not seen.

Learning is bounded by rows, SAMPLE of each class, whose whole texts count. Scores cover all texts.

Defined cases: null and empty texts have difference 0 and score as the shortest text; with one class
missing from the labels the score is that class's share; repeated rows are scored each; columns
named like the new ones are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.llm import labelled
from driftlog.llm.common import held_out, kept, small_batches, table

SAMPLE = 1500
BLOCK, LEVEL, DICTIONARY = 2048, 3, 96 << 10
#: Bytes up to which a text counts as short.
SHORT = 128
THRESHOLD = 0.3


def blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def dictionary(texts: list[bytes]) -> bytes:
    """Trained where there is enough text to train on, else the texts themselves."""
    parts = [b for t in texts for b in blocks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY:]


def compressor(data: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(data)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


Pair = tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]


def compressors(good: bytes, bad: bytes) -> Pair:
    """One pair for each Python worker and model."""
    return kept(f"compressors {zlib.crc32(good)} {zlib.crc32(bad)}", lambda: (compressor(good), compressor(bad)))


def difference(text: str, pair: Pair) -> float:
    """Bytes that the good dictionary saves over the bad one, for each byte of the text."""
    data = (text or "").encode()
    if not data:
        return 0.0
    g, b = pair
    return sum(len(b.compress(x)) - len(g.compress(x)) for x in blocks(data)) / len(data)


def features(sizes: np.ndarray, differences: np.ndarray) -> np.ndarray:
    """The difference, and how short the text is: little text moves little from what is usual."""
    return np.stack([differences, SHORT / (SHORT + sizes), np.ones(len(sizes))], 1)


def fit_curve(f: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic curve, by Newton's method with a little shrinkage."""
    spread = np.where(f.std(0) > 0, f.std(0), 1.0)
    f, w = f / spread, np.zeros(f.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        slope = f.T @ (weight * (p - y)) + 1e-2 * w
        bend = (f * (weight * p * (1 - p) + 1e-9)[:, None]).T @ f + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w / spread


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[bytes, bytes, np.ndarray]:
    """The two dictionaries and the curve."""
    bad_n, good_n = labelled.counts(labels, label)
    rows = labelled.sample_texts(docs, labels, label, SAMPLE)
    if not bad_n or not good_n or len({y for y, _ in rows}) < 2:
        share = 0.5 if bad_n == good_n else float(good_n > 0)
        return b"", b"", np.array([0.0, 0.0, np.log((share + 1e-3) / (1 - share + 1e-3))])
    seen = {0: [], 1: []}
    fresh = []
    for i, (y, t) in enumerate(rows):
        fresh.append((y, t)) if i % 3 == 0 else seen[y].append(t.encode())
    if len({y for y, _ in fresh}) < 2:
        fresh = rows
    good, bad = dictionary(seen[1] or seen[0]), dictionary(seen[0] or seen[1])
    pair = compressor(good), compressor(bad)
    x = np.array([difference(t, pair) for _, t in fresh])
    y = np.array([float(q) for q, _ in fresh])
    share = good_n / (good_n + bad_n)  # the sample holds the classes in other shares than the corpus
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    size = np.array([len(t.encode()) for _, t in fresh])
    return good, bad, fit_curve(features(size, x), y, weight)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with size_difference, score and predicted (1 from the threshold on)."""
    small_batches(docs.sparkSession)
    good, bad, curve = train(docs, labels)
    new = {"size_difference": "double", "score": "double", "predicted": "integer"}
    keep = [c for c in docs.columns if c.lower() not in new]
    schema = docs.select(*keep).schema
    for k, v in new.items():
        schema = schema.add(k, v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = compressors(good, bad) if good else None
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            x = np.array([difference(t, pair) if pair else 0.0 for t in texts])
            size = np.array([len(t.encode()) for t in texts])
            p = 1 / (1 + np.exp(-np.clip(features(size, x) @ curve, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(x, pa.float64()), pa.array(p, pa.float64()), pa.array(p >= threshold).cast(pa.int32())],
                [*keep, *new],
            )

    return docs.select(*keep).mapInArrow(run, schema)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "size_difference"
    )
