"""Toxicity by a factorization machine over hashed terms.

The terms of a text are its words, bare of punctuation and in lower case, and their first four and
five letters, hashed. A term's weight adds up; the inner products of terms' factors add what pairs
say together (an insult beside a mention of a group).

Learning takes two rounds. A pilot machine, strongly shrunk, learns weights and factors of all terms
that two texts of the sample share. The final one learns those that matter: terms that tell the classes
apart by themselves (a chi-square of CHANCE), and terms whose factors in the pilot stand out of what
chance leaves (OUT times the factors' ninth decile), since some only matter in pairs. So other words
cost one lookup and add no noise to long texts.

Learning is bounded by rows, SAMPLE of each class, whose whole texts count. Scores cover all terms of
whole texts.

Defined cases: null, empty and wordless texts get the score of the bias alone; with one class
missing from the labels nothing is learnt and the score is 0 or 1 like that class; repeated rows
are scored each; columns named like the new ones are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.llm import labelled
from driftlog.llm.common import held_out, small_batches, table

SAMPLE = 3000
FACTORS, EPOCHS, STEPS, BATCH, RATE = 8, 12, 300, 128, 0.1
BITS = 26
#: What makes a term matter, alone (one term in a hundred reaches this chi-square by chance) or in
#: pairs; rounds and shrinkage of the pilot and of the final machine.
CHANCE, OUT = 6.6, 4.0
PILOT, FINAL = (4, 1e-2), (EPOCHS, 1e-5)
MARKS = ".,;:!?\"'()[]{}*#$%&|<>-_/\\"
THRESHOLD = 0.5
#: Words whose terms a worker remembers.
REMEMBERED = 1_000_000


def terms_of(word: str) -> set[int]:
    """Hashed terms of one word of a text."""
    bare = word.strip(MARKS)
    if not bare:
        return set()
    names = {"w" + bare, "4" + bare[:4], "5" + bare[:5]}
    return {zlib.crc32(n.encode()) & ((1 << BITS) - 1) for n in names}


def terms(text: str | None) -> set[int]:
    return {t for w in set((text or "").lower().split()) for t in terms_of(w)}


class FactorizationMachine:
    def __init__(self, bias: float = 0.0, at: dict[int, int] | None = None, weight=None, factor=None):
        self.bias, self.at = bias, at or {}
        self.weight = np.zeros(0) if weight is None else weight
        self.factor = np.zeros((0, FACTORS)) if factor is None else factor
        self.scale, self.offset = 1.0, 0.0
        self.known: dict[str, tuple[int, ...]] = {}

    def raw(self, i: np.ndarray) -> float:
        """Weights and pairwise products of the terms at these places."""
        if not len(i):
            return self.bias
        v = self.factor[i]
        return self.bias + float(self.weight[i].sum() + 0.5 * ((v.sum(0) ** 2 - (v**2).sum(0)).sum()))

    def score(self, text: str | None) -> float:
        """Probability that the text is toxic."""
        known, own = self.known, set()
        for w in set((text or "").lower().split()):
            at = known.get(w)
            if at is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                at = known[w] = tuple(i for t in terms_of(w) if (i := self.at.get(t)) is not None)
            if at:
                own.update(at)
        z = self.scale * self.raw(np.fromiter(sorted(own), np.int64, len(own))) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[tuple[int, str]]) -> FactorizationMachine:
    """Learns from (label, text) rows."""
    return learn([np.array(sorted(terms(t)), np.int64) for _, t in rows], np.array([float(v) for v, _ in rows]))


def learn(found: list[np.ndarray], y: np.ndarray) -> FactorizationMachine:
    """Learns from texts' terms and labels."""
    if not len(y) or y.min() == y.max():
        return FactorizationMachine(30.0 if len(y) and y[0] == 1 else -30.0)
    # every fourth row of each class sets the scale of the scores, the others the parameters
    nth = np.where(y == 1, np.cumsum(y == 1), np.cumsum(y == 0))
    apart = (nth % 4 == 0) if min((y == 1).sum(), (y == 0).sum()) >= 8 else np.zeros(len(y), bool)
    own = [f for f, c in zip(found, apart, strict=True) if not c]
    best = _mattering(own, y[~apart])
    weight, factor = _descend([_places(f, best) for f in own], y[~apart], len(best), *FINAL)
    model = FactorizationMachine(0.0, {int(t): i for i, t in enumerate(best)}, weight, factor)
    over = apart if apart.any() else np.ones(len(y), bool)
    z = np.array([model.raw(_places(f, best)) for f, c in zip(found, over, strict=True) if c])
    # both classes weigh alike: a missed toxic text costs more than a false alarm
    own_weight = np.where(y[over] == 1, 0.5 / y[over].mean(), 0.5 / (1 - y[over].mean()))
    model.scale, model.offset = _curve(z, y[over], own_weight)
    return model


def _places(f: np.ndarray, every: np.ndarray) -> np.ndarray:
    """Where those of a text's terms stand that are in the sorted array."""
    if not len(every):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(every, f), len(every) - 1)
    return at[every[at] == f]


def _mattering(found: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The terms that matter alone or in pairs, sorted."""
    every, n = np.unique(np.concatenate(found), return_counts=True)
    every = every[n >= 2]
    at = [_places(f, every) for f in found]
    none = np.zeros(0, np.int64)
    counts = [np.bincount(np.concatenate([a for a, c in zip(at, y, strict=True) if c == v] or [none]), minlength=len(every)) for v in (0, 1)]
    n = counts[0] + counts[1]
    p, (no, yes) = n / len(y), ((y == 0).sum(), (y == 1).sum())
    told = (counts[1] / yes - counts[0] / no) ** 2 / np.maximum(p * (1 - p), 1e-9) * yes * no / len(y)
    told[n < 3] = 0
    _, factor = _descend(at, y, len(every), *PILOT)
    # what its factors can move: their length, times how much the term varies
    moves = np.sqrt((factor**2).sum(1) * p * (1 - p))
    return every[(told >= CHANCE) | (moves > OUT * np.quantile(moves, 0.9))] if len(every) else every


def _descend(at: list[np.ndarray], y: np.ndarray, n: int, epochs: int, shrink: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and factors of n terms by Adagrad over texts' places of terms; the bias is left to the curve."""
    rng = np.random.default_rng(7)
    w, v, bias = np.zeros(n, np.float32), rng.normal(0, 0.02, (n, FACTORS)).astype(np.float32), 0.0
    gw, gv, gb = np.full(n, 1e-2, np.float32), np.full(v.shape, 1e-2, np.float32), 1e-2
    # both classes weigh alike
    own_weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)).astype(np.float32)
    batches = []
    for own in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
        if not len(own := np.array([i for i in own if len(at[i])], np.int64)):
            continue
        sizes = np.array([len(at[i]) for i in own])
        terms_, row = np.concatenate([at[i] for i in own]).astype(np.int32), np.repeat(np.arange(len(own), dtype=np.int32), sizes)
        order = np.argsort(terms_, kind="stable")
        terms_, row = terms_[order], row[order]
        first = np.flatnonzero(np.r_[True, terms_[1:] != terms_[:-1]])
        batches.append((own, terms_, row, np.argsort(row, kind="stable").astype(np.int32), np.cumsum(np.r_[0, sizes[:-1]]), first))
    # small samples go round more often
    for _ in range(max(epochs, -(-STEPS * BATCH // max(1, len(y))))):
        for b in rng.permutation(len(batches)):
            own, terms_, row, by_row, starts, first = batches[b]
            vt = v[terms_]
            in_rows = vt[by_row]
            s = np.add.reduceat(in_rows, starts)
            z = bias + np.add.reduceat(w[terms_][by_row], starts) + 0.5 * (s**2 - np.add.reduceat(in_rows**2, starts)).sum(1)
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - y[own]).astype(np.float32) * own_weight[own] / len(own)
            down, u = g[row], terms_[first]
            dw = np.add.reduceat(down, first) + shrink * w[u]
            dv = np.add.reduceat(down[:, None] * (s[row] - vt), first) + shrink * v[u]
            gw[u] += dw**2
            gv[u] += dv**2
            gb += float(g.sum()) ** 2
            w[u] -= RATE * dw / np.sqrt(gw[u])
            v[u] -= RATE * 0.3 * dv / np.sqrt(gv[u])
            bias -= RATE * float(g.sum()) / gb**0.5
    return w.astype(float), v.astype(float)


def _curve(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and offset of the logistic curve over raw values, with a little shrinkage."""
    spread = float(z.std()) or 1.0
    f, w = np.stack([z / spread, np.ones_like(z)], 1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        slope = f.T @ (weight * (p - y)) + np.array([5e-2, 1e-3]) * w
        bend = (f * (weight * p * (1 - p) + 1e-9)[:, None]).T @ f + np.diag([5e-2, 1e-3])
        step = np.linalg.solve(bend, slope)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / spread), float(w[1])


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted (1 from the threshold on)."""
    small_batches(docs.sparkSession)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [sorted(terms(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("label").cast(pa.int32()), pa.array(own, pa.list_(pa.int64()))], ["doc_id", "label", "terms"])

    # at most 2 * SAMPLE rows of distinct terms come to the driver
    sample = labelled.sampled(docs, labels, "toxic", SAMPLE).select("doc_id", "label", "text").mapInArrow(told, "doc_id long, label int, terms array<long>").toArrow()
    sample = sorted(zip(*(sample.column(c) for c in ("doc_id", "label")), sample.column("terms"), strict=True), key=lambda r: (r[0].as_py(), r[2].values.to_numpy().tobytes()))
    model = learn([r[2].values.to_numpy() for r in sample], np.array([float(r[1].as_py()) for r in sample]))
    new = {"score": "double", "predicted": "integer"}
    keep = [c for c in docs.columns if c.lower() not in new]
    schema = docs.select(*keep).schema
    for k, v in new.items():
        schema = schema.add(k, v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.array([model.score(t) for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(p, pa.float64()), pa.array(p >= threshold).cast(pa.int32())],
                [*keep, *new],
            )

    return docs.select(*keep).mapInArrow(run, schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )
