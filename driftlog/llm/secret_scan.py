"""Secret scans: a character convolutional network in numpy over every candidate in its context.

Candidates are the spans of three fixed forms (assignments to telling names, access keys, long
hexadecimal runs) and every other run of key-like characters that is long and mixed enough to be a
secret. Spans of the fixed forms always count; the others where the network says so. It sees the
candidate's characters, which of them belong to it, and LEFT and RIGHT characters around it. It is
trained on labelled findings, made by a seeded generator of secrets and of lookalikes (digests in
prose, identifiers, paths, numbers), calibrated on a part held out, and its threshold is the highest
at which RECALL of that part's secrets are found.

Defined cases: null and empty texts have no spans; spans of one form do not overlap, of different
forms they may; repeated rows are searched each; columns named like the new ones are replaced.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from driftlog.llm.common import small_batches, table

KINDS = ("assign", "access", "hex", "other")
#: The fixed forms: keyword assignments, access keys, hexadecimal runs; and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
LONG_HEX = re.compile(r"[0-9a-f]{32,}")
#: Runs that may be a secret of no fixed form.
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_-])")
#: Characters of a window before, after and of the candidate; longer candidates have several windows.
LEFT, RIGHT, INSIDE = 24, 8, 48
WIDTH = LEFT + INSIDE + RIGHT
RECALL = 0.98
#: Characters the network tells apart; others share the last code.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 =:\"'_-+/.,;()[]{}<>@#\n"
CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
CODES = len(LETTERS) + 2


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, form) of the fixed forms, by start, then form as listed."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    # greedy runs do not touch each other, so the long ones can be asked for at once
    out += [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def other_candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Key-like runs with letters and digits, or of both cases and long, outside the fixed forms."""
    out, at, reach = [], 0, 0
    for m in RUN.finditer(text):
        x = m[0]
        # both come in order: what begins before the run's end and reaches into it
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][1])
            at += 1
        if reach > m.start():
            continue
        mixed = any(map(str.isdigit, x)) and any(map(str.isalpha, x))
        cased = len(x) >= 24 and sum(a.islower() and b.isupper() for a, b in zip(x, x[1:], strict=False)) >= 4
        if mixed or cased:
            out.append((m.start(), m.end()))
    return out


def encoded(text: str, start: int, end: int) -> np.ndarray:
    """Codes of the candidate's windows, one in each row; the candidate's characters carry an offset of
    CODES. A candidate longer than INSIDE has several windows, which overlap so far that the convolution
    sees every stretch of it."""
    rows, last = [], CODES - 1
    for s in range(start, max(start + 1, end - CharNet.SPAN + 1), INSIDE - CharNet.SPAN + 1):
        e = min(s + INSIDE, end)
        x = np.zeros(WIDTH, np.int64)
        left, own, right = text[max(0, s - LEFT) : s], text[s:e], text[e : e + RIGHT]
        x[LEFT - len(left) : LEFT] = [CODE.get(c, last) for c in left]
        x[LEFT : LEFT + len(own)] = [CODE.get(c, last) + CODES for c in own]
        x[LEFT + INSIDE : LEFT + INSIDE + len(right)] = [CODE.get(c, last) for c in right]
        if s > start:
            x[LEFT - min(len(left), s - start) : LEFT] += CODES
        if e < end:
            x[LEFT + INSIDE : LEFT + INSIDE + min(len(right), end - e)] += CODES
        rows.append(x)
        if e == end:
            break
    return np.stack(rows)


def windows_of(found: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """All candidates' windows, and where each candidate's begin."""
    own = [encoded(t, s, e) for t, s, e in found]
    return np.concatenate(own), np.cumsum([0, *map(len, own[:-1])])


class CharNet:
    """Embedding, one convolution of five characters, maximum over places, logistic output."""

    SPAN, DIM, FILTERS = 5, 12, 48

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.emb = rng.normal(0, 0.3, (2 * CODES, self.DIM))
        self.emb[0] = 0
        self.conv = rng.normal(0, (2 / (self.SPAN * self.DIM)) ** 0.5, (self.SPAN * self.DIM, self.FILTERS))
        self.shift = np.zeros(self.FILTERS)
        self.out = rng.normal(0, 0.2, 2 * self.FILTERS)
        self.bias = np.zeros(1)
        self.scale, self.offset, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray):
        e = self.emb[x]
        places = WIDTH - self.SPAN + 1
        c = np.concatenate([e[:, k : k + places] for k in range(self.SPAN)], 2)
        h = np.maximum(c @ self.conv + self.shift, 0)
        top = h.argmax(1)
        m = np.take_along_axis(h, top[:, None], 1)[:, 0]
        mean = h[:, LEFT - 2 : LEFT + INSIDE - 2].mean(1)
        z = np.concatenate([m, mean], 1) @ self.out + self.bias
        return c, h, top, m, mean, z

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 256])[-1] for i in range(0, len(x), 256)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of candidates whose windows begin at these rows: that of their most telling window."""
        z = np.maximum.reduceat(self.raw(x), first)
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.offset, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.003, seed: int = 5) -> None:
        rng, params = np.random.default_rng(seed), ["emb", "conv", "shift", "out", "bias"]
        m1 = {p: np.zeros_like(getattr(self, p)) for p in params}
        m2 = {p: np.zeros_like(getattr(self, p)) for p in params}
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for own in np.array_split(order, max(1, len(x) // batch)):
                t += 1
                c, h, top, m, mean, z = self._forward(x[own])
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]) / len(own)
                f = self.FILTERS
                grad = {"out": np.concatenate([m, mean], 1).T @ g, "bias": np.array([g.sum()])}
                dh = np.zeros_like(h)
                np.put_along_axis(dh, top[:, None], (g[:, None] * self.out[:f])[:, None], 1)
                dh[:, LEFT - 2 : LEFT + INSIDE - 2] += (g[:, None] * self.out[f:] / INSIDE)[:, None]
                dh *= h > 0
                flat = dh.reshape(-1, f)
                grad["conv"], grad["shift"] = c.reshape(-1, c.shape[2]).T @ flat, flat.sum(0)
                dc = dh @ self.conv.T
                de, places = np.zeros_like(self.emb), c.shape[1]
                for k in range(self.SPAN):
                    np.add.at(de, x[own][:, k : k + places], dc[:, :, k * self.DIM : (k + 1) * self.DIM])
                de[0] = 0
                grad["emb"] = de
                for p in params:
                    m1[p] = 0.9 * m1[p] + 0.1 * grad[p]
                    m2[p] = 0.999 * m2[p] + 0.001 * grad[p] ** 2
                    step = rate * (m1[p] / (1 - 0.9**t)) / (np.sqrt(m2[p] / (1 - 0.999**t)) + 1e-8)
                    setattr(self, p, getattr(self, p) - step)

    def calibrate(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, recall: float = RECALL) -> None:
        """A logistic curve over raw outputs, and the highest threshold that keeps the recall."""
        z = np.maximum.reduceat(self.raw(x), first)
        w = np.array([1.0, 0.0])
        f = np.stack([z, np.ones_like(z)], 1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
            bend = (f * (p * (1 - p) + 1e-6)[:, None]).T @ f + 1e-2 * np.eye(2)
            w -= np.clip(np.linalg.solve(bend, f.T @ (p - y) + 1e-2 * (w - [1, 0])), -2, 2)
        self.scale, self.offset = float(w[0]), float(w[1])
        good = np.sort(self.probability(x, first)[y == 1])
        self.threshold = float(good[int((1 - recall) * len(good))]) if len(good) else 0.5


def labelled_findings(n: int = 3000, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): secrets and lookalikes in prose or code, half of each."""
    r = random.Random(seed)
    lower, mixed = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    parts = ["the", "er", "tion", "an", "re", "ment", "la", "ung", "ing", "st", "de", "con", "ver"]

    def pick(letters: str, a: int, b: int) -> str:
        return "".join(r.choice(letters) for _ in range(r.randint(a, b)))

    def word() -> str:
        return "".join(r.choice(parts) for _ in range(r.randint(1, 4)))

    def prose(k: int) -> str:
        return " ".join(word() for _ in range(k))

    secrets = [
        lambda: pick(mixed, 20, 64), lambda: pick(mixed + "+/", 24, 60) + "==", lambda: "ghp_" + pick(mixed, 36, 36),
        lambda: "sk-" + pick(mixed, 32, 48), lambda: "xoxb-" + pick("0123456789", 10, 12) + "-" + pick(mixed, 24, 24),
        lambda: "eyJ" + pick(mixed + "_-", 40, 90), lambda: "AIza" + pick(mixed + "_-", 35, 35), lambda: pick(mixed + "_-", 24, 43),
        lambda: pick("0123456789abcdef", 24, 31), lambda: pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 18, 32),
    ]
    plain = [
        lambda: "-".join(word() for _ in range(r.randint(4, 7))) + "-" + str(r.randint(1, 2030)),
        lambda: "_".join(word() for _ in range(r.randint(4, 6))) + str(r.randint(0, 99)),
        lambda: "/".join(word() for _ in range(r.randint(3, 6))) + "/" + str(r.randint(1, 999)),
        lambda: word() + word() + word() + word() + str(r.randint(1, 2030)),
        lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}-{r.randint(0, 59):02}-{r.randint(0, 59):02}Z",
        lambda: "-".join(pick("0123456789", 3, 5) for _ in range(4)) + "x", lambda: "".join(word().capitalize() for _ in range(6)) + str(r.randint(1, 9)),
        lambda: word() * 4 + str(r.randint(1, 9)), lambda: "=" * r.randint(10, 20) + word() + str(r.randint(1, 99)) + "=" * r.randint(4, 10),
        lambda: "ISBN-" + pick("0123456789", 3, 3) + "-" + pick("0123456789", 10, 10), lambda: "a1b2c3d4" * r.randint(2, 4),
    ]
    names = ["key", "auth", "bearer", "credential", "access", "private", "signature", "pwd"]
    out = []
    for i in range(n):
        label = i % 2
        own = r.choice(secrets if label else plain)()
        if len(own) < 16:
            own += pick(lower, 16, 16) if not label else pick(mixed, 16, 16)
        style = r.random()
        left = prose(r.randint(1, 5)) + " "
        if style < 0.4:
            left += r.choice(names if label or style < 0.1 else ["file", "name", "id", "path", "title"]) + r.choice(["=", ": ", " = \"", "='"])
        text = left + own + r.choice([" ", "\n", "\" ", "; ", ". ", ", "]) + prose(2)
        out.append((text, len(left), len(left) + len(own), label))
    return out


@cache
def trained() -> CharNet:
    found = labelled_findings()
    y = np.array([float(v) for *_, v in found])
    cut = len(found) * 3 // 4
    x, first = windows_of([f[:3] for f in found[:cut]])
    net = CharNet()
    net.fit(x, np.repeat(y[:cut], np.diff(np.r_[first, len(x)])))
    net.calibrate(*windows_of([f[:3] for f in found[cut:]]), y[cut:])
    return net


def scan(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """docs without text, with n_assign, n_access, n_hex, base_sha256, spans, n_other
    and n_doubted (spans of fixed forms that the network would not have taken)."""
    small_batches(docs.sparkSession)
    net = trained()
    new = {"n_assign": "long", "n_access": "long", "n_hex": "long", "base_sha256": "string", "spans": "string", "n_other": "long", "n_doubted": "long"}
    keep = [c for c in docs.columns if c != "text" and c.lower() not in new]
    schema = docs.select(*keep).schema
    for k, v in new.items():
        schema = schema.add(k, v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = lambda spans: ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
        for b in batches:
            rows, asked, places, doubted = [], [], [], Counter()
            for i, text in enumerate(b.column("text").to_pylist()):
                text = text or ""
                base = base_spans(text)
                rows.append((base, list(base)))
                for s, e, k in [*base, *((s, e, "other") for s, e in other_candidates(text, base))]:
                    asked.append((text, s, e))
                    places.append((i, s, e, k))
            if asked:
                for (i, s, e, k), p in zip(places, net.probability(*windows_of(asked)), strict=True):
                    if k != "other":
                        doubted[i] += int(p < net.threshold)
                    elif p >= net.threshold:
                        rows[i][1].append((s, e, k))
            count = lambda k: pa.array([sum(x[2] == k for x in spans) for _, spans in rows], pa.int64())
            order = lambda spans: sorted(spans, key=lambda x: (x[0], KINDS.index(x[2])))
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(c) for c in keep), count("assign"), count("access"), count("hex"),
                    pa.array([hashlib.sha256(told(base).encode()).hexdigest() for base, _ in rows], pa.string()),
                    pa.array([told(order(spans)) for _, spans in rows], pa.string()), count("other"),
                    pa.array([doubted[i] for i in range(len(rows))], pa.int64()),
                ],
                [*keep, *new],
            )

    return docs.select(*keep, "text").mapInArrow(run, schema)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
