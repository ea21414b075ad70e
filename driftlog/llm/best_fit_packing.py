"""Packing token pieces into sequences by patterns fitted with non-negative least squares.

A document's ids (its text's tokens, then an end id) are cut only where they exceed a sequence.
The lengths of all pieces form a histogram of at most `capacity` bars, whatever the corpus holds.
On coarse length classes, patterns of few documents that fill a sequence are enumerated; least
squares finds how often to repeat each one; the rounded counts are carried out on exact lengths,
each sequence is topped up with the longest piece that still fits, and what is left is packed by
the same best fit. The plan is a table of runs (length, ranks, first sequence, offset) bounded by
the number of lengths; a piece finds its place by its rank among pieces of its length.

Ranks come from two levels, counts by task and then running sums over tasks, so no length,
however common, is gathered in one place.

Defined cases: a null text counts as empty (one piece with the end id alone); repeated rows and
ids are packed each; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlog.llm.common import by_size, kept, materialise, small_batches, table

CAPACITY = 4096
END_ID = 1
#: Pre-tokens whose ids a worker remembers (twice as many at most), and characters that it splits at once.
REMEMBERED, AT_ONCE = 250_000, 1_000_000
#: New pre-tokens that go to the library together.
ASKED = 20_000
#: Where a long text may be split.
GAP = re.compile(rb"[ \n]")
#: Coarse classes of length, and documents in an enumerated pattern at most.
CLASSES, FEW = 64, 4


class WordIds:
    """Ids of texts as little-endian 32-bit bytes; pre-tokens met before are not encoded again.

    The vocabulary drops white space and never merges across pre-tokens, so a text's ids are those of
    its pre-tokens in turn. Many texts' bytes are cut into them at once, each different one is looked up
    once, and new ones go to the library's model together; the ids of each end with a symbol that marks
    a word's end. Texts with special strings, or with characters that the library normalises by another
    version of Unicode, go to the library whole.
    """

    #: Classes of characters: pre-tokens are runs of letters or others, and single digits.
    UNKNOWN, SPACE, LETTER, DIGIT, OTHER = range(5)

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)  # no more than the merges
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = self.tokenizer.pre_tokenizer[0]
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.met: set[str] = set()
        self.odd: set[str] = set()
        self.classes = np.zeros(0x110000, np.uint8)
        self.classify(np.arange(128))
        # the characters that stand for bytes: printable ones for themselves, others from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = np.zeros(256, "<u4")
        self.letters[plain] = plain
        other = np.setdiff1d(np.arange(256), plain)
        self.letters[other] = 256 + np.arange(len(other))
        self.letters[32] = 32  # never inside a pre-token: it stands between two
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def encoded(self, texts: list[str]) -> list[bytes]:
        return [
            np.array(e.ids, "<u4").tobytes()
            for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ]

    def merged(self, parts: list[bytes]) -> list[bytes]:
        """The ids of pre-tokens, from the library's model."""

        def ids(own: list[bytes]) -> np.ndarray:
            text = self.letters[np.frombuffer(b" ".join(own), np.uint8)].tobytes().decode("utf-32-le")
            return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

        found = ids(parts)
        cuts = (np.flatnonzero(self.ends[found]) + 1).tolist()
        if len(cuts) != len(parts):
            return [ids([p]).tobytes() for p in parts]
        found = found.tobytes()
        return [found[4 * i : 4 * j] for i, j in zip([0, *cuts], cuts, strict=False)]

    def classify(self, points: np.ndarray) -> np.ndarray:
        """The class of each code point; the library's pattern tells it when first met."""
        found = self.classes[points]
        if not found.all():
            for p in np.unique(points[found == self.UNKNOWN]).tolist():
                c = chr(p)
                alone, after = (len(self.split.pre_tokenize_str(x)) for x in (c + c, "a" + c))
                self.classes[p] = (
                    self.SPACE if alone == 0 else self.DIGIT if alone == 2 else self.LETTER if after == 1 else self.OTHER
                )
            found = self.classes[points]
        return found

    def starts(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Which bytes begin a pre-token, and which are not white space; the text ends with white space."""
        a = np.frombuffer(text, np.uint8)
        kinds = self.classes[a]
        plain = text.isascii()
        if not plain:
            lead = np.flatnonzero(a >= 0xC0)
            first = a[lead]
            more = 1 + (first >= 0xE0) + (first >= 0xF0).astype(int)
            for n in (1, 2, 3):
                at = lead[more == n]
                points = a[at].astype(np.int32) & (0x3F >> n)
                for k in range(1, n + 1):
                    points = points << 6 | (a[at + k] & 0x3F)
                found = self.classify(points)
                for k in range(n + 1):
                    kinds[at + k] = found
        solid = kinds != self.SPACE
        start = solid.copy()
        start[1:] &= (kinds[1:] != kinds[:-1]) | (kinds[1:] == self.DIGIT)
        if not plain:
            start &= (a & 0xC0) != 0x80
        # 's 't 'm 'd and 're 've 'll where the apostrophe begins a pre-token
        at = np.flatnonzero(a == 39)
        at = at[start[at]]
        short = at[np.isin(a[at + 1], np.frombuffer(b"stmd", np.uint8))]
        pair = at[solid[at + 1]]  # then two more bytes follow
        both = a[pair + 1].astype(int) << 8 | a[pair + 2]
        pair = pair[np.isin(both, [x << 8 | y for x, y in (b"re", b"ve", b"ll")])]
        for own, n in ((short, 2), (pair, 3)):
            start[own + 1] = False
            start[own + n] |= solid[own + n]
        return start, solid

    def lowered(self, text: str) -> bytes:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # the library lowers each character by itself: no final sigma
        return ("".join(map(str.lower, text)) if "Σ" in text else text.lower()).encode()

    def apart(self, text: str) -> bool:
        """Whether only the library can tell this text's ids."""
        if any(map(text.__contains__, self.special)):
            return True
        if text.isascii():
            return False
        chars = set(text)
        for c in chars - self.met:
            self.met.add(c)
            # alone, and beside marks that it may change places with
            if any(self.normal.normalize_str(x) != self.lowered(x).decode() for x in (c, "a" + c, c + "\u0334", "\u0345" + c)):
                self.odd.add(c)
        return not self.odd.isdisjoint(chars)

    def lookup(self, parts: list[bytes]) -> list[bytes]:
        """The ids of different pre-tokens; what has not been met for long is forgotten."""
        found = list(map(self.known.get, parts))
        new = [i for i, ids in enumerate(found) if ids is None]
        if not new:
            return found
        ask = []
        for i in new:
            found[i] = self.older.get(parts[i])
            if found[i] is None:
                ask.append(i)
        for k in range(0, len(ask), ASKED):
            own = ask[k : k + ASKED]
            for i, ids in zip(own, self.merged([parts[i] for i in own]), strict=True):
                found[i] = ids
        if len(self.known) + len(new) > REMEMBERED:
            self.known, self.older = {}, self.known
        self.known.update((parts[i], found[i]) for i in new)
        return found

    def stretch(self, text: bytes, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The ids of a text that ends with white space, and how many bytes of them come before each of ends."""
        start, solid = self.starts(text)
        at = np.flatnonzero(start)
        before = np.searchsorted(at, ends)
        bare = np.frombuffer(text, np.uint8)[solid]
        offsets = np.append(np.flatnonzero(start[solid]), len(bare)).astype(np.int64)
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(bare)])
        parts = parts.dictionary_encode()
        if not len(parts):
            return b"", before
        each = pa.array(self.lookup(parts.dictionary.to_pylist()), pa.large_binary()).take(parts.indices)
        _, places, ids = each.buffers()
        return ids.to_pybytes(), np.frombuffer(places, np.int64, len(each) + 1)[before]

    def ids(self, texts: list[str]) -> list[bytes]:
        whole = {i for i, t in enumerate(texts) if self.apart(t)}
        own = [b"" if i in whole else self.lowered(t) for i, t in enumerate(texts)]
        ends = np.cumsum([len(t) + 1 for t in own])
        text = b"\n".join([*own, b""])
        found, cuts, at, had, i = [], [0], 0, 0, 0
        while at < len(text):  # long texts in stretches that end with white space
            to = m.end() if (m := GAP.search(text, at + AT_ONCE)) else len(text)
            j = int(np.searchsorted(ends, to, "right"))
            part, places = self.stretch(text[at:to], ends[i:j] - at)
            found.append(part)
            cuts += (places + had).tolist()
            at, had, i = to, had + len(part), j
        every = b"".join(found)
        return [
            self.encoded([t])[0] if i in whole else every[cuts[i] : cuts[i + 1]]
            for i, t in enumerate(texts)
        ]


def word_ids(path: str) -> WordIds:
    """One for each Python worker, so that tasks share what it remembers."""
    return kept(f"word ids {path}", lambda: WordIds(path))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Least squares with x >= 0, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    gram, aim = a.T @ a, a.T @ b
    tiny = 1e-9 * max(1.0, float(np.abs(aim).max(initial=0)))
    for _ in range(rounds):
        w = aim - gram @ x
        w[active] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= tiny:
            break
        active[j] = True
        while True:
            at = np.flatnonzero(active)
            s = np.linalg.lstsq(gram[np.ix_(at, at)], aim[at], rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - s[low], 1e-300))
            x[at] += step * (s - x[at])
            active[at[x[at] <= 1e-12]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def class_patterns(present: list[int], few: int = FEW) -> list[tuple[int, ...]]:
    """Multisets of up to `few` present classes (largest first) that fill CLASSES exactly."""
    found: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], room: int) -> None:
        if room == 0:
            found.append(head)
        elif len(head) < few:
            for c in present:
                if c <= room and (not head or c <= head[-1]):
                    extend((*head, c), room - c)

    extend((), CLASSES)
    return found


class Plan:
    """Carries out repeated sequences on a histogram of exact lengths."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = dict(histogram)
        self.lengths = sorted(k for k, v in histogram.items() if v > 0)
        self.used: Counter[int] = Counter()
        self.sequences = 0
        #: length, first rank, ranks, repeats, first sequence, offset
        self.runs: list[tuple[int, int, int, int, int, int]] = []

    def longest(self, most: int) -> int | None:
        at = bisect_right(self.lengths, most)
        return self.lengths[at - 1] if at else None

    def fill(self, wanted: list[tuple[int, int]], repeats: int) -> int:
        """One kind of sequence: the longest piece of each wanted span (low, high), then whatever
        fits best; repeated as often as the pieces last, at most `repeats` times. Returns how often."""
        room, taken = self.capacity, Counter()

        def take(low: int, high: int) -> bool:
            nonlocal room
            high = min(high, room)
            while (x := self.longest(high)) is not None and x > low:
                if self.left[x] > taken[x]:
                    m = (self.left[x] - taken[x]) if low == 0 and not wanted_now else 1
                    m = min(m, room // x) if m > 1 else 1
                    taken[x] += max(1, m)
                    room -= x * max(1, m)
                    return True
                high = x - 1
            return False

        wanted_now = True
        for i, (low, high) in enumerate(wanted):
            last = i == len(wanted) - 1
            if not take(low, self.capacity if last else high):
                return 0
        wanted_now = False
        while room > 0 and take(0, room):
            pass
        if not taken:
            return 0
        n = min([repeats, *(self.left[x] // m for x, m in taken.items())])
        offset = 0
        for x in sorted(taken, reverse=True):
            m = taken[x]
            self.runs.append((x, self.used[x], n * m, n, self.sequences, offset))
            self.used[x] += n * m
            self.left[x] -= n * m
            offset += m * x
            if self.left[x] == 0:
                self.lengths.remove(x)
        self.sequences += n
        return n


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    plan = Plan(histogram, capacity)
    width = -(-capacity // CLASSES)
    by_class: Counter[int] = Counter()
    for length, n in histogram.items():
        by_class[-(-length // width)] += n
    patterns = class_patterns(sorted(by_class))
    if patterns:
        a = np.zeros((CLASSES + 1, len(patterns)))
        for j, p in enumerate(patterns):
            for c in p:
                a[c, j] += 1
        b = np.array([by_class[c] for c in range(CLASSES + 1)], float)
        repeats = np.floor(nnls(a, b / max(1.0, b.max())) * max(1.0, b.max()) + 1e-6).astype(int)
        # long pieces first: short ones fit anywhere later
        for j in sorted(np.flatnonzero(repeats), key=lambda j: patterns[j], reverse=True):
            left = int(repeats[j])
            spans = [((c - 1) * width, c * width) for c in patterns[j]]
            while left > 0 and (n := plan.fill(spans, left)):
                left -= n
    while plan.lengths:
        plan.fill([(0, capacity)], 1 << 62)
    return plan


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """Every piece with its task, and its rank among that task's pieces of the same length."""
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = word_ids(path), TaskContext.get().partitionId(), Counter()
        for b in batches:
            rows = []
            texts = [t or "" for t in b.column("text").to_pylist()]
            encoded = (ids for own in by_size(texts, AT_ONCE) for ids in encoder.ids(texts[own]))
            for doc, ids in zip(b.column("doc_id").to_pylist(), encoded, strict=True):
                ids += end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    rows.append((doc, i, at // 4, n, zlib.crc32(own), part, seen[n]))
                    seen[n] += 1
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = (id_type, *[pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    from pyspark.sql.pandas.types import to_arrow_type

    id_field = docs.schema["doc_id"]
    id_type = to_arrow_type(id_field.dataType)
    schema = f"doc_id {id_field.dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, nth long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    spark = docs.sparkSession
    cut = materialise(pieces(docs, path, capacity, end_id), "pieces")
    by_task = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part")
    firsts = by_task.withColumn(
        "first", F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1))
    ).select("length", "part", F.coalesce("first", F.lit(0)).alias("first"))
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = sorted(plan_packing(histogram, capacity).runs)
    lengths, first, ranks, repeats, sequence, offset = (np.array(c, np.int64) for c in (zip(*runs, strict=True) if runs else [[]] * 6))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = lengths * (1 << 44) + first
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("first").to_numpy() + b.column("nth").to_numpy()
            at = np.searchsorted(key, length * (1 << 44) + rank, "right") - 1
            nth = rank - first[at]
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(c) for c in names),
                    pa.array(sequence[at] + nth % repeats[at]),
                    pa.array(offset[at] + nth // repeats[at] * length),
                ],
                [*names, "sequence_id", "offset"],
            )

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = cut.select(*names).schema.add("sequence_id", "long").add("offset", "long")
    ranked = cut.join(firsts, ["length", "part"]).select(*names, "nth", "first")
    return ranked.mapInArrow(place, schema)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
