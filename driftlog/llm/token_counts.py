"""Token counts by rank-synchronous merging of ragged arrays.

A text is cut into chunks at single spaces; what the library makes of a chunk depends on the chunk
alone. Chunks not met before are split into pre-tokens by the vocabulary's pattern; all
pre-tokens of a batch lie end to end in one numpy array of symbols, and in each round every
pre-token applies its own lowest-rank pair, at all its places, at once. What is left are its tokens.
Pre-tokens of more than LONG bytes are linked instead of packed, and their places wait by rank: each
round takes up the places of the lowest rank alone, so that the work does not grow as rounds times
length.

Defined cases: a null text counts as empty (0 bytes, 0 tokens, not over the limit); repeated rows
are counted each; other columns pass through unless they clash with the new ones, which win.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.llm.common import by_size, kept, small_batches, table

#: Chunks whose counts a worker remembers; beyond that it forgets all and starts again.
REMEMBERED = 400_000
#: Bytes beyond which pre-tokens are merged by waiting places; characters that are split at once.
LONG, AT_ONCE = 256, 1_000_000
NONE = np.int64(1) << 40


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for
    themselves, the others follow from code point 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class RankMerger:
    """Merges many byte strings at once by the ranks of a byte-level pair vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.byte_id = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        self.size = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """The number of symbols that each byte string keeps."""
        long = [i for i, t in enumerate(tokens) if len(t) > LONG]
        if not long:
            return self.packed(tokens)
        out = np.zeros(len(tokens), np.int64)
        short = [i for i, t in enumerate(tokens) if len(t) <= LONG]
        if short:
            out[short] = self.packed([tokens[i] for i in short])
        out[long] = self.linked([tokens[i] for i in long])
        return out

    def linked(self, tokens: list[bytes]) -> np.ndarray:
        """As packed, for long strings: neighbours are linked, and places wait by their pair's rank."""
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ends = np.cumsum(sizes + 1)  # a mark that pairs with nothing stands after each string
        symbols = np.full(int(ends[-1]) + 1, -self.size - 1, np.int64)
        inside = np.ones(len(symbols), bool)
        inside[0] = inside[ends] = False
        symbols[inside] = self.byte_id[np.frombuffer(b"".join(tokens), np.uint8)]
        after, before = np.arange(1, len(symbols) + 1), np.arange(-1, len(symbols) - 1)
        after[-1] = len(symbols) - 1
        rank = np.full(len(symbols), NONE)
        rank[:-1] = self.rank(symbols[:-1], symbols[1:])
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def wait(places: np.ndarray) -> None:
            own = rank[places]
            order = np.argsort(own, kind="stable")
            own, places = own[order], places[order]
            cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            for r, x in zip(own[cuts].tolist(), np.split(places, cuts[1:]), strict=True):
                if r in waiting:
                    waiting[r].append(x)
                else:
                    waiting[r] = [x]
                    heapq.heappush(ranks, r)

        if len(found := np.flatnonzero(rank < NONE)):
            wait(found)
        gone = np.zeros(len(symbols), bool)
        while ranks:
            r = heapq.heappop(ranks)
            at = waiting.pop(r)
            at = np.unique(np.concatenate(at)) if len(at) > 1 else at[0]
            at = at[(rank[at] == r) & ~gone[at]]
            if len(at) > 1:  # in a run of overlapping places every second one merges, from the left
                starts = np.r_[True, at[1:] != after[at[:-1]]]
                run = np.arange(len(at)) - np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
                at = at[run % 2 == 0]
            if not len(at):
                continue
            right = after[at]
            symbols[at] = self.made[r]
            gone[right] = True
            after[at] = after[right]
            before[after[right]] = at
            changed = np.unique(np.concatenate([before[at], at]))
            rank[changed] = self.rank(symbols[changed], symbols[after[changed]])
            if len(changed := changed[rank[changed] < NONE]):
                wait(changed)
        left = np.add.reduceat(~gone & inside, np.r_[0, ends[:-1]])
        return left.astype(np.int64)

    def packed(self, tokens: list[bytes]) -> np.ndarray:
        """All strings lie end to end; each round touches those that still merge."""
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        left = sizes.copy()
        symbols = self.byte_id[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), sizes)
        while len(symbols) > 1:
            rank = np.full(len(symbols), NONE)
            rank[:-1] = np.where(
                owner[:-1] == owner[1:], self.rank(symbols[:-1], symbols[1:]), NONE
            )
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, first)
            lengths = np.diff(np.r_[first, len(symbols)])
            live = np.repeat(lowest < NONE, lengths)
            hit = live & (rank == np.repeat(lowest, lengths))
            if not hit.any():
                break
            # in a run of overlapping places (a a a), every second one merges, from the left
            at = np.flatnonzero(hit)
            starts = np.r_[True, (np.diff(at) > 1) | (rank[at[1:]] != rank[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])]
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
            at = at[run % 2 == 0]
            left -= np.bincount(owner[at], minlength=len(left))
            symbols[at] = self.made[rank[at]]
            keep = live
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return left


class Counter:
    """Counts tokens of texts; remembers what it has found for each chunk."""

    def __init__(self, path: str, pattern: str):
        self.merger = RankMerger(path)
        self.pattern = regex.compile(pattern)
        self.pieces = regex.compile(r"\s*\S+|\s+")
        self.odd = regex.compile(r" (?=\s)|^(?=\s)|[\x00\x1c-\x1f\x85]")
        self.known: dict[str, int] = {}

    def chunks(self, text: str) -> list[str]:
        """Pieces whose tokens do not depend on each other. Those after the first keep no leading
        space; a mark in front tells the two kinds apart."""
        if self.odd.search(text):
            return ["\x00" + x for x in self.pieces.findall(text)]
        first, *rest = text.split(" ")
        rest.append("\x00" + first)
        return rest

    def learn(self, chunks: set[str]) -> None:
        new = list(chunks)
        tokens, owner = [], []
        for i, c in enumerate(new):
            for t in self.pattern.findall(c[1:] if c[:1] == "\x00" else " " + c):
                tokens.append(t.encode())
                owner.append(i)
        counts = np.bincount(owner, self.merger.counts(tokens), len(new)) if tokens else np.zeros(len(new))
        self.known.update(zip(new, counts.astype(int).tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        out, wait = [], []
        for text in texts:
            extra = 0
            parts = [text]
            for s in self.merger.special:  # the library takes them as single tokens wherever they stand
                if s in text:
                    parts = [y for x in parts for y in x.split(s)]
            extra = len(parts) - 1
            chunks = [c for p in parts if p for c in self.chunks(p)]
            wait.append((extra, chunks))
        known = self.known
        new = {c for _, chunks in wait for c in chunks if c not in known}
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = {c for _, chunks in wait for c in chunks}
        if new:
            self.learn(new)
        for extra, chunks in wait:
            out.append(extra + sum(map(known.__getitem__, chunks)))
        return out


def token_counts(
    docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, limit: int = 1024
) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit of its column text, and without that column."""
    small_batches(docs.sparkSession)
    new = {"n_bytes": "long", "n_tokens": "long", "over_limit": "boolean"}
    keep = [f for f in docs.columns if f != "text" and f.lower() not in new]
    fields = docs.select(*keep).schema
    for k, v in new.items():
        fields = fields.add(k, v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept(f"counter {path} {pattern}", lambda: Counter(path, pattern))
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            n = np.array([k for own in by_size(texts, AT_ONCE) for k in counter.count(texts[own])], np.int64)
            size = np.array([len(t.encode()) for t in texts], np.int64)
            cols = [b.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(size), pa.array(n), pa.array(n > limit)], [*keep, *new]
            )

    return docs.select(*keep, "text").mapInArrow(run, fields)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).select(
        "doc_id", F.col("n_bytes"), F.col("n_tokens"), F.col("over_limit")
    )
