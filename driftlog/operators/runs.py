"""Texts as operations: a row for each insertion, deletion and format, none for each character.

A run is what one insertion typed: its characters follow each other, so that their ids (clock and
place, as in sequence.py) need not be written. Sets of a run's places are bitmaps (bit p % 8 of byte
p // 8). All that belongs to a text is brought together by its key, once; results are those of the
operators on characters in sequence.py.

* runs: key, H, after, text, places. text holds the characters at the places that are known; null places: all.
* cuts: key, of (the run's clock), places, H. They may come before their run.
* formats: key, of, places, attr, value, H.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from driftlog.functions.workers import reachable
from driftlog.operators.sequence import KEY, char_id

PLACE = 8  # hex digits of a place in an id


def pack(mask: np.ndarray) -> bytes:
    return np.packbits(mask, bitorder="little").tobytes()


def unpack(places: bytes, n: int | None = None) -> np.ndarray:
    """The bits as booleans, n of them if given."""
    got = np.unpackbits(np.frombuffer(places, np.uint8), bitorder="little").view(bool)
    if n is None or len(got) == n:
        return got
    return got[:n] if len(got) > n else np.concatenate([got, np.zeros(n - len(got), bool)])


def chosen(n: Column, pick: Callable[[np.ndarray, int], np.ndarray]) -> Column:
    """Of n places those that pick(places, n) says."""

    @F.pandas_udf("binary")
    def made(n: pd.Series) -> pd.Series:
        return pd.Series([pack(pick(np.arange(x), x)) for x in n.tolist()], dtype=object)

    return made(n)


def holds(places: Column, place: Column) -> Column:
    """Whether a bitmap has a place."""
    byte = F.conv(F.hex(F.substring(places, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))


def text_runs(inserts: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Runs of inserted texts (key, H, after, text); an empty one has no characters."""
    return inserts.filter(F.length("text") > 0).select(*key, "H", "after", "text", F.lit(None).cast("binary").alias("places"))


def partly(runs: DataFrame, pick: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    """What a replica knows that has missed all places of whole runs but those that pick says."""
    names = runs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                texts, sets = [], []
                for x in part.column("text"):
                    codes = points(x.as_py())
                    mask = pick(np.arange(len(codes)), len(codes))
                    texts.append(letters(codes[mask]))
                    sets.append(pack(mask))
                made = {"text": pa.array(texts, pa.string()), "places": pa.array(sets, pa.binary())}
                yield pa.RecordBatch.from_arrays([made[c] if c in made else part.column(c) for c in names], names=names)

    reachable(runs.sparkSession)
    return runs.mapInArrow(run, runs.schema).filter(F.length("text") > 0)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def letters(codes: np.ndarray) -> str:
    return codes.tobytes().decode("utf-32-le")


def slices(b: pa.RecordBatch, most: int = 200) -> Iterator[pa.RecordBatch]:
    """A batch in parts, so that a worker holds the objects of a few texts only."""
    for i in range(0, b.num_rows, most):
        yield b.slice(i, most)


def together(rows: DataFrame, key: Sequence[str], work: Callable[[list[dict]], Iterable[tuple]], shape: str) -> DataFrame:
    """key and what work makes (rows of that shape) of all rows of each key."""
    own = rows.groupBy(*key).agg(F.collect_list(F.struct(*(c for c in rows.columns if c not in key))).alias("own"))
    out = StructType([*(own.schema[k] for k in key), *StructType.fromDDL(shape)])
    kinds = [to_arrow_type(f.dataType) for f in StructType.fromDDL(shape)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                at, made = [], []
                for i, x in enumerate(part.column("own")):
                    for row in work(x.as_py()):
                        at.append(i)
                        made.append(row)
                if made:
                    keys = [part.column(k).take(pa.array(at, pa.int64())) for k in key]
                    cols = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*keys, *cols], names=out.names)

    reachable(rows.sparkSession)
    return own.mapInArrow(run, out)


def _both(runs: DataFrame, cuts: DataFrame | None, key: Sequence[str], text: bool) -> DataFrame:
    """Runs and cuts (of is null for runs) in one shape; without their texts only lengths remain."""
    none = F.lit(None).cast("string")
    r = runs.select(*key, none.alias("of"), "H", "after", F.col("text") if text else none.alias("text"), F.length("text").cast("long").alias("n"), "places")
    if cuts is None:
        return r
    return r.unionByName(cuts.select(*key, "of", "H", none.alias("after"), none.alias("text"), F.lit(None).cast("long").alias("n"), "places"))


class Run:
    """What the rows of one run say, put together: its anchor, the places that are known, their characters."""

    def __init__(self, rows: list[dict]):
        rows = sorted(rows, key=lambda r: (r["places"] is not None, r["places"] or b"", r["after"] or "", r["text"] or ""))
        self.whole = rows[0]["text"] if rows[0]["places"] is None and len(rows) == 1 else None  # as it is, if it is simple
        self.after, self.conflict = rows[0]["after"], None
        if len(rows) == 1 and rows[0]["places"] is None:
            self.known, self.n = None, rows[0]["n"]
            return
        masks = [np.ones(r["n"], bool) if r["places"] is None else unpack(r["places"]) for r in rows]
        self.n = max(map(len, masks))
        self.known, self.codes, self.conflict = np.zeros(self.n, bool), np.zeros(self.n, np.uint32), np.zeros(self.n, bool)
        anchors = {r["after"] for r, m in zip(rows, masks, strict=True) if len(m) and m[0]}
        self.after = min(anchors, key=lambda a: (a is None, a or ""), default=None)  # a merge of characters takes the least that is known
        for r, m in zip(rows, masks, strict=True):
            at = np.flatnonzero(m)
            if r["text"] is not None:
                codes = points(r["text"])
                old = self.known[at]
                self.conflict[at[old & (self.codes[at] != codes)]] = True
                self.codes[at[~old]] = codes[~old]
            self.known[at] = True
        if len(anchors) > 1:
            self.conflict[0] = True

    def reach(self) -> int:
        """Places before the first that is not known: what follows that has no known anchor."""
        return self.n if self.known is None or self.known.all() else int(np.argmin(self.known))

    def show(self, start: int, end: int, dead: np.ndarray | None) -> str:
        if self.whole is not None:
            if dead is None:
                return self.whole if end - start == self.n else letters(points(self.whole)[start:end])
            return letters(points(self.whole)[start:end][~dead[start:end]])
        return letters(self.codes[start:end] if dead is None else self.codes[start:end][~dead[start:end]])


def anchor(after: str) -> tuple[str, int] | None:
    """The run and the place that an id names."""
    try:
        place = int(after[-PLACE:], 16)
    except ValueError:
        return None
    return (after[:-PLACE], place) if f"{place:08x}" == after[-PLACE:] else None


def gathered(rows: list[dict]) -> tuple[dict[str, Run], dict[str, list[tuple[str, bytes]]]]:
    """Runs by clock, and cuts (clock, places) by the clock of their run."""
    own: dict[str, list[dict]] = {}
    cuts: dict[str, list[tuple[str, bytes]]] = {}
    for r in rows:
        if r["of"] is None:
            own.setdefault(r["H"], []).append(r)
        else:
            cuts.setdefault(r["of"], []).append((r["H"], r["places"]))
    return {h: Run(x) for h, x in own.items()}, cuts


def walk(runs: dict[str, Run]) -> Iterator[tuple[str, int, int]]:
    """Stretches (run, start, end) in the order of the text. What hangs on a character, its own run's next one
    too, comes newest id first, each with all that hangs on it."""
    hang: dict[str, dict[int, list[str]]] = {}
    roots = []
    for h, r in runs.items():
        if r.reach():
            if r.after is None:
                roots.append(h)
            elif a := anchor(r.after):
                hang.setdefault(a[0], {}).setdefault(a[1], []).append(h)
    split = {h: sorted(x) for h, x in hang.items()}
    zero = "0" * PLACE
    stack = [(h, 0) for h in sorted(roots, key=lambda h: h + zero)]
    while stack:
        h, start = stack.pop()
        n, at = runs[h].reach(), split.get(h, ())
        i = bisect_left(at, start)
        if i == len(at) or at[i] >= n:
            yield h, start, n
            continue
        p = at[i]
        yield h, start, p + 1
        next_ = [(x, 0) for x in hang[h][p]] + ([(h, p + 1)] if p + 1 < n else [])
        stack.extend(sorted(next_, key=lambda x: f"{x[0]}{x[1]:08x}"))


def dead_of(h: str, n: int, cuts: list[tuple[str, bytes]]) -> np.ndarray | None:
    """Places that deletions hide: those as old as the insertion or newer."""
    masks = [unpack(places, n) for at, places in cuts if at >= h]
    return np.logical_or.reduce(masks) if masks else None


def text_string(runs: DataFrame, cuts: DataFrame | None = None, key: Sequence[str] = KEY) -> DataFrame:
    """key, text of the texts that show a character."""

    def work(rows: list[dict]) -> Iterable[tuple]:
        own, cut = gathered(rows)
        dead = {h: dead_of(h, r.n, cut[h]) for h, r in own.items() if h in cut}
        text = "".join([own[h].show(start, end, dead.get(h)) for h, start, end in walk(own)])
        return [(text,)] if text else []

    return together(_both(runs, cuts, key, True), key, work, "text string")


def text_visible(runs: DataFrame, cuts: DataFrame | None = None, key: Sequence[str] = KEY) -> DataFrame:
    """key, of, places, position, n: stretches of a run that show n characters, the first at that position."""

    def work(rows: list[dict]) -> Iterator[tuple]:
        own, cut = gathered(rows)
        dead = {h: dead_of(h, r.n, cut[h]) for h, r in own.items() if h in cut}
        position = 0
        for h, start, end in walk(own):
            mask = np.zeros(end, bool)
            mask[start:] = True if dead.get(h) is None else ~dead[h][start:end]
            if n := int(mask.sum()):
                yield h, pack(mask), position, n
                position += n

    return together(_both(runs, cuts, key, False), key, work, "of string, places binary, position long, n long")


def place_at(shown: DataFrame, position: int, key: Sequence[str] = KEY) -> DataFrame:
    """key, id, of, place of the character that shows at a position of each text."""

    @F.pandas_udf("long")
    def nth(places: pd.Series, skip: pd.Series) -> pd.Series:
        return pd.Series([int(np.flatnonzero(unpack(p))[k]) for p, k in zip(places, skip, strict=True)], dtype="int64")

    reachable(shown.sparkSession)
    at = shown.filter((F.col("position") <= position) & (F.col("position") + F.col("n") > position))
    return at.select(*key, "of", nth("places", F.lit(position) - F.col("position")).alias("place")).select(*key, char_id(F.col("of"), F.col("place")).alias("id"), "of", "place")


def text_format(formats: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """key, of, attr, value, H, places, n: each format with the n places where it is the newest."""

    def work(rows: list[dict]) -> Iterator[tuple]:
        rows.sort(key=lambda r: (r["H"], r["value"] is not None, r["value"] or ""), reverse=True)
        masks = [unpack(r["places"]) for r in rows]
        free = np.ones(max(map(len, masks)), bool)
        for r, m in zip(rows, masks, strict=True):
            won = m & free[: len(m)]
            free[: len(m)] &= ~m
            if n := int(won.sum()):
                yield r["value"], r["H"], pack(won), n

    slim = formats.select(*key, "of", "attr", "places", "value", "H")
    return together(slim, [*key, "of", "attr"], work, "value string, H string, places binary, n long")


def format_at(shown: DataFrame, attrs: DataFrame, position: int, key: Sequence[str] = KEY) -> DataFrame:
    """key, attr, value: what the character at a position wears."""
    worn = attrs.filter(F.col("value").isNotNull()).join(place_at(shown, position, key).select(*key, "of", "place"), [*key, "of"])
    return worn.filter(holds(F.col("places"), F.col("place"))).select(*key, "attr", "value")


def text_compact_chars(runs: DataFrame, cuts: DataFrame, watermark: str, key: Sequence[str] = KEY) -> DataFrame:
    """key, of, places, n: the n characters of each run, and deletions that wait for one, that stay. A character
    goes if its newest deletion is as old as the watermark and nothing that stays follows it."""

    def work(rows: list[dict]) -> Iterator[tuple]:
        own, cut = gathered(rows)
        n = {h: max([own[h].n if h in own else 0, *(8 * len(p) for _, p in cut.get(h, ()))]) for h in {*own, *cut}}
        known = {h: np.zeros(x, bool) for h, x in n.items()}
        for h, r in own.items():
            known[h][: r.n] = True if r.known is None else r.known
        stable, there = {}, {}
        for h, x in n.items():
            old, new = np.zeros(x, bool), np.zeros(x, bool)
            for at, places in cut.get(h, ()):
                (old if at <= watermark else new)[: 8 * len(places)] |= unpack(places)
            stable[h], there[h] = old & ~new, known[h] | old | new
        hang: dict[str, dict[int, int]] = {}
        up = {h: a for h, r in own.items() if known[h][0] and r.after is not None and (a := anchor(r.after))}
        for a, p in up.values():
            at = hang.setdefault(a, {})
            at[p] = at.get(p, 0) + 1
        todo, left = list(n), {}
        while todo:
            h = todo.pop()
            needed = ~stable[h]
            if own_hang := [p for p, many in hang.get(h, {}).items() if many and p < n[h]]:
                needed[own_hang] = True
            left[h] = stay(there[h], known[h], needed)
            if h in up and not left[h][0]:
                a, p = up.pop(h)
                hang[a][p] -= 1
                if a in n and not hang[a][p]:
                    todo.append(a)
        return ((h, pack(m), int(m.sum())) for h, m in left.items() if m.any())

    return together(_both(runs, cuts, key, False), key, work, "of string, places binary, n long")


def stay(there: np.ndarray, known: np.ndarray, needed: np.ndarray) -> np.ndarray:
    """Of the elements there are those that are needed and those that, by known ones, a needed one follows."""
    n = len(there)
    places = np.arange(n)
    first = np.minimum.accumulate(np.where(there & needed, places, n)[::-1])[::-1]  # next needed one
    ends = np.flatnonzero(~np.append(known[1:], False))  # a chain ends where no known one follows
    return there & (first <= ends[np.searchsorted(ends, places)])


def kept(rows: DataFrame, left: DataFrame, clock: str, key: Sequence[str] = KEY) -> DataFrame:
    """Runs (clock H) or cuts (clock of) without what a compaction took from them."""
    texts = "text" in rows.columns

    @F.pandas_udf("text string, places binary")
    def cut(text: pd.Series, places: pd.Series, stays: pd.Series) -> pd.DataFrame:
        out = []
        for t, p, s in zip(text, places, stays, strict=True):
            old = np.ones(len(t), bool) if p is None else unpack(p)
            new = old & unpack(s, len(old))
            out.append((letters(points(t)[new[old]]) if t is not None else None, pack(new) if new.any() else None))
        return pd.DataFrame(out, columns=["text", "places"])

    reachable(rows.sparkSession)
    both = rows.join(left.select(*key, F.col("of").alias(clock), F.col("places").alias("stays")), [*key, clock])
    made = both.withColumn("x", cut(F.col("text") if texts else F.lit(None).cast("string"), "places", "stays")).filter("x.places is not null")
    return made.withColumns({"places": F.col("x.places")} | ({"text": F.col("x.text")} if texts else {})).select(rows.columns)


def text_merge(replicas: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Union of replicas' runs: key, H, after, text, places, conflicts, the places that they tell differently and a merge
    must refuse, and their number n_conflicts. Cuts are united as they are."""

    def work(rows: list[dict]) -> Iterable[tuple]:
        h = rows[0]["h"]
        r = Run(rows)
        if r.whole is not None:
            return [(h, r.after, r.whole, None, None, 0)]
        n = int(r.conflict.sum())
        return [(h, r.after, letters(r.codes[r.known]), None if r.known.all() else pack(r.known), pack(r.conflict) if n else None, n)]

    slim = _both(replicas, None, key, True).withColumn("run", F.col("H")).withColumnRenamed("H", "h").drop("of")
    return together(slim, [*key, "run"], work, "H string, after string, text string, places binary, conflicts binary, n_conflicts long").drop("run")
