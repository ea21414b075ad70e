"""Nested cells: events that address cells inside a row, folded in order of arrival.

Replacing or deleting a cell compares its own clock only and discards what is inside it, so the
result depends on arrival where ancestors and descendants are both written; a fold by key is then the
only faithful form. Events: pk, offset, path (array of field names, empty for the row), op (replace,
delete), value, H.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlog.functions.workers import reachable


class Cell:
    __slots__ = ("value", "h", "fields")

    def __init__(self) -> None:
        self.value: str | None = None
        self.h = ""
        self.fields: dict[str, Cell] | None = None

    def at(self, path: list[str], h: str) -> Cell | None:
        """The addressed cell; missing fields are made. A cell that holds no record becomes one only
        for an event newer than all of it."""
        own = self
        for field in path:
            if own.fields is None:
                if h <= own.newest():
                    return None
                own.fields, own.value = {}, None
            own = own.fields.setdefault(field, Cell())
        return own

    def newest(self) -> str:
        return max([self.h, *(c.newest() for c in (self.fields or {}).values())])

    def apply(self, op: str, value: str | None, h: str) -> bool:
        if h <= self.h:
            return False
        self.value, self.fields, self.h = (value if op == "replace" else None), None, h
        return True

    def leaves(self, path: tuple[str, ...] = ()):
        if self.fields is None:
            if self.h:
                yield path, self.value, self.h
            return
        for name in sorted(self.fields):
            yield from self.fields[name].leaves((*path, name))


def project(cells: DataFrame, path: str) -> DataFrame:
    """Of folded cells (pk, path, value, H) those at a path or below it."""
    return cells.filter((F.col("path") == path) | F.col("path").startswith(path + "/") | F.lit(path == ""))


def newest(cells: DataFrame) -> DataFrame:
    """pk, H: the newest clock in each row's cells."""
    return cells.groupBy("pk").agg(F.max("H").alias("H"))


def fold(events: DataFrame) -> DataFrame:
    """pk, path (fields joined by /), value, H of every cell that was written, tombstones too."""

    def own(rows: pd.DataFrame) -> pd.DataFrame:
        root = Cell()
        for path, op, value, h in rows.sort_values("offset")[["path", "op", "value", "H"]].itertuples(index=False):
            cell = root.at(list(path), h)
            if cell is not None:
                cell.apply(op, value, h)
        out = [(rows["pk"].iloc[0], "/".join(p), v, h) for p, v, h in root.leaves()]
        return pd.DataFrame(out, columns=["pk", "path", "value", "H"])

    reachable(events.sparkSession)
    kind = events.schema["pk"].dataType.simpleString()
    return events.select("pk", "offset", "path", "op", "value", "H").groupBy("pk").applyInPandas(own, f"pk {kind}, path string, value string, H string")
