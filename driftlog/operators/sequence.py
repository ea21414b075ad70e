"""Lists and texts: sequences whose elements name the element they follow.

Order is a walk from the head: the children of an element are visited newest id first, each before
its own children's later siblings; deleted elements are passed but their children are visited;
elements whose anchor is unknown are hidden. The walk is sequential within one sequence, so it runs
per sequence on arrays (an iterative walk: a typed text is a chain as deep as it is long).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlog.functions.workers import reachable

KEY = ("pk",)


def walk(ids: Sequence[str], after: Sequence[str | None]) -> list[int]:
    """Positions of the elements in visiting order, tombstones included."""
    children: dict[str | None, list[int]] = {}
    for i, a in enumerate(after):
        children.setdefault(a, []).append(i)
    for own in children.values():
        own.sort(key=lambda i: ids[i])  # the stack turns it round: newest first
    order, stack = [], list(children.get(None, ()))
    while stack:
        i = stack.pop()
        order.append(i)
        stack.extend(children.get(ids[i], ()))
    return order


def list_elements(inserts: DataFrame, deletes: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Elements (key, id, after, ...) with deleted_at, the newest deletion's clock, and known. Deletions of
    elements that have not been inserted yet wait as elements that are not known: they and what
    follows them are hidden."""
    gone = deletes.groupBy(*key, "id").agg(F.max("H").alias("deleted_at"))
    return inserts.withColumn("known", F.lit(True)).join(gone, [*key, "id"], "full_outer").withColumn("known", F.coalesce("known", F.lit(False)))


def list_dead(i: str, deleted_at: str) -> bool:
    """A list's element outlives deletions that are not newer than its insertion."""
    return deleted_at > i


def text_dead(i: str, deleted_at: str) -> bool:
    """A character's id is its insertion's clock and eight digits; a deletion as old as that hides it."""
    return deleted_at >= i[:-8]


def visible(elements: DataFrame, key: Sequence[str] = KEY, hidden: Callable[[str, str], bool] = list_dead) -> DataFrame:
    """key, id, position (from 0) of the elements that show: placed, and not deleted. Other columns ride
    along by a join on the id."""
    kinds = elements.select(*key).schema.simpleString()[7:-1].replace(":", " ")

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.reset_index(drop=True)
        ids = rows["id"].tolist()
        after = [None if pd.isna(a) else a for a in rows["after"]]
        dead = [not pd.isna(d) and hidden(i, d) for d, i in zip(rows["deleted_at"], ids, strict=True)]
        at = [i for i in walk(ids, after) if not dead[i]]
        out = rows.loc[at, [*key, "id"]].copy()
        out["position"] = range(len(at))
        return out

    reachable(elements.sparkSession)
    slim = (elements.filter("known") if "known" in elements.columns else elements).select(*key, "id", "after", "deleted_at")
    return slim.groupBy(*key).applyInPandas(place, f"{kinds.replace(',', ', ')}, id string, position long")


def list_merge(replicas: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Union of replicas' elements; deletions keep the newest clock, and what one replica knows of an
    element's place all know. conflict marks ids that the replicas place differently, which a merge must
    refuse."""
    known = F.col("known") if "known" in replicas.columns else F.lit(True)
    return replicas.groupBy(*key, "id").agg(
        F.min("after").alias("after"), F.max("deleted_at").alias("deleted_at"), F.max(known).alias("known"),
        (F.countDistinct(F.when(known, F.coalesce("after", F.lit("")))) > 1).alias("conflict"),
    )


def list_compact(elements: DataFrame, watermark: str, key: Sequence[str] = KEY, hidden: Callable[[str, str], bool] = list_dead) -> DataFrame:
    """Without deleted elements as old as the watermark that no remaining element follows, until
    none is left. Chains of tombstones fall together: an element goes if all that hang on it go."""

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in elements.schema)

    def shrink(rows: pd.DataFrame) -> pd.DataFrame:
        ids, after = rows["id"].tolist(), rows["after"].tolist()
        stable = {i for i, d in zip(ids, rows["deleted_at"], strict=True) if not pd.isna(d) and hidden(i, d) and d <= watermark}
        needed = dict.fromkeys(ids, 0)
        for a in after:
            if a in needed:
                needed[a] += 1
        parent = dict(zip(ids, after, strict=True))
        todo = [i for i in stable if not needed[i]]
        gone = set()
        while todo:
            i = todo.pop()
            gone.add(i)
            p = parent[i]
            if p in needed:
                needed[p] -= 1
                if p in stable and not needed[p]:
                    todo.append(p)
        return rows[~rows["id"].isin(gone)]

    reachable(elements.sparkSession)
    return elements.groupBy(*key).applyInPandas(shrink, kinds)


def text_inserts(inserts: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """(key, id, after, ch): one element for each code point of inserted texts (key, H, after, text).

    An id is the insertion's clock and the character's place in it, in eight hex digits; every
    character follows the one before.
    """
    each = inserts.select(*key, "H", "after", F.posexplode(F.filter(F.split("text", ""), lambda c: c != "")).alias("at", "ch"))
    return each.select(*key, char_id(F.col("H"), F.col("at")).alias("id"), F.when(F.col("at") == 0, F.col("after")).otherwise(char_id(F.col("H"), F.col("at") - 1)).alias("after"), "ch")


def char_id(h: Column, at: Column) -> Column:
    return F.concat(h, F.lpad(F.lower(F.hex(at.cast("long"))), 8, "0"))


def text_visible(chars: DataFrame, deletes: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """key, id, position of the characters that show. A character outlives deletions older than it."""
    return visible(list_elements(chars, deletes, key), key, text_dead)


def text_string(chars: DataFrame, deletes: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """key, text. The characters of one text are put together in one row, as any text is."""
    shown = text_visible(chars, deletes, key).join(chars.select(*key, "id", "ch"), [*key, "id"])
    own = F.array_sort(F.collect_list(F.struct("position", "ch")))
    return shown.groupBy(*key).agg(F.array_join(F.transform(own, lambda x: x["ch"]), "").alias("text"))


def text_format(formats: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """key, id, attr, value: of format operations (key, ids array, attr, value, H) the newest for
    each character and attribute; a null value takes the attribute off."""
    each = formats.select(*key, F.explode("ids").alias("id"), "attr", "value", "H")
    own = each.groupBy(*key, "id", "attr").agg(F.max_by(F.struct("value"), "H").alias("v"), F.max("H").alias("H"))
    return own.select(*key, "id", "attr", F.col("v.value").alias("value"), "H")


def text_compact(attrs: DataFrame, watermark: str) -> DataFrame:
    """Attributes without the removals that are as old as the watermark."""
    return attrs.filter(F.col("value").isNotNull() | (F.col("H") > watermark))


def text_compact_chars(chars: DataFrame, watermark: str, key: Sequence[str] = KEY) -> DataFrame:
    """Characters (key, id, after, deleted_at, ...) without those deleted by the watermark that no
    remaining character follows; deletions that wait for their character go likewise."""
    return list_compact(chars, watermark, key, lambda i, d: True)


def cell_at(shown: DataFrame, elements: DataFrame, position: int, key: Sequence[str] = KEY) -> DataFrame:
    """The elements, with all their columns, at a position of each sequence."""
    return elements.join(id_at(shown, position).select(*key, "id"), [*key, "id"], "left_semi")


def id_at(shown: DataFrame, position: int) -> DataFrame:
    """Of visible elements (key, id, position) the one at a position of each sequence."""
    return shown.filter(F.col("position") == position)


def format_range(shown: DataFrame, start: int, end: int, attr: str, value: str | None, h: str, key: Sequence[str] = KEY) -> DataFrame:
    """The format operation (key, ids, attr, value, H) for the visible interval [start, end)."""
    own = shown.filter((F.col("position") >= start) & (F.col("position") < end))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda x: x["id"])
    return own.groupBy(*key).agg(ids.alias("ids")).select(*key, "ids", F.lit(attr).alias("attr"), F.lit(value).cast("string").alias("value"), F.lit(h).alias("H"))


def format_at(shown: DataFrame, attrs: DataFrame, position: int, key: Sequence[str] = KEY) -> DataFrame:
    """key, attr, value: what the character at a position wears."""
    at = id_at(shown, position).select(*key, "id")
    return attrs.filter(F.col("value").isNotNull()).join(at, [*key, "id"]).select(*key, "attr", "value")
