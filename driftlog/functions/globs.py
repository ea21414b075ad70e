"""Table name patterns: any number of stars, each for any run of characters."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kind(pattern: str) -> str:
    """all, exact, prefix, suffix or segments."""
    if pattern.strip("*") == "" and pattern:
        return "all"
    stars = pattern.count("*")
    if stars == 0:
        return "exact"
    if stars == 1 and pattern.endswith("*"):
        return "prefix"
    if stars == 1 and pattern.startswith("*"):
        return "suffix"
    return "segments"


def regex_of(pattern: str) -> str:
    return "(?s)^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"


def matches_name(pattern: str, name: str) -> bool:
    return re.match(regex_of(pattern), name) is not None


def matches(column: Column, pattern: str) -> Column:
    """Specialised to what the optimiser can push down, where the pattern allows."""
    k = kind(pattern)
    if k == "all":
        return column.isNotNull()
    if k == "exact":
        return column == pattern
    if k == "prefix":
        return column.startswith(pattern[:-1])
    if k == "suffix":
        return column.endswith(pattern[1:])
    return column.rlike(regex_of(pattern))


def subscribed(tables: DataFrame, patterns: list[str], name: str = "table_id") -> DataFrame:
    """Rows of tables that any pattern matches."""
    if not patterns:
        return tables.limit(0)
    return tables.filter(reduce(lambda a, b: a | b, (matches(F.col(name), p) for p in patterns)))


def match_pairs(tables: DataFrame, patterns: list[str], name: str = "table_id") -> DataFrame:
    """(pattern, name) for every match: one projection per pattern, no join."""
    hits = [F.when(matches(F.col(name), p), F.lit(p)) for p in patterns]
    return tables.select(F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("pattern"), name)
