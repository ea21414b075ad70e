"""Tokens of texts for the full-text index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_BYTES = 2


def words(text: Column, least: int = MIN_BYTES) -> Column:
    """Runs of letters and digits in lower case, of `least` bytes at least, in order, repeats kept."""
    found = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(found, lambda x: F.octet_length(x) >= max(1, least))


def tokens(text: Column, least: int = MIN_BYTES) -> Column:
    """The distinct words, sorted."""
    return F.array_sort(F.array_distinct(words(text, least)))
