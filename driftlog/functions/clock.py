"""Hybrid logical clocks as text of fixed width: 12 hex digits of milliseconds, 4 of the logical
counter, 16 of the device. The text orders, groups and joins like the clock's bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Before every real clock; used in comparisons only.
ZERO = ""
MOST_MS = (1 << 48) - 1


def _hex(x: Column, width: int) -> Column:
    return F.lpad(F.lower(F.hex(x)), width, "0")


def clock(ms: Column, logical: Column, device: Column) -> Column:
    """Null where the milliseconds do not fit into 48 bits."""
    return F.when((ms >= 0) & (ms <= MOST_MS), F.concat(_hex(ms, 12), _hex(logical, 4), _hex(device, 16)))


def ms_of(h: Column) -> Column:
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("long")


def logical_of(h: Column) -> Column:
    return F.conv(F.substring(h, 13, 4), 16, 10).cast("long")


def device_of(h: Column) -> Column:
    return F.substring(h, 17, 16)


def shown(h: Column) -> Column:
    """Clock for people: Hlc(ms:logical:device)."""
    return F.format_string("Hlc(%d:%d:%s)", ms_of(h), logical_of(h), device_of(h))


def now_ms() -> Column:
    """The query's own time in milliseconds."""
    return F.unix_millis(F.current_timestamp())


def beats(h: Column, other: Column) -> Column:
    """Strictly newer; anything beats no clock."""
    return h > F.coalesce(other, F.lit(ZERO))
