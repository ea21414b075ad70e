"""What several operators of this subpackage share: inputs, shared storage, batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

from driftlog.functions.workers import reachable

T = TypeVar("T")

#: White space that separates words, as the contracts state it.
SPACE = " \t\n\x0b\x0c\r"

#: Tables of so many rows and bytes at most may be broadcast, after both have been counted.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20

#: At most this many bytes of rows stand in one Arrow batch, however long the texts are.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir of the session.

    Only where it is unset and all runs on one machine (tests) is a temporary folder made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        found = tempfile.mkdtemp(prefix="driftlog-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends here.

    A lost executor costs the tasks that it ran, never the stages before. The files stay until
    the application's folder is removed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/driftlog-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_bytes(kind: DataType, x: Column) -> Column:
    """About as many bytes as a value takes in a row."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(x), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, ArrayType, StructType)):
            each = F.transform(x, lambda y: row_bytes(kind.elementType, y).cast("long"))
            return F.coalesce(F.aggregate(each, F.lit(0).cast("long"), lambda a, y: a + y), F.lit(0).cast("long")) + 16
        return F.greatest(F.size(x), F.lit(0)) * 8 + 16
    if isinstance(kind, StructType):
        return sum((row_bytes(f.dataType, x[f.name]) for f in kind), F.lit(16))
    return F.lit(8)


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """df marked for broadcast if it has BROADCAST_ROWS rows and BROADCAST_BYTES bytes at most (both
    counted), else as it is: then the join shuffles. df should be cheap to read twice."""
    own = sum((row_bytes(f.dataType, F.col(f"`{f.name}`")).cast("long") for f in df.schema), F.lit(16).cast("long"))
    rows, size = df.limit(BROADCAST_ROWS + 1).select(own.alias("b")).agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers (Arrow batches are cut by bytes, not only by rows), and let
    them find this package."""
    reachable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable[[], T]) -> T:
    """In a Python worker: what an operator remembers between tasks, made once. A worker serves many
    operators in turn; it keeps what the present one remembers and gives the rest back to the machine
    (the allocator would otherwise hold it beside the JVM's heap)."""
    if name not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            give_back()
        _KEPT[name] = make()
    return _KEPT[name]


def give_back() -> None:
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def by_size(texts: list[str], most: int) -> Iterator[slice]:
    """Stretches of a batch of about `most` characters (one text at least)."""
    first = n = 0
    for i, t in enumerate(texts):
        if i > first and n + len(t) > most:
            yield slice(first, i)
            first, n = i, 0
        n += len(t)
    if first < len(texts):
        yield slice(first, len(texts))


def held_out(doc_id: Column) -> Column:
    """Rows whose label no model may learn from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def words_of(text: Column) -> Column:
    """Native: the words of a text (runs of other than white space), an empty array if none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(
        F.split(bare, "[ \\t-\\r]+")
    )
