"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import inspect
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affect.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A given table, with only ``columns`` if any are named."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the cluster's shared folder and read back.

    What follows then has a short lineage, is planned from real sizes, and a
    lost executor never makes what came before run again."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, df: DataFrame) -> str:
    """``name``, lengthened until ``df`` has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def give_back() -> None:
    """What this worker process has freed goes back to the system.

    Arrow's pool and the C library keep freed memory for later use; workers
    outlive their tasks, so it would count against the executor from one stage to the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries have none
    if trim is not None:
        trim(0)


def giving_back(function):
    """``function`` of a group of rows (for ``applyInPandas``), followed by ``give_back()``."""
    def of_rows(rows):
        out = function(rows)
        give_back()
        return out

    def of_key(key, rows):
        out = function(key, rows)
        give_back()
        return out

    def of_two(key, left, right):
        out = function(key, left, right)
        give_back()
        return out

    return [of_rows, of_key, of_two][len(inspect.signature(function).parameters) - 1]


def arrow_column(function, returns: str, column: str | Column) -> Column:
    """A column that ``function`` makes from the Arrow arrays of ``column``.

    It counts as non-deterministic so that the optimizer never copies it into
    a filter, which would run it twice for each row."""
    def run(values: pa.Array) -> pa.Array:
        out = function(values)
        give_back()
        return out

    return F.arrow_udf(run, returns).asNondeterministic()(F.col(column) if isinstance(column, str) else column)


_kept: dict[str, tuple[str, object]] = {}


def once_a_process(slot: str, key: str, make):
    """What ``make()`` returned for ``key`` in this worker process; each slot keeps its last key only."""
    if slot not in _kept or _kept[slot][0] != key:
        _kept.pop(slot, None)
        _kept[slot] = (key, make())
    return _kept[slot][1]


#: Texts that are taken out of an Arrow array together.
SLICE = 500


def utf8(texts: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text, a slice at a time; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    for i in range(0, len(texts), SLICE):
        for t in texts.slice(i, SLICE).cast(kind).to_pylist():
            yield t or b""


def strings(texts: pa.Array) -> Iterator[str]:
    """Each text, a slice at a time; null counts as empty."""
    for i in range(0, len(texts), SLICE):
        for t in texts.slice(i, SLICE).to_pylist():
            yield t or ""
