"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_LIBC = ctypes.CDLL(None)
#: Characters of text that a task works on at a time, whatever the size of its Arrow batches.
SLICE = 300_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One input table, always through Spark's reader, with only the columns asked for."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where none is set and one machine does all."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        named = sc.getCheckpointDir()
    return named


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """An Arrow batch in slices of about ``limit`` bytes of ``column``; a longer value is a slice of its own.

    Other columns stay Arrow arrays, so 64-bit ids keep their value beside nulls.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def with_columns(part: pa.RecordBatch, keep: list[str], **columns: pa.Array) -> pa.RecordBatch:
    """Columns of a batch as they are, and new ones behind them."""
    return pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *columns.values()], [*keep, *columns])


def schema_of(df: DataFrame, *names: str) -> str:
    """The columns' DDL, for the schema of a function that passes them on."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"`{n}` {types[n]}" for n in names)


_HELD: dict[object, Any] = {}


def trim() -> None:
    """What is free goes back to the machine."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def hold(key: object = None, make: Callable[[], Any] | None = None) -> Any:
    """What a Python worker keeps from task to task: one operator's memory at a time; without a key, nothing.

    Workers serve the tasks of all operators, one after another, so what one remembers must not stay with the next, and
    what it freed goes back to the machine.
    """
    if key not in _HELD:
        _HELD.clear()
        trim()
        if make is not None:
            _HELD[key] = make()
    return _HELD.get(key)


def tidy(f: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A task's function that leaves no memory behind in its worker, which may wait idle beside others."""

    def run(batches: Iterator) -> Iterator:
        yield from f(batches)
        hold()

    return run
