"""State machines over streams: each key's rows in order, however many a trigger brings.

A trigger's rows meet the memory of earlier triggers, are dealt out by key and sorted in their partitions by Spark
(which spills), and one pass over a partition takes each key's rows in order, one Arrow batch at a time. So neither a
key nor a trigger has to fit in memory, and the order does not depend on how rows were batched. The rows of one key go
through one task, because each step needs the one before it.

Every trigger writes one part, with what the steps said and the memories that hold now, named by the trigger's number:
a trigger that is run again after a failure reads the same part before it and overwrites its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Row = dict[str, Any]


@dataclass(frozen=True)
class Machine:
    """A step takes a key's memory (None at first) and a row, and gives the memory after it and what it says.

    ``said`` and ``memory`` are DDL of what a step gives.
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    step: Callable[[Row | None, Row], tuple[Row | None, Row]]
    said: str
    memory: str


#: From (rows of a trigger, memories, a folder for intermediate tables): rows and memories that are left to the machine, and
#: what ``folded`` gives for all other keys.
Shortcut = Callable[[DataFrame, DataFrame | None, str], tuple[DataFrame, DataFrame | None, DataFrame]]


def folded(machine: Machine, rows: DataFrame, memories: DataFrame | None = None) -> DataFrame:
    """Keys, ``said`` (a row's) and ``memory`` (a key's, once) after all of ``rows``; one of the two is null."""
    keyed = rows.select(*machine.keys, F.lit(None).cast(f"struct<{machine.memory}>").alias("memory"), F.struct(*[c for c in rows.columns if c not in machine.keys]).alias("row"))
    if memories is not None:
        keyed = memories.select(*machine.keys, "memory", F.lit(None).cast(keyed.schema["row"].dataType).alias("row")).unionByName(keyed)
    ordered = keyed.repartition(*machine.keys).sortWithinPartitions(*machine.keys, F.col("row").isNotNull(), *(f"row.{c}" for c in machine.order))
    shape = StructType([*(keyed.schema[k] for k in machine.keys)]).add("said", StructType.fromDDL(machine.said)).add("memory", StructType.fromDDL(machine.memory))
    arrow = to_arrow_schema(shape)
    keys, step = machine.keys, machine.step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, memory = None, None
        for batch in batches:
            out: list[Row] = []
            for r in batch.to_pylist():
                key = tuple(r[k] for k in keys)
                if key != now:
                    if memory is not None:
                        out.append(dict(zip(keys, now), said=None, memory=memory))
                    now, memory = key, None
                if r["row"] is None:
                    memory = r["memory"]
                else:
                    memory, said = step(memory, r["row"])
                    out.append(dict(zip(keys, key), said=said, memory=None))
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if memory is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(keys, now), said=None, memory=memory)], schema=arrow)

    return ordered.mapInArrow(run, shape)


def said(result: DataFrame) -> DataFrame:
    """What the steps said: keys and the columns of ``said``."""
    keys = [c for c in result.columns if c not in ("said", "memory", "part")]
    return result.where("said IS NOT NULL").select(*keys, "said.*")


def run_folded(machine: Machine, stream: DataFrame, folder: str, alive: Callable[[DataFrame, DataFrame], DataFrame] | None = None, shortcut: Shortcut | None = None) -> DataFrame:
    """Run a machine over all that a stream's source holds now; what its steps said.

    ``alive`` (memories, rows of the trigger) leaves out memories that have ended; ``shortcut`` takes the keys that need no machine.
    """
    at = f"{folder.rstrip('/')}/folded-{uuid.uuid4().hex}"

    def handle(rows: DataFrame, number: int) -> None:
        memories = None
        if number:
            memories = rows.sparkSession.read.parquet(f"{at}/parts/part={number - 1}").where("memory IS NOT NULL")
            memories = alive(memories, rows) if alive is not None else memories
        done = None
        if shortcut is not None:
            rows, memories, done = shortcut(rows, memories, f"{at}/work/{number}")
        result = folded(machine, rows, memories)
        result = result if done is None else result.unionByName(done)
        result.write.mode("overwrite").parquet(f"{at}/parts/part={number}")

    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    keyed = StructType([stream.schema[k] for k in machine.keys])
    shape = keyed.add("said", StructType.fromDDL(machine.said)).add("memory", StructType.fromDDL(machine.memory))
    return said(spark.read.schema(shape).parquet(f"{at}/parts"))
