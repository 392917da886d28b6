"""A table of the newest row of each key, written by any number of writers.

A write is a part of its own, and counts once its record is there; readers take the parts of all records and keep each
key's newest row. As the newest of rows does not depend on their order, writers need no lock, a write under the same name
replaces itself, and a writer that breaks off leaves nothing that a reader sees. A record says until when its rows
live, so parts that have expired are not read at all: what a reader reads is what was written within one lifetime.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOREVER = float("inf")


@dataclass(frozen=True)
class KeyedTable:
    """``newest``: of rows of one key, the one with the largest of these stays. ``expires``: a column of seconds, or none."""

    path: str
    keys: tuple[str, ...]
    newest: tuple[str, ...]
    expires: str | None = None

    def write(self, rows: DataFrame, name: str, clock: float | None = None) -> None:
        """Put ``rows`` in under ``name``; ``clock`` (seconds) is the time of the write."""
        self.write_part(rows, name)
        self.write_record(rows.sparkSession, name, clock)

    def write_part(self, rows: DataFrame, name: str) -> None:
        self._newest(rows).write.mode("overwrite").parquet(f"{self.path}/parts/name={name}")

    def write_record(self, spark: SparkSession, name: str, clock: float | None) -> None:
        until = F.max(self.expires) if self.expires else F.lit(FOREVER)
        part = spark.read.parquet(f"{self.path}/parts/name={name}")
        record = part.agg(F.coalesce(until, F.lit(-FOREVER)).cast("double").alias("until"), F.lit(clock).cast("double").alias("clock"), F.count(F.lit(1)).alias("rows"))
        record.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/records/name={name}")

    def records(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("until double, clock double, rows long, name string").parquet(f"{self.path}/records")

    def read(self, spark: SparkSession, clock: float | None = None) -> DataFrame:
        """Each key's newest row, unless it has expired by ``clock`` (without one: the latest write's)."""
        records = self.records(spark)
        now = clock if clock is not None else records.agg(F.max("clock")).first()[0]
        living = records if now is None else records.where(F.col("until") > now)
        # One name for each write within a lifetime.
        paths = [f"{self.path}/parts/name={r['name']}" for r in living.select("name").collect()]
        if not paths:
            any_part = f"{self.path}/parts/name={records.first()['name']}"
            return spark.read.parquet(any_part).limit(0)
        newest = self._newest(spark.read.parquet(*paths))
        return newest if self.expires is None or now is None else newest.where(F.col(self.expires) > now)

    def _newest(self, rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c not in self.keys]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*others), F.struct(*self.newest)).alias("_row")).select(*self.keys, "_row.*")


def run_upserts(stream: DataFrame, target: KeyedTable, at: str) -> None:
    """Write all that a stream holds now into ``target``, trigger by trigger; ``at`` is the column of seconds."""

    def handle(rows: DataFrame, number: int) -> None:
        name = f"{number:012d}"
        target.write_part(rows, name)
        clock = rows.sparkSession.read.parquet(f"{target.path}/parts/name={name}").agg(F.max(at)).first()[0]
        target.write_record(rows.sparkSession, name, clock)

    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{target.path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
