"""Token counts by source, language and tokenizer version, kept up by signed deltas.

A batch of changes (inserts, deletes, revised counts) becomes signed sums for each group, written to a folder of its own
and committed by one record. A batch that is committed already is left alone, so repeats and retries change nothing;
one that broke off has no record and is written anew. Totals are the sums over all committed batches; ``compact`` folds
many batches into one that takes their place.

Edge cases: null sources and languages are groups of their own; null and empty texts count one document and no
tokens; a null text is no copy of another; equal rows are documents of their own; groups without documents
left aren't shown; an empty table gives an empty rollup; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import word_tokens
from .common import ensure_checkpoint_dir, schema_of, table, text_slices, with_columns, written

GROUP = ["source", "lang", "tokenizer"]
INSERT, DELETE, REVISE = "insert", "delete", "revise"


class Rollup:
    """Folders of signed sums, and commits that say which folder holds which batch.

    A batch's sums are written to a folder of their own first; one record then commits it. Of several records of one
    batch (two writers at once, or a retry) the one of the least folder name counts, for every reader alike, so a batch
    counts once. A commit may take the place of others (``compact``), which readers leave out from then on.
    """

    COMMIT = "batch string, folder string, checksum long, replaces array<string>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commits(self) -> DataFrame:
        """batch, folder, checksum and replaces of every batch that counts."""
        try:
            records = self.spark.read.schema(self.COMMIT).parquet(f"{self.path}/commits")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.COMMIT)
        one = records.groupBy("batch").agg(F.min(F.struct("folder", "checksum", "replaces")).alias("c")).select("batch", "c.*")
        gone = one.select(F.explode("replaces").alias("batch")).distinct()
        return one.join(F.broadcast(gone), "batch", "left_anti")  # names of batches

    def committed(self, batch: str) -> bool:
        """Whether the batch counts, by itself or in a batch that took its place."""
        try:
            records = self.spark.read.schema(self.COMMIT).parquet(f"{self.path}/commits")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return False
        return not records.where(F.col("batch") == batch).isEmpty()

    def _commit(self, batch: str, sums: DataFrame, replaces: list[str]) -> None:
        folder = f"data-{uuid.uuid4().hex}"
        sums.coalesce(1).write.parquet(f"{self.path}/{folder}")
        held = self.spark.read.schema(sums.schema).parquet(f"{self.path}/{folder}")
        checksum = held.agg(F.coalesce(F.bit_xor(F.xxhash64(*held.columns)), F.lit(0)).alias("x")).first()["x"]
        self.spark.createDataFrame([(batch, folder, checksum, replaces)], self.COMMIT).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit ``changes`` (op, source, lang, tokenizer, tokens, old_tokenizer, old_tokens) once; False if it was there.

        A revision takes the old count from the old tokenizer's group and adds the new one to the new group's.
        """
        if self.committed(batch):
            return False
        signed = changes.select("source", "lang", F.explode(F.when(F.col("op") == INSERT, F.array(self._entry("tokenizer", "tokens", 1)))
            .when(F.col("op") == DELETE, F.array(self._entry("tokenizer", "tokens", -1)))
            .when(F.col("op") == REVISE, F.array(self._entry("old_tokenizer", "old_tokens", -1), self._entry("tokenizer", "tokens", 1)))).alias("e")).select("source", "lang", "e.*")
        self._commit(batch, signed.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")), [])
        return True

    @staticmethod
    def _entry(tokenizer: str, tokens: str, sign: int):
        return F.struct(F.col(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("documents"), (F.coalesce(F.col(tokens), F.lit(0)) * sign).cast("long").alias("tokens"))

    def totals(self, batches: list[str] | None = None) -> DataFrame:
        """source, lang, tokenizer, documents, tokens over ``batches``, or over all that count."""
        found = self.commits() if batches is None else self.commits().where(F.col("batch").isin(batches))
        folders = [r["folder"] for r in found.select("folder").collect()]
        schema = "source string, lang string, tokenizer string, documents long, tokens long"
        parts = self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)
        out = parts.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return out.where("documents <> 0 or tokens <> 0")

    def compact(self, batches: list[str], into: str) -> None:
        """Commit the sums over ``batches`` as the batch ``into``, which takes their place."""
        if not self.committed(into):
            self._commit(into, self.totals(batches), batches)


def counted(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, source, lang, text_hash and tokens of every whole text."""
    kept = ["doc_id", "source", "lang", "text_hash", "n_bytes"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokens.load(vocabulary)
        for batch in batches:
            for part in text_slices(batch, limit=2_000_000):
                packed = encoder.encode_packed([t or "" for t in part.column("text").to_pylist()])
                yield with_columns(part, kept, tokens=pa.array([len(p) // 4 for p in packed], pa.int64()))

    hashed = docs.select("doc_id", "source", "lang", F.xxhash64("text").alias("text_hash"), F.coalesce(F.octet_length("text"), F.lit(-1)).alias("n_bytes"), "text")
    return hashed.mapInArrow(run, f"{schema_of(hashed, *kept)}, tokens long")


def token_counts(docs: DataFrame, vocabulary: str, name: str = "word_bpe_49k", path: str | None = None, all_inserts: bool = False) -> DataFrame:
    """Rollup of a corpus that arrives, is cleared of exact copies and moves to a version that counts the end id too.

    Batches: inserts of all documents; deletes of all copies but one of each text; revisions of what is left; and
    the first two a second time, which changes nothing. The row of least doc_id, then source, then language of each
    text stays, nulls last. With ``all_inserts`` the totals of all documents, copies too, are shown besides, under the
    version of the inserts.
    """
    spark = docs.sparkSession
    rows = written(counted(docs, vocabulary).withColumn("row", F.monotonically_increasing_id()), "token-rows")
    # Rows that are equal in all of these count alike, so which of them stays changes nothing.
    order = [x for c in ("doc_id", "source", "lang") for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))]
    first = rows.where("n_bytes >= 0").groupBy("text_hash", "n_bytes").agg(F.min(F.struct(*order, "row"))["row"].alias("first"))
    marked = rows.join(first, ["text_hash", "n_bytes"], "left").withColumn("copy", F.col("first").isNotNull() & (F.col("row") != F.col("first")))
    version, later = F.lit(f"{name}/1"), F.lit(f"{name}/2")
    none = F.lit(None)
    change = lambda df, op, to, tokens, old, old_tokens: df.select(F.lit(op).alias("op"), "source", "lang", to.alias("tokenizer"), tokens.alias("tokens"), old.cast("string").alias("old_tokenizer"), old_tokens.cast("long").alias("old_tokens"))
    inserts = change(rows, INSERT, version, F.col("tokens"), none, none)
    deletes = change(marked.where("copy"), DELETE, version, F.col("tokens"), none, none)
    revisions = change(marked.where("not copy"), REVISE, later, F.col("tokens") + 1, version, F.col("tokens"))
    rollup = Rollup(spark, path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-counts-{uuid.uuid4().hex}")
    for batch, changes in (("1", inserts), ("2", deletes), ("3", revisions), ("1", inserts), ("2", deletes)):
        rollup.apply(batch, changes)
    left = rollup.totals(["1", "2", "3"])
    return rollup.totals(["1"]).unionByName(left) if all_inserts else left


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"), public_tokenizers.path("word_bpe_49k.json"), all_inserts=True)
