"""From raw documents to training sequences: toxicity, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir); all but the last keep the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, packing, suffix_dedup, toxicity
from tidemark.llm.common import table, trim, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows of a batch between Spark and Python: texts are long, and tasks of all stages share an executor's memory.
BATCH = 2000


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The session's batches stay at most BATCH rows from a stage on, as its result is only computed when it is written."""

    def run_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(name)) <= BATCH:
            spark.conf.set(name, BATCH)
        return stage(spark, docs, sf_dir)

    return run_


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half stay. The model learns from labelled rows of the stage's own input."""
    model = toxicity.train(*toxicity.training_bags(docs.select("doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")))
    trim()  # of the driver, which keeps what the training took otherwise
    return toxicity.score_texts(docs.select(*COLUMNS), *model).where("score < 0.5").drop("score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest doc_id stays (the first of equal ones)."""
    return jaccard_join.one_of_each(docs.select(*COLUMNS))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated 200-byte strings are cut out of the texts; documents of which nothing is left go."""
    cut = suffix_dedup.remove_repeats(docs, with_text=True, keep=COLUMNS)
    cut = cut.where((F.length("kept_text") > 0) | (F.col("n_bytes") == 0))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens with their ids."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [(name, in_small_batches(stage)) for name, stage in (("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("repeated passages", drop_repeated_passages), ("packing", pack))]

#: The trained classifier, the tokenizer and the byte-wise cuts have no SQL; tests hold the stages against their operators, and the operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
