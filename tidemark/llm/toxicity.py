"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its hashed character n-grams and itself; a text is the mean of the vectors of all its
distinct words' subwords. Vectors and the softmax are trained together, in numpy, on a sample of labelled texts whose
size is bounded by ``SAMPLE`` texts and ``SAMPLE_BYTES`` bytes of each class. Misspellings that were never seen share n-grams with
words that were. As the softmax is linear, a text's logit is the mean of its words' projected scores, so only one
number per subword travels to the executors.

Edge cases: null and empty texts get the score of an empty bag (below one half); null labels and null doc_ids of
labels teach nothing; of repeated labels the largest counts, of the texts of a repeated doc_id the first in order;
where one class has no labelled text the score is that of the other class; an empty table gives an empty table;
further columns are ignored; texts of any length are scored whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hold, schema_of, table, text_slices, with_columns

#: Labelled texts of each class that the model is fitted on, at most. The rest of the corpus is only scored.
SAMPLE = 2500
#: Bytes of these texts for each class, at most, so that the driver's share doesn't follow the length of texts.
SAMPLE_BYTES = 64_000_000
BUCKET_BITS = 17
DIMENSIONS, BUCKETS, EPOCHS, RATE = 8, 1 << BUCKET_BITS, 4, 0.1
#: Words of a text that count for a bucket, at most, by the width of a bag's integers.
MOST = (1 << 32 - BUCKET_BITS) - 1
#: Scale of the means: a few telling words in a long text must be able to move it.
GAIN = 30
#: Evidence from which on a subword's vector starts along the softmax's direction, how far, and the scale of chance.
EVIDENCE, START, NOISE = 2.0, 0.2, 0.02
#: Moves that a subword without evidence counts as made before: it learns in smaller steps.
CAUTION = 10.0
SHORTEST, LONGEST = 3, 6
PUNCTUATION = ".,;:!?\"'()[]{}<>-_*"
#: Subwords without a score that every bag holds besides its own: a few words prove little.
NEUTRAL = 500
CACHE = 250_000


def subwords(word: str) -> list[int]:
    """Buckets of a word's character n-grams, and of the word as a whole."""
    word = word.strip(PUNCTUATION)
    if not word:
        return []
    marked, crc, mask = f"<{word}>", zlib.crc32, BUCKETS - 1
    raw = [marked[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(marked) - n + 1)]
    return [crc(g.encode()) & mask for g in [*raw, marked + "="]]


def bag(text: str | None) -> np.ndarray:
    """A whole text's buckets and how often its distinct words have them: one integer for each, its bucket in the low bits."""
    found = [b for w in set((text or "").lower().split()) for b in subwords(w)]
    keys, counts = np.unique(np.array(found, np.uint32), return_counts=True)
    return keys | np.minimum(counts, MOST).astype(np.uint32) << BUCKET_BITS


def shares(bag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a bag and their shares in its mean."""
    counts = bag >> BUCKET_BITS
    return (bag & (BUCKETS - 1)).astype(np.int32), (counts / (counts.sum() + NEUTRAL)).astype(np.float32)


def subword_evidence(bags: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Of each bucket the signed root of its log-likelihood ratio between the classes' texts, less ``EVIDENCE``.

    A bucket that a few texts share by chance stays at zero; one that many toxic and no clean texts hold does not.
    """
    counts = np.zeros((2, BUCKETS))
    for bag, y in zip(bags, labels):
        counts[y, bag & (BUCKETS - 1)] += 1
    texts = [max(1, int((labels == c).sum())) for c in (0, 1)]
    held, ratio = counts[0] + counts[1], np.zeros(BUCKETS)
    for c in (0, 1):
        share = texts[c] / sum(texts)
        for seen, expected in ((counts[c], held * share), (texts[c] - counts[c], (sum(texts) - held) * share)):
            some = seen > 0
            ratio[some] += seen[some] * np.log(seen[some] / np.maximum(expected[some], 1e-9))
    side = np.sign(counts[1] / texts[1] - counts[0] / texts[0])
    return side * np.maximum(0, np.sqrt(np.maximum(0, 2 * ratio)) - EVIDENCE)


def train_vectors(bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors of all buckets, the softmax's weights, its bias), trained together over all subwords of ``bags``.

    Vectors start at random and, for subwords with evidence, along the softmax's first direction besides; buckets that no
    text of the sample holds are zero. Each bucket's step is scaled by what it has moved before.
    """
    rng = np.random.default_rng(seed)
    share = float(labels.mean())
    direction = rng.standard_normal(DIMENSIONS)
    direction /= np.sqrt((direction**2).sum())
    weights = (np.stack([-direction, direction]) + NOISE * rng.standard_normal((2, DIMENSIONS))).astype(np.float32)
    bias = np.zeros(2, np.float32)
    evidence, held = subword_evidence(bags, labels), np.zeros(BUCKETS, bool)
    for bag in bags:
        held[bag & (BUCKETS - 1)] = True
    vectors = np.float32(NOISE) * rng.standard_normal((BUCKETS, DIMENSIONS), np.float32)
    vectors += (START * evidence[:, None] * direction).astype(np.float32)
    vectors[~held] = 0
    moved, moved_w = np.where(evidence != 0, 1e-2, CAUTION).astype(np.float32), np.float32(1e-8)
    balance = np.array([0.5 / (1 - share), 0.5 / share])
    for epoch in range(EPOCHS):
        rate = np.float32(RATE * (1 - epoch / EPOCHS))
        for i in rng.permutation(len(bags)):
            keys, parts = shares(bags[i])
            parts *= np.float32(GAIN)
            mean = parts @ vectors[keys]
            z = weights @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= balance[labels[i]]
            step = p @ weights
            moved[keys] += parts * parts * float(step @ step)
            vectors[keys] -= (rate * parts / np.sqrt(moved[keys]))[:, None] * step
            grad = np.outer(p, mean)
            moved_w += float((grad * grad).sum() + (p * p).sum())
            weights -= rate * 0.3 * grad / np.sqrt(moved_w)
            bias -= rate * 3 * p / np.sqrt(moved_w)
    return vectors, weights, bias


def train(bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Projected score of every bucket (its vector along the difference of the softmax's two rows) and the bias."""
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return np.zeros(BUCKETS, np.float32), 30.0 if share else -30.0
    vectors, weights, bias = train_vectors(bags, labels, seed)
    return (GAIN * (vectors @ (weights[1] - weights[0]))).astype(np.float32), float(bias[1] - bias[0])


def training_bags(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> tuple[list[np.ndarray], np.ndarray]:
    """Bags of at most ``sample`` labelled texts of each class, chosen by a hash of doc_id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    picked = None
    for value in (0, 1):
        part = known.where((F.col("label") == value)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = part if picked is None else picked.unionByName(part)
    # Two times the sample in ids: a bound that does not follow the input.
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    upto = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))
    texts = texts.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_BYTES).select("doc_id", "text", "label")
    texts = texts.repartition(docs.sparkSession.sparkContext.defaultParallelism, "doc_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                bags = pa.array([bag(t).tobytes() for t in part.column("text").to_pylist()], pa.binary())
                yield with_columns(part, ["doc_id", "label"], bag=bags)

    rows = texts.mapInArrow(run, "doc_id long, label int, bag binary").toArrow()
    order = np.lexsort((rows["label"].to_numpy(), rows["doc_id"].to_numpy()))
    bags = [np.frombuffer(b.as_buffer(), np.uint32) for b in rows["bag"]]
    return [bags[i] for i in order], rows["label"].to_numpy().astype(int)[order]


class _Scores(dict):
    """Word to (sum of projected scores, number of subwords), as one complex number."""

    def __init__(self, projected: np.ndarray):
        self.projected = projected.tolist()

    def __missing__(self, word: str) -> complex:
        buckets = subwords(word)
        value = complex(sum(map(self.projected.__getitem__, buckets)), len(buckets))
        if len(word) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[word] = value
        return value


def score_texts(docs: DataFrame, projected: np.ndarray, bias: float) -> DataFrame:
    """``docs`` with a score for every whole ``text``; other columns pass as they are."""
    model = docs.sparkSession.sparkContext.broadcast((projected, bias))  # of fixed size: one number per bucket
    columns = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        projected, bias = model.value
        known = _Scores(projected)
        for batch in batches:
            for part in text_slices(batch):
                logits = []
                for text in part.column("text").to_pylist():
                    total = sum(map(known.__getitem__, set(text.lower().split())), 0j) if text else 0j
                    logits.append(bias + total.real / (total.imag + NEUTRAL) if total.imag else min(bias, -1.0))
                yield with_columns(part, columns, score=pa.array(1 / (1 + np.exp(-np.clip(np.array(logits), -60, 60)))))
        known.clear()
        hold()

    return docs.mapInArrow(run, f"{schema_of(docs, *columns)}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, training_docs: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    projected, bias = train(*training_bags(training_docs if training_docs is not None else docs, labels))
    scored = score_texts(docs.select("doc_id", "text"), projected, bias)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))
