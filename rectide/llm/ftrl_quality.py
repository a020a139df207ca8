"""Quality classifier: hashed word n-grams, logistic regression, FTRL updates."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rectide.llm.words import mix, text_slices, word_table

#: Words are runs of letters (with digits and non-ASCII) or runs of one kind of sign.
_CLASS = np.full(256, 2, dtype=np.uint8)
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_CLASS[0x30:0x3A] = _CLASS[0x61:0x7B] = _CLASS[0x80:] = 1
_CLASS[0x27] = 1
#: Sizes of the training sample and the model (parameters of the operator).
SAMPLE_ROWS = 16_384
MODEL_BITS = 18


def features(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value): hashed word 1- and 2-grams, square-root counts, rows of length 1.

    A word equal to the one before it makes one shared 2-gram, so repetition is
    seen whatever the word is.  Feature 0 is the bias, value 1.
    """
    table = word_table(texts, _CLASS, lower=True)
    n, row = len(texts), table.doc_of_word()
    pair = table.window_starts(2)
    same = table.hashes[pair] == table.hashes[pair + 1]
    codes = np.concatenate([mix(table.hashes, 5), np.where(same, np.uint64(1) << np.uint64(60), table.window_hash(pair, 2, salt=6))])
    slot = (codes >> np.uint64(64 - bits)).astype(np.int64)
    slot[slot == 0] = 1
    key, count = np.unique((np.concatenate([row, row[pair]]) << bits) | slot, return_counts=True)
    row, slot, value = key >> bits, key & ((1 << bits) - 1), np.sqrt(count)
    norm = np.sqrt(np.bincount(row, value * value, minlength=n))
    value = value / norm[row] if len(row) else value
    everyone = np.arange(n)
    return np.concatenate([everyone, row]), np.concatenate([np.zeros(n, np.int64), slot]), np.concatenate([np.ones(n), value])


class Ftrl:
    """Follow-the-regularised-leader (proximal) logistic regression, one example at a time."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, slot=slice(None)) -> np.ndarray:
        z, n = self.z[slot], self.n[slot]
        step = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / step)

    def update(self, slot: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(slot)
        p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
        g = (p - label) * value
        n = self.n[slot]
        self.z[slot] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[slot] = n + g * g


def train(
    docs: DataFrame, labels: DataFrame, folds: int, sample_rows: int, bits: int, epochs: int, seed: int
) -> np.ndarray:
    """Weights (2**bits) learnt from at most ``sample_rows`` labelled documents outside fold 0.

    The sample is the ids first in a seeded hash order of doc_id, which is also
    the order of training; its features are extracted by many tasks, one task
    runs the updates over this bounded sample.  Of an id with several texts as
    many distinct ones are kept (first by a seeded hash) as fit for every id.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
        .filter("label in (0, 1)")
        .filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != 0)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .withColumn("place", F.xxhash64(F.lit(seed), "doc_id"))
        .orderBy("place", "doc_id")
        .limit(sample_rows)
    )
    each = max(1, sample_rows // max(1, chosen.count()))
    # at most sample_rows rows of three numbers
    texts_ = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .distinct()
    )
    # Spark cuts to the first rows of an id before the shuffle too, so a repeated id does not fill a task
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64(F.lit(seed), "text"), "text")
    sample = texts_.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= each)

    def extract(batches):
        for batch in batches:
            for begin, end, texts in text_slices(batch.column("text")):
                row, slot, value = features(texts, bits)
                order = np.argsort(row, kind="stable")
                cut = np.searchsorted(row[order], np.arange(1, len(texts)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("place").slice(begin, end - begin),
                        batch.column("doc_id").slice(begin, end - begin),
                        batch.column("label").slice(begin, end - begin),
                        pa.array([x.astype(np.int32).tobytes() for x in np.split(slot[order], cut)], pa.binary()),
                        pa.array([x.astype(np.float32).tobytes() for x in np.split(value[order], cut)], pa.binary()),
                    ],
                    names=["place", "doc_id", "label", "slots", "vals"],
                )

    def learn(table: pa.Table) -> pa.Table:
        model = Ftrl(1 << bits)
        # rows sharing an id are trained in the order of their features
        rows = table.sort_by([("place", "ascending"), ("doc_id", "ascending"), ("slots", "ascending")])
        labels_ = rows.column("label").to_pylist()
        slots, values = rows.column("slots"), rows.column("vals")
        for _ in range(epochs):
            for i, label in enumerate(labels_):
                model.update(
                    np.frombuffer(slots[i].as_py(), np.int32), np.frombuffer(values[i].as_py(), np.float32), label
                )
        return pa.table({"weights": pa.array([model.weights().astype(np.float32).tobytes()], pa.binary())})

    rows = (
        sample.select("place", "doc_id", "label", "text")
        .mapInArrow(extract, "place long, doc_id long, label int, slots binary, vals binary")
        .groupBy(F.lit(0).alias("all"))
        .applyInArrow(lambda t: learn(t), "weights binary")
        .collect()  # one row of 4 * 2**bits bytes
    )
    return np.frombuffer(rows[0][0], np.float32) if rows else np.zeros(1 << bits, dtype=np.float32)


def score_texts(texts: list[bytes], weights: np.ndarray, bits: int) -> np.ndarray:
    row, slot, value = features(texts, bits)
    margin = np.bincount(row, weights[slot] * value, minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def with_quality(
    docs: DataFrame,
    labels: DataFrame,
    name: str = "score",
    folds: int = 5,
    sample_rows: int = SAMPLE_ROWS,
    bits: int = MODEL_BITS,
    epochs: int = 2,
    seed: int = 42,
) -> DataFrame:
    """All columns of ``docs`` and the quality score of the text in column ``name``.

    Logistic regression over hashed word 1- and 2-grams (``features``), trained
    with FTRL on ``labels.quality`` of documents whose crc32 of the id as text
    is not 0 modulo ``folds`` (``train``), scored as a sparse dot product with
    the weights.  Only the text is an input.  Null and empty texts score the
    bias alone, one value in 0..1; labels other than 0 and 1 are passed over; of
    several labels of an id the largest holds; without labels all scores are
    0.5.  One row for each input row; an empty table gives no rows.
    """
    weights = train(docs, labels, folds, sample_rows, bits, epochs, seed)
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def score(batches):
        for batch in batches:
            for begin, end, texts in text_slices(batch.column(at)):
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(score_texts(texts, weights, bits))], names=[*part.schema.names, name]
                )

    return docs.mapInArrow(score, schema)


def ftrl_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, **options) -> DataFrame:
    """doc_id, held_out (crc32 of the id is 0 modulo ``folds``; a null id is not), score, predicted."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = with_quality(slim, labels, folds=folds, **options)
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def crc_fold(doc_id: int, folds: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds
