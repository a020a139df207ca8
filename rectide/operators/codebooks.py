"""Codebooks of item vectors as tables: fit, save, load, encode.

``fit_codebooks`` runs Lloyd rounds for every start (and, for independent levels,
every level) in one scan of the vectors a round: a task holds the centres, sums
the vectors of its partition by (head, code) and sends one row for each of them,
so what is shuffled and collected is the size of the codebooks times the tasks,
whatever the number of vectors.  Seeds are the items of least md5 for a head, so
a run can be repeated; the start of least squared error wins, the first of those
equal to nine digits.

With ``residual`` a level quantises what the levels before left over; the left
over is computed in the task, no residual table is written.  ``encode`` needs no
fit: it reads a codebook table and keeps the ``beam`` best residual paths of an
item at each level.

Null vectors take no part in a fit and get a null code; vectors of another
length are an error.  Fewer vectors than codes give fewer codes.  Equal seeds
give equal centres: the lower code takes the items, the other stays empty and
where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rectide.operators.quality import ValidationError
from rectide.session import stored

CODEBOOK_SCHEMA = "level int, code int, residual boolean, centre array<double>"
# doubles that a task holds as centres, and distances that it holds at a time
MAX_CENTRE_VALUES = 1 << 21
CHUNK_VALUES = 1 << 22


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of equal length as a matrix; the column holds no nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) and pc.any(pc.not_equal(pc.list_value_length(column), dim)).as_py():
        raise ValidationError(f"vectors must have {dim} values")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _chunks(x: np.ndarray, width: int) -> Iterator[np.ndarray]:
    step = max(1, CHUNK_VALUES // max(1, width))
    for lo in range(0, len(x), step):
        yield x[lo : lo + step]


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances (rows of x) x (centres)."""
    cross = (x * x).sum(1)[:, None] - 2.0 * (x @ centres.T) + (centres * centres).sum(1)[None, :]
    return np.maximum(cross, 0.0)


def _left_over(x: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    for book in books:
        x = x - book[_squared(x, book).argmin(1)]
    return x


def _vectors(points: DataFrame) -> DataFrame:
    return points.where(F.col("vector").isNotNull()).select(
        F.col("item_id").cast("string").alias("item_id"), F.col("vector").cast("array<double>").alias("vector")
    )


def _seeds(vectors: DataFrame, heads: list[tuple[int, int, int]], seed: int) -> list[np.ndarray]:
    """For each head (level, start, k) the vectors of the k items of least md5, in this order: one scan for all heads."""
    keys = [
        F.struct(F.lit(i).alias("head"), F.md5(F.concat(F.lit(f"{seed}:{level}:{start}:"), "item_id").cast("binary")).alias("key"))
        for i, (level, start, _) in enumerate(heads)
    ]
    by_key = Window.partitionBy("head").orderBy("key", "item_id", "vector")
    # the tasks keep the least rows of a head before the shuffle; what is collected is bounded by the size check of the codebooks
    least = (
        vectors.select("item_id", "vector", F.explode(F.array(*keys)).alias("h"))
        .select("item_id", "vector", "h.head", "h.key")
        .withColumn("place", F.row_number().over(by_key))
        .where(F.col("place") <= max(k for _, _, k in heads))
        .select("head", "place", "vector")
        .collect()
    )
    held = [sorted((r["place"], r["vector"]) for r in least if r["head"] == i and r["place"] <= k) for i, (_, _, k) in enumerate(heads)]
    return [np.array([vector for _, vector in rows], dtype=np.float64) for rows in held]


def _lloyd_round(vectors: DataFrame, heads: list[np.ndarray], books: list[np.ndarray]):
    """(new centres, squared error of the given ones) of each head, from one scan."""
    dim = heads[0].shape[1]
    width = sum(len(h) for h in heads) + dim

    def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros_like(h) for h in heads]
        counts = [np.zeros(len(h), dtype=np.int64) for h in heads]
        cost = [np.zeros(len(h)) for h in heads]
        for batch in batches:
            for chunk in _chunks(_matrix(batch.column(0), dim), width):
                rest = _left_over(chunk, books)
                for i, centres in enumerate(heads):
                    d2 = _squared(rest, centres)
                    code = d2.argmin(1)
                    member = (code[None, :] == np.arange(len(centres))[:, None]).astype(np.float64)
                    sums[i] += member @ rest
                    counts[i] += np.bincount(code, minlength=len(centres))
                    cost[i] += np.bincount(code, weights=d2[np.arange(len(code)), code], minlength=len(centres))
        rows = [(i, c) for i, h in enumerate(heads) for c in range(len(h)) if counts[i][c]]
        yield pa.RecordBatch.from_pydict(
            {
                "head": pa.array([i for i, _ in rows], pa.int32()),
                "code": pa.array([c for _, c in rows], pa.int32()),
                "n": pa.array([int(counts[i][c]) for i, c in rows], pa.int64()),
                "cost": pa.array([float(cost[i][c]) for i, c in rows], pa.float64()),
                "total": pa.array([sums[i][c].tolist() for i, c in rows], pa.list_(pa.float64())),
            }
        )

    partial = vectors.select("vector").mapInArrow(partial_sums, "head int, code int, n long, cost double, total array<double>")
    rows = (
        partial.withColumn("total", array_to_vector("total"))
        .groupBy("head", "code")
        .agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), Summarizer.sum(F.col("total")).alias("total"))
        .collect()  # a row a centre
    )
    centres, cost = [h.copy() for h in heads], np.zeros(len(heads))
    for r in rows:
        centres[r["head"]][r["code"]] = r["total"].toArray() / r["n"]
        cost[r["head"]] += r["cost"]
    return centres, cost


def _lloyd(vectors: DataFrame, heads: list[np.ndarray], books: list[np.ndarray], rounds: int):
    """Rounds until no centre moves; (centres, squared error with them) of each head."""
    for _ in range(rounds):
        moved, _ = _lloyd_round(vectors, heads, books)
        still = all(np.allclose(a, b, rtol=0.0, atol=1e-12) for a, b in zip(heads, moved))
        heads = moved
        if still:
            break
    _, cost = _lloyd_round(vectors, heads, books)
    return heads, cost


def _best(heads: list[np.ndarray], cost: np.ndarray) -> np.ndarray:
    return heads[min(range(len(heads)), key=lambda i: float(f"{cost[i]:.9g}"))]


def fit_codebooks(
    points: DataFrame, sizes: list[int], starts: int = 10, rounds: int = 20, seed: int = 42, residual: bool = True
) -> DataFrame:
    """Codebook table (level, code, residual, centre) of (item_id, vector); ``sizes`` has the codes of each level."""
    if not sizes or min(sizes) < 1 or starts < 1 or rounds < 0:
        raise ValueError("sizes, starts and rounds must be positive")
    vectors = stored(_vectors(points))
    first = vectors.first()
    if first is None:
        raise ValidationError("vectors must not be empty")
    dim = len(first["vector"])
    if dim < 1 or sum(sizes) * starts * dim > MAX_CENTRE_VALUES:
        raise ValueError(f"codebooks of {sum(sizes)} codes, {starts} starts and {dim} values do not fit a task")
    books: list[np.ndarray] = []
    if residual:
        for level, k in enumerate(sizes):
            seeds = [_left_over(s, books) for s in _seeds(vectors, [(level, i, k) for i in range(starts)], seed)]
            books.append(_best(*_lloyd(vectors, seeds, books, rounds)))
    else:
        every = [(level, i, k) for level, k in enumerate(sizes) for i in range(starts)]
        heads, cost = _lloyd(vectors, _seeds(vectors, every, seed), [], rounds)
        for level in range(len(sizes)):
            own = slice(level * starts, (level + 1) * starts)
            books.append(_best(heads[own], cost[own]))
    rows = [(lv, c, residual, [float(v) for v in centre]) for lv, book in enumerate(books) for c, centre in enumerate(book)]
    return points.sparkSession.createDataFrame(rows, CODEBOOK_SCHEMA)


def _books(codebooks: DataFrame) -> tuple[list[np.ndarray], bool]:
    rows = codebooks.orderBy("level", "code").limit(MAX_CENTRE_VALUES + 1).collect()
    if not rows or len(rows) * len(rows[0]["centre"]) > MAX_CENTRE_VALUES:
        raise ValueError("the codebook table is empty or does not fit a task")
    levels = sorted({r["level"] for r in rows})
    books = [np.array([r["centre"] for r in rows if r["level"] == lv], dtype=np.float64) for lv in levels]
    return books, bool(rows[0]["residual"])


def _independent_codes(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    d2 = [_squared(x, book) for book in books]
    return np.stack([d.argmin(1) for d in d2], axis=1), np.sum([d.min(1) for d in d2], axis=0)


def _beam_codes(x: np.ndarray, books: list[np.ndarray], beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the best kept path and its squared error; of equal paths the first in code order of the kept ones."""
    n, dim = x.shape
    rest, paths, error = x[:, None, :], np.zeros((n, 1, 0), dtype=np.int32), (x * x).sum(1)[:, None]
    every = np.arange(n)[:, None]
    for book in books:
        held = rest.shape[1]
        d2 = _squared(rest.reshape(n * held, dim), book).reshape(n, held * len(book))
        order = np.argsort(d2, axis=1, kind="stable")[:, :beam]
        parent, code = order // len(book), order % len(book)
        error = np.take_along_axis(d2, order, axis=1)
        rest = rest[every, parent] - book[code]
        paths = np.concatenate([paths[every, parent], code[:, :, None].astype(np.int32)], axis=2)
    return paths[:, 0], error[:, 0]


def encode(points: DataFrame, codebooks: DataFrame, beam: int = 1) -> DataFrame:
    """(item_id, topic, semantic_id, semantic_id_str, error) of (item_id, topic, vector) by a codebook table.

    ``error`` is the squared distance to the sum of the codes, for independent levels the sum of those of the levels."""
    if beam < 1:
        raise ValueError("beam must be positive")
    books, residual = _books(codebooks)
    dim, width = books[0].shape[1], (max(len(b) for b in books) + books[0].shape[1]) * beam

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            present = batch.filter(batch.column(2).is_valid())
            absent = batch.filter(batch.column(2).is_null())
            x = _matrix(present.column(2), dim)
            found = [_beam_codes(c, books, beam) if residual else _independent_codes(c, books) for c in _chunks(x, width)]
            sid = [row.tolist() for path, _ in found for row in path] + [None] * len(absent)
            error = [float(e) for _, errors in found for e in errors] + [None] * len(absent)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([present.column(0), absent.column(0)]),
                    pa.concat_arrays([present.column(1), absent.column(1)]),
                    pa.array(sid, pa.list_(pa.int32())),
                    pa.array(error, pa.float64()),
                ],
                names=["item_id", "topic", "semantic_id", "error"],
            )

    topic = F.col("topic").cast("string") if "topic" in points.columns else F.lit(None).cast("string")
    rows = points.select(F.col("item_id").cast("string").alias("item_id"), topic.alias("topic"), F.col("vector").cast("array<double>").alias("vector"))
    out = rows.mapInArrow(codes, "item_id string, topic string, semantic_id array<int>, error double")
    return out.select(
        "item_id", "topic", "semantic_id", F.array_join(F.transform("semantic_id", lambda c: c.cast("string")), "-").alias("semantic_id_str"), "error"
    )
