"""Skip-gram with hierarchical softmax over numbered sentences (M11), without the vectors on the driver.

Words are numbered by falling count.  The code tree is built from the counts
alone; a task gets the parents of its nodes (4 bytes a node) and holds vectors
only of the words of its sentences and of the inner nodes on their paths.  First
vectors follow from the seed and the word's number.  A task trains its sentences
in order; around one event all its pairs are trained at once.  After a pass the
vectors that several tasks have trained are averaged, as MLlib's are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rectide.session import stored

LEARNING_RATE = 0.025
_MAX_EXP = 6.0
#: Vectors of one batch that a task gives.
_OUT_ROWS = 8192
_WORD, _NODE = 0, 1


def code_tree(counts: np.ndarray) -> np.ndarray:
    """Parents of a Huffman tree over words of falling count: words 0..n-1, inner nodes n..2n-2 (the last is the root).

    A parent p is given as 2p + bit of the child; the root has -1."""
    n = len(counts)
    parent = np.full(max(2 * n - 1, 1), -1, dtype=np.int64)
    leaves = counts.tolist()
    inner: list[int] = []
    leaf, made = n - 1, 0
    for at in range(n - 1):
        pair = []
        for _ in range(2):
            if leaf >= 0 and (made >= len(inner) or leaves[leaf] < inner[made]):
                pair.append((leaf, leaves[leaf]))
                leaf -= 1
            else:
                pair.append((n + made, inner[made]))
                made += 1
        inner.append(pair[0][1] + pair[1][1])
        parent[pair[0][0]], parent[pair[1][0]] = 2 * (n + at), 2 * (n + at) + 1
    return parent.astype(np.int32) if n < 1 << 29 else parent


def _paths(words: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, inner nodes, bits): the path of each word to the root, one after the other."""
    at, owner = words.astype(np.int64), np.arange(len(words))
    owners, nodes, bits = [], [], []
    while len(at):
        up = parent[at].astype(np.int64)
        at, owner, up = at[up >= 0], owner[up >= 0], up[up >= 0]
        owners.append(owner)
        nodes.append(up >> 1)
        bits.append(up & 1)
        at = up >> 1
    owner, node, bit = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owners, nodes, bits))
    order = np.argsort(owner, kind="stable")
    start = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])
    return start, node[order], bit[order]


def first_vectors(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Uniform in +-0.5 / size, by a hash of seed, word and place."""
    x = (words.astype(np.uint64)[:, None] * np.uint64(size) + np.arange(size, dtype=np.uint64)) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return (((x >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24) - np.float32(0.5)) / np.float32(size)).astype(np.float32)


def _place(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    return np.searchsorted(known, values)


def _train_task(
    sentences: pa.Table, state: pa.Table, parent: np.ndarray, task: int, tasks: int, before: int, total: int,
    size: int, window: int, seed: int, last: bool,
) -> pa.Table:
    items = sentences.column("items").combine_chunks()
    flat = items.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    length = np.diff(items.offsets.to_numpy())
    words = np.unique(flat)
    start, node, bit = _paths(words, parent)
    inner = np.unique(node)
    word, point = _place(flat, words), _place(node, inner)
    target = (1 - bit).astype(np.float32)
    if state.num_rows:
        held = [np.zeros((len(known), size), dtype=np.float32) for known in (words, inner)]
        kind, ix = (state.column(c).to_numpy() for c in ("kind", "ix"))
        vectors = state.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        for k, known in ((_WORD, words), (_NODE, inner)):
            held[k][_place(ix[kind == k], known)] = vectors[kind == k]
        out, hidden = held
    else:
        out, hidden = first_vectors(words, size, seed), np.zeros((len(inner), size), dtype=np.float32)
    rng = np.random.default_rng([seed, task, before])
    alpha, done, at, shown = LEARNING_RATE, 0, 0, 0
    bound = start.tolist()
    for n in length.tolist():
        if done - shown > 10_000:
            alpha = max(LEARNING_RATE * (1 - (tasks * done + before) / total), LEARNING_RATE * 0.0001)
            shown = done
        own = word[at : at + n]
        reach = rng.integers(1, window + 1, n).tolist()
        for i, centre in enumerate(own.tolist()):
            around = np.concatenate([own[max(i - reach[i], 0) : i], own[i + 1 : i + 1 + reach[i]]])
            a, b = bound[centre], bound[centre + 1]
            if not len(around) or a == b:
                continue
            points, near = point[a:b], out[around]
            ahead = hidden[points]
            f = near @ ahead.T
            g = (target[a:b] - 1 / (1 + np.exp(-f))) * np.float32(alpha)
            g[np.abs(f) >= _MAX_EXP] = 0
            hidden[points] = ahead + g.T @ near  # a path has no node twice
            step = g @ ahead
            if len(around) == 1 or len(set(around.tolist())) == len(around):
                out[around] = near + step
            else:
                np.add.at(out, around, step)
        at, done = at + n, done + n
    parts = [(_WORD, words, out)] if last else [(_WORD, words, out), (_NODE, inner, hidden)]
    batches = []
    for kind, known, vectors in parts:
        for a in range(0, len(known), _OUT_ROWS):
            ix, own = known[a : a + _OUT_ROWS], vectors[a : a + _OUT_ROWS]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ix) + 1, dtype=np.int32) * size), pa.array(own.ravel(), pa.float32()))
            batches.append(
                pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ix), task), pa.int32()), pa.array(np.full(len(ix), kind), pa.int32()), pa.array(ix, pa.int32()), lists],
                    names=["task", "kind", "ix", "vector"],
                )
            )
    return pa.Table.from_batches(batches)


def _averages(trained: DataFrame, size: int) -> DataFrame:
    """(kind, ix, vector): the mean over the tasks that trained it, at most one vector a task."""
    several = trained.groupBy("kind", "ix").agg(F.collect_list("vector").alias("vs"))
    mean = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: (F.aggregate("vs", F.lit(0.0), lambda total, v: total + F.get(v, i)) / F.size("vs")).cast("float"),
    )
    return several.select("kind", "ix", F.when(F.size("vs") == 1, F.get("vs", F.lit(0))).otherwise(mean).alias("vector"))


class Word2Vec:
    """A trainer with the parameters of MLlib's; a partition is a task."""

    def __init__(self, vectorSize: int, windowSize: int, seed: int, maxIter: int, numPartitions: int):  # noqa: N803
        self.size, self.window, self.seed, self.passes, self.tasks = vectorSize, windowSize, seed, maxIter, numPartitions

    def fit(self, sentences: DataFrame, counts: np.ndarray) -> DataFrame:
        """(ix int, vector ARRAY<FLOAT>) from sentences (task, items ARRAY<INT>) and the words' counts in order."""
        size, window, seed, passes, tasks = self.size, self.window, self.seed, self.passes, self.tasks
        spark = sentences.sparkSession
        parent = spark.sparkContext.broadcast(code_tree(counts))
        events = int(counts.sum())
        schema = "task int, kind int, ix int, vector array<float>"
        state = spark.createDataFrame([], schema)

        def pass_of(done):
            return lambda key, rows, held: _train_task(
                rows, held, parent.value, key[0].as_py(), tasks, done * events, events * passes + 1, size, window, seed, done == passes - 1
            )

        for done in range(passes):
            dealt = sentences.repartition(tasks, "task").groupBy("task")
            trained = stored(dealt.cogroup(state.repartition(tasks, "task").groupBy("task")).applyInArrow(pass_of(done), schema))
            merged = _averages(trained, size)
            if done < passes - 1:
                state = stored(trained.select("task", "kind", "ix").join(merged, ["kind", "ix"]).select("task", "kind", "ix", "vector"))
        return merged.where(F.col("kind") == _WORD).select("ix", "vector")
