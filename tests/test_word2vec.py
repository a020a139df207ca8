"""Word2Vec whose vectors stay on the executors."""

import heapq
import random

import numpy as np

from rectide.operators import semantic_id, word2vec


def test_code_tree_is_optimal():
    rng = random.Random(4)
    for counts in ([5], [3, 3], sorted((rng.randrange(1, 60) for _ in range(50)), reverse=True)):
        parent = word2vec.code_tree(np.array(counts))
        start, node, bit = word2vec._paths(np.arange(len(counts)), parent)
        heap = list(counts)
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        assert sum(c * n for c, n in zip(counts, np.diff(start).tolist())) == cost
        codes = {tuple(zip(node[a:b].tolist(), bit[a:b].tolist())) for a, b in zip(start[:-1], start[1:])}
        assert len(codes) == len(counts)


def test_items_of_the_same_company_are_near(spark):
    rng = random.Random(2)
    rows = [(f"u{u}", p, f"{'ab'[u % 2]}{rng.randrange(6)}") for u in range(300) for p in range(1, 21)]
    seq = spark.createDataFrame(rows, "user_id string, pos int, item_id string")

    def check(**more):
        got = {r.item_id: np.array(r.vector) for r in semantic_id.item_embeddings(seq, 16, **more).collect()}
        assert len(got) == 12
        unit = {i: v / np.linalg.norm(v) for i, v in got.items()}
        mean = lambda same: np.mean([unit[x] @ unit[y] for x in got for y in got if x != y and (x[0] == y[0]) == same])
        assert mean(True) > mean(False) + 0.2

    check(max_iter=3)
    check(max_iter=3, events_per_task=2500)  # three tasks, merged after each pass


def test_no_vector_reaches_the_driver(spark, monkeypatch):
    seen = []
    broadcast = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: (seen.append(value), broadcast(self, value))[1])
    rows = [(f"u{u}", p, f"i{(u * p) % 50}") for u in range(40) for p in range(1, 9)]
    seq = spark.createDataFrame(rows, "user_id string, pos int, item_id string")
    found = semantic_id.item_embeddings(seq, 64, min_count=2)
    items = found.count()
    assert [v.nbytes for v in seen] == [4 * (2 * items - 1)]
    assert "LocalTableScan" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_factor_blocks_follow_the_ratings(spark, monkeypatch):
    asked = []
    als = semantic_id.ALS
    monkeypatch.setattr(semantic_id, "ALS", lambda **params: (asked.append((params["numUserBlocks"], params["numItemBlocks"])), als(**params))[1])
    rows = [(f"u{u}", p, f"i{(u * p) % 9}") for u in range(12) for p in range(1, 9)]
    seq = spark.createDataFrame(rows, "user_id string, pos int, item_id string")
    ratings = seq.select("user_id", "item_id").distinct().count()
    assert semantic_id.item_factors(seq, 4, 1).count() == 9
    monkeypatch.setattr(semantic_id, "ALS_BLOCK_RATINGS", 5)
    assert semantic_id.item_factors(seq, 4, 1).count() == 9
    assert asked == [(10, 10), (-(-ratings // 5), -(-ratings // 5))]
