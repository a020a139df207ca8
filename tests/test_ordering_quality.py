import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rectide.operators import quality
from rectide.operators.ordering import exact_quantiles, global_rank, ordered_positions, prefix_join
from rectide.plans.prepare import Bundle


def test_global_rank_is_consecutive_over_many_partitions(spark):
    rnd = random.Random(5)
    rows = [(f"i{j:04d}", float(rnd.randint(0, 20))) for j in range(1500)]
    df = spark.createDataFrame(rows, "item_id string, score double").repartition(13)
    got = global_rank(df, [F.col("score").desc(), F.col("item_id").asc()], "r").orderBy("r").collect()
    want = sorted(rows, key=lambda x: (-x[1], x[0]))
    assert [r.r for r in got] == list(range(1, len(rows) + 1))
    assert [r.item_id for r in got] == [w[0] for w in want]


def test_ordered_positions_lag_and_length(spark):
    rows = [(u, t, float(t * 10)) for u in ("a", "b") for t in range(7 if u == "a" else 3)]
    df = spark.createDataFrame(rows, "user_id string, t int, v double")
    out = ordered_positions(df, "user_id", [F.col("t").asc()], lag_cols=["v"]).orderBy("user_id", "pos").collect()
    a = [r for r in out if r.user_id == "a"]
    assert [r.pos for r in a] == list(range(1, 8)) and all(r.n == 7 for r in a)
    assert [r.prev_v for r in a] == [None] + [float(t * 10) for t in range(6)]


def test_prefix_join_equals_theta_join(spark):
    ranked = spark.createDataFrame([(f"i{j}", j) for j in range(1, 101)], "item_id string, grank long")
    needs = spark.createDataFrame([("u0", 0), ("u1", 1), ("u2", 7), ("u3", 64), ("u4", 65), ("u5", 100)], "user_id string, need int")
    got = sorted((r.user_id, r.grank) for r in prefix_join(needs, ranked, block=8).collect())
    want = sorted((u, g) for u, n in [("u0", 0), ("u1", 1), ("u2", 7), ("u3", 64), ("u4", 65), ("u5", 100)] for g in range(1, n + 1))
    assert got == want


@pytest.mark.parametrize("qs", [(0.66, 0.33), (0.0, 0.5, 1.0)])
def test_exact_quantiles_match_numpy(spark, qs):
    vals = [random.Random(9).random() for _ in range(1)] + [x / 7 for x in range(37)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    row = exact_quantiles(df, "x", list(qs)).collect()[0]
    for i, q in enumerate(qs):
        assert row[f"q_{i}"] == pytest.approx(float(np.quantile(vals, q)))


def test_vector_and_request_checks(spark):
    cands = spark.createDataFrame([("1",), ("2",)], "item_id string")
    vecs = spark.createDataFrame([("1", [1.0, 0.0]), ("3", [1.0, 0.0, 0.5])], "item_id string, vector array<float>")
    assert [r.key for r in quality.missing_vectors(cands, vecs).collect()] == ["2"]
    assert quality.vector_shape_violations(vecs).count() == 2
    req = spark.createDataFrame([("r1", 0), ("r2", None), ("r3", 50)], "request_id string, top_k int")
    assert [r.key for r in quality.request_violations(req).collect()] == ["r1"]
    with pytest.raises(quality.ValidationError):
        quality.require_non_empty(cands.limit(0), "candidates")


def test_item_and_interaction_validation(spark):
    items = spark.createDataFrame(
        [("i1", "t", "b", "x", "a", "2026-01-01", "0.5"), ("i1", "t", "b", "x", "a", "bad", "nan?")],
        "item_id string, title string, body string, topic string, author_id string, publish_time string, quality_score string",
    )
    rules = {r.rule for r in quality.validate_items(items).collect()}
    assert rules == {"items.duplicate_item_id", "items.invalid_publish_time", "items.invalid_quality_score"}
    inter = spark.createDataFrame(
        [("u", "i1", "click", "2026-01-01", "1.0"), ("u", "i1", "share", "2026-01-01", "-1")],
        "user_id string, item_id string, event_type string, event_time string, dwell_time string",
    )
    rules = {r.rule for r in quality.validate_interactions(inter).collect()}
    assert rules == {"interactions.invalid_event_type", "interactions.negative_dwell_time"}
    with pytest.raises(quality.ValidationError, match="missing columns"):
        quality.validate_users(spark.createDataFrame([(1,)], "id int"))


def test_ordered_positions_of_full_slots_and_of_the_others(spark):
    rows = [(u, t, t % 3) for u, many in (("a", 40), ("b", 2), ("c", 9), (None, 5)) for t in range(many)]
    df = spark.createDataFrame(rows, "user_id string, t int, v int").repartition(5)
    want = sorted((u, t, t + 1, sum(r[0] == u for r in rows), (t - 1) % 3 if t else None) for u, t, _ in rows if u)
    for slot_rows in (0, 8, 1 << 17):  # all, some and no keys are spread
        out = ordered_positions(df, "user_id", [F.col("t").asc()], lag_cols=["v"], slot_rows=slot_rows)
        assert sorted((r.user_id, r.t, r.pos, r.n, r.prev_v) for r in out.collect()) == want
        assert dict(out.dtypes)["pos"] == dict(out.dtypes)["n"] == "int"


def test_candidates_are_ranked_for_the_first_reader_only():
    asked = []
    b = Bundle(None, None, None, None, None, lambda: asked.append(1) or "ranked")
    assert not asked
    assert b.candidates == b.candidates == "ranked" and len(asked) == 1
