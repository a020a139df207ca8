import json
import math

import pytest
from pyspark.sql import functions as F

from rectide.operators.behaviors import attach_actions, normalize_matrix_columns
from rectide.operators.quality import ValidationError
from rectide.operators.sequences import (
    build_content_sequences,
    build_watch_sequences,
    sequence_rows,
    sequences_from_rows,
    targets,
    train_only_view,
)


def test_action_thresholds_and_weights(spark):
    df = spark.createDataFrame([(0.2,), (0.8,), (1.4,), (2.2,), (float("nan"),), (None,)], "watch_ratio double")
    out = attach_actions(df).collect()
    assert [r.action for r in out] == [
        "short_view", "valid_view", "complete_view", "high_interest", "high_interest", "high_interest",
    ]
    assert [r.action_weight for r in out] == [0.2, 1.0, 1.5, 2.5, 2.5, 2.5]


def test_attach_actions_requires_watch_ratio(spark):
    with pytest.raises(ValidationError, match="watch_ratio"):
        attach_actions(spark.createDataFrame([(1,)], "user_id int"))


def _watch(spark, rows):
    df = spark.createDataFrame(rows, "user_id long, video_id long, timestamp double, watch_ratio double")
    return attach_actions(df)


def test_watch_sequence_split_and_deltas(spark):
    log = _watch(spark, [(8, 52, 40.0, 0.1), (8, 57, 15.0, 1.0), (8, 55, 27.0, 2.0), (8, 51, 27.0, 0.3), (8, 59, 90.0, 0.7)])
    seq = build_watch_sequences(log, min_history=3).orderBy("pos").collect()
    assert [r.item_id for r in seq] == ["57", "51", "55", "52", "59"]  # equal times: by id
    assert [r.delta for r in seq] == [0, 12, 0, 13, 50]
    assert [r.split for r in seq] == ["train", "train", "train", "validation", "test"]
    t = targets(build_watch_sequences(log, min_history=3)).collect()[0]
    assert (t.validation_item_id, t.test_item_id, t.train_length) == ("52", "59", 3)


def test_watch_sequences_drop_short_users(spark):
    log = _watch(spark, [(1, 10, 1.0, 0.4), (1, 11, 2.0, 0.4), (2, 10, 1.0, 0.5)])
    assert build_watch_sequences(log, min_history=3).count() == 0


def test_timestamp_fallback_from_time_column(spark):
    df = spark.createDataFrame([(1, 10, "5", 0.4), (1, 11, "3", 0.5)], "user_id long, item_id long, time string, watch_ratio double")
    out = normalize_matrix_columns(df).orderBy("timestamp").collect()
    assert [r.video_id for r in out] == [11, 10]
    assert [r.timestamp for r in out] == [3.0, 5.0]


def test_derived_watch_ratio_keeps_null_duration(spark):
    df = spark.createDataFrame([(1, 1, 1.0, 4.0, 2.0), (1, 2, 2.0, 4.0, None)], "user_id long, video_id long, timestamp double, play_duration double, video_duration double")
    out = normalize_matrix_columns(df).orderBy("video_id").collect()
    assert out[0].watch_ratio == 2.0 and out[1].watch_ratio is None


def test_content_sequence_skips_negative_events(spark):
    rows = [
        ("c7", "m3", "collect", "2025-03-02 08:00:00", 12.0),
        ("c7", "m9", "skip", "2025-03-02 08:00:05", 1.0),
        ("c7", "m1", "like", "2025-03-02 07:59:00", 4.0),
        ("c7", "m6", "click", "2025-03-02 08:05:00", 2.0),
        ("c7", "m4", "click", "2025-03-02 08:02:00", 9.0),
    ]
    df = spark.createDataFrame(rows, "user_id string, item_id string, event_type string, event_time string, dwell_time double").withColumn(
        "event_time", F.to_timestamp("event_time")
    )
    seq = build_content_sequences(df).orderBy("pos").collect()
    assert [r.item_id for r in seq] == ["m1", "m3", "m4", "m6"]
    assert [r.event_weight for r in seq] == [2.0, 3.0, 1.0, 1.0]
    assert build_content_sequences(df.where("item_id IN ('m1', 'm3')")).count() == 0


def test_hot_user_positions_are_consecutive_across_partitions(spark):
    # one user owns most rows; force many small range partitions
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        n = 3000
        hot = [(1, i % 97, float(i), 0.5) for i in range(n)]
        cold = [(u, 5, 1.0, 0.5) for u in range(2, 50) for _ in range(6)]
        log = _watch(spark, hot + cold)
        seq = build_watch_sequences(log, min_history=3)
        got = seq.where("user_id = '1'").orderBy("pos").select("pos", "n", "ts", "delta").collect()
        assert [r.pos for r in got] == list(range(1, n + 1))
        assert all(r.n == n for r in got)
        assert [r.ts for r in got] == list(range(n))
        assert [r.delta for r in got] == [0] + [1] * (n - 1)
        assert seq.where("user_id <> '1'").groupBy("user_id").agg(F.max("pos").alias("m")).where("m <> 6").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_train_only_view_and_json_round_trip(spark, tmp_path):
    log = _watch(spark, [(4, 71, 5.0, 0.1), (4, 72, 9.0, 0.9), (4, 74, 30.0, 1.2), (4, 73, 11.0, 2.0)])
    seq = build_watch_sequences(log, min_history=2)
    tr = train_only_view(seq).orderBy("pos").collect()
    assert [r.item_id for r in tr] == ["71", "72"] and tr[0].protocol_view == "train_only" and tr[0].n == 2
    path = str(tmp_path / "seq")
    sequence_rows(seq).write.json(path)
    row = json.loads(open(next((tmp_path / "seq").glob("part-*.json"))).readline())
    assert row["item_ids"] == ["71", "72", "73", "74"]
    assert row["train_history_item_ids"] == ["71", "72"]
    assert row["test_history_item_ids"] == ["71", "72", "73"]
    back = sequences_from_rows(spark.read.json(path)).orderBy("pos").collect()
    assert [r.item_id for r in back] == ["71", "72", "73", "74"]
    assert math.isclose(back[2].event_weight, 2.5)
