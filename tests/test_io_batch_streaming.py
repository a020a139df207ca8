import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from rectide.plans import batch
from rectide.sources import files


def test_csv_matrix_with_quoted_multiline_and_time_column(spark, tmp_path):
    p = tmp_path / "raw" / "data"
    p.mkdir(parents=True)
    (p / "small_matrix.csv").write_text('user_id,item_id,time,watch_ratio,note\n1,10,5,0.4,"a\nb"\n1,11,3,1.2,x\n')
    (p / "item_categories.csv").write_text("video_id,feat\n10,food|life\n")
    bundle = files.load_raw_bundle(spark, str(tmp_path / "raw"))
    inter = bundle["interactions"].orderBy("timestamp").collect()
    assert [r.video_id for r in inter] == ["11", "10"]
    assert [r.timestamp for r in inter] == [3.0, 5.0]
    assert bundle["item_categories"].count() == 1
    assert bundle["caption_category"].count() == 0 and "video_id" in bundle["caption_category"].columns
    with pytest.raises(ValueError):
        files.load_raw_bundle(spark, str(tmp_path / "raw"), matrix="medium")


def test_resolve_raw_file_recursive_and_optional(spark, tmp_path):
    deep = tmp_path / "x" / "y"
    deep.mkdir(parents=True)
    (deep / "user_features.csv").write_text("user_id\n1\n")
    assert files.resolve_raw_file(spark, str(tmp_path), "user_features.csv").endswith("x/y/user_features.csv")
    assert files.resolve_raw_file(spark, str(tmp_path), "missing.csv", required=False) is None
    with pytest.raises(FileNotFoundError):
        files.resolve_raw_file(spark, str(tmp_path), "missing.csv")


def test_read_items_by_suffix(spark, tmp_path):
    with pytest.raises(ValueError):
        files.read_items(spark, str(tmp_path / "items.json"))
    empty = files.read_items_from_dir(spark, str(tmp_path))
    assert empty.count() == 0 and {"item_id", "topic", "hot_score"} <= set(empty.columns)


def test_metric_upsert_newest_wins(spark):
    t0, t1 = dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 2)
    m1 = spark.createDataFrame([("all", "HR@10", 0.1), ("all", "Coverage", 0.2)], "segment string, metric string, value double")
    m2 = spark.createDataFrame([("all", "HR@10", 0.5)], "segment string, metric string, value double")
    hist = files.metric_rows(m1, "popular", t0).unionByName(files.metric_rows(m2, "popular", t1)).unionByName(
        files.metric_rows(m1, "itemcf", t0)
    )
    panel = {r.method: r for r in files.metric_panel(hist).collect()}
    assert panel["popular"]["HR@10"] == 0.5 and panel["popular"]["Coverage"] == 0.2
    assert panel["popular"]["NDCG@10"] == 0.0
    assert [r.method for r in files.metric_panel(hist).collect()] == ["itemcf", "popular"]


def test_vector_batch_explanations(spark):
    # cosine with 71: 72 0.96, 74 0.8, 73 0
    vecs = spark.createDataFrame(
        [("71", [3.0, 4.0]), ("72", [4.0, 3.0]), ("73", [-4.0, 3.0]), ("74", [0.0, 1.0])], "item_id string, vector array<float>"
    )
    mapping = spark.createDataFrame([("71", "3-0-2"), ("72", "3-1-0"), ("73", "0-0-4"), ("74", "6-2-2")], "item_id string, semantic_id_str string")
    items = spark.createDataFrame([("71", "cars"), ("72", "boats"), ("73", "cars"), ("74", "trains")], "item_id string, topic string")
    req = spark.createDataFrame(
        [("a9", "u7", ["71"], ["complete_view"], 2), ("b4", "u8", [], [], None)],
        "request_id string, user_id string, history_item_ids array<string>, history_actions array<string>, top_k int",
    )
    out = batch.vector_batch(req, vecs, mapping, items).orderBy("request_id", "ann_rank").collect()
    known = [r for r in out if r.request_id == "a9"]
    assert [r.item_id for r in known] == ["72", "74"]
    assert known[0].semantic_id == "3-1-0" and known[0].source == "ann_transformer" and known[0].ann_rank == 1
    assert known[0].reason == "ANN retrieved short-video candidate in topic=boats; recent action context=complete_view."
    empty = [r for r in out if r.request_id == "b4"]
    assert len(empty) == 4 and empty[0].action_context == "unknown"


def test_request_validation(spark):
    req = spark.createDataFrame([("r1", "u1", ["1"], 51)], "request_id string, user_id string, history_item_ids array<string>, top_k int")
    vecs = spark.createDataFrame([("1", [1.0, 0.0])], "item_id string, vector array<float>")
    with pytest.raises(ValueError, match="top_k"):
        batch.vector_batch(req, vecs)


def test_generative_batch_explanations(spark):
    from rectide.operators.sequences import sequences_from_rows

    seq = sequences_from_rows(
        spark.createDataFrame([("u_001", ["i_001", "i_002", "i_005"]), ("u_002", ["i_001", "i_002"])], "user_id string, item_ids array<string>")
    )
    mapping = spark.createDataFrame([("i_001", "0-0-0"), ("i_002", "1-0-0"), ("i_005", "2-0-0")], "item_id string, semantic_id_str string")
    items = spark.createDataFrame(
        [("i_001", "a", "x", "2026-06-01 00:00:00", 0.5, 10), ("i_002", "b", "y", "2026-06-29 00:00:00", 0.5, 10), ("i_005", "c", "z", "2026-01-01 00:00:00", 0.95, 0)],
        "item_id string, topic string, author_id string, publish_time string, quality_score double, exposure_count int",
    ).withColumn("publish_time", F.to_timestamp("publish_time"))
    req = spark.createDataFrame([("r1", "u", ["i_001"], 2)], "request_id string, user_id string, history_item_ids array<string>, top_k int")
    out = batch.generative_batch(req, seq, mapping, items, "2026-06-30T00:00:00", 2, 2).orderBy("position").collect()
    assert [r.item_id for r in out] == ["i_002", "i_005"]
    assert out[0].rerank_reason == "freshness_boost" and out[1].rerank_reason == "long_tail_protection"
    assert out[0].recall_path == [
        "history_items=i_001", "history_semantic_ids=0-0-0", "generated_semantic_ids=1-0-0>2-0-0", "decoded_item=i_002;semantic_id=1-0-0",
    ]
    assert out[0].semantic_id == [1, 0, 0]


def test_popularity_stream(spark, tmp_path):
    from rectide.streaming.popularity import start_popularity

    src = tmp_path / "src"
    spark.createDataFrame([(1, 10, 1.0, 0.2), (2, 10, 2.0, 2.5), (1, 11, 3.0, 0.5)], "user_id long, video_id long, timestamp double, watch_ratio double").write.parquet(str(src))
    q = start_popularity(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    got = {r.item_id: r.score for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"10": pytest.approx(2.7), "11": pytest.approx(1.0)}
