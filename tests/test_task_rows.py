"""What one task sorts or groups does not grow with the rows (session of 4 or 8 shuffle partitions, tasks of few rows)."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rectide.operators import features, ordering, sequences, vector
from rectide.sources import testdata


@pytest.fixture
def few_rows(monkeypatch):
    """Tasks of 20 rows."""
    monkeypatch.setitem(ordering.dealt.__kwdefaults__, "task_rows", 20)


def _most_in_a_task(df):
    return max(df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())


def _watch_tables(spark, folder, items=400):
    """Two line items on each of two days for every item; the third item comes twice in the table of items."""
    day = dt.datetime(1995, 1, 1)
    lines = [(o * 2 + k, o % items, 1, 10.0 + k, "A" if k else "R", "F", day + dt.timedelta(days=o // items)) for o in range(items * 2) for k in range(2)]
    spark.createDataFrame(
        lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    ).write.parquet(f"{folder}/lineitem.parquet")
    parts = [(p, f"name {p}", "Brand#1", "T", 5, 1.5) for p in [*range(items), 2]]
    spark.createDataFrame(
        parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    ).write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(o, o % 40) for o in range(items * 4)], "o_orderkey long, o_custkey long").write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_dealt_tasks_follow_the_rows(spark):
    rows = spark.range(4000)
    assert ordering.dealt(rows, 20, "id", task_rows=20) is rows
    assert _most_in_a_task(ordering.dealt(rows, 4000, "id", task_rows=20)) < 80


def test_item_features_deal_the_days_of_items(spark, tmp_path, few_rows):
    sf = _watch_tables(spark, tmp_path)
    daily = testdata.item_daily(spark, sf)
    assert _most_in_a_task(daily) < 80  # 802 days of items: they were one to eight tasks
    items = features.build_item_features(testdata.item_categories(spark, sf), testdata.item_captions(spark, sf), daily, order_col="date")
    assert _most_in_a_task(items) < 80
    got = {r["item_id"]: r for r in items.collect()}
    assert len(got) == 400
    assert (got["0"]["title"], got["0"]["topic"], got["0"]["author_id"], got["0"]["duration"]) == ("name 0", "t", "Brand#1", 5.0)
    assert got["2"]["title"] == "name 2 name 2"
    assert {r["quality_score"] for r in got.values()} == {1.0 * 4 / 21}


def test_watch_log_and_positions_are_dealt(spark, tmp_path, few_rows):
    log = testdata.watch_matrix(spark, _watch_tables(spark, tmp_path, 100))
    assert _most_in_a_task(log) < 80  # 404 rows: one to eight tasks
    rows = ordering.ordered_positions(log, "user_id", [F.col("timestamp").asc(), F.col("row_ix").asc()], slot_rows=1 << 17)
    assert _most_in_a_task(rows) < 120
    got = rows.collect()
    by_user = {}
    for r in got:
        by_user.setdefault(r["user_id"], []).append(r)
    assert len(got) == 404
    for own in by_user.values():
        own.sort(key=lambda r: (r["timestamp"], r["row_ix"]))
        assert [r["n"] for r in own] == [len(own)] * len(own)
        assert sorted(r["pos"] for r in own) == [*range(1, len(own) + 1)]


def test_hot_keys_and_lists_are_dealt(spark, few_rows, monkeypatch):
    monkeypatch.setattr(ordering, "TASK_ROWS", 20)
    events = spark.createDataFrame([("hot" if k % 2 else f"u{k % 100}", k, f"i{k}") for k in range(1000)], "user_id string, t long, item_id string")
    rows = ordering.ordered_positions(events, "user_id", [F.col("t").asc()], ["t"], slot_rows=100)
    hot = sorted((r for r in rows.collect() if r["user_id"] == "hot"), key=lambda r: r["t"])
    assert [r["pos"] for r in hot] == [*range(1, 501)] and {r["n"] for r in hot} == {500}
    assert [r["prev_t"] for r in hot] == [None, *range(1, 999, 2)]
    seq = rows.selectExpr(
        "user_id", "pos", "n", "item_id", "'a' AS action", "1D AS action_weight", "1D AS event_weight", "t AS ts", "t AS delta"
    )
    lists = sequences.sequence_rows(seq)
    assert _most_in_a_task(lists) < 20  # 51 users
    back = sequences.sequences_from_rows(lists)
    assert sorted(map(tuple, back.select("user_id", "pos", "n", "item_id").collect())) == sorted(
        map(tuple, seq.select("user_id", "pos", "n", "item_id").collect())
    )


def test_mean_vectors_sort_few_vectors_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(vector, "VECTOR_ROWS", 20)
    counted = []
    monkeypatch.setattr(vector, "task_count", lambda *given: counted.append(ordering.task_count(*given)) or counted[-1])
    histories = spark.createDataFrame([(f"u{k % 7}", f"i{k % 10}") for k in range(2000)], "user_id string, item_id string")
    vectors = spark.createDataFrame([(f"i{k}", [float(k), 1.0]) for k in range(10)], "item_id string, vector array<float>")
    got = {r["user_id"]: r["qvec"] for r in vector.mean_vectors(histories, vectors).collect()}
    assert counted == [100]
    for u in range(7):
        own = [k % 10 for k in range(2000) if k % 7 == u]
        assert got[f"u{u}"] == pytest.approx([sum(own) / len(own), 1.0])


def test_cells_are_scored_without_a_loop_over_queries():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[200:250] = x[100:150]  # equal scores: the smaller id goes first
    ids = [f"i{k * 7 % 300}" for k in range(300)]
    vectors = pa.array(list(x), pa.list_(pa.float32()))
    queries = pa.table({"user_id": ids, "qvec": vectors, "keep": pa.array([3 + k % 4 for k in range(300)], pa.int32())})
    got = vector._score_cell(queries, pa.table({"item_id": ids, "vector": vectors})).to_pylist()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    by_query = {}
    for r in got:
        by_query.setdefault(r["user_id"], []).append((round(-r["score"], 9), r["item_id"]))
    for k, q in enumerate(ids):
        best = sorted((round(-float(unit[k] @ unit[j]), 9), ids[j]) for j in range(300))[: 3 + k % 4]
        assert by_query[q] == best
    assert vector._score_cell(queries, pa.table({"item_id": ids, "vector": vectors}).slice(0, 0)).num_rows == 0
