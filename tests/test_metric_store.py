"""Keyed metric store: idempotent, newest run wins, other methods untouched."""

import datetime as dt
import os

import pytest

from rectide.sources import files
from rectide.sources.metric_store import read_metric_store, store_metrics

SCHEMA = "run_ts timestamp, method string, segment string, metric string, value double"


def run(spark, day, method, **values):
    rows = [(dt.datetime(2026, 5, day), method, s, m.replace("_", "@"), v) for m, v in values.items() for s in ("all", "action=like")]
    return spark.createDataFrame(rows, SCHEMA)


def stored(spark, path):
    return sorted((r.method, r.segment, r.metric, r.value, r.run_ts.day) for r in read_metric_store(spark, path).collect())


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    assert read_metric_store(spark, path).collect() == []
    store_metrics(run(spark, 3, "a", HR_10=0.5, Coverage=0.25), path)
    store_metrics(run(spark, 3, "b/c d", HR_10=0.125), path)
    first = stored(spark, path)
    store_metrics(run(spark, 3, "a", HR_10=0.5, Coverage=0.25), path)  # a rerun
    assert stored(spark, path) == first
    store_metrics(run(spark, 1, "a", HR_10=0.875, NDCG_10=0.0625), path)  # older: only the key that is new
    store_metrics(run(spark, 4, "a", Coverage=0.75), path)
    got = {(m, k): (v, day) for m, s, k, v, day in stored(spark, path) if s == "all"}
    assert got == {("a", "HR@10"): (0.5, 3), ("a", "Coverage"): (0.75, 4), ("a", "NDCG@10"): (0.0625, 1), ("b/c d", "HR@10"): (0.125, 3)}
    parts = [f for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")]
    assert len(parts) == 2  # one file for each method
    panel = {r.method: r for r in files.metric_panel(read_metric_store(spark, path)).collect()}
    assert panel["a"]["Coverage"] == 0.75 and panel["b/c d"]["Coverage"] == 0.0


def test_repeated_and_null_rows(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = run(spark, 2, "a", HR_10=0.5)
    store_metrics(rows.unionByName(rows).unionByName(run(spark, 2, "a", HR_10=None)), path)
    assert [r[3] for r in stored(spark, path)] == [0.5, 0.5]
    before = stored(spark, path)
    with pytest.raises(ValueError):
        store_metrics(rows.selectExpr("run_ts", "method", "cast(null as string) segment", "metric", "value"), path)
    store_metrics(rows.limit(0), path)
    assert stored(spark, path) == before
