"""What the driver holds: broadcasts by the size of their rows, models without a Python object for each transition."""

import os
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rectide.operators.generative import Adjacency
from rectide.operators.ordering import prefix_join
from rectide.session import size_files_as_rows, stored


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_small_files_of_many_rows_are_not_broadcast(spark):
    before = spark.conf.get("spark.sql.sources.fileCompressionFactor")
    rows = stored(spark.range(1 << 20).select(F.col("id").cast("string").alias("k"), F.lit("same").alias("v")))
    left = stored(spark.range(10).select(F.col("id").cast("string").alias("k")))
    try:
        size_files_as_rows(spark)
        assert float(spark.conf.get("spark.sql.sources.fileCompressionFactor")) >= 16
        # the ten rows may be sent, the million may not
        assert "BuildRight" not in _plan(left.join(rows, "k", "left"))
        assert "BuildRight" in _plan(rows.join(left, "k", "left"))
    finally:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", before)


def test_copies_of_a_ranking_are_not_broadcast(spark):
    ranked = stored(spark.range(1, 1000).select(F.col("id").alias("grank"), F.col("id").cast("string").alias("item")))
    needs = spark.createDataFrame([("a", 3), ("b", 70)], "user string, need int")
    joined = prefix_join(needs, ranked)
    assert "Broadcast" not in _plan(joined)
    assert {r[0]: r[1] for r in joined.groupBy("user").count().collect()} == {"a": 3, "b": 70}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    folder = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    folders = [d.getPath() for d in folder]

    def files():
        return {f for d in folders for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}

    before = files()
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert stored(df).count() == 7
    for _ in range(50):
        if not [f for f in files() - before if f.endswith(".data")]:
            break
        time.sleep(0.1)
    # the count's own shuffle may still be there, the write's is gone
    assert len([f for f in files() - before if f.endswith(".data")]) <= spark.sparkContext.defaultParallelism


def test_adjacency_from_arrow_columns():
    src, dst, cnt = ["b", "a", "a"], ["a", "c", "b"], np.array([1.0, 2.0, 2.0])
    sid, n = ["c", "a"], np.array([1.0, 4.0])
    lists = Adjacency(src, dst, cnt, sid, n)
    arrow = Adjacency(*(pa.chunked_array([pa.array(c[:1]), pa.array(c[1:])]) for c in (src, dst)), cnt, pa.chunked_array([pa.array(sid)]), n)
    assert arrow.sids == lists.sids == ["a", "b", "c"]
    assert arrow.search("b", ["b"], 2, 3) == lists.search("b", ["b"], 2, 3) == (["a", "c"], 3.0)
    assert arrow.dst.dtype == np.int32
