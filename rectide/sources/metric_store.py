"""Stored metrics with one row for each (method, segment, metric).

The store is a Parquet table partitioned by method.  ``store_metrics`` merges
rows into it: the newest run of a key wins, keys that a run does not report stay,
and only the partitions of the reported methods are replaced, each as one file.
Storing the same rows again changes nothing, so a job that is run twice or
retried leaves one row a key.  One job at a time may write a method.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from rectide.session import cut_lineage

KEY = ["method", "segment", "metric"]
COLUMNS = ["run_ts", "segment", "metric", "value", "method"]
SCHEMA = "run_ts timestamp, segment string, metric string, value double, method string"


def read_metric_store(spark: SparkSession, path: str) -> DataFrame:
    """(run_ts, segment, metric, value, method); an empty table where nothing is stored yet."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def newest(rows: DataFrame) -> DataFrame:
    """One row a key: of the newest run; of one run's repeated rows the largest value, a number before null."""
    order = Window.partitionBy(*KEY).orderBy(F.col("run_ts").desc(), F.col("value").desc_nulls_last())
    return rows.select(*COLUMNS).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def store_metrics(rows: DataFrame, path: str) -> None:
    """Merge (run_ts, method, segment, metric, value) into the store; a null method or key is an error."""
    spark = rows.sparkSession
    rows = cut_lineage(rows.select(*COLUMNS))
    if not rows.where(" OR ".join(f"{c} IS NULL" for c in [*KEY, "run_ts"])).isEmpty():
        raise ValueError("metric rows need a run, a method, a segment and a metric")
    touched = rows.select("method").distinct()
    held = read_metric_store(spark, path).join(touched, "method", "left_semi").select(*COLUMNS)
    # read before the partitions are replaced
    merged = cut_lineage(newest(held.unionByName(rows)))
    (
        merged.repartition("method").sortWithinPartitions(*KEY)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method").parquet(path)
    )
