"""File sources and sinks.

Readers never infer types: CSV columns arrive as text and are typed by the
normalisation operators with ``try_cast`` (bad values become NULL instead of
failing the job).  An ingest ordinal ``row_ix`` is attached at load so
order-dependent rules (first row per key, ordered text concatenation,
timestamp fallback) have an explicit order.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rectide.operators.behaviors import normalize_matrix_columns
from rectide.operators.quality import MATRIX_COLUMNS, require_columns

# Raw file names of the public short-video dataset bundle and
# the required columns of each optional table.
RAW_FILES = {
    "small": "small_matrix.csv",
    "big": "big_matrix.csv",
    "user_features": "user_features.csv",
    "item_daily_features": "item_daily_features.csv",
    "item_categories": "item_categories.csv",
    "caption_category": "kuairec_caption_category.csv",
}
OPTIONAL_REQUIRED = {
    "item_categories": {"video_id"},
    "caption_category": {"video_id"},
    "item_daily_features": {"video_id"},
    "user_features": {"user_id"},
}
VENDOR_SUBDIR = "KuaiRec 2.0/data"


# ---- filesystem helpers (driver-side metadata only) --------------------------

def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def resolve_raw_file(spark: SparkSession, raw_dir: str, filename: str, required: bool = True) -> str | None:
    """Root, root/data, vendor sub-folder, then the first sorted recursive match."""
    root = raw_dir.rstrip("/")
    for cand in (f"{root}/{filename}", f"{root}/data/{filename}", f"{root}/{VENDOR_SUBDIR}/{filename}"):
        if path_exists(spark, cand):
            return cand
    matches = []
    if path_exists(spark, root):
        fs, p = _fs(spark, root)
        it = fs.listFiles(p, True)
        while it.hasNext():
            st = it.next()
            if st.getPath().getName() == filename:
                matches.append(st.getPath().toString())
    if matches:
        return sorted(matches)[0]
    if required:
        raise FileNotFoundError(f"raw file not found: {filename} under {raw_dir}")
    return None


# ---- readers -------------------------------------------------------------------

def read_csv(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = True) -> DataFrame:
    """Tolerant CSV scan (header, quoted fields, PERMISSIVE mode; malformed
    rows keep their text in ``_corrupt_record`` when a schema is given).
    ``multi_line`` allows line breaks inside quotes, and makes each file one task;
    without it a large file is read by many."""
    reader = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
    )
    if schema:
        reader = reader.schema(schema + ", _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record")
    return with_ingest_order(reader.csv(path))


def with_ingest_order(df: DataFrame) -> DataFrame:
    """Attach ``row_ix``: increasing in file/partition order (unique, not dense)."""
    return df if "row_ix" in df.columns else df.withColumn("row_ix", F.monotonically_increasing_id())


def read_matrix(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """S1 + P1 normalisation + required columns."""
    frame = normalize_matrix_columns(read_csv(spark, path, multi_line=multi_line), row_ix="row_ix")
    require_columns(frame, MATRIX_COLUMNS, "matrix")
    return frame


def read_optional_csv(
    spark: SparkSession, path: str | None, required_columns: Iterable[str], multi_line: bool = True
) -> DataFrame:
    """S3: a missing file gives an empty table with the required columns."""
    required = sorted(set(required_columns))
    if path is None or not path_exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in required))
    frame = read_csv(spark, path, multi_line=multi_line)
    if "item_id" in frame.columns and "video_id" not in frame.columns:
        frame = frame.withColumnRenamed("item_id", "video_id")
    require_columns(frame, set(required), path.rsplit("/", 1)[-1])
    return frame


def load_raw_bundle(
    spark: SparkSession, raw_dir: str, matrix: str = "small", multi_line: Iterable[str] | None = None
) -> dict[str, DataFrame]:
    """The five raw tables, lazily defined.  ``multi_line`` names the tables
    that may hold line breaks inside quotes (default: all; see ``read_csv``)."""
    name = matrix.lower()
    if name not in ("small", "big"):
        raise ValueError("matrix must be 'small' or 'big'")
    broken = {"interactions", *OPTIONAL_REQUIRED} if multi_line is None else set(multi_line)
    out = {"interactions": read_matrix(spark, resolve_raw_file(spark, raw_dir, RAW_FILES[name]), "interactions" in broken)}
    for key, req in OPTIONAL_REQUIRED.items():
        path = resolve_raw_file(spark, raw_dir, RAW_FILES[key], required=False)
        out[key] = read_optional_csv(spark, path, req, multi_line=key in broken)
    return out


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items by suffix (parquet/csv), else an error."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        return read_csv(spark, path)
    raise ValueError(f"unsupported item file type: {path}")


def read_items_from_dir(spark: SparkSession, data_dir: str, names=("items.parquet", "item_features.parquet")) -> DataFrame:
    """First existing item table, else an empty typed table."""
    for name in names:
        path = f"{data_dir.rstrip('/')}/{name}"
        if path_exists(spark, path):
            return read_items(spark, path)
    return spark.createDataFrame([], "item_id string, topic string, hot_score double")


SEQUENCE_SCHEMA = (
    "user_id string, item_ids array<string>, actions array<string>, action_weights array<double>, "
    "event_weights array<double>, timestamps array<long>, time_deltas array<long>, "
    "train_history_item_ids array<string>, validation_history_item_ids array<string>, "
    "test_history_item_ids array<string>, validation_item_id string, test_item_id string, "
    "validation_action string, test_action string, validation_action_weight double, "
    "test_action_weight double, sequence_length int"
)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines sequences with an explicit schema (blank lines skipped)."""
    return spark.read.schema(SEQUENCE_SCHEMA).json(path)


def write_sequences(rows: DataFrame, path: str) -> None:
    """JSON-lines sink of list-form sequence rows."""
    rows.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Table sink (Parquet by default, CSV with header)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


# ---- model artefacts -------------------------------------------------------------

def write_vectors(vectors: DataFrame, path: str) -> None:
    """(item_id STRING, vector ARRAY<FLOAT>) Parquet."""
    vectors.select(F.col("item_id").cast("string"), F.col("vector").cast("array<float>")).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("item_id").cast("string"), F.col("vector").cast("array<float>"))


def save_retriever(mapping: DataFrame, transitions: DataFrame, global_counts: DataFrame, path: str, beam_width: int, max_steps: int) -> None:
    """Generative retriever = three Parquet tables + one params row."""
    spark = mapping.sparkSession
    mapping.write.mode("overwrite").parquet(f"{path}/mapping")
    transitions.write.mode("overwrite").parquet(f"{path}/transitions")
    global_counts.write.mode("overwrite").parquet(f"{path}/global_counts")
    spark.createDataFrame([(beam_width, max_steps)], "beam_width int, max_steps int").coalesce(1).write.mode("overwrite").json(f"{path}/params")


def load_retriever(spark: SparkSession, path: str) -> dict:
    params = spark.read.schema("beam_width int, max_steps int").json(f"{path}/params").first()
    return {
        "mapping": spark.read.parquet(f"{path}/mapping"),
        "transitions": spark.read.parquet(f"{path}/transitions"),
        "global_counts": spark.read.parquet(f"{path}/global_counts"),
        "beam_width": int(params["beam_width"]),
        "max_steps": int(params["max_steps"]),
    }


# ---- metric tables (S14, S15) ----------------------------------------------------

METRIC_SCHEMA = "run_ts timestamp, method string, segment string, metric string, value double"


def metric_rows(metrics: DataFrame, method: str, run_ts: dt.datetime | None = None) -> DataFrame:
    """Long metric rows of one run: (run_ts, method, segment, metric, value);
    a metrics table without ``segment`` is stored under segment 'all'."""
    seg = F.col("segment") if "segment" in metrics.columns else F.lit("all")
    ts = run_ts or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    return metrics.select(
        F.lit(ts).cast("timestamp").alias("run_ts"), F.lit(method).alias("method"), seg.alias("segment"),
        F.col("metric"), F.col("value").cast("double"),
    )


def append_metrics(rows: DataFrame, path: str) -> None:
    """S14 sink: append a run to the metric table (partitioned by method)."""
    rows.write.mode("append").partitionBy("method").parquet(path)


def latest_metrics(history: DataFrame) -> DataFrame:
    """S15 keyed upsert: newest row per (method, segment, metric) wins."""
    w = Window.partitionBy("method", "segment", "metric").orderBy(F.col("run_ts").desc())
    return history.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


# Metrics of the summary panel and of the content baseline table.
PANEL_METRICS = ["HR@10", "NDCG@10", "Recall@20", "Coverage", "Diversity"]
BASELINE_METRICS = ["Recall@5", "Recall@10", "NDCG@5", "NDCG@10", "Coverage", "Diversity"]


def metric_panel(history: DataFrame, metrics: list[str] = PANEL_METRICS, segment: str = "all") -> DataFrame:
    """S15 panel: one row per method (sorted), absent metrics read as 0.0."""
    latest = latest_metrics(history).where(F.col("segment") == segment)
    wide = latest.groupBy("method").pivot("metric", metrics).agg(F.first("value"))
    return wide.select("method", *[F.coalesce(F.col(f"`{m}`"), F.lit(0.0)).alias(m) for m in metrics]).orderBy("method")
