"""Job that fits a tokenizer on item vectors and keeps what it made.

Under ``out_dir``: ``codebooks`` (the fitted table), ``mapping`` (a code for each
item) and ``metrics`` (the keyed metric store with the quality figures).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rectide.operators import codebooks, metrics
from rectide.sources.files import metric_rows, write_table
from rectide.sources.metric_store import store_metrics


def quality_rows(mapping: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """A12-A14, with an ``items`` table A15 too, and the mean error: (metric, value)."""
    wide = [metrics.collision_purity(mapping), mapping.agg(F.avg("error").alias("mean_error"))]
    if items is not None:
        wide.append(metrics.bucket_collision(mapping, items))
    out = None
    for table in wide:
        pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in table.columns]
        part = table.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
        out = part if out is None else out.unionByName(part)
    return out


def train_tokenizer(
    spark: SparkSession,
    vectors: DataFrame,
    out_dir: str,
    method: str = "residual",
    sizes: tuple[int, ...] = (32, 32, 32),
    starts: int = 10,
    rounds: int = 20,
    seed: int = 42,
    beam: int = 4,
    items: DataFrame | None = None,
    run_ts: dt.datetime | None = None,
) -> DataFrame:
    """Fit on (item_id, topic, vector), write codebooks, mapping and figures; returns the mapping as written."""
    if method not in ("residual", "kmeans"):
        raise ValueError(f"unsupported tokenizer method: {method}")
    root = out_dir.rstrip("/")
    fitted = codebooks.fit_codebooks(vectors, list(sizes), starts, rounds, seed, residual=method == "residual")
    write_table(fitted, f"{root}/codebooks")
    mapping = encode_items(spark, vectors, root, beam)
    write_table(mapping, f"{root}/mapping")
    written = spark.read.parquet(f"{root}/mapping")
    coded = written.where(F.col("semantic_id").isNotNull())
    store_metrics(metric_rows(quality_rows(coded, items), f"tokenizer_{method}", run_ts), f"{root}/metrics")
    return written


def encode_items(spark: SparkSession, vectors: DataFrame, out_dir: str, beam: int = 4) -> DataFrame:
    """Codes by the codebooks that a job left in ``out_dir``, also for items that came later."""
    stored = spark.read.schema(codebooks.CODEBOOK_SCHEMA).parquet(f"{out_dir.rstrip('/')}/codebooks")
    return codebooks.encode(vectors, stored, beam)
