"""Session construction and lineage cutting.

Every job that re-reads an intermediate (global ranking, skew-safe sequence
numbering, iterative beam search) cuts lineage with a *reliable* checkpoint in
the directory the cluster names in ``spark.checkpoint.dir``.  Only when that
setting is absent *and* the master is local (tests, benches) do we create a
scratch directory ourselves; on a cluster a missing setting is an error, never
a silent fallback to machine-local disk.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(
    master: str | None = None,
    app_name: str = "rectide",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, creating a local one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/object store) before running rectide jobs on a cluster"
        )
    local_dir = tempfile.mkdtemp(prefix="rectide-ckpt-")
    sc.setCheckpointDir(local_dir)
    return sc.getCheckpointDir() or local_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with a reliable checkpoint (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet under the checkpoint folder and read from there.

    Cuts lineage as ``cut_lineage`` does, in columns and compressed: a checkpoint
    holds every row as serialised bytes, several times as many.  The write's own
    shuffle files are removed with its end, not when the driver next collects
    its garbage.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes in memory for a byte of Parquet: 1.2 million ids of a dictionary take 168 MB as a broadcast, under 10 MB as a file.
FILE_EXPANSION = 16.0
_EXPANSION = "spark.sql.sources.fileCompressionFactor"


def size_files_as_rows(spark: SparkSession) -> None:
    """Let the broadcast threshold meet the rows that a file holds, not its compressed bytes; a larger factor set before stays.

    A broadcast table is built on the driver, several at a time."""
    if float(spark.conf.get(_EXPANSION, "1.0")) < FILE_EXPANSION:
        spark.conf.set(_EXPANSION, str(FILE_EXPANSION))
