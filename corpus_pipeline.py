"""Corpus pipeline: quality, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept and, but for the last, returns the columns of documents.  ``run`` writes
every stage as Parquet to the shared checkpoint folder and reads it again.
Stages match decisions to documents by a 128-bit digest of id and text in which
null is unlike any text, so repeated ids with different texts are told apart and
null ids take part.  An empty table passes every stage as an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rectide.llm.budget_mix import budget_mix
from rectide.llm.decontaminate import decontaminate
from rectide.llm.ftrl_quality import with_quality
from rectide.llm.keys import row_key
from rectide.llm.ring_shards import ring_shards
from rectide.llm.simhash_dedup import simhash_dedup
from rectide.session import ensure_checkpoint_dir

MIN_QUALITY = 0.3
SHARDS = 40
#: Copies of a row that are made from one array.
COPIES = 1024


def _free(name: str, df: DataFrame) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name += "_"
    return name


def _keyed(docs: DataFrame, *more: str) -> tuple[DataFrame, str]:
    key = _free("_row_key", docs)
    return docs.withColumn(key, row_key("doc_id", "text", *more)), key


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier scores below ``MIN_QUALITY``.

    Null and empty texts have the score of the bias; repeated rows share a fate.
    """
    score = _free("_quality", docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return with_quality(docs, labels, score).filter(F.col(score) >= MIN_QUALITY).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash component: the smallest id (then row key); null ids last.

    Rows equal in id and text are copies of one another: one of them stays.
    Null, empty and blank texts are one component.
    """
    found = simhash_dedup(docs)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    keep = found.groupBy("root").agg(F.min(order)["row_key"].alias("keep"))
    keyed, key = _keyed(docs)
    kept = keyed.join(keep.select(F.col("keep").alias(key)), key, "left_semi")
    return kept.dropDuplicates([key]).drop(key)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of the benchmark.

    Null and empty texts hold none and stay; repeated rows stay or go together.
    """
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.filter("contaminated").select("row_key").distinct()
    keyed, key = _keyed(docs)
    return keyed.join(bad.withColumnRenamed("row_key", key), key, "left_anti").drop(key)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix of the sources takes it, none for not at all.

    Rows equal in id, text and source are alike to the mix: the copies that it
    takes of them are dealt out evenly, one more to the first of them in the
    order of their digests, whatever their other columns hold.  Null is a source;
    texts without words are not taken.
    """
    taken = budget_mix(docs).groupBy("row_key").agg(F.sum("copies").alias("total"), F.count(F.lit(1)).alias("rows"))
    keyed, key = _keyed(docs, "source")
    whole, held, before, copies, chunk = (_free(c, docs) for c in ("_whole", "_held", "_before", "_copies", "_chunk"))
    equal = keyed.groupBy(*docs.columns, key).agg(F.count(F.lit(1)).alias(held)).withColumn(whole, row_key(*docs.columns))
    order = Window.partitionBy(key).orderBy(whole).rowsBetween(Window.unboundedPreceding, -1)
    named = taken.filter("total > 0").select(F.col("row_key").alias(key), F.struct("total", "rows").alias(copies))
    total, rows = F.col(copies)["total"], F.col(copies)["rows"]
    one_more = F.greatest(F.lit(0), F.least(F.col(before) + F.col(held), total % rows) - F.col(before))
    dealt = (
        equal.withColumn(before, F.coalesce(F.sum(held).over(order), F.lit(0)))
        .join(named, key)
        .withColumn(copies, (F.floor(total / rows) * F.col(held) + one_more).cast("long"))
        .filter(F.col(copies) > 0)
    )
    # in two steps: no array is longer than a part of the copies
    return (
        dealt.withColumn(chunk, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / COPIES))))
        .withColumn(copies, F.least(F.lit(COPIES).cast("long"), F.col(copies) - F.col(chunk) * COPIES))
        .withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
        .select(*docs.columns)
    )


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document of the mix.

    Nulls, empty texts and repeated rows are documents like any other.
    """
    return ring_shards(docs, shards=SHARDS).select("doc_id", "size", "text_crc32", "law", "shard", "slot")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark_free", benchmark_free),
    ("mix", mix),
    ("shard", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; gives the rows of the last."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


#: Training and fingerprints cannot be expressed in SQL.
ORACLE_SQL = None
