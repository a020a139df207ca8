"""Model tables derived from the bundled TPC-H-like test tables.

All mappings are plain DataFrame projections/joins over the given tables, so
their work grows with the tables.  See README "Test-data mapping".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rectide.operators.ordering import dealt, global_rank

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def epoch_seconds(col: str) -> F.Column:
    """Seconds since 1970-01-01 of a TIMESTAMP or TIMESTAMP_NTZ column, read
    as wall-clock UTC regardless of the session time zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({col} AS TIMESTAMP_NTZ))")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def watch_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watch log: customer watches part.

    user_id=o_custkey, video_id=l_partkey, timestamp=epoch seconds of
    l_shipdate, play_duration=l_quantity, video_duration=p_size,
    row_ix=l_orderkey*8+l_linenumber (ingest ordinal used as last tie-break).
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    rows = li.count()
    ordered = dealt(li, rows, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return (
        dealt(ordered, rows, "l_partkey")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_custkey").alias("user_id"),
            F.col("l_partkey").alias("video_id"),
            epoch_seconds("l_shipdate").cast("double").alias("timestamp"),
            F.col("l_quantity").cast("double").alias("play_duration"),
            F.col("p_size").cast("double").alias("video_duration"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_ix"),
        )
    )


# Content event mapping of the test `events` table
# view -> click, click -> like, purchase -> collect, anything else -> skip.
EVENT_TYPE_MAP = {"view": "click", "click": "like", "purchase": "collect"}


def content_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    mapped = F.coalesce(
        F.create_map(*[F.lit(x) for kv in EVENT_TYPE_MAP.items() for x in kv])[F.col("event_type")],
        F.lit("skip"),
    )
    return ev.select(
        F.col("user_id").cast("long").alias("user_id"),
        F.get_json_object("props", "$.k").cast("long").alias("item_id"),
        mapped.alias("event_type"),
        F.col("ts").alias("event_time"),
        F.col("value").cast("double").alias("dwell_time"),
        F.col("event_id").alias("row_ix"),
    )


def content_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items for the content path/reranker: one row per part.

    publish_time = first ship date, exposure_count = number of line items,
    quality_score = cents of the retail price / 100 (in [0, 1)).
    """
    part = table(spark, sf_dir, "part")
    li = table(spark, sf_dir, "lineitem")
    stats = li.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.min("l_shipdate").alias("publish_time"),
        F.count(F.lit(1)).cast("int").alias("exposure_count"),
    )
    return part.join(stats, "p_partkey", "left").select(
        F.col("p_partkey").cast("string").alias("item_id"),
        F.col("p_name").alias("title"),
        F.concat_ws(" ", "p_name", "p_type").alias("body"),
        F.col("p_type").alias("topic"),
        F.col("p_brand").alias("author_id"),
        F.col("publish_time"),
        F.round(F.col("p_retailprice") - F.floor("p_retailprice"), 2).alias("quality_score"),
        F.coalesce(F.col("exposure_count"), F.lit(0)).alias("exposure_count"),
    )


def item_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category table: feat = 'type|size-class' per part."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("video_id"),
        F.concat_ws("|", F.lower("p_type"), F.concat(F.lit("size"), (F.col("p_size") % 5).cast("string"))).alias("feat"),
    )


def item_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("video_id"),
        F.col("p_name").alias("caption"),
        F.lower("p_type").alias("category"),
    )


def item_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily item statistics: lineitem grouped by (part, ship date)."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    # the days of an item meet in one task: they are summed, joined and averaged there
    daily = dealt(li, li.count(), "l_partkey").groupBy("l_partkey", F.to_date("l_shipdate").alias("date")).agg(
        F.sum("l_quantity").alias("show_cnt"),
        F.count(F.lit(1)).cast("double").alias("play_cnt"),
        F.sum(F.when(F.col("l_returnflag") == "A", 1).otherwise(0)).cast("double").alias("like_cnt"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("double").alias("comment_cnt"),
        F.sum(F.when(F.col("l_linestatus") == "F", 1).otherwise(0)).cast("double").alias("share_cnt"),
    )
    return daily.join(part, daily.l_partkey == part.p_partkey).select(
        F.col("l_partkey").alias("video_id"),
        F.col("date"),
        F.col("p_brand").alias("author_id"),
        F.col("p_size").cast("double").alias("video_duration"),
        "show_cnt",
        "play_cnt",
        "like_cnt",
        "comment_cnt",
        "share_cnt",
    )


def user_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = table(spark, sf_dir, "customer")
    return cust.select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_mktsegment").alias("user_active_degree"),
        F.col("c_nationkey").alias("nation"),
    )


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("vec_id").cast("string").alias("item_id"),
        F.col("embedding").alias("vector"),
        F.col("label").cast("string").alias("topic"),
    )


def fixed_semantic_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic 3-level semantic id per part.

    level 0 = p_type code (dense order of the type text, 0-based),
    level 1 = brand number - 1 (from 'Brand#N'), level 2 = p_size % 4.
    The type code is the global rank of the type among distinct types.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    codes = global_rank(
        part.select("p_type").distinct(), [F.col("p_type").asc()], "type_rank"
    ).select("p_type", (F.col("type_rank") - 1).cast("int").alias("type_code"))
    brand_code = (F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int") - 1).alias("brand_code")
    sid = part.join(codes, "p_type").select(
        F.col("p_partkey").cast("string").alias("item_id"),
        F.col("p_type").alias("topic"),
        F.array(F.col("type_code"), brand_code, (F.col("p_size") % 4).cast("int")).alias("semantic_id"),
    )
    return sid.select(
        "item_id",
        "topic",
        "semantic_id",
        F.array_join(F.transform("semantic_id", lambda x: x.cast("string")), "-").alias("semantic_id_str"),
    )


def text_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text items for TF-IDF semantic ids: documents (title/body from text)."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("item_id"),
        F.lit("").alias("title"),
        F.col("text").alias("body"),
        F.col("lang").alias("topic"),
        F.col("source").alias("author_id"),
    )
