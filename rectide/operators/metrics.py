"""Offline ranking metrics.

Recommendations are a long table ``(user_id, rank, item_id[, score])`` with a
1-based rank.  Every metric is computed in one pass at the largest k; each k
is a conditional aggregate.  Results are long ``(segment, metric, value)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rectide.functions.exprs import activity_bucket
from rectide.operators.ordering import exact_quantiles, with_scalars


def _target_ranks(recs: DataFrame, tgt: DataFrame, max_k: int) -> DataFrame:
    """Per user the 1-based rank of the target within the first max_k (NULL if absent)."""
    hits = (
        recs.where(F.col("rank") <= max_k)
        .join(tgt.select("user_id", F.col("test_item_id").alias("item_id")), ["user_id", "item_id"])
        .groupBy("user_id")
        .agg(F.min("rank").alias("hit_rank"))
    )
    return tgt.join(hits, "user_id", "left")


def _hit_aggs(k_values: Sequence[int], prefix_names: dict[str, str]) -> list:
    aggs = []
    for k in k_values:
        hit = F.when(F.col("hit_rank") <= k, 1.0).otherwise(0.0)
        gain = F.when(F.col("hit_rank") <= k, 1.0 / F.log2(F.col("hit_rank") + 1.0)).otherwise(0.0)
        for name, kind in prefix_names.items():
            aggs.append(F.avg(hit if kind == "hit" else gain).alias(f"{name}@{k}"))
    return aggs


def item_topics(items: DataFrame | None) -> DataFrame | None:
    """Item -> topic ('unknown' when the column is missing)."""
    if items is None or "item_id" not in items.columns:
        return None
    topic = F.col("topic").cast("string") if "topic" in items.columns else F.lit("unknown")
    if "row_ix" in items.columns:
        # a later row of the same item wins (dictionary-update semantics)
        return items.groupBy(F.col("item_id").cast("string").alias("item_id")).agg(F.max_by(topic, F.col("row_ix")).alias("topic"))
    return items.select(F.col("item_id").cast("string").alias("item_id"), topic.alias("topic")).dropDuplicates(["item_id"])


def popularity_buckets(items: DataFrame) -> DataFrame:
    """Head (>= q66) / tail (<= q33) / middle per item; head tested first.
    hot_score NULL/unparseable -> 0.0.  Quantiles are exact (linear)."""
    scored = items.select(
        F.col("item_id").cast("string").alias("item_id"),
        F.coalesce(F.col("hot_score").try_cast("double"), F.lit(0.0)).alias("hot"),
    )
    q = exact_quantiles(scored, "hot", [0.66, 0.33])
    joined = with_scalars(scored, q)
    return joined.select(
        "item_id",
        "hot",
        F.when(F.col("hot") >= F.col("q_0"), "head").when(F.col("hot") <= F.col("q_1"), "tail").otherwise("middle").alias("bucket"),
    )


def segmented_metrics(
    recs: DataFrame,
    tgt: DataFrame,
    items: DataFrame | None,
    catalog: DataFrame | None,
    k_values: Sequence[int] = (10, 20),
) -> DataFrame:
    """A23-A26.  ``tgt``: (user_id, test_item_id, test_action, train_length).

    Segments: all, action=<test action>, activity=<bucket of train length>,
    popularity=<bucket of the target, 'tail' when unknown>.  Coverage =
    distinct recommended (top max_k) ∩ catalog / |catalog|; Diversity = mean
    over users with a non-empty list of distinct topics (unknown counted as a
    topic) / list length.
    """
    max_k = max(k_values) if k_values else 10
    users = tgt.select(
        "user_id",
        "test_item_id",
        F.coalesce(F.col("test_action").cast("string"), F.lit("unknown")).alias("test_action"),
        "train_length",
    )
    if items is not None and "hot_score" in items.columns:
        buckets = popularity_buckets(items).select(F.col("item_id").alias("test_item_id"), "bucket")
        users = users.join(buckets, "test_item_id", "left")
    else:
        users = users.withColumn("bucket", F.lit(None).cast("string"))
    seg = users.select(
        "user_id",
        "test_item_id",
        F.explode(
            F.array(
                F.lit("all"),
                F.concat(F.lit("action="), F.col("test_action")),
                F.concat(F.lit("activity="), activity_bucket("train_length")),
                F.concat(F.lit("popularity="), F.coalesce("bucket", F.lit("tail"))),
            )
        ).alias("segment"),
    )
    top = recs.where(F.col("rank") <= max_k).select("user_id", "rank", "item_id")
    ranked_users = _target_ranks(top, users.select("user_id", "test_item_id"), max_k)

    # per-user diversity: distinct topics / list length
    topics = item_topics(items)
    with_topic = top.join(topics, "item_id", "left") if topics is not None else top.withColumn("topic", F.lit(None).cast("string"))
    per_user_div = with_topic.groupBy("user_id").agg(
        (F.countDistinct(F.coalesce("topic", F.lit("unknown"))) / F.count(F.lit(1))).alias("div")
    )
    per_user = ranked_users.select("user_id", "hit_rank").join(per_user_div, "user_id", "left")
    seg_users = seg.join(per_user, "user_id")
    aggs = _hit_aggs(k_values, {"HR": "hit", "NDCG": "gain", "Recall": "hit"})
    aggs.append(F.coalesce(F.avg("div"), F.lit(0.0)).alias("Diversity"))
    hits = seg_users.groupBy("segment").agg(*aggs)

    # coverage per segment
    if catalog is None:
        if items is not None:
            catalog = items.select(F.col("item_id").cast("string").alias("item_id")).distinct()
        else:
            catalog = top.select("item_id").unionByName(users.select(F.col("test_item_id").alias("item_id"))).distinct()
    catalog = catalog.select("item_id").distinct()
    cat_size = catalog.agg(F.count(F.lit(1)).alias("cat_n"))
    seg_items = (
        seg.select("user_id", "segment")
        .join(top.select("user_id", "item_id"), "user_id")
        .join(catalog, "item_id", "left_semi")
        .groupBy("segment")
        .agg(F.countDistinct("item_id").alias("covered"))
    )
    coverage = with_scalars(hits.select("segment").join(seg_items, "segment", "left"), cat_size).select(
        "segment",
        F.when(F.col("cat_n") > 0, F.coalesce("covered", F.lit(0)) / F.col("cat_n")).otherwise(0.0).alias("Coverage"),
    )
    wide = hits.join(coverage, "segment")
    metric_cols = [c for c in wide.columns if c != "segment"]
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in metric_cols]))
    return wide.select("segment", stacked.alias("m")).select("segment", "m.metric", "m.value")


def ranking_metrics(
    recs: DataFrame,
    tgt: DataFrame,
    catalog: DataFrame,
    topics: DataFrame | None,
    k_values: Sequence[int] = (5, 10),
) -> DataFrame:
    """A17-A21 (content path): Recall/NDCG@k over users with a target, Coverage
    and Diversity at max k.  Diversity counts only known topics; users with an
    empty list are skipped; a list with no known topic scores 0."""
    max_k = max(k_values) if k_values else 10
    top = recs.where(F.col("rank") <= max_k).select("user_id", "rank", "item_id")
    ranked = _target_ranks(top, tgt.select("user_id", "test_item_id"), max_k)
    hits = ranked.agg(*_hit_aggs(k_values, {"Recall": "hit", "NDCG": "gain"}))
    cat = catalog.select("item_id").distinct()
    cov = (
        with_scalars(
            top.select("item_id").distinct().join(cat, "item_id", "left_semi").agg(F.count(F.lit(1)).alias("c")),
            cat.agg(F.count(F.lit(1)).alias("n")),
        )
        .select(F.when(F.col("n") > 0, F.col("c") / F.col("n")).otherwise(0.0).alias("Coverage"))
    )
    known = top.join(topics.select("item_id", "topic"), "item_id", "left") if topics is not None else top.withColumn("topic", F.lit(None).cast("string"))
    div = (
        known.groupBy("user_id")
        .agg((F.countDistinct("topic") / F.count(F.lit(1))).alias("d"))
        .agg(F.coalesce(F.avg("d"), F.lit(0.0)).alias("Diversity"))
    )
    wide = with_scalars(with_scalars(hits, cov), div)
    cols = wide.columns
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("value")) for c in cols]))
    return wide.select(stacked.alias("m")).select("m.metric", "m.value")


def hit_rate(recs: DataFrame, tgt: DataFrame, k: int, weight_col: str | None = None) -> DataFrame:
    """(weighted) hit rate per user at k: weight * [target in top k]."""
    ranked = _target_ranks(recs, tgt, k)
    w = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    return ranked.select("user_id", (w * F.when(F.col("hit_rank").isNotNull(), 1.0).otherwise(0.0)).alias("hit"))


def collision_purity(mapping: DataFrame) -> DataFrame:
    """item_count, semantic_id_unique, collision_rate, topic_purity."""
    per_topic = mapping.groupBy("semantic_id_str", "topic").agg(F.count(F.lit(1)).alias("c"))
    dominant = per_topic.groupBy("semantic_id_str").agg(F.max("c").alias("top"))
    stats = dominant.agg(
        F.coalesce(F.sum("top"), F.lit(0)).alias("dominant"),
        F.count(F.lit(1)).alias("uniq"),
    )
    n = mapping.agg(F.count(F.lit(1)).alias("rows"))
    both = with_scalars(n, stats)
    return both.select(
        F.col("rows").cast("double").alias("item_count"),
        F.col("uniq").cast("double").alias("semantic_id_unique"),
        F.when(F.col("rows") > 0, 1.0 - F.col("uniq") / F.col("rows")).otherwise(0.0).alias("collision_rate"),
        F.when(F.col("rows") > 0, F.col("dominant") / F.col("rows")).otherwise(0.0).alias("topic_purity"),
    )


def bucket_collision(mapping: DataFrame, items: DataFrame) -> DataFrame:
    """Collision rate within hot-score buckets head (>= q66), middle
    (strictly between), tail (<= q33); buckets may overlap.  No hot_score
    column -> zeros."""
    if "hot_score" not in items.columns:
        return mapping.sparkSession.createDataFrame(
            [(0.0, 0.0, 0.0)], "collision_rate_head double, collision_rate_middle double, collision_rate_tail double"
        )
    merged = mapping.select("item_id", "semantic_id_str").join(
        items.select(F.col("item_id").cast("string").alias("item_id"), "hot_score"), "item_id", "left"
    ).select("semantic_id_str", F.coalesce(F.col("hot_score").try_cast("double"), F.lit(0.0)).alias("hot"))
    q = exact_quantiles(merged, "hot", [0.66, 0.33])
    tagged = with_scalars(merged, q)
    conds = {
        "head": F.col("hot") >= F.col("q_0"),
        "middle": (F.col("hot") < F.col("q_0")) & (F.col("hot") > F.col("q_1")),
        "tail": F.col("hot") <= F.col("q_1"),
    }
    flagged = tagged.select(
        "semantic_id_str", *[F.when(c, 1).otherwise(0).alias(b) for b, c in conds.items()]
    )
    per_sid = flagged.groupBy("semantic_id_str").agg(*[F.sum(b).alias(b) for b in conds])
    agg = per_sid.agg(
        *[F.sum(b).alias(f"rows_{b}") for b in conds],
        *[F.sum(F.when(F.col(b) > 0, 1).otherwise(0)).alias(f"uniq_{b}") for b in conds],
    )
    return agg.select(
        *[
            F.when(F.col(f"rows_{b}") > 0, 1.0 - F.col(f"uniq_{b}") / F.col(f"rows_{b}")).otherwise(0.0).alias(f"collision_rate_{b}")
            for b in conds
        ]
    )


def info_nce_loss(pairs: DataFrame, temperature: float = 0.07) -> DataFrame:
    """In-batch contrastive loss, as an evaluation statistic.

    ``pairs``: (batch_id, row_id, user_vec ARRAY<FLOAT>, item_vec ARRAY<FLOAT>).
    loss = mean over rows of logsumexp_j(u_i.v_j / t) - u_i.v_i / t, where j
    ranges over the rows of the same batch (batch size is the caller's bound).
    """
    u = pairs.select("batch_id", F.col("row_id").alias("i"), F.col("user_vec").alias("u"))
    v = pairs.select("batch_id", F.col("row_id").alias("j"), F.col("item_vec").alias("v"))
    dot = F.aggregate(F.zip_with("u", "v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    logits = u.join(v, "batch_id").select("batch_id", "i", "j", (dot / F.lit(temperature)).alias("z"))
    per_row = logits.groupBy("batch_id", "i").agg(
        F.max("z").alias("m"),
        F.max(F.when(F.col("i") == F.col("j"), F.col("z"))).alias("pos"),
        F.collect_list("z").alias("zs"),
    )
    lse = F.col("m") + F.log(F.aggregate("zs", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("m"))))
    return per_row.select((lse - F.col("pos")).alias("row_loss")).agg(F.avg("row_loss").alias("loss"))
