"""Popularity retrieval.

Ranking unseen candidates per user is a full sort of the catalog in the
single-process original.  Here the catalog is ranked once (``global_rank``);
a user's top-k unseen items lie within the first ``k + |history ∩ catalog|``
ranks, so each user joins only that prefix (``prefix_join``), drops history
with an anti join and keeps ``row_number() <= k``.  Exact, and linear in
users x (k + history).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rectide.functions.exprs import stable_id_order
from rectide.operators.ordering import global_rank, prefix_join, top_k_per_group


def candidate_universe(interactions: DataFrame, item_col: str = "video_id") -> DataFrame:
    """U4: distinct interaction items as text, with the stable id order as rank."""
    ids = interactions.select(F.col(item_col).cast("string").alias("item_id")).distinct()
    return global_rank(ids, stable_id_order("item_id"), "candidate_pos")


def popularity_from_sequences(seq: DataFrame) -> DataFrame:
    """A8 sequence form: sum of event weights (1.0 when absent) per item."""
    w = F.col("event_weight") if "event_weight" in seq.columns else F.lit(1.0)
    return seq.groupBy("item_id").agg(exact_weight_sum(w).alias("score"))


def exact_weight_sum(w) -> F.Column:
    """Sum of weights in DECIMAL(38,6), so ties do not depend on addition order
    (the weights are short decimals such as 0.2 or 1.5)."""
    return F.sum(w.cast("decimal(38,6)")).cast("double")


def popularity_from_log(log: DataFrame) -> DataFrame:
    """A8 log form: item_id else video_id; action_weight when present, else
    the content event weights (non-positive events contribute nothing)."""
    from rectide.functions.exprs import positive_event_weight

    item = "item_id" if "item_id" in log.columns else "video_id"
    if "action_weight" in log.columns:
        w = F.col("action_weight").cast("double")
    else:
        w = positive_event_weight(F.coalesce(F.col("event_type").cast("string"), F.lit("")))
    rows = log.where(F.col(item).isNotNull() & w.isNotNull())
    return rows.groupBy(F.col(item).cast("string").alias("item_id")).agg(exact_weight_sum(w).alias("score"))


def rank_catalog(scores: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(item_id, score, grank) over the candidate universe (zero-score candidates
    kept) or, without candidates, over the scored items; order (-score, id)."""
    if candidates is not None:
        scored = candidates.select("item_id").join(scores, "item_id", "left").select(
            "item_id", F.coalesce(F.col("score"), F.lit(0.0)).alias("score")
        )
    else:
        scored = scores.select("item_id", "score")
    return global_rank(scored, [F.col("score").desc(), F.col("item_id").asc()], "grank")


def recommend_from_ranking(
    ranked: DataFrame,
    users: DataFrame,
    exclusions: DataFrame,
    k: int,
    block: int = 64,
) -> DataFrame:
    """Top-k of ``ranked`` (item_id, score, grank) per user, skipping the
    user's ``exclusions``.

    ``users``: (user_id); ``exclusions``: (user_id, item_id) (any duplicates).
    Output: (user_id, rank, item_id, score), rank 1-based.
    """
    if "score" not in ranked.columns:
        ranked = ranked.withColumn("score", F.lit(None).cast("double"))
    excl = exclusions.select("user_id", "item_id").distinct()
    in_catalog = excl.join(ranked.select("item_id"), "item_id", "left_semi")
    n_excl = in_catalog.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_excl"))
    needs = users.select("user_id").distinct().join(n_excl, "user_id", "left").select(
        "user_id", (F.lit(k) + F.coalesce(F.col("n_excl"), F.lit(0))).alias("need")
    )
    window = prefix_join(needs, ranked.select("item_id", "score", "grank"), block=block)
    unseen = window.join(excl, ["user_id", "item_id"], "left_anti")
    top = top_k_per_group(unseen, ["user_id"], [F.col("grank").asc()], k)
    return top.select("user_id", F.col("rank").cast("int").alias("rank"), "item_id", "score")


def popular_recommendations(
    train_seq: DataFrame,
    histories: DataFrame,
    candidates: DataFrame | None,
    k: int = 20,
) -> DataFrame:
    """Fit on ``train_seq``, rank candidates (or scored items) minus history."""
    ranked = rank_catalog(popularity_from_sequences(train_seq), candidates)
    users = histories.select("user_id").distinct()
    return recommend_from_ranking(ranked, users, histories, k)
