"""Method dispatch and evaluation drivers.

``recommend_watch`` fits a method on the train-only view and ranks the full
candidate universe for every evaluation user (history = all but the test
event); ``evaluate_watch`` checks the protocol (V10-V12) and returns the
segmented metric table.  ``evaluate_content`` is the historical content path:
fit on whole sequences, history = train part, Recall/NDCG@5,10.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rectide.operators import generative, itemcf, metrics, popular, protocol, rerank, vector
from rectide.plans.prepare import Bundle
from rectide.session import stored
from rectide.sources.files import metric_rows
from rectide.sources.metric_store import store_metrics

WATCH_METHODS = ("popular", "itemcf", "ann")
#: Histories and neighbour lists of the co-occurrence method (arguments of ``fit_itemcf``).
ITEMCF_CUTS = (100, 200)
CONTENT_METHODS = ("popular", "itemcf", "generative", "generative_rerank")


def recommend_watch(method: str, b: Bundle, k: int = 20, vectors: DataFrame | None = None) -> DataFrame:
    users = b.targets.select("user_id")
    if method == "popular":
        ranked = popular.rank_catalog(popular.popularity_from_sequences(b.train), b.candidates)
        return popular.recommend_from_ranking(ranked, users, b.histories, k)
    if method == "itemcf":
        nbrs, pop = itemcf.fit_itemcf(b.train, *ITEMCF_CUTS, packed=True)
        return itemcf.itemcf_recommendations(nbrs, pop, b.histories, b.candidates, k)
    if method in ("ann", "ann_transformer", "vector"):
        if vectors is None:
            raise ValueError("vector retrieval needs an item vector table")
        from rectide.operators.quality import assert_valid, missing_vectors

        assert_valid(missing_vectors(b.candidates, vectors))
        return vector.vector_recommendations(b.histories, vectors, b.candidates, k)
    raise ValueError(f"unsupported method: {method}")


def evaluate_watch(
    method: str,
    b: Bundle,
    items: DataFrame | None,
    k_values=(10, 20),
    vectors: DataFrame | None = None,
    check_protocol: bool = True,
) -> DataFrame:
    k = max(k_values)
    recs = stored(recommend_watch(method, b, k, vectors))  # read by the checks and the metrics
    if check_protocol:
        protocol.assert_clean(protocol.long_sequence_violations(b.seq, b.candidates))
        protocol.assert_clean(
            protocol.recommendation_violations(recs, b.targets.select("user_id"), b.histories, b.candidates, k)
        )
    return metrics.segmented_metrics(recs, b.targets, items, b.candidates.select("item_id"), k_values)


def store_watch_evaluation(
    methods: Sequence[str],
    b: Bundle,
    items: DataFrame | None,
    path: str,
    run_ts: dt.datetime | None = None,
    k_values=(10, 20),
    vectors: DataFrame | None = None,
) -> None:
    """Evaluate the methods one after the other and merge their metrics into the store at ``path``."""
    for method in methods:
        store_metrics(metric_rows(evaluate_watch(method, b, items, k_values, vectors), method, run_ts), path)


def store_content_evaluation(
    methods: Sequence[str],
    b: Bundle,
    items: DataFrame,
    path: str,
    run_ts: dt.datetime | None = None,
    k_values=(5, 10),
    mapping: DataFrame | None = None,
    now: str | None = None,
) -> None:
    """As ``store_watch_evaluation`` on the content path."""
    for method in methods:
        store_metrics(metric_rows(evaluate_content(method, b, items, k_values, mapping, now), method, run_ts), path)


def recommend_content(
    method: str,
    b: Bundle,
    k: int = 10,
    mapping: DataFrame | None = None,
    items: DataFrame | None = None,
    now: str | None = None,
) -> DataFrame:
    users = b.targets.select("user_id")
    if method == "popular":
        ranked = popular.rank_catalog(popular.popularity_from_sequences(b.train), None)
        return popular.recommend_from_ranking(ranked, users, b.histories, k)
    if method == "itemcf":
        nbrs, pop = itemcf.fit_itemcf(b.train, *ITEMCF_CUTS, packed=True)
        return itemcf.itemcf_recommendations(nbrs, pop, b.histories, None, k)
    if method in ("generative", "generative_rerank"):
        if mapping is None:
            raise ValueError("generative retrieval needs a semantic id mapping")
        fetch = k * 3 if method == "generative_rerank" else k
        recs = generative.generative_recommendations(b.train, b.histories, mapping, fetch)
        if method == "generative":
            return recs.select("user_id", "rank", "item_id", F.lit(None).cast("double").alias("score"))
        if items is None or now is None:
            raise ValueError("generative_rerank needs items and an explicit now")
        cands = rerank.reciprocal_rank_candidates(recs)
        out = rerank.diversity_rerank(rerank.enrich_candidates(cands, items, now), k)
        return out.select("user_id", F.col("rerank_pos").alias("rank"), "item_id", F.col("adjusted_score").alias("score"))
    raise ValueError(f"unsupported method: {method}")


def evaluate_content(
    method: str,
    b: Bundle,
    items: DataFrame,
    k_values=(5, 10),
    mapping: DataFrame | None = None,
    now: str | None = None,
) -> DataFrame:
    recs = recommend_content(method, b, max(k_values), mapping, items, now)
    catalog = items.select(F.col("item_id").cast("string")).unionByName(b.seq.select("item_id")).distinct()
    topics = items.select(F.col("item_id").cast("string"), F.col("topic").cast("string"))
    return metrics.ranking_metrics(recs, b.targets, catalog, topics, k_values)
