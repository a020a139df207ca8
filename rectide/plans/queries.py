"""Registry of named queries: ``name -> (spark, sf_dir) -> DataFrame``.

Every query reads the bundled tables (or tables Spark derives from them) in
full.  Output columns are aliased and typed to match the DuckDB oracle in
``rectide.plans.oracle``: ids as STRING, counters/ranks as BIGINT, real
numbers as DOUBLE rounded to 6 digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rectide.operators import (
    features,
    generative,
    itemcf,
    metrics,
    popular,
    protocol,
    quality,
    rerank,
    semantic_id,
    sequences,
    vector,
)
from rectide.operators.ordering import global_rank
from rectide.operators.rules import rule_report
from rectide.plans.job_queries import JOBS
from rectide.plans.prepare import content_bundle, watch_bundle, watch_items
from rectide.sources import testdata

Query = Callable[[SparkSession, str], DataFrame]
K_EVAL = 20
K_VALUES = (10, 20)


def r6(c) -> F.Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


def _long(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# ---- labelling and sequences ------------------------------------------------

def q_attach_actions(spark, sf):
    log = watch_bundle(spark, sf).log
    return log.select(
        F.col("user_id").cast("string").alias("user_id"),
        F.col("video_id").cast("string").alias("video_id"),
        _long("row_ix").alias("row_ix"),
        r6("watch_ratio").alias("watch_ratio"),
        "action",
        r6("action_weight").alias("action_weight"),
    )


def q_sequence_positions(spark, sf):
    seq = watch_bundle(spark, sf).seq
    return seq.select("user_id", _long("pos").alias("pos"), _long("n").alias("n"), "item_id", "action", r6("action_weight").alias("action_weight"))


def q_time_deltas(spark, sf):
    seq = watch_bundle(spark, sf).seq
    return seq.select("user_id", _long("pos").alias("pos"), _long("ts").alias("ts"), _long("delta").alias("delta"))


def q_sequence_split(spark, sf):
    t = watch_bundle(spark, sf).targets
    return t.select(
        "user_id", "validation_item_id", "test_item_id", "validation_action", "test_action",
        r6("validation_action_weight").alias("validation_action_weight"),
        r6("test_action_weight").alias("test_action_weight"),
        _long("train_length").alias("train_length"), _long("sequence_length").alias("sequence_length"),
    )


def q_train_view(spark, sf):
    tr = watch_bundle(spark, sf).train
    return tr.select("user_id", _long("pos").alias("pos"), _long("n").alias("train_length"), "item_id", r6("event_weight").alias("event_weight"))


def q_candidates(spark, sf):
    c = watch_bundle(spark, sf).candidates
    return c.select("item_id", _long("candidate_pos").alias("candidate_pos"))


# ---- popularity -------------------------------------------------------------

def _pop_scores(b):
    return popular.popularity_from_sequences(b.train)


def _pop_recs(spark, sf):
    b = watch_bundle(spark, sf)
    ranked = popular.rank_catalog(_pop_scores(b), b.candidates)
    return popular.recommend_from_ranking(ranked, b.targets.select("user_id"), b.histories, K_EVAL)


def q_popular_scores(spark, sf):
    return _pop_scores(watch_bundle(spark, sf)).select("item_id", r6("score").alias("score"))


def q_popular_log_scores(spark, sf):
    scores = popular.popularity_from_log(testdata.content_interactions(spark, sf))
    return scores.select("item_id", r6("score").alias("score"))


def q_hit_rate_popular(spark, sf):
    """A22, weighted by the test event."""
    hits = metrics.hit_rate(_pop_recs(spark, sf), watch_bundle(spark, sf).targets, K_EVAL, "test_action_weight")
    return hits.select("user_id", r6("hit").alias("hit"))


def q_popular_topk(spark, sf):
    return _pop_recs(spark, sf).select("user_id", _long("rank").alias("rank"), "item_id", r6("score").alias("score"))


def _items(spark, sf):
    return watch_items(spark, sf)


def _segmented(spark, sf, recs):
    b = watch_bundle(spark, sf)
    out = metrics.segmented_metrics(recs, b.targets, _items(spark, sf), b.candidates.select("item_id"), K_VALUES)
    return out.select("segment", "metric", r6("value").alias("value"))


def q_eval_popular(spark, sf):
    return _segmented(spark, sf, _pop_recs(spark, sf))


# ---- item co-occurrence -----------------------------------------------------

def _cf_fit(spark, sf, packed=False):
    b = watch_bundle(spark, sf)
    return itemcf.fit_itemcf(b.train, 100, 200, packed=packed)


def _cf_recs(spark, sf):
    b = watch_bundle(spark, sf)
    nbrs, pop = _cf_fit(spark, sf, packed=True)
    return itemcf.itemcf_recommendations(nbrs, pop, b.histories, b.candidates, K_EVAL)


def q_itemcf_neighbors(spark, sf):
    nbrs, _ = _cf_fit(spark, sf)
    return nbrs.select("item_id", "neighbor_id", r6("sim").alias("sim"), _long("nrank").alias("nrank"))


def q_itemcf_neighbors_all(spark, sf):
    """No cut of histories or neighbour lists."""
    nbrs, _ = itemcf.fit_itemcf(watch_bundle(spark, sf).train)
    return nbrs.select("item_id", "neighbor_id", r6("sim").alias("sim"), _long("nrank").alias("nrank"))


def q_itemcf_neighbors_top(spark, sf):
    """Whole histories, the 50 best neighbours of each item."""
    nbrs, _ = itemcf.fit_itemcf(watch_bundle(spark, sf).train, None, 50)
    return nbrs.select("item_id", "neighbor_id", r6("sim").alias("sim"), _long("nrank").alias("nrank"))


def _cf_recs_all(spark, sf):
    b = watch_bundle(spark, sf)
    nbrs, pop = itemcf.fit_itemcf(b.train, packed=True)
    return itemcf.itemcf_recommendations(nbrs, pop, b.histories, b.candidates, K_EVAL)


def q_itemcf_topk_all(spark, sf):
    """No cut of histories or neighbour lists."""
    return _cf_recs_all(spark, sf).select("user_id", _long("rank").alias("rank"), "item_id", r6("score").alias("score"))


def q_eval_itemcf_all(spark, sf):
    return _segmented(spark, sf, _cf_recs_all(spark, sf))


def q_itemcf_topk(spark, sf):
    return _cf_recs(spark, sf).select("user_id", _long("rank").alias("rank"), "item_id", r6("score").alias("score"))


def q_eval_itemcf(spark, sf):
    return _segmented(spark, sf, _cf_recs(spark, sf))


# ---- features ---------------------------------------------------------------

def q_item_features(spark, sf):
    it = _items(spark, sf)
    return it.select(
        "item_id", "title", "body", "topic", "author_id", r6("duration").alias("duration"),
        r6("quality_score").alias("quality_score"), r6("hot_score").alias("hot_score"),
        "caption_text", "category_text",
    )


def q_user_features(spark, sf):
    uf = features.build_user_features(testdata.user_profiles(spark, sf), watch_bundle(spark, sf).log, order_col=None)
    return uf.select("user_id", "interaction_count", "activity_bucket", "user_active_degree", _long("nation").alias("nation"))


def q_popularity_buckets(spark, sf):
    pb = metrics.popularity_buckets(_items(spark, sf))
    return pb.select("item_id", r6("hot").alias("hot_score"), "bucket")


# ---- generative (semantic ids) ----------------------------------------------
K_GEN = 10


def _sid_mapping(spark, sf):
    return testdata.fixed_semantic_ids(spark, sf)


def q_sid_transitions(spark, sf):
    tr, _ = generative.fit_transitions(watch_bundle(spark, sf).train, _sid_mapping(spark, sf))
    return tr.select("src", "dst", r6("cnt").alias("cnt"))


def q_sid_global_counts(spark, sf):
    _, gc = generative.fit_transitions(watch_bundle(spark, sf).train, _sid_mapping(spark, sf))
    return gc.select("sid", r6("cnt").alias("cnt"))


def q_sid_decode(spark, sf):
    d = generative.sid_decoder(_sid_mapping(spark, sf))
    return d.select("sid", "item_id", _long("item_pos").alias("item_pos"))


def q_beam_search(spark, sf):
    b = watch_bundle(spark, sf)
    paths, _ = generative.fit_and_generate(b.train, b.histories, _sid_mapping(spark, sf), 5, 3)
    return paths.select("user_id", F.array_join("path", ">").alias("path"), r6("score").alias("score"))


def q_generative_topk(spark, sf):
    b = watch_bundle(spark, sf)
    recs = generative.generative_recommendations(b.train, b.histories, _sid_mapping(spark, sf), K_GEN, 5, 3)
    return recs.select("user_id", _long("rank").alias("rank"), "item_id", "source")


# ---- content path (historical baseline) -------------------------------------
K_CONTENT = (5, 10)


def q_content_sequences(spark, sf):
    seq = content_bundle(spark, sf).seq
    return seq.select("user_id", _long("pos").alias("pos"), _long("n").alias("n"), "item_id", r6("event_weight").alias("event_weight"))


def _content_catalog_topics(spark, sf):
    items = testdata.content_items(spark, sf)
    b = content_bundle(spark, sf)
    catalog = items.select("item_id").unionByName(b.seq.select("item_id")).distinct()
    return catalog, items.select("item_id", "topic")


def _content_popular(spark, sf):
    b = content_bundle(spark, sf)
    ranked = popular.rank_catalog(popular.popularity_from_sequences(b.train), None)
    return popular.recommend_from_ranking(ranked, b.targets.select("user_id"), b.histories, max(K_CONTENT))


def _content_itemcf(spark, sf):
    b = content_bundle(spark, sf)
    nbrs, pop = itemcf.fit_itemcf(b.train, 100, 200, packed=True)
    return itemcf.itemcf_recommendations(nbrs, pop, b.histories, None, max(K_CONTENT))


def _content_metrics(spark, sf, recs):
    b = content_bundle(spark, sf)
    catalog, topics = _content_catalog_topics(spark, sf)
    return metrics.ranking_metrics(recs, b.targets, catalog, topics, K_CONTENT)


def q_ranking_metrics(spark, sf):
    return _content_metrics(spark, sf, _content_popular(spark, sf)).select("metric", r6("value").alias("value"))


def q_coverage_diversity(spark, sf):
    out = _content_metrics(spark, sf, _content_itemcf(spark, sf))
    return out.where(F.col("metric").isin("Coverage", "Diversity")).select("metric", r6("value").alias("value"))


def q_content_itemcf_topk(spark, sf):
    return _content_itemcf(spark, sf).select("user_id", _long("rank").alias("rank"), "item_id", r6("score").alias("score"))


# ---- vectors ------------------------------------------------------------------

def _vector_histories(spark, sf):
    return sequences.evaluation_histories(content_bundle(spark, sf).seq)


def q_cosine_topk(spark, sf):
    nb = vector.item_neighbors(testdata.item_vectors(spark, sf), 10)
    return nb.select("item_id", _long("rank").alias("rank"), "neighbor_id", r6("score").alias("score"))


def q_mean_query_topk(spark, sf):
    recs = vector.vector_recommendations(_vector_histories(spark, sf), testdata.item_vectors(spark, sf), None, 10)
    return recs.select("user_id", _long("rank").alias("rank"), "item_id", r6("score").alias("score"))


def q_mean_query_candidates_topk(spark, sf):
    """Candidates: the items that are the test item of some user."""
    cands = content_bundle(spark, sf).targets.select(F.col("test_item_id").alias("item_id")).distinct()
    recs = vector.vector_recommendations(_vector_histories(spark, sf), testdata.item_vectors(spark, sf), cands, 10)
    return recs.select("user_id", _long("rank").alias("rank"), "item_id", r6("score").alias("score"))


def q_contrastive_loss(spark, sf):
    """A29 on (mean train-history vector, validation-item vector) pairs in
    batches of 32 users (user id order)."""
    seq = content_bundle(spark, sf).seq
    vecs = testdata.item_vectors(spark, sf)
    uvec = vector.mean_vectors(sequences.train_histories(seq), vecs)
    tgt = seq.where(F.col("pos") == F.col("n") - 1).select("user_id", "item_id").join(vecs.select("item_id", "vector"), "item_id")
    pairs = uvec.join(tgt, "user_id")
    ranked = global_rank(pairs, [F.col("user_id").asc()], "urank")
    batched = ranked.select(
        F.floor((F.col("urank") - 1) / 32).alias("batch_id"), F.col("urank").alias("row_id"),
        F.col("qvec").alias("user_vec"), F.col("vector").alias("item_vec"),
    )
    return metrics.info_nce_loss(batched, 0.07).select(r6("loss").alias("loss"))


def _examples(spark, sf):
    b = watch_bundle(spark, sf)
    parts = testdata.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("item_id"))
    return sequences.training_examples(b.seq, sequences.item_index(b.seq, parts), 64)


def q_training_log_gaps(spark, sf):
    return _examples(spark, sf).select("user_id", _long("slot").alias("slot"), r6("log_gap").alias("log_gap"))


def q_padded_examples(spark, sf):
    padded = sequences.padded_examples(_examples(spark, sf), 64)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("long").cast("string")), ",").alias(c)
    return padded.select("user_id", text("item_ids"), text("action_ids"), text("time_gaps"), _long("target_index").alias("target_index"))


def q_training_examples(spark, sf):
    ex = _examples(spark, sf)
    return ex.select("user_id", _long("slot").alias("slot"), _long("item_index").alias("item_index"),
                     _long("action_id").alias("action_id"), r6("time_gap").alias("time_gap"), _long("target_index").alias("target_index"))


# ---- rerank -------------------------------------------------------------------
NOW = "1998-08-01"


def _enriched(spark, sf):
    b = watch_bundle(spark, sf)
    ranked = popular.rank_catalog(_pop_scores(b), b.candidates)
    recs = popular.recommend_from_ranking(ranked, b.targets.select("user_id"), b.histories, 30)
    cands = rerank.reciprocal_rank_candidates(recs)
    return rerank.enrich_candidates(cands, testdata.content_items(spark, sf), NOW, long_tail_exposure_threshold=25, long_tail_quality_threshold=0.85)


def q_freshness_longtail(spark, sf):
    e = _enriched(spark, sf)
    return e.select("user_id", "item_id", _long("rank").alias("rank"), r6("adjusted_score").alias("adjusted_score"),
                    "is_fresh", "is_long_tail")


def q_rerank(spark, sf):
    out = rerank.diversity_rerank(_enriched(spark, sf), 10, 2, 1)
    return out.select("user_id", _long("rerank_pos").alias("rerank_pos"), "item_id", r6("adjusted_score").alias("adjusted_score"), "source_reason")


# ---- semantic id quality ------------------------------------------------------

def q_collision_purity(spark, sf):
    cp = metrics.collision_purity(_sid_mapping(spark, sf))
    return cp.select(*[r6(c).alias(c) for c in cp.columns])


def q_bucket_collision(spark, sf):
    bc = metrics.bucket_collision(_sid_mapping(spark, sf), _items(spark, sf))
    return bc.select(*[r6(c).alias(c) for c in bc.columns])


def q_semantic_ids_kmeans(spark, sf):
    m = semantic_id.kmeans_semantic_ids(testdata.text_items(spark, sf))
    return m.select("item_id", "topic", "semantic_id_str")


def q_semantic_ids_residual(spark, sf):
    m = semantic_id.residual_semantic_ids(testdata.text_items(spark, sf))
    return m.select("item_id", "topic", "semantic_id_str", "tokenizer_method")


def q_word2vec_items(spark, sf):
    emb = semantic_id.item_embeddings(watch_bundle(spark, sf).train, vector_size=32)
    return emb.select("item_id", F.size("vector").cast("long").alias("dim"))


def q_lsh_topk(spark, sf):
    # the form that its SQL states: few candidates, low recall; lsh_probe_topk runs the defaults
    nb = vector.lsh_neighbors(testdata.item_vectors(spark, sf), 10, num_tables=8, bits=8, probes=0)
    return nb.select("item_id", _long("rank").alias("rank"), "neighbor_id", r6("score").alias("score"))


def q_lsh_probe_topk(spark, sf):
    nb = vector.lsh_neighbors(testdata.item_vectors(spark, sf), 10)
    return nb.select("item_id", _long("rank").alias("rank"), "neighbor_id", r6("score").alias("score"))


# ---- protocol and validation --------------------------------------------------

def q_protocol_violations(spark, sf):
    b = watch_bundle(spark, sf)
    manifest = protocol.build_manifest(spark, b.candidates, "sf")
    # long-form checks: no per-user list is ever assembled
    out = protocol.manifest_violations(manifest, b.candidates).unionByName(protocol.long_sequence_violations(b.seq, b.candidates))
    return out.select("rule", _long("violations").alias("violations"))


def q_recommendation_violations(spark, sf):
    b = watch_bundle(spark, sf)
    out = protocol.recommendation_violations(_pop_recs(spark, sf), b.targets.select("user_id"), b.histories, b.candidates, K_EVAL)
    return out.select("rule", _long("violations").alias("violations"))


def q_data_violations(spark, sf):
    items = testdata.content_items(spark, sf)
    inter = testdata.content_interactions(spark, sf).withColumn("item_id", F.col("item_id").cast("string")).withColumn("user_id", F.col("user_id").cast("string"))
    users = testdata.user_profiles(spark, sf).withColumn("user_id", F.col("user_id").cast("string"))
    return rule_report(quality.data_checks(items, users, inter))


REGISTRY: dict[str, Query] = {
    "content_sequences": q_content_sequences,
    "ranking_metrics": q_ranking_metrics,
    "coverage_diversity": q_coverage_diversity,
    "content_itemcf_topk": q_content_itemcf_topk,
    "cosine_topk": q_cosine_topk,
    "mean_query_topk": q_mean_query_topk,
    "contrastive_loss": q_contrastive_loss,
    "training_examples": q_training_examples,
    "training_log_gaps": q_training_log_gaps,
    "padded_examples": q_padded_examples,
    "mean_query_candidates_topk": q_mean_query_candidates_topk,
    "popular_log_scores": q_popular_log_scores,
    "hit_rate_popular": q_hit_rate_popular,
    "itemcf_neighbors_all": q_itemcf_neighbors_all,
    "freshness_longtail": q_freshness_longtail,
    "rerank": q_rerank,
    "collision_purity": q_collision_purity,
    "bucket_collision": q_bucket_collision,
    "semantic_ids_kmeans": q_semantic_ids_kmeans,
    "semantic_ids_residual": q_semantic_ids_residual,
    "word2vec_items": q_word2vec_items,
    "lsh_topk": q_lsh_topk,
    "lsh_probe_topk": q_lsh_probe_topk,
    "protocol_violations": q_protocol_violations,
    "recommendation_violations": q_recommendation_violations,
    "data_violations": q_data_violations,
    "sid_transitions": q_sid_transitions,
    "sid_global_counts": q_sid_global_counts,
    "sid_decode": q_sid_decode,
    "beam_search": q_beam_search,
    "generative_topk": q_generative_topk,
    "attach_actions": q_attach_actions,
    "sequence_positions": q_sequence_positions,
    "time_deltas": q_time_deltas,
    "sequence_split": q_sequence_split,
    "train_view": q_train_view,
    "candidates": q_candidates,
    "popular_scores": q_popular_scores,
    "popular_topk": q_popular_topk,
    "eval_popular": q_eval_popular,
    "itemcf_neighbors": q_itemcf_neighbors,
    "itemcf_topk": q_itemcf_topk,
    "eval_itemcf": q_eval_itemcf,
    "itemcf_neighbors_top": q_itemcf_neighbors_top,
    "itemcf_topk_all": q_itemcf_topk_all,
    "eval_itemcf_all": q_eval_itemcf_all,
    "item_features": q_item_features,
    "user_features": q_user_features,
    "popularity_buckets": q_popularity_buckets,
    **JOBS,
}
