"""Registered queries of the jobs around the operators: sources and sinks read
back, checks over tables that break their rules, batch services, item factors.

Round trips write the given tables to a new folder under the shared checkpoint
folder and return what is read from there.  The tables that break rules are
derived from the given ones, so every rule has something to find.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rectide.functions.exprs import first_token, has_text
from rectide.operators import behaviors, generative, protocol, quality, rerank, semantic_id, sequences
from rectide.operators.rules import observed, observed_counts, rule_report, violating_rows
from rectide.plans import batch, evaluate, tokenizer
from rectide.plans.prepare import content_bundle, run_counters, watch_bundle, watch_items
from rectide.session import ensure_checkpoint_dir
from rectide.sources import files, testdata
from rectide.sources.metric_store import read_metric_store, store_metrics


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/roundtrip-{uuid.uuid4().hex}"


# ---- sources and sinks ----------------------------------------------------------

def q_csv_bundle(spark, sf):
    """The watch log as CSV, read as a raw bundle."""
    root = _folder(spark)
    log = testdata.watch_matrix(spark, sf).select(
        "user_id", F.col("video_id").alias("item_id"), F.col("timestamp").alias("time"), "play_duration", "video_duration"
    )
    files.write_table(log, f"{root}/data/{files.RAW_FILES['small']}", "csv")
    read = files.load_raw_bundle(spark, root, multi_line=())["interactions"]
    return read.select(
        F.col("user_id").cast("string").alias("user_id"),
        F.col("video_id").cast("string").alias("video_id"),
        F.col("timestamp").cast("double").alias("timestamp"),
        F.round(F.col("watch_ratio").cast("double"), 6).alias("watch_ratio"),
    )


def q_csv_captions(spark, sf):
    """Captions with line breaks and quotes, and a category table."""
    root = _folder(spark)
    part = testdata.table(spark, sf, "part")
    captions = part.select(
        F.col("p_partkey").alias("item_id"), F.concat("p_name", F.lit('\n"'), "p_type", F.lit('", '), "p_brand").alias("caption")
    )
    captions.write.option("header", True).option("escape", '"').csv(f"{root}/{files.RAW_FILES['caption_category']}")
    files.write_table(testdata.watch_matrix(spark, sf), f"{root}/{files.RAW_FILES['big']}", "csv")
    files.write_table(testdata.item_categories(spark, sf), f"{root}/{files.RAW_FILES['item_categories']}", "csv")
    read = files.load_raw_bundle(spark, root, "big", multi_line=["caption_category"])
    return read["caption_category"].join(read["item_categories"], "video_id").select(
        F.col("video_id").cast("string").alias("video_id"), "caption", "feat"
    )


def q_items_read(spark, sf):
    """The first item table of a folder."""
    root = _folder(spark)
    files.write_table(testdata.content_items(spark, sf), f"{root}/item_features.parquet")
    read = files.read_items_from_dir(spark, root)
    return read.select("item_id", "topic", "author_id", F.round("quality_score", 6).alias("quality_score"))


def q_sequence_json(spark, sf):
    """Sequences as JSON lines and back to the long table."""
    path = f"{_folder(spark)}/sequences"
    files.write_sequences(sequences.sequence_rows(watch_bundle(spark, sf).seq), path)
    seq = sequences.sequences_from_rows(files.read_sequences(spark, path))
    return seq.select(
        "user_id", F.col("pos").cast("long").alias("pos"), F.col("n").cast("long").alias("n"), "item_id", "action",
        F.round("event_weight", 6).alias("event_weight"),
    )


def q_manifest_read(spark, sf):
    """Manifest and candidates."""
    root = _folder(spark)
    cands = watch_bundle(spark, sf).candidates
    protocol.write_manifest(protocol.build_manifest(spark, cands, "sf"), cands, root)
    manifest, read = protocol.read_manifest(spark, root)
    stats = read.agg(F.count(F.lit(1)).alias("candidates"), F.sum("candidate_pos").cast("long").alias("pos_sum"))
    return stats.join(F.broadcast(manifest)).select(  # one row each
        "protocol_name", "ranking_mode", F.col("candidate_count").cast("long").alias("candidate_count"), "candidates", "pos_sum"
    )


def q_vectors_read(spark, sf):
    """S12."""
    path = f"{_folder(spark)}/vectors"
    files.write_vectors(testdata.item_vectors(spark, sf), path)
    return files.read_vectors(spark, path).select(
        "item_id", F.posexplode("vector").alias("d", "x")
    ).select("item_id", F.col("d").cast("long").alias("d"), F.round(F.col("x").cast("double"), 6).alias("x"))


def _saved_retriever(spark, sf) -> dict:
    b = watch_bundle(spark, sf)
    mapping = testdata.fixed_semantic_ids(spark, sf)
    transitions, global_counts = generative.fit_transitions(b.train, mapping)
    path = f"{_folder(spark)}/retriever"
    files.save_retriever(mapping, transitions, global_counts, path, 5, 3)
    return files.load_retriever(spark, path)


def q_retriever_read(spark, sf):
    """S13."""
    model = _saved_retriever(spark, sf)
    return model["transitions"].select("src", "dst", F.round("cnt", 6).alias("cnt"))


def q_metric_history(spark, sf):
    """Two runs appended, the newer one read."""
    from rectide.plans.queries import q_ranking_metrics

    path = f"{_folder(spark)}/metrics"
    now = q_ranking_metrics(spark, sf)
    old = now.withColumn("value", F.col("value") / 2)
    files.append_metrics(files.metric_rows(now, "popular", dt.datetime(2026, 2, 1)), path)
    files.append_metrics(files.metric_rows(old, "popular", dt.datetime(2026, 1, 1)), path)
    latest = files.latest_metrics(spark.read.parquet(path))
    return latest.select(F.col("method").cast("string").alias("method"), "segment", "metric", F.round("value", 6).alias("value"))


def _stored(spark, path):
    return read_metric_store(spark, path).select("method", "segment", "metric", F.round("value", 6).alias("value"))


def q_evaluation_store(spark, sf):
    """Both co-occurrence and popularity evaluated and stored, popularity twice and once as an older run."""
    b, items, path = watch_bundle(spark, sf), watch_items(spark, sf), f"{_folder(spark)}/metrics"
    evaluate.store_watch_evaluation(["popular", "itemcf"], b, items, path, dt.datetime(2026, 2, 1))
    evaluate.store_watch_evaluation(["popular"], b, items, path, dt.datetime(2026, 2, 2))
    older = _stored(spark, path).withColumn("value", -F.col("value"))
    store_metrics(older.withColumn("run_ts", F.lit(dt.datetime(2026, 1, 1))), path)
    return _stored(spark, path)


def q_content_evaluation_store(spark, sf):
    """M14, S14, S15 on the content path."""
    b, path = content_bundle(spark, sf), f"{_folder(spark)}/metrics"
    items = testdata.content_items(spark, sf)
    for day in (1, 2):
        evaluate.store_content_evaluation(["popular"], b, items, path, dt.datetime(2026, 2, day))
    return _stored(spark, path)


def q_run_counters(spark, sf):
    """A28."""
    b = watch_bundle(spark, sf)
    return run_counters(b.log, b.seq, b.candidates, testdata.content_items(spark, sf), testdata.user_profiles(spark, sf))


# ---- checks that find something --------------------------------------------------

def _broken_tables(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items, users and interactions that break every rule."""
    part = testdata.table(spark, sf, "part")
    size = F.col("p_size")
    items = part.select(
        F.col("p_partkey").cast("string").alias("item_id"), F.col("p_name").alias("title"), F.col("p_type").alias("body"),
        F.col("p_type").alias("topic"), F.col("p_brand").alias("author_id"),
        F.when(size == 7, F.col("p_name")).otherwise(F.concat(F.lit("1998-01-"), F.lpad((size % 28 + 1).cast("string"), 2, "0"))).alias("publish_time"),
        F.when(size == 11, F.col("p_brand")).when(size == 13, "1.5").otherwise("0.5").alias("quality_score"),
    )
    items = items.unionByName(items.join(part.where(size == 17).select(F.col("p_partkey").cast("string").alias("item_id")), "item_id"))
    users = testdata.user_profiles(spark, sf).withColumn("user_id", F.col("user_id").cast("string"))
    users = users.unionByName(users.where("nation = 3"))
    events = testdata.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("user_id"),
        (F.get_json_object("props", "$.k").cast("long") * 40).cast("string").alias("item_id"),
        "event_type",
        F.when(F.col("event_type") == "view", F.col("props")).otherwise("1998-01-01 00:00:00").alias("event_time"),
        F.when(F.col("event_type") == "click", F.col("event_type")).otherwise((F.col("value") - 20).cast("string")).alias("dwell_time"),
    )
    return items, users, events


def q_broken_data_violations(spark, sf):
    """V2-V9 over items, users and interactions that break every rule: one scan a table."""
    items, users, events = _broken_tables(spark, sf)
    return rule_report(quality.data_checks(items, users, events, contracts=True)).where("violations > 0")


def q_observed_violations(spark, sf):
    """V3, V4, V7, V8 counted by the write of the interactions and of the items itself, no scan of their own."""
    items, _, events = _broken_tables(spark, sf)
    root, counts = _folder(spark), {}
    for name, df, rules in (
        ("items", items, [*quality.item_rules(items), quality.quality_range_rule()]),
        ("interactions", events, quality.interaction_rules(events)),
    ):
        watched, observation = observed(df, rules)
        files.write_table(watched, f"{root}/{name}.parquet")
        counts |= observed_counts(observation, rules)
    return spark.createDataFrame(list(counts.items()), "rule string, violations long")  # a row a rule


def q_violators(spark, sf):
    """V2-V9 on demand: keys and details of what breaks a rule."""
    items, users, events = _broken_tables(spark, sf)
    found = violating_rows(quality.data_checks(items, users, events, contracts=True))
    # a number as decimal text
    negative = F.col("rule") == "interactions.negative_dwell_time"
    return found.select("rule", "key", F.when(negative, F.col("detail").try_cast("decimal(18,6)").cast("string")).otherwise(F.col("detail")).alias("detail"))


def q_broken_protocol_violations(spark, sf):
    """One manifest a nation, and list-form sequences with leaks and short lists."""
    b = watch_bundle(spark, sf)
    cands = b.candidates.select("item_id").unionByName(b.candidates.where("candidate_pos <= 5").select("item_id"))
    key, region = F.col("n_nationkey"), F.col("n_regionkey")
    good = protocol.REQUIRED_FIELDS
    manifests = testdata.table(spark, sf, "nation").select(
        (F.lit(1) + (region == 0).cast("int")).alias("schema_version"),
        F.when(region == 1, F.col("n_name")).otherwise(protocol.SEQUENTIAL_NEXT_ITEM).alias("protocol_name"),
        F.when(region == 2, F.col("n_name")).otherwise("full_sort").alias("ranking_mode"),
        key.cast("int").alias("candidate_count"),
        F.when(region == 3, F.col("n_name")).otherwise(good["fit_history_field"]).alias("fit_history_field"),
        F.when(region == 4, F.col("n_name")).otherwise(good["history_field"]).alias("history_field"),
        F.when(key == 3, F.col("n_name")).otherwise(good["target_field"]).alias("target_field"),
    )
    n = F.col("sequence_length")
    rows = sequences.sequence_rows(b.seq)
    rows = rows.unionByName(rows.where(n % 8 == 0))
    rows = rows.select(
        F.when(n % 9 == 0, "").otherwise(F.col("user_id")).alias("user_id"),
        "item_ids",
        F.when(n % 3 == 0, F.col("test_history_item_ids")).otherwise(F.col("train_history_item_ids")).alias("train_history_item_ids"),
        F.when(n % 4 == 0, F.col("train_history_item_ids")).otherwise(F.col("test_history_item_ids")).alias("test_history_item_ids"),
        F.when(n % 6 == 0, F.element_at("item_ids", 1)).otherwise(F.col("validation_item_id")).alias("validation_item_id"),
        F.when(n % 10 == 0, "").when(n % 7 == 0, F.concat(F.lit("gone"), "test_item_id")).otherwise(F.col("test_item_id")).alias("test_item_id"),
        F.when(n % 5 == 0, F.slice("actions", 1, 1)).otherwise(F.col("actions")).alias("actions"),
    )
    out = protocol.manifest_violations(manifests, cands).unionByName(protocol.sequence_violations(rows, b.candidates))
    return out.select("rule", F.col("violations").cast("long").alias("violations"))


def q_vector_violations(spark, sf):
    """Parts without a vector, and vectors of two lengths."""
    vecs = testdata.item_vectors(spark, sf)
    ragged = vecs.withColumn("vector", F.when(F.col("topic") == "0", F.slice("vector", 1, 3)).otherwise(F.col("vector")))
    parts = testdata.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("item_id"))
    return quality.missing_vectors(parts, vecs).unionByName(quality.vector_shape_violations(ragged))


# ---- small operators on their own ------------------------------------------------

def q_unseen_interactions(spark, sf):
    """Interactions with items that the user has not collected."""
    log = testdata.content_interactions(spark, sf)
    kept = rerank.filter_seen(log, log.where("event_type = 'collect'"))
    return kept.select(F.col("row_ix").cast("long").alias("row_ix"), F.col("user_id").cast("long").alias("user_id"), "item_id", "event_type")


def q_first_tokens(spark, sf):
    """The first token of every text, and whether it has any text."""
    docs = testdata.table(spark, sf, "documents")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), first_token("text").alias("token"), F.coalesce(has_text("text"), F.lit(False)).alias("has_text"))


def q_sampled_log(spark, sf):
    """The first 100 users of the watch log and their first 1,000 rows (a sampling operator)."""
    log = testdata.watch_matrix(spark, sf)
    kept = behaviors.sample_first_rows(behaviors.sample_first_users(log, 100), 1000)
    return kept.select(F.col("row_ix").cast("long").alias("row_ix"), F.col("user_id").cast("long").alias("user_id"), F.col("video_id").cast("long").alias("video_id"))


# ---- tokenizers on item vectors ----------------------------------------------------

def _tokenizer(spark, sf, method, beam, days=(1,)) -> str:
    """The folder of a tokenizer fitted on the item vectors, written anew each day."""
    root, vectors = _folder(spark), testdata.item_vectors(spark, sf)
    for day in days:
        tokenizer.train_tokenizer(spark, vectors, root, method, (8, 8), 3, 3, 42, beam, run_ts=dt.datetime(2026, 2, day))
    return root


def _codes(mapping):
    return mapping.select("item_id", "topic", "semantic_id_str", F.round("error", 6).alias("error"))


def _figures(spark, root):
    stored = _stored(spark, f"{root}/metrics")
    return stored.select(F.col("method").cast("string").alias("method"), "metric", "value")


def q_tokenizer_kmeans(spark, sf):
    """M2, M5: levels fitted independently, three starts and three rounds; the mapping as written."""
    return _codes(spark.read.parquet(f"{_tokenizer(spark, sf, 'kmeans', 1)}/mapping"))


def q_tokenizer_residual(spark, sf):
    """M3, M4, M5: residual levels, nearest code at each; the vectors encoded again by the saved codebooks."""
    return _codes(tokenizer.encode_items(spark, testdata.item_vectors(spark, sf), _tokenizer(spark, sf, "residual", 1), 1))


def q_tokenizer_beam(spark, sf):
    """M3, M4: the same codebooks, four residual paths kept."""
    return _codes(spark.read.parquet(f"{_tokenizer(spark, sf, 'residual', 4)}/mapping"))


def q_tokenizer_quality(spark, sf):
    """The stored figures of both tokenizers, one of them run twice."""
    return _figures(spark, _tokenizer(spark, sf, "kmeans", 1, (1, 2))).unionByName(_figures(spark, _tokenizer(spark, sf, "residual", 4)))


# ---- batch services ---------------------------------------------------------------

def _requests(spark, sf, item) -> DataFrame:
    """One request a customer: its orders as history (``item`` gives the id, not
    always a known one); no orders, no history."""
    orders = testdata.table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.array_sort(F.collect_list(F.struct("o_orderkey", item.cast("string").alias("id"))))["id"].alias("history_item_ids")
    )
    cust = testdata.table(spark, sf, "customer")
    nation = F.col("c_nationkey")
    return cust.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.concat(F.lit("r"), "c_custkey").alias("request_id"),
        F.col("c_custkey").cast("string").alias("user_id"),
        "history_item_ids",
        F.array("c_mktsegment").alias("history_actions"),
        F.when(nation != 7, nation + 1).alias("top_k"),
    )


def q_request_violations(spark, sf):
    """``top_k`` from below 1 to above 50."""
    req = _requests(spark, sf, F.col("o_orderkey")).withColumn("top_k", (F.col("top_k") - 2) * 3)
    return quality.request_violations(req)


def q_batch_vector(spark, sf):
    """M13, P20-P22."""
    req = _requests(spark, sf, F.col("o_orderkey") % 1000)
    items = testdata.item_vectors(spark, sf)
    out = batch.vector_batch(req, items, testdata.fixed_semantic_ids(spark, sf), items.select("item_id", "topic"))
    return out.withColumn("ann_rank", F.col("ann_rank").cast("long"))


def q_batch_generative(spark, sf):
    """M12 with a retriever written and read again."""
    req = _requests(spark, sf, F.col("o_orderkey") % 4000)
    out = batch.generative_batch(
        req, None, testdata.fixed_semantic_ids(spark, sf), testdata.content_items(spark, sf), "1998-08-01",
        model=_saved_retriever(spark, sf),
    )
    return out.withColumn("position", F.col("position").cast("long"))


def q_item_factors(spark, sf):
    """Item vectors from the train views, all of their values."""
    return semantic_id.item_factors(watch_bundle(spark, sf).train, vector_size=32)


def q_tfidf_weights(spark, sf):
    """M1, P16 without stop words."""
    out = semantic_id.tfidf_weights(testdata.text_items(spark, sf), stop_words=[])
    return out.withColumn("weight", F.round("weight", 6))


def q_tfidf_weights_all(spark, sf):
    """M1, P16 on every term, without stop words."""
    out = semantic_id.tfidf_weights_long(testdata.text_items(spark, sf), stop_words=[])
    return out.withColumn("weight", F.round("weight", 6))


JOBS = {
    "tfidf_weights_all": q_tfidf_weights_all,
    "tfidf_weights": q_tfidf_weights,
    "csv_bundle_read": q_csv_bundle,
    "csv_captions_read": q_csv_captions,
    "items_read": q_items_read,
    "sequence_json_read": q_sequence_json,
    "manifest_read": q_manifest_read,
    "vectors_read": q_vectors_read,
    "retriever_read": q_retriever_read,
    "metric_history": q_metric_history,
    "evaluation_store": q_evaluation_store,
    "content_evaluation_store": q_content_evaluation_store,
    "run_counters": q_run_counters,
    "broken_data_violations": q_broken_data_violations,
    "observed_violations": q_observed_violations,
    "violators": q_violators,
    "broken_protocol_violations": q_broken_protocol_violations,
    "vector_violations": q_vector_violations,
    "request_violations": q_request_violations,
    "batch_vector": q_batch_vector,
    "batch_generative": q_batch_generative,
    "item_factors": q_item_factors,
    "unseen_interactions": q_unseen_interactions,
    "first_tokens": q_first_tokens,
    "sampled_log": q_sampled_log,
    "tokenizer_kmeans": q_tokenizer_kmeans,
    "tokenizer_residual": q_tokenizer_residual,
    "tokenizer_beam": q_tokenizer_beam,
    "tokenizer_quality": q_tokenizer_quality,
}
