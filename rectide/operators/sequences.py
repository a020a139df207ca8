"""Chronological user sequences.

Canonical form is a *long* table, one row per event::

    user_id STRING, pos INT (1-based), n INT (sequence length), item_id STRING,
    action STRING, action_weight DOUBLE, event_weight DOUBLE, ts BIGINT,
    delta BIGINT, split STRING ('train' | 'validation' | 'test')

Leave-one-out: ``pos <= n-2`` train, ``n-1`` validation, ``n`` test.  The
reference's per-user list fields are projections of this table
(``train_history = pos <= n-2``, ``test_history = pos <= n-1`` ...).  Positions
come from ``ordered_positions`` so a user holding a third of the log is still
spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rectide.functions.exprs import action_id
from rectide.operators.behaviors import min_action_weight_filter, positive_events
from rectide.operators.ordering import dealt, ordered_positions
from rectide.operators.quality import SEQUENCE_COLUMNS, require_columns

def split_label() -> F.Column:
    return (
        F.when(F.col("pos") <= F.col("n") - 2, F.lit("train"))
        .when(F.col("pos") == F.col("n") - 1, F.lit("validation"))
        .otherwise(F.lit("test"))
    )


def build_watch_sequences(
    frame: DataFrame,
    min_history: int = 3,
    min_action_weight: float = 0.0,
    tiebreak: tuple[str, ...] = ("row_ix",),
) -> DataFrame:
    """W1-W5 on the watch log: order (user, timestamp, video_id, ingest order)."""
    require_columns(frame, SEQUENCE_COLUMNS, "interactions")
    tiebreak = tuple(c for c in tiebreak if c in frame.columns)
    events = min_action_weight_filter(frame, min_action_weight).select(
        F.col("user_id"),
        F.col("video_id"),
        F.col("timestamp").cast("double").alias("_ts_raw"),
        F.col("timestamp").cast("double").cast("long").alias("ts"),
        F.col("action").cast("string").alias("action"),
        F.col("action_weight").cast("double").alias("action_weight"),
        *[F.col(c) for c in tiebreak],
    )
    order = [F.col("_ts_raw").asc_nulls_last(), F.col("video_id").asc(), *[F.col(c).asc() for c in tiebreak]]
    positioned = ordered_positions(events, "user_id", order, lag_cols=["ts"])
    kept = positioned.where(F.col("n") >= min_history + 2)
    return kept.select(
        F.col("user_id").cast("string").alias("user_id"),
        "pos",
        "n",
        F.col("video_id").cast("string").alias("item_id"),
        "action",
        "action_weight",
        F.col("action_weight").alias("event_weight"),
        "ts",
        F.when(F.col("pos") == 1, F.lit(0).cast("long"))
        .otherwise(F.greatest(F.col("ts") - F.col("prev_ts"), F.lit(0).cast("long")))
        .alias("delta"),
        split_label().alias("split"),
    )


def build_content_sequences(
    interactions: DataFrame, min_events: int = 3, tiebreak: tuple[str, ...] = ("row_ix",)
) -> DataFrame:
    """Content path: positive events ordered (user, event_time, item_id), >= 3 events."""
    tiebreak = tuple(c for c in tiebreak if c in interactions.columns)
    pos_events = positive_events(interactions).select(
        "user_id", "item_id", "event_type", "event_time", "event_weight", *tiebreak
    )
    order = [F.col("event_time").asc_nulls_last(), F.col("item_id").asc(), *[F.col(c).asc() for c in tiebreak]]
    positioned = ordered_positions(pos_events, "user_id", order)
    kept = positioned.where(F.col("n") >= min_events)
    return kept.select(
        F.col("user_id").cast("string").alias("user_id"),
        "pos",
        "n",
        F.col("item_id").cast("string").alias("item_id"),
        F.col("event_type").alias("action"),
        F.col("event_weight").alias("action_weight"),
        "event_weight",
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(event_time AS TIMESTAMP_NTZ))").alias("ts"),
        F.lit(None).cast("long").alias("delta"),
        split_label().alias("split"),
    )


def train_only_view(seq: DataFrame) -> DataFrame:
    """Events with pos <= n-2; ``n`` becomes the train length."""
    return seq.where(F.col("pos") <= F.col("n") - 2).withColumn("n", F.col("n") - 2).withColumn(
        "protocol_view", F.lit("train_only")
    )


def evaluation_histories(seq: DataFrame) -> DataFrame:
    """(user_id, item_id) rows of items[:-1] (duplicates kept)."""
    return seq.where(F.col("pos") <= F.col("n") - 1).select("user_id", "pos", "item_id")


def train_histories(seq: DataFrame) -> DataFrame:
    return seq.where(F.col("pos") <= F.col("n") - 2).select("user_id", "pos", "item_id")


def targets(seq: DataFrame) -> DataFrame:
    """One row per user: test/validation targets, actions, weights, train length."""
    last = seq.where(F.col("pos") >= F.col("n") - 1)
    return last.groupBy("user_id").agg(
        F.max_by("item_id", "pos").alias("test_item_id"),
        F.min_by("item_id", "pos").alias("validation_item_id"),
        F.max_by("action", "pos").alias("test_action"),
        F.min_by("action", "pos").alias("validation_action"),
        F.max_by("action_weight", "pos").alias("test_action_weight"),
        F.min_by("action_weight", "pos").alias("validation_action_weight"),
        (F.first("n") - 2).alias("train_length"),
        F.first("n").alias("sequence_length"),
    )


def sequence_rows(seq: DataFrame) -> DataFrame:
    """Export view (S9 format): one row per user with the list fields.

    Only for writing JSON lines in the reference's layout; no operator reads
    it.  The arrays are as long as the user's history by definition.
    """
    ordered = F.array_sort(
        F.collect_list(F.struct("pos", "item_id", "action", "action_weight", "event_weight", "ts", "delta"))
    )
    events = dealt(seq, seq.count(), "user_id")  # the lists of a task do not grow with the log
    base = events.groupBy("user_id").agg(ordered.alias("ev"), F.first("n").alias("sequence_length"))
    items = F.col("ev.item_id")
    n = F.col("sequence_length")
    return base.select(
        "user_id",
        items.alias("item_ids"),
        F.col("ev.action").alias("actions"),
        F.col("ev.action_weight").alias("action_weights"),
        F.col("ev.event_weight").alias("event_weights"),
        F.col("ev.ts").alias("timestamps"),
        F.col("ev.delta").alias("time_deltas"),
        F.slice(items, 1, F.greatest(n - 2, F.lit(0))).alias("train_history_item_ids"),
        F.slice(items, 1, F.greatest(n - 2, F.lit(0))).alias("validation_history_item_ids"),
        F.slice(items, 1, F.greatest(n - 1, F.lit(0))).alias("test_history_item_ids"),
        F.element_at(items, -2).alias("validation_item_id"),
        F.element_at(items, -1).alias("test_item_id"),
        F.element_at(F.col("ev.action"), -2).alias("validation_action"),
        F.element_at(F.col("ev.action"), -1).alias("test_action"),
        F.element_at(F.col("ev.action_weight"), -2).alias("validation_action_weight"),
        F.element_at(F.col("ev.action_weight"), -1).alias("test_action_weight"),
        n.alias("sequence_length"),
    )


def sequences_from_rows(rows: DataFrame) -> DataFrame:
    """Inverse of ``sequence_rows``: list-form rows (e.g. read from JSON lines)
    back to the long table."""
    cols = set(rows.columns)
    weights = "event_weights" if "event_weights" in cols else ("action_weights" if "action_weights" in cols else None)
    ex = rows.select(
        F.col("user_id").cast("string").alias("user_id"),
        F.posexplode("item_ids").alias("p0", "item_id"),
        *([F.col(weights).alias("_w")] if weights else []),
        *([F.col("actions").alias("_a")] if "actions" in cols else []),
        *([F.col("timestamps").alias("_t")] if "timestamps" in cols else []),
        *([F.col("time_deltas").alias("_d")] if "time_deltas" in cols else []),
        F.size("item_ids").alias("n"),
    )
    at = lambda c: F.try_element_at(F.col(c), F.col("p0") + 1) if c in ex.columns else F.lit(None)
    w = at("_w").cast("double") if weights else F.lit(1.0)
    return ex.select(
        "user_id",
        (F.col("p0") + 1).cast("int").alias("pos"),
        F.col("n").cast("int").alias("n"),
        F.col("item_id").cast("string").alias("item_id"),
        at("_a").cast("string").alias("action"),
        w.alias("action_weight"),
        w.alias("event_weight"),
        at("_t").cast("long").alias("ts"),
        at("_d").cast("long").alias("delta"),
        split_label().alias("split"),
    )


def item_index(seq: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """1..N over the stable order of the union of ids (0 = padding)."""
    from rectide.functions.exprs import stable_id_order
    from rectide.operators.ordering import global_rank

    ids = seq.select("item_id")
    if items is not None:
        ids = ids.unionByName(items.select(F.col("item_id").cast("string")))
    return global_rank(ids.distinct(), stable_id_order("item_id"), "item_index")


def training_examples(seq: DataFrame, item_to_index: DataFrame, max_len: int = 64) -> DataFrame:
    """Last ``max_len`` train items (+ aligned actions/log-gaps) -> target.

    Target = validation item (else test item); users with no train history or
    an unknown target are skipped.  ``time_gap`` is the raw delta (the encoder
    input applies ``log1p``, given as ``log_gap``).  Actions/deltas are aligned by position
    (documented deviation from the single-process builder).
    Output one row per (user, slot) in long form: slot 1..max_len, right padded
    with item 0 / action 0 / gap 0.
    """
    idx = item_to_index.select("item_id", F.col("item_index").cast("long"))
    tgt = (
        seq.where(F.col("pos") == F.col("n") - 1)
        .select("user_id", F.col("item_id").alias("target_item"))
        .join(idx.withColumnRenamed("item_id", "target_item"), "target_item")
        .select("user_id", F.col("item_index").alias("target_index"))
    )
    hist = (
        seq.where((F.col("pos") <= F.col("n") - 2) & (F.col("pos") > F.col("n") - 2 - max_len))
        .select(
            "user_id",
            (F.col("pos") - F.greatest(F.col("n") - 2 - max_len, F.lit(0))).alias("slot"),
            "item_id",
            action_id("action").alias("action_id"),
            F.coalesce(F.col("delta"), F.lit(0)).cast("double").alias("time_gap"),
            F.log1p(F.coalesce(F.col("delta"), F.lit(0)).cast("double")).alias("log_gap"),
        )
        .join(idx, "item_id", "left")
        .select("user_id", "slot", F.coalesce("item_index", F.lit(0).cast("long")).alias("item_index"), "action_id", "time_gap", "log_gap")
    )
    return hist.join(tgt, "user_id")


def padded_examples(examples: DataFrame, max_len: int = 64) -> DataFrame:
    """One row per user with right-padded arrays of length ``max_len``
    (items/actions 0, gaps 0.0).  Each array holds at most ``max_len`` slots by
    construction of ``training_examples``."""
    slots = F.array_sort(F.collect_list(F.struct("slot", "item_index", "action_id", "time_gap")))
    per_user = examples.groupBy("user_id", "target_index").agg(slots.alias("s"))
    pad = lambda c, zero: F.concat(
        F.transform("s", lambda x: x[c]), F.array_repeat(zero, F.lit(max_len) - F.size("s"))
    )
    return per_user.select(
        "user_id",
        pad("item_index", F.lit(0).cast("long")).alias("item_ids"),
        pad("action_id", F.lit(0).cast("int")).alias("action_ids"),
        pad("time_gap", F.lit(0.0)).alias("time_gaps"),
        "target_index",
    )
