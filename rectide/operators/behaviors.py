"""Behaviour labelling (P3-P7, P1 normalisation)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rectide.functions.exprs import (
    action_from_watch_ratio,
    action_weight,
    positive_event_weight,
)
from rectide.operators.quality import require_columns


def normalize_matrix_columns(frame: DataFrame, row_ix: str | None = None) -> DataFrame:
    """Alias item_id/time/event_time, derive watch_ratio, numeric timestamp.

    Timestamp fallback order: numeric(timestamp) -> numeric(time) ->
    numeric(event_time) -> ingest ordinal ``row_ix``.  When both ``time`` and
    ``event_time`` exist they are coalesced in that order (the single-process
    original would produce two columns named timestamp).
    """
    cols = set(frame.columns)
    out = frame
    if "item_id" in cols and "video_id" not in cols:
        out = out.withColumnRenamed("item_id", "video_id")
    if "watch_ratio" not in cols and {"play_duration", "video_duration"} <= cols:
        duration = F.col("video_duration").try_cast("double")
        out = out.withColumn(
            "watch_ratio",
            F.col("play_duration").try_cast("double")
            / F.when(duration.isNotNull(), F.greatest(duration, F.lit(1e-12))),
        )
    candidates = [c for c in ("timestamp", "time", "event_time") if c in cols]
    numeric = [F.col(c).try_cast("double") for c in candidates]
    if row_ix is not None:
        numeric.append(F.col(row_ix).cast("double"))
    if numeric:
        out = out.withColumn("timestamp", F.coalesce(*numeric) if len(numeric) > 1 else numeric[0])
    return out


def attach_actions(interactions: DataFrame) -> DataFrame:
    """Add ``action`` and ``action_weight`` from ``watch_ratio``."""
    require_columns(interactions, {"watch_ratio"}, "interactions")
    action = action_from_watch_ratio("watch_ratio")
    return interactions.withColumn("action", action).withColumn(
        "action_weight", action_weight(action)
    )


def positive_events(interactions: DataFrame) -> DataFrame:
    """Keep click/like/collect and attach the event weight."""
    weight = positive_event_weight("event_type")
    return interactions.where(weight.isNotNull()).withColumn("event_weight", weight)


def min_action_weight_filter(frame: DataFrame, minimum: float = 0.0) -> DataFrame:
    """Keep rows whose numeric action_weight >= minimum (non-numeric dropped)."""
    return frame.where(F.col("action_weight").try_cast("double") >= F.lit(float(minimum)))


def sample_first_users(frame: DataFrame, max_users: int, order_col: str = "row_ix") -> DataFrame:
    """Keep the first ``max_users`` distinct users in appearance order
    (a sampling operator: the limit is the feature)."""
    if max_users <= 0:
        return frame
    first = frame.groupBy("user_id").agg(F.min(order_col).alias("_first"))
    keep = first.orderBy("_first").limit(max_users).select("user_id")
    return frame.join(keep, "user_id", "left_semi")


def sample_first_rows(frame: DataFrame, max_rows: int, order_col: str = "row_ix") -> DataFrame:
    """Keep the first ``max_rows`` rows in ingest order."""
    if max_rows <= 0:
        return frame
    return frame.orderBy(order_col).limit(max_rows)
