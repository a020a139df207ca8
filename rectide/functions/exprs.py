"""Column expressions shared by the operators.

Everything here builds a ``pyspark.sql.Column`` from built-in functions, so it
stays inside whole-stage code generation (no Python per row).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the reference behaviour exactly.
# Watch-ratio thresholds: < 0.3 short_view, < 1.0 valid_view, < 2.0 complete_view,
# otherwise high_interest.
# Action weights: short_view 0.2, valid_view 1.0, complete_view 1.5, high_interest 2.5.
# Action ids: pad 0, short_view 1, valid_view 2, complete_view 3, high_interest 4.
# Positive content events and weights: click 1.0, like 2.0, collect 3.0.
# Valid content event types: click, like, collect, skip.
# Activity buckets: count < 2 short, < 10 medium, otherwise long.
# ---------------------------------------------------------------------------
ACTION_THRESHOLDS = [(0.3, "short_view"), (1.0, "valid_view"), (2.0, "complete_view")]
ACTION_TOP = "high_interest"
ACTION_WEIGHTS = {
    "short_view": 0.2,
    "valid_view": 1.0,
    "complete_view": 1.5,
    "high_interest": 2.5,
}
ACTION_TO_ID = {
    "pad": 0,
    "short_view": 1,
    "valid_view": 2,
    "complete_view": 3,
    "high_interest": 4,
}
POSITIVE_EVENT_WEIGHTS = {"click": 1.0, "like": 2.0, "collect": 3.0}
VALID_EVENT_TYPES = ("click", "like", "collect", "skip")


def _literal_map(mapping: dict) -> Column:
    items = []
    for key, value in mapping.items():
        items.extend([F.lit(key), F.lit(value)])
    return F.create_map(*items)


def action_from_watch_ratio(ratio: Column | str) -> Column:
    """P3.  NULL and NaN fall through every ``<`` test to ``high_interest``."""
    ratio = F.col(ratio) if isinstance(ratio, str) else ratio
    expr = None
    for threshold, label in ACTION_THRESHOLDS:
        cond = ratio.cast("double") < F.lit(threshold)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(ACTION_TOP)


def action_weight(action: Column | str) -> Column:
    """Weight of an action label (NULL for an unknown label)."""
    action = F.col(action) if isinstance(action, str) else action
    return _literal_map(ACTION_WEIGHTS)[action].cast("double")


def action_id(action: Column | str) -> Column:
    """P5: integer id of an action label, unknown -> 0."""
    action = F.col(action) if isinstance(action, str) else action
    return F.coalesce(_literal_map(ACTION_TO_ID)[action], F.lit(0)).cast("int")


def positive_event_weight(event_type: Column | str) -> Column:
    """Weight of a positive content event (NULL when not positive)."""
    event_type = F.col(event_type) if isinstance(event_type, str) else event_type
    return _literal_map(POSITIVE_EVENT_WEIGHTS)[event_type].cast("double")


def activity_bucket(count: Column | str) -> Column:
    """P14."""
    count = F.col(count) if isinstance(count, str) else count
    return F.when(count < 2, "short").when(count < 10, "medium").otherwise("long")


def has_text(value: Column | str) -> Column:
    """Not NULL/NaN, not blank, not the text 'nan' in any case."""
    value = F.col(value) if isinstance(value, str) else value
    text = value.cast("string")
    # all white space of any script, and the four separator controls; a search ends at the first other character
    return (
        value.isNotNull()
        & text.rlike(r"(?U)[^\s\x1c-\x1f]")
        & ~text.rlike(r"(?U)\A[\s\x1c-\x1f]*[nN][aA][nN][\s\x1c-\x1f]*\z")
    )


def text_or_null(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.when(has_text(value), value.cast("string"))


def join_text(*values: Column | str) -> Column:
    """Space-join the values that carry text."""
    return F.concat_ws(" ", *[text_or_null(v) for v in values])


def first_text(*values: Column | str) -> Column:
    """First value with text, else ''."""
    return F.coalesce(*[text_or_null(v) for v in values], F.lit(""))


def first_token(value: Column | str) -> Column:
    """First token split on '|' or whitespace ('' when there is none)."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.regexp_extract(value, r"[^|\s]+", 0), F.lit(""))


def is_all_digits(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return value.rlike("^[0-9]+$")


def stable_id_order(value: Column | str) -> list[Column]:
    """All-digit ids first by number, then other ids by text."""
    value = F.col(value) if isinstance(value, str) else value
    digits = is_all_digits(value)
    return [
        F.when(digits, F.lit(0)).otherwise(F.lit(1)).asc(),
        F.when(digits, value.cast("decimal(38,0)")).asc_nulls_last(),
        value.asc(),
    ]


def semantic_id_string(values: Column | str) -> Column:
    """ARRAY<INT> -> 'a-b-c'."""
    values = F.col(values) if isinstance(values, str) else values
    return F.array_join(F.transform(values, lambda x: x.cast("string")), "-")


def semantic_id_array(text: Column | str) -> Column:
    """P17: 'a-b-c' -> ARRAY<INT>."""
    text = F.col(text) if isinstance(text, str) else text
    return F.transform(F.split(text, "-"), lambda x: x.cast("int"))


def reciprocal_rank_score(rank_1based: Column | str) -> Column:
    """1/(rank0+1) with a 1-based rank column."""
    rank_1based = F.col(rank_1based) if isinstance(rank_1based, str) else rank_1based
    return F.lit(1.0) / rank_1based.cast("double")


def numeric_or_zero(value: Column | str) -> Column:
    """Numeric value, bad or missing -> 0.0."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def log_gap(delta: Column | str) -> Column:
    """P25: ``log1p`` scaling of a time gap."""
    delta = F.col(delta) if isinstance(delta, str) else delta
    return F.log1p(delta.cast("double"))
