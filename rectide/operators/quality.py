"""Validation operators.

Schema checks (V1) are driver-side metadata checks and run no job.  The rules of
a table are lists for ``rules.rule_report`` (counts of all rules in one scan),
``rules.violating_rows`` (the violators) and ``rules.observed`` (counts by the
job's own write).  ``validate_*`` return a *violations* DataFrame with columns
``(rule, key, detail)``; ``assert_valid`` raises when it has any row,
``require_clean`` counts first and looks for violators only if there are some.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rectide.functions.exprs import VALID_EVENT_TYPES
from rectide.operators.rules import KNOWN, REPEATED, ROWS, UNKNOWN, VALUES, Check, Rule, rule_report, violating_rows

# Required column sets of the reference data contract.
ITEM_COLUMNS = {"item_id", "title", "body", "topic", "author_id", "publish_time", "quality_score"}
USER_COLUMNS = {"user_id"}
INTERACTION_COLUMNS = {"user_id", "item_id", "event_type", "event_time", "dwell_time"}
MATRIX_COLUMNS = {"user_id", "video_id", "timestamp", "watch_ratio"}
SEQUENCE_COLUMNS = {"user_id", "video_id", "timestamp", "action", "action_weight"}

VIOLATION_SCHEMA = "rule string, key string, detail string"


class ValidationError(ValueError):
    pass


def require_columns(df: DataFrame, required: set[str], label: str) -> None:
    """V1 (schema only, no Spark job)."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValidationError(f"{label} missing columns: {missing}")


def _violations(df: DataFrame, rule: str, key, detail) -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule"),
        key.cast("string").alias("key"),
        detail.cast("string").alias("detail"),
    )


def union_violations(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def duplicate_rule(column: str, label: str) -> Rule:
    """V2: keys occurring more than once (NULLs group together, as in pandas)."""
    return Rule(f"{label}.duplicate_{column}", REPEATED, F.col(column))


def _bad_timestamp(df: DataFrame, column: str) -> Column:
    if dict(df.dtypes)[column] in ("timestamp", "timestamp_ntz", "date"):
        return F.lit(False)
    return F.col(column).isNotNull() & F.try_to_timestamp(F.col(column).cast("string")).isNull()


def timestamp_rule(df: DataFrame, column: str, label: str) -> Rule:
    """V3: present values that do not parse as a timestamp."""
    return Rule(f"{label}.invalid_{column}", ROWS, F.col(column), _bad_timestamp(df, column))


def number_rule(column: str, label: str) -> Rule:
    """V4: present values that do not parse as a number."""
    raw = F.col(column)
    return Rule(f"{label}.invalid_{column}", ROWS, raw, raw.isNotNull() & raw.try_cast("double").isNull())


def item_rules(items: DataFrame) -> list[Rule]:
    """V5."""
    require_columns(items, ITEM_COLUMNS, "items")
    return [duplicate_rule("item_id", "items"), timestamp_rule(items, "publish_time", "items"), number_rule("quality_score", "items")]


def user_rules(users: DataFrame) -> list[Rule]:
    """V6."""
    require_columns(users, USER_COLUMNS, "users")
    return [duplicate_rule("user_id", "users")]


def interaction_rules(interactions: DataFrame) -> list[Rule]:
    """V7: event-type domain (NULL ignored), parseable time/dwell, dwell >= 0."""
    require_columns(interactions, INTERACTION_COLUMNS, "interactions")
    et = F.col("event_type")
    return [
        Rule("interactions.invalid_event_type", VALUES, et, et.isNotNull() & ~et.isin(*VALID_EVENT_TYPES)),
        timestamp_rule(interactions, "event_time", "interactions"),
        number_rule("dwell_time", "interactions"),
        Rule(
            "interactions.negative_dwell_time", ROWS, F.col("user_id"),
            F.col("dwell_time").try_cast("double") < 0, F.col("dwell_time"),
        ),
    ]


def quality_range_rule() -> Rule:
    """V8, items: quality in [0, 1]."""
    q = F.col("quality_score").try_cast("double")
    return Rule("items.quality_out_of_range", ROWS, F.col("item_id"), (q < 0) | (q > 1), F.col("quality_score"))


def profile_rules(users: DataFrame) -> list[Rule]:
    """V8, users: the optional profile fields may be absent or NULL; a present sign-up time must parse.
    A segment is free text, so no value of it breaks a rule."""
    return [timestamp_rule(users, "signup_time", "users")] if "signup_time" in users.columns else []


def referential_checks(interactions: DataFrame, items: DataFrame, users: DataFrame) -> list[Check]:
    """V9: interactions pointing at unknown items/users."""
    item, user = "interactions.unknown_item", "interactions.unknown_user"
    return [
        (interactions, [Rule(item, UNKNOWN, F.col("item_id")), Rule(user, UNKNOWN, F.col("user_id"))]),
        (items, [Rule(item, KNOWN, F.col("item_id"))]),
        (users, [Rule(user, KNOWN, F.col("user_id"))]),
    ]


def data_checks(items: DataFrame, users: DataFrame, interactions: DataFrame, contracts: bool = False) -> list[Check]:
    """V2-V7 and V9 of the three tables, with ``contracts`` V8 too: one scan a table in ``rule_report``."""
    extra = [quality_range_rule()] if contracts else []
    own = {0: interaction_rules(interactions), 1: item_rules(items) + extra, 2: user_rules(users)}
    if contracts:
        own[2] = own[2] + profile_rules(users)
    return [(df, own[i] + rules) for i, (df, rules) in enumerate(referential_checks(interactions, items, users))]


def validate_items(items: DataFrame) -> DataFrame:
    """V5."""
    return violating_rows([(items, item_rules(items))])


def validate_users(users: DataFrame) -> DataFrame:
    """V6."""
    return violating_rows([(users, user_rules(users))])


def validate_interactions(interactions: DataFrame) -> DataFrame:
    """V7."""
    return violating_rows([(interactions, interaction_rules(interactions))])


def row_contract_violations(
    items: DataFrame | None = None, interactions: DataFrame | None = None, users: DataFrame | None = None
) -> DataFrame:
    """V8: declared row contracts (quality in [0,1], dwell >= 0, event literal, profile fields)."""
    checks = []
    if items is not None:
        checks.append((items, [quality_range_rule()]))
    if interactions is not None:
        checks.append((interactions, interaction_rules(interactions)))
    if users is not None and profile_rules(users):
        checks.append((users, profile_rules(users)))
    if not checks:
        raise ValueError("no table with a row contract")
    return violating_rows(checks)


def referential_violations(interactions: DataFrame, items: DataFrame, users: DataFrame) -> DataFrame:
    """V9: interactions pointing at unknown items/users."""
    return violating_rows(referential_checks(interactions, items, users))


def missing_vectors(candidates: DataFrame, vectors: DataFrame) -> DataFrame:
    """Every candidate must have a vector."""
    miss = candidates.select("item_id").join(vectors.select("item_id"), "item_id", "left_anti")
    return _violations(miss, "vectors.missing_candidate", F.col("item_id"), F.col("item_id"))


def vector_shape_violations(vectors: DataFrame) -> DataFrame:
    """All vectors share one length; reports every length when several occur."""
    sizes = vectors.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("cnt"))
    # one row per distinct length: this window is tiny by construction
    ragged = sizes.withColumn("ndims", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))).where("ndims > 1")
    return _violations(ragged, "vectors.ragged_dimension", F.col("dim"), F.col("cnt"))


def request_violations(requests: DataFrame) -> DataFrame:
    """1 <= top_k <= 50 on a request table (NULL top_k means the default 10)."""
    k = F.coalesce(F.col("top_k"), F.lit(10))
    bad = requests.where((k < 1) | (k > 50))
    return _violations(bad, "request.top_k_out_of_range", F.col("request_id"), k)


def require_non_empty(df: DataFrame, label: str) -> None:
    """V17."""
    if df.isEmpty():
        raise ValidationError(f"{label} must not be empty")


def assert_valid(violations: DataFrame, max_examples: int = 5) -> None:
    examples = violations.limit(max_examples).collect()
    if examples:
        shown = "; ".join(f"{r['rule']}[{r['key']}]={r['detail']}" for r in examples)
        raise ValidationError(f"validation failed: {shown}")


def require_clean(checks: list[Check], max_examples: int = 5) -> None:
    """Raise with a few violators if any rule has violations; clean tables are scanned once."""
    if not rule_report(checks).where("violations > 0").isEmpty():
        assert_valid(violating_rows(checks), max_examples)
