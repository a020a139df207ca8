"""All rules of a job's tables in one pass.

A check is a pair ``(table, rules)``.  ``rule_report`` counts every rule of every
check: each row is read once and gives one short row for each rule that it
touches, these are summed map-side by (rule, value) and then by rule, so a table
is scanned once however many rules it has, and a value held by a third of the
rows is one row a task in the shuffle.  ``violating_rows`` gives the keys of the
violators and is for use on demand, after a report that is not clean.
``observed`` carries the row rules on a write of the table, without a scan of
their own.

Conditions that are NULL count as no violation.  Values are compared as strings;
NULL values are one value for ``repeated`` and unknown everywhere else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# what a rule counts
ROWS = "rows"  # rows that meet the condition
VALUES = "values"  # distinct values among the rows that meet the condition
REPEATED = "repeated"  # values of more than one row
UNKNOWN = "unknown"  # distinct values that no KNOWN entry of the same rule names
UNKNOWN_ROWS = "unknown_rows"  # rows with such a value
KNOWN = "known"  # the values that a rule of another check may have


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str
    value: Column
    condition: Column | None = None
    detail: Column | None = None


Check = tuple[DataFrame, list[Rule]]


def _fired(rule: Rule, **fields: Column) -> Column:
    struct = F.struct(F.lit(rule.name).alias("rule"), *[c.alias(k) for k, c in fields.items()])
    condition = F.lit(True) if rule.condition is None else rule.condition
    if rule.kind == KNOWN:
        condition = condition & rule.value.isNotNull()
    return F.when(condition, struct)


def _touched(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row a row and rule that it touches: (rule, value, n, known)."""
    fired = [
        _fired(
            r,
            value=F.lit(None).cast("string") if r.kind == ROWS else r.value.cast("string"),
            n=F.lit(int(r.kind != KNOWN)).cast("long"),
            known=F.lit(int(r.kind == KNOWN)).cast("long"),
        )
        for r in rules
    ]
    return df.select(F.explode(F.array_compact(F.array(*fired))).alias("f")).select("f.*")


def _kinds(checks: list[Check]) -> dict[str, str]:
    kinds: dict[str, str] = {}
    for _, rules in checks:
        for r in rules:
            if r.kind != KNOWN and kinds.setdefault(r.name, r.kind) != r.kind:
                raise ValueError(f"rule {r.name} has two kinds")
    return kinds


def _by_value(checks: list[Check], kinds: dict[str, str]) -> DataFrame:
    """(rule, value, n, known, violations) of all checks."""
    parts = [_touched(df, rules) for df, rules in checks if rules]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    unknown = (F.col("known") == 0) | F.col("value").isNull()
    counts = {
        ROWS: F.col("n"),
        VALUES: (F.col("n") > 0).cast("long"),
        REPEATED: (F.col("n") > 1).cast("long"),
        UNKNOWN: ((F.col("n") > 0) & unknown).cast("long"),
        UNKNOWN_ROWS: F.when(unknown, F.col("n")).otherwise(0),
    }
    violations = F.lit(0).cast("long")
    for kind, count in counts.items():
        names = [name for name, k in kinds.items() if k == kind]
        if names:
            violations = F.when(F.col("rule").isin(names), count).otherwise(violations)
    return (
        rows.groupBy("rule", "value")
        .agg(F.sum("n").alias("n"), F.sum("known").alias("known"))
        .withColumn("violations", violations)
    )


def rule_report(checks: list[Check]) -> DataFrame:
    """(rule, violations), one row for every rule, those without violations too."""
    kinds = _kinds(checks)
    spark = checks[0][0].sparkSession
    every = spark.range(0, 1, 1, 1).select(
        F.explode(F.array(*[F.lit(name) for name in kinds])).alias("rule"), F.lit(0).cast("long").alias("violations")
    )
    found = _by_value(checks, kinds).where(F.col("rule").isin(list(kinds))).select("rule", "violations")
    return every.unionByName(found).groupBy("rule").agg(F.sum("violations").alias("violations"))


def violating_rows(checks: list[Check]) -> DataFrame:
    """(rule, key, detail): one row for each row that breaks a row rule, and one for each value
    that breaks another (its detail is the row count of a repeated value, else the value)."""
    out = None
    for df, rules in checks:
        rows = [
            _fired(r, key=r.value.cast("string"), detail=(r.value if r.detail is None else r.detail).cast("string"))
            for r in rules
            if r.kind == ROWS
        ]
        if rows:
            part = df.select(F.explode(F.array_compact(F.array(*rows))).alias("f")).select("f.*")
            out = part if out is None else out.unionByName(part)
    rest = [(df, [r for r in rules if r.kind != ROWS]) for df, rules in checks]
    rest = [(df, rules) for df, rules in rest if rules]
    kinds = _kinds(rest)
    if kinds:
        detail = F.when(
            F.col("rule").isin([n for n, k in kinds.items() if k == REPEATED]), F.col("n").cast("string")
        ).otherwise(F.col("value"))
        part = _by_value(rest, kinds).where("violations > 0").select("rule", F.col("value").alias("key"), detail.alias("detail"))
        out = part if out is None else out.unionByName(part)
    return out


def observed(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, Observation]:
    """The table with its row rules counted by whichever action runs over it.

    Rules of other kinds need a shuffle and are left to ``rule_report``.  Put this
    directly before a write: a stage before a shuffle that is run again after a lost
    executor would count its rows twice, a task of the write counts once.
    """
    observation = Observation()
    counts = [F.count_if(r.condition).alias(f"rule_{i}") for i, r in enumerate(_row_rules(rules))]
    return df.observe(observation, *counts), observation


def observed_counts(observation: Observation, rules: list[Rule]) -> dict[str, int]:
    """Violations by rule, once the action has run; a table without partitions has none."""
    values = observation.get
    return {r.name: int(values.get(f"rule_{i}") or 0) for i, r in enumerate(_row_rules(rules))}


def _row_rules(rules: list[Rule]) -> list[Rule]:
    return [r for r in rules if r.kind == ROWS]
