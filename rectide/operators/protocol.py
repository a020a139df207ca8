"""Evaluation protocol: candidate manifest and leakage checks.

The manifest is two tables: ``candidates(item_id, candidate_pos)`` and a
one-row ``manifest`` with the scalar fields.  Checks return per-rule counts
``(rule, violations)`` so a job reports every rule at once; ``assert_clean``
raises on any non-zero count.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rectide.operators.ordering import with_scalars
from rectide.operators.rules import KNOWN, REPEATED, ROWS, UNKNOWN_ROWS, Rule, rule_report

# Protocol name, ranking mode, schema version and the field
# names the sequential protocol requires.
SEQUENTIAL_NEXT_ITEM = "sequential_next_item"
REQUIRED_FIELDS = {
    "fit_history_field": "train_history_item_ids",
    "history_field": "test_history_item_ids",
    "target_field": "test_item_id",
}
MANIFEST_SCHEMA = (
    "schema_version int, protocol_name string, dataset_matrix string, candidate_source string, "
    "candidate_count int, history_field string, target_field string, fit_history_field string, "
    "ranking_mode string, random_seed int"
)


def build_manifest(spark: SparkSession, candidates: DataFrame, dataset_matrix: str, random_seed: int = 42) -> DataFrame:
    """One-row manifest; candidate_count is computed from the candidate table."""
    n = candidates.agg(F.count(F.lit(1)).cast("int").alias("candidate_count"))
    base = spark.createDataFrame(
        [(1, SEQUENTIAL_NEXT_ITEM, dataset_matrix, "prepared_interactions", REQUIRED_FIELDS["history_field"],
          REQUIRED_FIELDS["target_field"], REQUIRED_FIELDS["fit_history_field"], "full_sort", random_seed)],
        "schema_version int, protocol_name string, dataset_matrix string, candidate_source string, history_field string, "
        "target_field string, fit_history_field string, ranking_mode string, random_seed int",
    )
    return with_scalars(base, n).select(*[c.split()[0] for c in MANIFEST_SCHEMA.split(", ")])


def write_manifest(manifest: DataFrame, candidates: DataFrame, path: str) -> None:
    """S11 sink: ``path/manifest`` (JSON, one row) and ``path/candidates`` (Parquet)."""
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    candidates.write.mode("overwrite").parquet(f"{path}/candidates")


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S11 source; the stated count must equal the candidate rows (checked by
    ``manifest_violations``)."""
    return spark.read.schema(MANIFEST_SCHEMA).json(f"{path}/manifest"), spark.read.parquet(f"{path}/candidates")


def manifest_from_json(spark: SparkSession, payload: str) -> tuple[DataFrame, DataFrame]:
    """Parse a reference-style manifest JSON document (small, scalar fields +
    id list) into the two tables."""
    data = json.loads(payload)
    ids = [str(x) for x in data["candidate_item_ids"]]
    row = dict(
        schema_version=int(data.get("schema_version", 1)), protocol_name=str(data["protocol_name"]),
        dataset_matrix=str(data["dataset_matrix"]), candidate_source=str(data["candidate_source"]),
        candidate_count=int(data.get("candidate_count", len(ids))),
        history_field=str(data.get("history_field", REQUIRED_FIELDS["history_field"])),
        target_field=str(data.get("target_field", REQUIRED_FIELDS["target_field"])),
        fit_history_field=str(data.get("fit_history_field", REQUIRED_FIELDS["fit_history_field"])),
        ranking_mode=str(data.get("ranking_mode", "full_sort")), random_seed=int(data.get("random_seed", 42)),
    )
    manifest = spark.createDataFrame([row], MANIFEST_SCHEMA)
    cands = spark.createDataFrame([(i, p + 1) for p, i in enumerate(ids)], "item_id string, candidate_pos long")
    return manifest, cands


def _totals(df: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """(rule, violations): all counts of a table in one aggregate, a row for each."""
    names = list(counts)
    one = df.agg(*[counts[r].cast("long").alias(f"c{i}") for i, r in enumerate(names)])
    pairs = [F.struct(F.lit(r).alias("rule"), F.coalesce(f"c{i}", F.lit(0).cast("long")).alias("violations")) for i, r in enumerate(names)]
    return one.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def manifest_violations(manifest: DataFrame, candidates: DataFrame) -> DataFrame:
    """V10."""
    stats = candidates.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("item_id").alias("distinct_ids")
    )
    m = with_scalars(manifest, stats)
    checks = {
        "manifest.schema_version": F.col("schema_version") != 1,
        "manifest.protocol_name": F.col("protocol_name") != SEQUENTIAL_NEXT_ITEM,
        "manifest.ranking_mode": F.col("ranking_mode") != "full_sort",
        "manifest.empty_universe": F.col("rows") == 0,
        "manifest.duplicate_ids": F.col("distinct_ids") != F.col("rows"),
        "manifest.count_mismatch": F.col("candidate_count") != F.col("rows"),
        **{f"manifest.{k}": F.col(k) != v for k, v in REQUIRED_FIELDS.items()},
    }
    return _totals(m, {r: F.count_if(c) for r, c in checks.items()})


def sequence_violations(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """V11 on list-form sequences (as read from JSON lines): per-rule counts, one scan of either table."""
    items = F.coalesce(F.col("item_ids"), F.array().cast("array<string>"))
    n = F.size(items)
    head = lambda m: F.slice(items, 1, F.greatest(n - m, F.lit(0)))
    val = F.coalesce(F.col("validation_item_id").cast("string"), F.lit(""))
    test = F.coalesce(F.col("test_item_id").cast("string"), F.lit(""))
    cast_arr = lambda c: F.coalesce(F.transform(F.col(c), lambda x: x.cast("string")), F.array().cast("array<string>"))
    checks = {
        "sequence.missing_user_id": F.coalesce(F.col("user_id").cast("string"), F.lit("")) == "",
        "sequence.incomplete_split": (n < 2) | (val == "") | (test == ""),
        "sequence.train_history_leak": (n >= 2) & (cast_arr("train_history_item_ids") != head(2)),
        "sequence.validation_not_penultimate": (n >= 2) & (val != F.element_at(items, -2)),
        "sequence.test_history_mismatch": (n >= 2) & (cast_arr("test_history_item_ids") != head(1)),
        "sequence.test_not_last": (n >= 2) & (test != F.element_at(items, -1)),
    }
    # Aligned list fields must cover the train history
    train_len = F.size(cast_arr("train_history_item_ids"))
    for field in ("actions", "action_weights", "event_weights", "timestamps", "time_deltas"):
        if field in rows.columns:
            checks[f"sequence.short_{field}"] = F.col(field).isNotNull() & (F.size(field) < train_len)
    target, reach = F.col("test_item_id").cast("string"), "sequence.unreachable_target"
    rules = [Rule(name, ROWS, F.col("user_id"), c) for name, c in checks.items()]
    rules.append(Rule("sequence.duplicate_user", REPEATED, F.col("user_id")))
    rules.append(Rule(reach, UNKNOWN_ROWS, target, target != ""))
    return rule_report([(rows, rules), (candidates, [Rule(reach, KNOWN, F.col("item_id"))])])


def long_sequence_violations(seq: DataFrame, candidates: DataFrame) -> DataFrame:
    """V11 on the canonical long table: positions 1..n without gaps, n >= 2,
    unique (user, pos), test target (pos = n) inside the candidate universe.

    Every row stands for its user, a last one for its target too; both are summed
    by (kind, value) in one scan of either table."""
    pos, n = F.col("pos").cast("long"), F.col("n").cast("long")
    absent, mark = F.lit(None).cast("long"), F.lit(1).cast("long")

    def entry(kind: str, value: str, pos: Column, n: Column, known: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), F.col(value).cast("string").alias("value"), pos.alias("pos"), n.alias("n"), known.alias("known")
        )

    last = F.when(pos == n, entry("target", "item_id", absent, absent, absent))
    rows = seq.select(F.explode(F.array_compact(F.array(entry("user", "user_id", pos, n, absent), last))).alias("e")).select("e.*")
    known = candidates.where(F.col("item_id").isNotNull()).select(entry("target", "item_id", absent, absent, mark).alias("e")).select("e.*")
    per = rows.unionByName(known).groupBy("kind", "value").agg(
        F.count(F.lit(1)).alias("rows"), F.count("known").alias("known"), F.countDistinct("pos").alias("dpos"),
        F.min("pos").alias("pmin"), F.max("pos").alias("pmax"), F.max("n").alias("nmax"), F.min("n").alias("nmin"),
    )
    user, value = F.col("kind") == "user", F.col("value")
    gap = (F.col("pmin") != 1) | (F.col("pmax") != F.col("nmax")) | (F.col("dpos") != F.col("rows"))
    gap = gap | (F.col("rows") != F.col("nmax")) | (F.col("nmin") != F.col("nmax"))
    return _totals(
        per,
        {
            "sequence.missing_user_id": F.count_if(user & (value.isNull() | (value == ""))),
            "sequence.incomplete_split": F.count_if(user & (F.col("nmax") < 2)),
            "sequence.position_gap": F.count_if(user & gap),
            "sequence.unreachable_target": F.sum(F.when(~user & (F.col("known") == 0), F.col("rows"))),
        },
    )


def recommendation_violations(recs: DataFrame, users: DataFrame, histories: DataFrame, candidates: DataFrame, top_k: int) -> DataFrame:
    """Users equal both ways, no duplicates, all in candidates, none in
    history, list length = min(k, |candidates - history|) (history items
    outside the candidates do not lower the eligible count).

    Recommended and seen rows are summed by (user, item), looked up once among the
    candidates and summed by user; NULL ids equal no other id."""
    rec, seen = F.col("rec"), F.col("seen")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    pairs = (
        recs.select("user_id", "item_id", one.alias("rec"), none.alias("seen"))
        .unionByName(histories.select("user_id", "item_id", none.alias("rec"), one.alias("seen")))
        .groupBy("user_id", "item_id")
        .agg(F.sum("rec").alias("rec"), F.max("seen").alias("seen"))
    )
    ids = candidates.select("item_id").distinct()
    inside = F.coalesce(F.col("inside"), F.lit(False))
    named = F.col("user_id").isNotNull()
    per_user = (
        pairs.join(ids.withColumn("inside", F.lit(True)), "item_id", "left")
        .groupBy("user_id")
        .agg(
            F.sum("rec").alias("got"),
            F.count_if(rec > 1).alias("repeated"),
            F.sum(F.when(~inside, rec).otherwise(0)).alias("outside"),
            F.sum(F.when(named & F.col("item_id").isNotNull() & (seen == 1), rec).otherwise(0)).alias("leaked"),
            F.count_if(named & inside & (seen == 1)).alias("nh"),
        )
        .withColumn("asked", F.lit(0))
        .unionByName(users.select("user_id", F.lit(1).alias("asked")), allowMissingColumns=True)
        .groupBy("user_id")
        .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("got", "repeated", "outside", "leaked", "nh")], F.max("asked").alias("asked"))
    )
    counts = with_scalars(per_user, ids.agg(F.count("item_id").alias("nc")))
    asked, got = F.col("asked") == 1, F.when(named, F.col("got")).otherwise(0)
    return _totals(
        counts,
        {
            "recs.missing_user": F.count_if(asked & (got == 0)),
            "recs.extra_user": F.count_if((F.col("got") > 0) & (~asked | ~named)),
            "recs.duplicate_item": F.sum("repeated"),
            "recs.outside_candidates": F.sum("outside"),
            "recs.history_leak": F.sum("leaked"),
            "recs.count_mismatch": F.count_if(asked & (got != F.least(F.lit(top_k), F.col("nc") - F.col("nh")))),
        },
    )


def assert_clean(report: DataFrame) -> None:
    bad = report.where("violations > 0").collect()
    if bad:
        raise ValueError("protocol violations: " + ", ".join(f"{r['rule']}={r['violations']}" for r in bad))
