import random
import re

import pytest
from pyspark.sql import functions as F

from rectide.operators import protocol, quality
from rectide.operators.rules import KNOWN, REPEATED, ROWS, UNKNOWN, UNKNOWN_ROWS, VALUES, Rule, observed, observed_counts, rule_report, violating_rows


def _counts(df):
    return {r.rule: r.violations for r in df.collect()}


def _scans(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return len(re.findall(r"Relation \[|LogicalRDD", plan))


def test_report_and_violators_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, "a", "b", "c", "d", "e"]), rng.choice([None, -1, 0, 3])) for _ in range(60)]
    allowed = ["a", "b", None]
    df = spark.createDataFrame(rows, "k string, x int")
    known = spark.createDataFrame([(a,) for a in allowed], "k string")
    k, x = F.col("k"), F.col("x")
    rules = [
        Rule("neg", ROWS, k, x < 0, x),
        Rule("twice", REPEATED, k),
        Rule("negkeys", VALUES, k, x < 0),
        Rule("gone", UNKNOWN, k),
        Rule("gonerows", UNKNOWN_ROWS, k, k.isNotNull()),
        Rule("never", ROWS, k, x > 100),
    ]
    checks = [(df, rules), (known, [Rule("gone", KNOWN, k), Rule("gonerows", KNOWN, k)])]
    keys = [r[0] for r in rows]
    assert _counts(rule_report(checks)) == {
        "neg": sum(1 for r in rows if r[1] == -1),
        "twice": len({v for v in keys if keys.count(v) > 1}),
        "negkeys": len({r[0] for r in rows if r[1] == -1}),
        "gone": len({v for v in keys if v not in ("a", "b")}),
        "gonerows": sum(1 for v in keys if v is not None and v not in ("a", "b")),
        "never": 0,
    }
    found = [(r.rule, r.key, r.detail) for r in violating_rows(checks).collect()]
    assert sorted(f for f in found if f[0] == "neg" and f[1]) == sorted(("neg", r[0], "-1") for r in rows if r[1] == -1 and r[0])
    assert {f[1]: f[2] for f in found if f[0] == "twice"} == {v: str(keys.count(v)) for v in set(keys) if keys.count(v) > 1}
    assert not [f for f in found if f[0] == "never"]


def test_empty_tables_have_a_row_for_every_rule(spark):
    items = spark.createDataFrame([], "item_id string, title string, body string, topic string, author_id string, publish_time string, quality_score string")
    got = _counts(rule_report([(items, quality.item_rules(items))]))
    assert got == {"items.duplicate_item_id": 0, "items.invalid_publish_time": 0, "items.invalid_quality_score": 0}
    assert violating_rows([(items, quality.item_rules(items))]).count() == 0
    quality.require_clean([(items, quality.item_rules(items))])


def test_one_scan_for_each_table(spark, tmp_path):
    spark.range(20).select(
        F.col("id").cast("string").alias("user_id"), F.col("id").cast("string").alias("item_id"), F.lit("x").alias("event_type"),
        F.lit("2020").alias("event_time"), F.lit("-1").alias("dwell_time"), F.lit("t").alias("title"), F.lit("b").alias("body"),
        F.lit("p").alias("topic"), F.lit("a").alias("author_id"), F.lit("never").alias("publish_time"), F.lit("2").alias("quality_score"),
        F.lit("soon").alias("signup_time"), F.lit(1).alias("pos"), F.lit(1).alias("n"),
    ).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    report = rule_report(quality.data_checks(t, t, t, contracts=True))
    assert _scans(report) == 3
    got = _counts(report)
    assert got["items.quality_out_of_range"] == got["interactions.negative_dwell_time"] == got["users.invalid_signup_time"] == 20
    assert got["interactions.invalid_event_type"] == 1 and got["interactions.unknown_item"] == 0
    assert _scans(protocol.long_sequence_violations(t, t)) == 2
    with pytest.raises(quality.ValidationError, match="invalid_publish_time"):
        quality.require_clean([(t, quality.item_rules(t))])


def test_rules_observed_by_the_write(spark, tmp_path):
    rows = [(str(i), "soon" if i % 3 == 0 else None if i % 3 == 1 else "2020-01-01") for i in range(50)]
    users = spark.createDataFrame(rows, "user_id string, signup_time string").repartition(4)
    rules = quality.user_rules(users) + quality.profile_rules(users)
    watched, observation = observed(users, rules)
    watched.write.parquet(str(tmp_path / "u"))
    assert observed_counts(observation, rules) == {"users.invalid_signup_time": 17}


def test_long_sequences_against_brute_force(spark):
    rng = random.Random(11)
    rows = [(u, p, n, str(rng.randrange(8))) for u, n in (("", 3), (None, 2), ("a", 1), ("b", 4)) for p in range(1, n + 1)]
    rows += [("c", 1, 3, "1"), ("c", 3, 3, "99"), ("d", 1, 2, "1"), ("d", 2, 2, "99"), ("d", 2, 2, "99"), ("e", 1, 2, "0"), ("e", 2, 3, "1")]
    cands = [str(i) for i in range(8)] + ["0"]
    got = _counts(protocol.long_sequence_violations(
        spark.createDataFrame(rows, "user_id string, pos int, n int, item_id string"), spark.createDataFrame([(c,) for c in cands], "item_id string")))
    assert got == {
        "sequence.missing_user_id": 2, "sequence.incomplete_split": 1, "sequence.position_gap": 3,
        "sequence.unreachable_target": sum(1 for r in rows if r[1] == r[2] and r[3] not in cands),
    }


def test_recommendations_against_brute_force(spark):
    rng = random.Random(3)
    for _ in range(4):
        cands = [str(i) for i in range(6)] + ["0"]
        hist = [(rng.choice("abcd"), str(rng.randrange(9))) for _ in range(9)]
        recs = [(rng.choice("abcx"), str(rng.randrange(8))) for _ in range(9)]
        users = ["a", "b", "d", "e"]
        make = lambda data: spark.createDataFrame(data, "user_id string, item_id string")
        got = _counts(protocol.recommendation_violations(
            make(recs), spark.createDataFrame([(u,) for u in users], "user_id string"), make(hist),
            spark.createDataFrame([(c,) for c in cands], "item_id string"), 2))
        named = {u for u, _ in recs}
        eligible = {u: len(set(cands) - {i for v, i in hist if v == u}) for u in users}
        assert got == {
            "recs.missing_user": len(set(users) - named),
            "recs.extra_user": len(named - set(users)),
            "recs.duplicate_item": sum(1 for r in set(recs) if recs.count(r) > 1),
            "recs.outside_candidates": sum(1 for _, i in recs if i not in cands),
            "recs.history_leak": sum(1 for r in recs if r in hist),
            "recs.count_mismatch": sum(1 for u in users if sum(1 for v, _ in recs if v == u) != min(2, eligible[u])),
        }


def test_white_space_of_any_script_is_no_text(spark):
    from rectide.functions.exprs import has_text

    values = ["\u00a0", "\u2028 \t", "\x1c", "\u3000nan ", "\u00a0a", "x y", "", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    assert [r.t for r in df.orderBy("i").select(has_text("v").alias("t")).collect()] == [False, False, False, False, True, True, False, False]
