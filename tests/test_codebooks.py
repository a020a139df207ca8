import datetime as dt
import hashlib
import itertools

import numpy as np
import pytest

from rectide.operators import codebooks
from rectide.operators.quality import ValidationError
from rectide.plans.tokenizer import encode_items, train_tokenizer
from rectide.sources.metric_store import read_metric_store

SCHEMA = "item_id string, topic string, vector array<float>"


def _points(n=120, dim=5, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, dim)) * 4
    return {str(i): (centre[i % 6] + rng.normal(size=dim)).astype(np.float32).astype(float) for i in range(n)}


def _frame(spark, points, parts=3):
    return spark.createDataFrame([(i, str(int(i) % 6), [float(v) for v in x]) for i, x in points.items()], SCHEMA).repartition(parts)


def _brute_fit(points, sizes, starts, rounds, seed, residual):
    ids = list(points)
    x = np.array([points[i] for i in ids])
    rest, books = x.copy(), []
    for level, k in enumerate(sizes):
        runs = []
        for start in range(starts):
            order = sorted(range(len(ids)), key=lambda j: (hashlib.md5(f"{seed}:{level}:{start}:{ids[j]}".encode()).hexdigest(), ids[j]))
            centres = rest[order[:k]].copy()
            for _ in range(rounds):
                code = [int(np.argmin([((v - c) ** 2).sum() for c in centres])) for v in rest]
                for c in range(len(centres)):
                    mine = [v for v, g in zip(rest, code) if g == c]
                    if mine:
                        centres[c] = np.mean(mine, axis=0)
            cost = sum(min(((v - c) ** 2).sum() for c in centres) for v in rest)
            runs.append((float(f"{cost:.9g}"), start, centres))
        best = min(runs, key=lambda r: r[:2])[2]
        books.append(best)
        if residual:
            rest = np.array([v - best[int(np.argmin([((v - c) ** 2).sum() for c in best]))] for v in rest])
    return books


@pytest.mark.parametrize("residual", [True, False])
def test_fit_against_brute_force(spark, residual):
    points = _points()
    table = codebooks.fit_codebooks(_frame(spark, points), [4, 3], starts=3, rounds=3, seed=7, residual=residual)
    books, kind = codebooks._books(table)
    assert kind is residual
    for got, want in zip(books, _brute_fit(points, [4, 3], 3, 3, 7, residual), strict=True):
        np.testing.assert_allclose(got, want, atol=1e-9)


def test_full_beam_is_the_best_path_of_all(spark):
    points = _points(60)
    df = _frame(spark, points)
    table = codebooks.fit_codebooks(df, [3, 3, 3], starts=1, rounds=2)
    books, _ = codebooks._books(table)
    full = {r.item_id: r for r in codebooks.encode(df, table, beam=9).collect()}
    greedy = {r.item_id: r.error for r in codebooks.encode(df, table, beam=1).collect()}
    better = 0
    for i, x in points.items():
        errors = {p: ((x - sum(b[c] for b, c in zip(books, p))) ** 2).sum() for p in itertools.product(range(3), repeat=3)}
        assert full[i].error == pytest.approx(min(errors.values()), abs=1e-9)
        assert errors[tuple(full[i].semantic_id)] == pytest.approx(full[i].error, abs=1e-9)
        better += full[i].error < greedy[i] - 1e-9
        assert full[i].error <= greedy[i] + 1e-9
    assert better > 0


def test_nulls_repeats_few_rows_and_bad_input(spark):
    rows = [("1", "a", [1.0, 0.0]), ("1", "a", [1.0, 0.0]), ("2", None, None), ("3", "b", [0.0, 5.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    table = codebooks.fit_codebooks(df, [8, 2], starts=2, rounds=5)
    got = sorted((r.item_id, r.semantic_id, r.error) for r in codebooks.encode(df, table).collect())
    assert len(got) == 4 and got[0] == got[1] and got[0][2] == pytest.approx(0.0, abs=1e-12)
    assert got[2][1] is None and got[2][2] is None
    with pytest.raises(ValidationError):
        codebooks.fit_codebooks(df.where("vector IS NULL"), [2])
    with pytest.raises(Exception, match="must have 2 values"):
        codebooks.encode(spark.createDataFrame([("9", "a", [1.0, 2.0, 3.0])], SCHEMA), table).collect()
    with pytest.raises(ValueError, match="do not fit"):
        codebooks.fit_codebooks(df, [1 << 21], starts=2)


def test_job_writes_codebooks_mapping_and_figures(spark, tmp_path):
    points = _points()
    df = _frame(spark, points)
    for day in (1, 2):
        mapping = train_tokenizer(spark, df, str(tmp_path), "kmeans", (6, 4), 3, 5, run_ts=dt.datetime(2026, 1, day))
    again = {r.item_id: r.semantic_id_str for r in encode_items(spark, df, str(tmp_path)).collect()}
    assert {r.item_id: r.semantic_id_str for r in mapping.collect()} == again and len(again) == len(points)
    stored = {r.metric: r.value for r in read_metric_store(spark, f"{tmp_path}/metrics").collect()}
    assert stored["item_count"] == len(points) and stored["semantic_id_unique"] == len(set(again.values()))
    assert read_metric_store(spark, f"{tmp_path}/metrics").count() == 5
    topics = [(again[i], int(i) % 6) for i in points]
    dominant = sum(max(topics.count((sid, t)) for t in range(6)) for sid in set(again.values()))
    assert stored["topic_purity"] == pytest.approx(dominant / len(points))
