"""Content path on seven items and three users; every list is worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from rectide.operators.sequences import build_content_sequences, targets, train_histories
from rectide.plans.evaluate import evaluate_content, recommend_content
from rectide.plans.prepare import Bundle

ITEMS = [
    ("n1", "Slow looms", "weaving on a floor loom", "arts", "w2", "2025-01-11 07:00:00", 0.40),
    ("n2", "Ink from oak galls", "a recipe with iron", "arts", "w2", "2025-05-08 06:30:00", 0.55),
    ("n3", "Rowing at dawn", "eights on the river", "sport", "w3", "2025-02-02 05:00:00", 0.61),
    ("n4", "Harbour closes", "ferries go elsewhere", "news", "w1", "2025-02-20 12:00:00", 0.33),
    ("n5", "Chess by post", "a game of two years", "sport", "w4", "2025-03-01 09:00:00", 0.70),
    ("n6", "Blue glazes", "cobalt and ash", "arts", "w1", "2025-03-15 18:00:00", 0.48),
    ("n7", "Bridge reopens", "traffic after the flood", "news", "w5", "2025-04-01 08:00:00", 0.52),
]
EVENTS = [
    ("ada", "n3", "click", "2025-05-01 08:00:00", 9.0),
    ("ada", "n1", "collect", "2025-05-01 08:10:00", 80.0),
    ("ada", "n6", "like", "2025-05-01 08:20:00", 33.0),
    ("ada", "n2", "click", "2025-05-01 08:30:00", 14.0),
    ("ben", "n1", "like", "2025-05-02 19:00:00", 21.0),
    ("ben", "n6", "click", "2025-05-02 19:04:00", 7.0),
    ("ben", "n4", "collect", "2025-05-02 19:09:00", 55.0),
    ("cal", "n5", "click", "2025-05-03 10:00:00", 3.0),
    ("cal", "n7", "skip", "2025-05-03 10:01:00", 1.0),
]
MAPPING = [("n1", "4-1-0"), ("n2", "2-0-3"), ("n3", "0-5-5"), ("n4", "3-3-1"), ("n5", "5-0-0"), ("n6", "1-2-2")]
NOW = "2025-05-10T00:00:00"
# ada has read n3, n1 and is tested on n2; ben has read n1 and is tested on n4; cal is too short.
# popular: n1 5, n4 3, n6 3, n2 1, n3 1.  itemcf, ada: n6 1 + 2, n2 1 + 1, n4 1; ben: n6 2, n2, n3, n4 1.
# generative: n1 leads to n6, n6 to n2 or n4 (equal counts: the smaller path), then the most frequent others.
# reranked: n2 is fresh (+0.15), but topics alternate.
LISTS = {
    "popular": {"ada": ["n4", "n6", "n2"], "ben": ["n4", "n6", "n2", "n3"]},
    "itemcf": {"ada": ["n6", "n2", "n4"], "ben": ["n6", "n2", "n3", "n4"]},
    "generative": {"ada": ["n6", "n2", "n4"], "ben": ["n6", "n2", "n3", "n4"]},
    "generative_rerank": {"ada": ["n6", "n4", "n2"], "ben": ["n6", "n3", "n2", "n4"]},
}


@pytest.fixture(scope="module")
def golden(spark):
    items = spark.createDataFrame(ITEMS, "item_id string, title string, body string, topic string, author_id string, publish_time string, quality_score double")
    items = items.withColumn("publish_time", F.to_timestamp("publish_time"))
    inter = spark.createDataFrame(EVENTS, "user_id string, item_id string, event_type string, event_time string, dwell_time double")
    inter = inter.withColumn("event_time", F.to_timestamp("event_time"))
    seq = build_content_sequences(inter)
    b = Bundle(log=inter, seq=seq, train=seq, histories=train_histories(seq), targets=targets(seq), candidates=None)
    mapping = spark.createDataFrame(MAPPING, "item_id string, semantic_id_str string")
    return b, items, mapping


@pytest.mark.parametrize("method", list(LISTS))
def test_content_methods(golden, method):
    b, items, mapping = golden
    got = {}
    for r in recommend_content(method, b, 10, mapping, items, NOW).orderBy("user_id", "rank").collect():
        got.setdefault(r.user_id, []).append(r.item_id)
    assert got == LISTS[method]
    gains = [1 / math.log2(LISTS[method][u].index(t) + 2) for u, t in (("ada", "n2"), ("ben", "n4"))]
    m = {r.metric: r.value for r in evaluate_content(method, b, items, (5, 10), mapping, NOW).collect()}
    assert m["Recall@5"] == 1.0 and m["Recall@10"] == 1.0
    assert m["NDCG@5"] == m["NDCG@10"] == pytest.approx(sum(gains) / 2)
    assert m["Coverage"] == pytest.approx(4 / 7) and m["Diversity"] == pytest.approx((2 / 3 + 3 / 4) / 2)


def test_rerank_scores(golden):
    b, items, mapping = golden
    recs = recommend_content("generative_rerank", b, 10, mapping, items, NOW).where("user_id = 'ada'").orderBy("rank").collect()
    assert [r.score for r in recs] == pytest.approx([1.0, 1 / 3, 0.65])
