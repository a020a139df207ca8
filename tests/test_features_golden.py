"""Watch-ratio log of five users: features, sequences and both baselines against plain Python."""

import math

import pytest

from rectide.operators import features, itemcf, metrics, popular
from rectide.operators.behaviors import attach_actions
from rectide.operators.sequences import build_watch_sequences, evaluation_histories, targets, train_only_view

# (user, video, time, watch ratio); the last user is too short to take part
LOG = [
    (31, 204, 7, 1.9), (31, 201, 3, 0.5), (31, 206, 12, 0.1), (31, 202, 20, 2.6), (31, 207, 26, 1.0),
    (32, 206, 4, 1.2), (32, 203, 9, 2.0), (32, 201, 14, 0.9), (32, 208, 21, 0.3),
    (33, 202, 2, 0.2), (33, 207, 6, 1.5), (33, 204, 11, 2.2), (33, 203, 16, 0.7), (33, 205, 33, 1.1), (33, 206, 40, 3.0),
    (34, 208, 1, 0.6), (34, 205, 8, 0.29), (34, 201, 19, 1.3),
    (35, 203, 5, 1.0),
]
TEXTS = [
    (201, "pruning roses", "garden"), (202, "sharpening a plane", "workshop"), (203, "dovetails by hand", "workshop"),
    (204, "compost heap", "garden"), (205, "night train to the coast", "rail"), (206, "signal box tour", "rail"),
    (207, "seed swapping", "garden"), (208, "varnish drying", "workshop"),
]
# (video, author, duration, shown, played, likes, comments, shares)
DAYS = [
    (201, "w1", 40, 300, 210, 21, 4, 5), (202, "w2", 31, 150, 160, 9, 0, 1), (203, "w2", 55, 80, 20, 6, 3, 0),
    (204, "w1", 12, 500, 450, 70, 11, 9), (205, "w3", 99, 40, 40, 0, 0, 0), (206, "w3", 64, 220, 100, 33, 2, 8),
    (207, "w4", 18, 130, 90, 12, 1, 0), (208, "w5", 26, 10, 3, 1, 1, 1),
]
MIN_HISTORY = 1  # train events; one more each for validation and test


def _weight(ratio):
    return 0.2 if ratio < 0.3 else 1.0 if ratio < 1 else 1.5 if ratio < 2 else 2.5


def _sequences():
    out = {}
    for user, video, _, ratio in sorted(LOG, key=lambda x: (x[0], x[2])):
        out.setdefault(str(user), []).append((str(video), _weight(ratio)))
    return {u: s for u, s in out.items() if len(s) >= MIN_HISTORY + 2}


def _ranked(scores, history):
    return sorted((i for i in scores if i not in history), key=lambda i: (-scores[i], i))


def _popular_lists(seqs, items):
    score = dict.fromkeys(items, 0.0)
    for s in seqs.values():
        for item, w in s[:-2]:
            score[item] += w
    return {u: _ranked(score, {i for i, _ in s[:-1]}) for u, s in seqs.items()}


def _cooccurrence_lists(seqs, items):
    held = {u: {i for i, _ in s[:-2]} for u, s in seqs.items()}
    lists = {}
    for u, s in seqs.items():
        history = {i for i, _ in s[:-1]}
        score = {}
        for item in items:
            shared = sum(len(h & history) for h in held.values() if item in h)
            score[item] = shared or sum(item in h for h in held.values())
        lists[u] = _ranked(score, history)
    return lists


@pytest.fixture(scope="module")
def sample(spark):
    log = attach_actions(spark.createDataFrame(LOG, "user_id long, video_id long, timestamp long, watch_ratio double"))
    seq = build_watch_sequences(log, min_history=MIN_HISTORY)
    cats = spark.createDataFrame([(v, f"{topic}|tips") for v, _, topic in TEXTS], "video_id long, feat string")
    caps = spark.createDataFrame(TEXTS, "video_id long, caption string, category string")
    daily = spark.createDataFrame(
        DAYS, "video_id long, author_id string, video_duration long, show_cnt long, play_cnt long, like_cnt long, comment_cnt long, share_cnt long"
    )
    return log, seq, features.build_item_features(cats, caps, daily, order_col=None)


def test_item_features(sample):
    _, _, items = sample
    got = {r.item_id: r for r in items.collect()}
    assert sorted(got) == [str(v) for v, *_ in TEXTS]
    hottest = max(math.log1p(shown + played + likes) for _, _, _, shown, played, likes, _, _ in DAYS)
    for video, author, duration, shown, played, likes, comments, shares in DAYS:
        r = got[str(video)]
        assert r.quality_score == pytest.approx((likes + comments + shares) / max(shown, played))
        assert r.hot_score == pytest.approx(math.log1p(shown + played + likes) / hottest)
        assert (r.author_id, r.duration) == (author, duration)
    first = got["201"]
    assert (first.topic, first.title, first.body) == ("garden", "pruning roses", "pruning roses garden|tips")


def test_item_features_topic_falls_back_to_category_token(spark):
    cats = spark.createDataFrame([(77, "rail|night")], "video_id long, feat string")
    daily = spark.createDataFrame([(77, 40, 30, 6)], "video_id long, show_cnt long, play_cnt long, like_cnt long")
    r = features.build_item_features(cats, None, daily, order_col=None).collect()[0]
    assert (r.item_id, r.topic, r.title) == ("77", "rail", "rail|night")
    assert r.quality_score == pytest.approx(6 / 40) and r.hot_score == 1.0


def test_user_features(spark):
    users = spark.createDataFrame([(6, "weekly"), (7, "daily")], "user_id long, user_active_degree string")
    inter = spark.createDataFrame([(6, 1), (8, 2), (8, 3), (8, 4)], "user_id long, video_id long")
    got = {r.user_id: r for r in features.build_user_features(users, inter, order_col=None).collect()}
    assert set(got) == {"6", "7", "8"}
    assert [got[u].activity_bucket for u in "678"] == ["short", "short", "medium"]
    assert [got[u].user_active_degree for u in "678"] == ["weekly", "daily", None]


def test_sequences(sample):
    _, seq, _ = sample
    per = {}
    for r in seq.orderBy("user_id", "pos").collect():
        per.setdefault(r.user_id, []).append((r.item_id, r.event_weight))
    assert per == _sequences()
    assert [r.delta for r in seq.where("user_id = '33'").orderBy("pos").collect()] == [0, 4, 5, 5, 17, 7]


def _lists(recs):
    out = {}
    for r in recs.orderBy("user_id", "rank").collect():
        out.setdefault(r.user_id, []).append(r.item_id)
    return out


def test_baselines(spark, sample):
    log, seq, items = sample
    seqs, videos = _sequences(), sorted({str(v) for _, v, _, _ in LOG})
    cands = popular.candidate_universe(log)
    train = train_only_view(seq)
    hist = evaluation_histories(seq)
    ranked = popular.rank_catalog(popular.popularity_from_sequences(train), cands)
    pop = popular.recommend_from_ranking(ranked, seq.select("user_id").distinct(), hist, 20)
    assert _lists(pop) == _popular_lists(seqs, videos)
    nb, pp = itemcf.fit_itemcf(train)
    cf = itemcf.itemcf_recommendations(nb, pp, hist, cands, 20)
    assert _lists(cf) == _cooccurrence_lists(seqs, videos)
    tgt = targets(seq)
    for recs, lists in ((pop, _popular_lists(seqs, videos)), (cf, _cooccurrence_lists(seqs, videos))):
        rep = {(r.segment, r.metric): r.value for r in metrics.segmented_metrics(recs, tgt, items, cands.select("item_id"), (10, 20)).collect()}
        places = [lists[u].index(s[-1][0]) + 1 for u, s in seqs.items() if s[-1][0] in lists[u]]
        assert rep[("all", "HR@10")] == pytest.approx(len(places) / len(seqs))
        assert rep[("all", "NDCG@10")] == pytest.approx(sum(1 / math.log2(p + 1) for p in places) / len(seqs))
