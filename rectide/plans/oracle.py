"""DuckDB oracle SQL for the registered queries.

Each string runs on the pre-registered views (region nation customer supplier
part orders lineitem events documents embeddings pages benchmark labels
conversations).  The SQL states the reference semantics directly (plain
window functions and full sorts), independent of the Spark plans.
"""

from __future__ import annotations

# ---- shared CTE fragments ---------------------------------------------------

WATCH = """
wm AS (
  SELECT o.o_custkey AS user_id, l.l_partkey AS video_id,
         CAST(epoch(l.l_shipdate) AS DOUBLE) AS ts_raw,
         CAST(l.l_quantity AS DOUBLE) / GREATEST(CAST(p.p_size AS DOUBLE), 1e-12) AS watch_ratio,
         l.l_orderkey * 8 + l.l_linenumber AS row_ix
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                  JOIN part p ON l.l_partkey = p.p_partkey
),
lab AS (
  SELECT *, CASE WHEN watch_ratio < 0.3 THEN 'short_view'
                 WHEN watch_ratio < 1.0 THEN 'valid_view'
                 WHEN watch_ratio < 2.0 THEN 'complete_view'
                 ELSE 'high_interest' END AS action
  FROM wm
),
lw AS (
  SELECT *, CAST(CASE action WHEN 'short_view' THEN 0.2 WHEN 'valid_view' THEN 1.0
                        WHEN 'complete_view' THEN 1.5 WHEN 'high_interest' THEN 2.5 END AS DOUBLE) AS action_weight
  FROM lab
),
numbered AS MATERIALIZED (
  SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(video_id AS VARCHAR) AS item_id,
         action, CAST(action_weight AS DOUBLE) AS action_weight,
         CAST(trunc(ts_raw) AS BIGINT) AS ts,
         ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts_raw, video_id, row_ix) AS pos,
         COUNT(*) OVER (PARTITION BY user_id) AS n,
         LAG(CAST(trunc(ts_raw) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts_raw, video_id, row_ix) AS prev_ts
  FROM lw WHERE action_weight >= 0.0
),
seq AS MATERIALIZED (
  SELECT user_id, pos, n, item_id, action, action_weight, action_weight AS event_weight, ts,
         CASE WHEN pos = 1 THEN 0 ELSE GREATEST(ts - prev_ts, 0) END AS delta,
         CASE WHEN pos <= n - 2 THEN 'train' WHEN pos = n - 1 THEN 'validation' ELSE 'test' END AS split
  FROM numbered WHERE n >= 5
),
train AS (SELECT * FROM seq WHERE pos <= n - 2),
hist AS MATERIALIZED (SELECT DISTINCT user_id, item_id FROM seq WHERE pos <= n - 1),
users AS MATERIALIZED (SELECT DISTINCT user_id FROM seq),
cands AS MATERIALIZED (SELECT DISTINCT CAST(video_id AS VARCHAR) AS item_id FROM wm),
tgt AS MATERIALIZED (
  SELECT user_id,
         max(CASE WHEN pos = n THEN item_id END) AS test_item_id,
         max(CASE WHEN pos = n - 1 THEN item_id END) AS validation_item_id,
         max(CASE WHEN pos = n THEN action END) AS test_action,
         max(CASE WHEN pos = n - 1 THEN action END) AS validation_action,
         max(CASE WHEN pos = n THEN action_weight END) AS test_action_weight,
         max(CASE WHEN pos = n - 1 THEN action_weight END) AS validation_action_weight,
         max(n) - 2 AS train_length, max(n) AS sequence_length
  FROM seq GROUP BY user_id
)
"""

POP = """
pop_scores AS MATERIALIZED (
  SELECT item_id, CAST(SUM(CAST(event_weight AS DECIMAL(38,6))) AS DOUBLE) AS score
  FROM train GROUP BY item_id
),
pop_scored AS (
  SELECT c.item_id, COALESCE(s.score, 0.0) AS score FROM cands c LEFT JOIN pop_scores s USING (item_id)
),
pop_pairs AS (
  SELECT u.user_id, s.item_id, s.score FROM users u CROSS JOIN pop_scored s
  WHERE NOT EXISTS (SELECT 1 FROM hist h WHERE h.user_id = u.user_id AND h.item_id = s.item_id)
),
pop_recs AS MATERIALIZED (
  SELECT * FROM (
    SELECT user_id, item_id, score,
           ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank
    FROM pop_pairs) WHERE rank <= 20
)
"""

ITEMCF = """
cf_first AS (SELECT user_id, item_id, min(pos) AS first_pos FROM train GROUP BY user_id, item_id),
cf_capped AS MATERIALIZED (
  SELECT user_id, item_id FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY first_pos DESC) AS r FROM cf_first
  ) WHERE r <= 100
),
cf_pop AS MATERIALIZED (SELECT item_id, CAST(count(*) AS DOUBLE) AS popularity FROM cf_capped GROUP BY item_id),
cf_pairs AS (
  SELECT a.item_id, b.item_id AS neighbor_id, CAST(count(*) AS DOUBLE) AS sim
  FROM cf_capped a JOIN cf_capped b ON a.user_id = b.user_id AND a.item_id <> b.item_id
  GROUP BY a.item_id, b.item_id
),
cf_nbrs AS MATERIALIZED (
  SELECT * FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY sim DESC, neighbor_id) AS nrank FROM cf_pairs
  ) WHERE nrank <= 200
),
cf_scored AS MATERIALIZED (
  SELECT h.user_id, nb.neighbor_id AS item_id, sum(nb.sim) AS score
  FROM hist h JOIN cf_nbrs nb ON h.item_id = nb.item_id
  WHERE nb.neighbor_id IN (SELECT item_id FROM cands)
    AND NOT EXISTS (SELECT 1 FROM hist h2 WHERE h2.user_id = h.user_id AND h2.item_id = nb.neighbor_id)
  GROUP BY h.user_id, nb.neighbor_id
),
cf_all AS (
  SELECT u.user_id, c.item_id, COALESCE(s.score, COALESCE(p.popularity, 0.0)) AS score
  FROM users u CROSS JOIN cands c
  LEFT JOIN cf_scored s ON s.user_id = u.user_id AND s.item_id = c.item_id
  LEFT JOIN cf_pop p ON p.item_id = c.item_id
  WHERE NOT EXISTS (SELECT 1 FROM hist h WHERE h.user_id = u.user_id AND h.item_id = c.item_id)
),
cf_recs AS (
  SELECT * FROM (
    SELECT user_id, item_id, score,
           ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank
    FROM cf_all) WHERE rank <= 20
)
"""


#: No cut of histories or neighbour lists.
ITEMCF_ALL = ITEMCF.replace("WHERE r <= 100", "").replace("WHERE nrank <= 200", "")


def with_(*fragments: str) -> str:
    return "WITH " + ",".join(f.strip() for f in fragments) + "\n"


ITEMS = """
cat_t AS (
  SELECT CAST(p_partkey AS VARCHAR) AS video_id,
         lower(p_type) || '|' || 'size' || CAST(p_size % 5 AS VARCHAR) AS category_text
  FROM part
),
cap_t AS (SELECT CAST(p_partkey AS VARCHAR) AS video_id, p_name AS caption_text, lower(p_type) AS topic FROM part),
dly AS (
  SELECT l_partkey, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS show_cnt,
         CAST(count(*) AS DOUBLE) AS play_cnt,
         CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS DOUBLE) AS like_cnt,
         CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS comment_cnt,
         CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) AS share_cnt
  FROM lineitem GROUP BY 1, 2
),
dstat AS (
  SELECT CAST(d.l_partkey AS VARCHAR) AS video_id, min(p.p_brand) AS author_id,
         avg(CAST(p.p_size AS DOUBLE)) AS duration,
         avg(show_cnt) AS show_m, avg(play_cnt) AS play_m, avg(like_cnt) AS like_m,
         avg(comment_cnt) AS comment_m, avg(share_cnt) AS share_m
  FROM dly d JOIN part p ON d.l_partkey = p.p_partkey GROUP BY 1
),
dq AS (
  SELECT *, LEAST(GREATEST((like_m + comment_m + share_m) / GREATEST(play_m, show_m, 1.0), 0.0), 1.0) AS quality_score,
         ln(1 + show_m + play_m + like_m) AS raw_hot
  FROM dstat
),
dh AS (
  SELECT dq.*, CASE WHEN mx.m <= 0 THEN 0.0 ELSE raw_hot / mx.m END AS hot_score
  FROM dq, (SELECT max(raw_hot) AS m FROM dq) mx
),
feat AS MATERIALIZED (
  SELECT c.video_id AS item_id,
         CASE WHEN coalesce(cp.caption_text, '') <> '' THEN cp.caption_text
              WHEN coalesce(c.category_text, '') <> '' THEN c.category_text
              ELSE 'video ' || c.video_id END AS title,
         concat_ws(' ', NULLIF(coalesce(cp.caption_text, ''), ''), NULLIF(coalesce(c.category_text, ''), '')) AS body,
         CASE WHEN coalesce(cp.topic, '') <> '' THEN cp.topic
              WHEN coalesce(regexp_extract(c.category_text, '[^|\\s]+', 0), '') <> '' THEN regexp_extract(c.category_text, '[^|\\s]+', 0)
              ELSE 'unknown' END AS topic,
         coalesce(dh.author_id, '') AS author_id,
         coalesce(dh.duration, 0.0) AS duration,
         coalesce(dh.quality_score, 0.0) AS quality_score,
         coalesce(dh.hot_score, 0.0) AS hot_score,
         coalesce(cp.caption_text, '') AS caption_text,
         coalesce(c.category_text, '') AS category_text
  FROM cat_t c LEFT JOIN cap_t cp USING (video_id) LEFT JOIN dh USING (video_id)
),
qs AS (SELECT quantile_cont(hot_score, 0.66) AS hi, quantile_cont(hot_score, 0.33) AS lo FROM feat),
pbucket AS (
  SELECT item_id, hot_score,
         CASE WHEN hot_score >= hi THEN 'head' WHEN hot_score <= lo THEN 'tail' ELSE 'middle' END AS bucket
  FROM feat, qs
)
"""


def segmented(recs_cte: str) -> str:
    """Segmented metrics (k = 10, 20) over ``recs(user_id, item_id, rank)``."""
    return with_(WATCH, ITEMS, recs_cte, """
useg AS (
  SELECT t.user_id, t.test_item_id, s.seg
  FROM tgt t LEFT JOIN pbucket b ON b.item_id = t.test_item_id,
       unnest([ 'all', 'action=' || coalesce(t.test_action, 'unknown'),
                'activity=' || CASE WHEN t.train_length < 2 THEN 'short' WHEN t.train_length < 10 THEN 'medium' ELSE 'long' END,
                'popularity=' || coalesce(b.bucket, 'tail') ]) AS s(seg)
),
hitr AS (
  SELECT r.user_id, min(r.rank) AS hit_rank FROM recs r JOIN tgt t ON r.user_id = t.user_id AND r.item_id = t.test_item_id
  WHERE r.rank <= 20 GROUP BY r.user_id
),
udiv AS (
  SELECT r.user_id, CAST(count(DISTINCT coalesce(f.topic, 'unknown')) AS DOUBLE) / count(*) AS dv
  FROM recs r LEFT JOIN feat f USING (item_id) WHERE r.rank <= 20 GROUP BY r.user_id
),
agg AS (
  SELECT seg,
    avg(CASE WHEN hit_rank <= 10 THEN 1.0 ELSE 0.0 END) AS "HR@10",
    avg(CASE WHEN hit_rank <= 10 THEN 1.0 / log2(hit_rank + 1.0) ELSE 0.0 END) AS "NDCG@10",
    avg(CASE WHEN hit_rank <= 10 THEN 1.0 ELSE 0.0 END) AS "Recall@10",
    avg(CASE WHEN hit_rank <= 20 THEN 1.0 ELSE 0.0 END) AS "HR@20",
    avg(CASE WHEN hit_rank <= 20 THEN 1.0 / log2(hit_rank + 1.0) ELSE 0.0 END) AS "NDCG@20",
    avg(CASE WHEN hit_rank <= 20 THEN 1.0 ELSE 0.0 END) AS "Recall@20",
    coalesce(avg(dv), 0.0) AS "Diversity"
  FROM useg LEFT JOIN hitr USING (user_id) LEFT JOIN udiv USING (user_id) GROUP BY seg
),
cov AS (
  SELECT u.seg, count(DISTINCT r.item_id) AS covered FROM useg u JOIN recs r USING (user_id)
  WHERE r.rank <= 20 AND r.item_id IN (SELECT item_id FROM cands) GROUP BY u.seg
),
wide AS (
  SELECT a.*, CAST(coalesce(c.covered, 0) AS DOUBLE) / (SELECT count(*) FROM cands) AS "Coverage"
  FROM agg a LEFT JOIN cov c USING (seg)
)
SELECT seg AS segment, metric, round(CAST(value AS DOUBLE), 6) AS value
FROM (UNPIVOT wide ON "HR@10", "NDCG@10", "Recall@10", "HR@20", "NDCG@20", "Recall@20", "Diversity", "Coverage"
      INTO NAME metric VALUE value)
""")


SIDS = """
sidmap AS MATERIALIZED (
  SELECT CAST(p_partkey AS VARCHAR) AS item_id,
         CAST(DENSE_RANK() OVER (ORDER BY p_type) - 1 AS VARCHAR) || '-' ||
         CAST(CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) - 1 AS VARCHAR) || '-' ||
         CAST(p_size % 4 AS VARCHAR) AS sid
  FROM part
),
mev AS (SELECT t.user_id, t.pos, m.sid FROM train t JOIN sidmap m USING (item_id)),
mnum AS (SELECT *, LAG(sid) OVER (PARTITION BY user_id ORDER BY pos) AS prev_sid FROM mev),
trans AS MATERIALIZED (SELECT prev_sid AS src, sid AS dst, CAST(count(*) AS DOUBLE) AS cnt FROM mnum WHERE prev_sid IS NOT NULL GROUP BY 1, 2),
gcnt AS MATERIALIZED (SELECT sid, CAST(count(*) AS DOUBLE) AS cnt FROM mev GROUP BY sid),
hev AS MATERIALIZED (SELECT h.user_id, h.pos, m.sid FROM seq h JOIN sidmap m USING (item_id) WHERE h.pos <= h.n - 1),
hx AS MATERIALIZED (SELECT DISTINCT user_id, sid FROM hev),
b0 AS MATERIALIZED (SELECT user_id, CAST([] AS VARCHAR[]) AS path, arg_max(sid, pos) AS cur, 0.0 AS score FROM hev GROUP BY user_id)
"""


def beam_step(i: int, width: int = 5) -> str:
    p = f"b{i - 1}"
    return f"""
c{i} AS MATERIALIZED (
  SELECT b.user_id, b.path, b.score, t.dst, t.cnt FROM {p} b JOIN trans t ON t.src = b.cur
  WHERE NOT list_contains(b.path, t.dst)
    AND NOT EXISTS (SELECT 1 FROM hx WHERE hx.user_id = b.user_id AND hx.sid = t.dst)
),
g{i} AS (
  SELECT b.user_id, b.path, b.score, g.sid AS dst, g.cnt FROM {p} b JOIN gcnt g ON TRUE
  WHERE NOT EXISTS (SELECT 1 FROM c{i} c WHERE c.user_id = b.user_id AND c.path = b.path)
    AND NOT list_contains(b.path, g.sid)
    AND NOT EXISTS (SELECT 1 FROM hx WHERE hx.user_id = b.user_id AND hx.sid = g.sid)
),
e{i} AS (
  SELECT user_id, list_append(path, dst) AS path, dst AS cur, score + cnt AS score
  FROM (SELECT * FROM c{i} UNION ALL SELECT * FROM g{i})
),
x{i} AS MATERIALIZED (
  SELECT user_id, path, cur, score FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY score DESC, path) AS r FROM e{i}
  ) WHERE r <= {width}
),
b{i} AS MATERIALIZED (
  SELECT * FROM x{i}
  UNION ALL SELECT user_id, path, cur, score FROM {p} WHERE user_id NOT IN (SELECT user_id FROM x{i})
)"""


BEAM = SIDS.strip() + "," + ",".join(beam_step(i).strip() for i in (1, 2, 3)) + """,
best AS MATERIALIZED (
  SELECT user_id, path, score FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY score DESC, path) AS r FROM b3
  ) WHERE r = 1
)
"""

GEN = """
gsteps AS MATERIALIZED (SELECT user_id, unnest(path) AS sid, generate_subscripts(path, 1) AS step FROM best),
gdec AS (
  SELECT g.user_id, m.item_id, g.step FROM gsteps g JOIN sidmap m USING (sid)
  WHERE NOT EXISTS (SELECT 1 FROM hist h WHERE h.user_id = g.user_id AND h.item_id = m.item_id)
),
ggen AS (
  SELECT user_id, item_id, 0 AS src, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY step, item_id) AS r FROM gdec
),
gitems AS MATERIALIZED (
  SELECT m.item_id, m.sid, ROW_NUMBER() OVER (ORDER BY g.cnt DESC, g.sid, m.item_id) AS irank
  FROM sidmap m JOIN gcnt g USING (sid)
),
gfill AS (
  SELECT u.user_id, i.item_id, 1 AS src, ROW_NUMBER() OVER (PARTITION BY u.user_id ORDER BY i.irank) AS r
  FROM users u CROSS JOIN gitems i
  WHERE NOT EXISTS (SELECT 1 FROM hist h WHERE h.user_id = u.user_id AND h.item_id = i.item_id)
    AND NOT EXISTS (SELECT 1 FROM gsteps s WHERE s.user_id = u.user_id AND s.sid = i.sid)
),
gen_recs AS (
  SELECT user_id, item_id, src, rank FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY src, r) AS rank
    FROM (SELECT * FROM ggen WHERE r <= 10 UNION ALL SELECT * FROM gfill WHERE r <= 10)
  ) WHERE rank <= 10
)
"""


CONTENT = """
ev AS (
  SELECT CAST(user_id AS BIGINT) AS user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
         CASE event_type WHEN 'view' THEN 'click' WHEN 'click' THEN 'like' WHEN 'purchase' THEN 'collect' ELSE 'skip' END AS et,
         ts, value AS dwell_time, event_id
  FROM events
),
pev AS (
  SELECT *, CAST(CASE et WHEN 'click' THEN 1.0 WHEN 'like' THEN 2.0 WHEN 'collect' THEN 3.0 END AS DOUBLE) AS w
  FROM ev WHERE et IN ('click', 'like', 'collect')
),
cnum AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS item_id, w AS event_weight,
         ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, item_id, event_id) AS pos,
         COUNT(*) OVER (PARTITION BY user_id) AS n
  FROM pev
),
cseq AS MATERIALIZED (SELECT * FROM cnum WHERE n >= 3),
cusers AS (SELECT DISTINCT user_id FROM cseq),
chist AS MATERIALIZED (SELECT DISTINCT user_id, item_id FROM cseq WHERE pos <= n - 2),
ctgt AS (SELECT user_id, item_id AS test_item_id FROM cseq WHERE pos = n),
citems AS MATERIALIZED (
  SELECT CAST(p.p_partkey AS VARCHAR) AS item_id, p.p_type AS topic, p.p_brand AS author_id,
         s.publish_time, CAST(coalesce(s.exposure_count, 0) AS INTEGER) AS exposure_count,
         round(p.p_retailprice - floor(p.p_retailprice), 2) AS quality_score
  FROM part p LEFT JOIN (
    SELECT l_partkey, min(l_shipdate) AS publish_time, count(*) AS exposure_count FROM lineitem GROUP BY l_partkey
  ) s ON s.l_partkey = p.p_partkey
),
ccatalog AS (SELECT item_id FROM citems UNION SELECT item_id FROM cseq)
"""

CPOP = """
cp_scores AS (SELECT item_id, CAST(SUM(CAST(event_weight AS DECIMAL(38,6))) AS DOUBLE) AS score FROM cseq GROUP BY item_id),
crecs AS MATERIALIZED (
  SELECT * FROM (
    SELECT u.user_id, s.item_id, s.score,
           ROW_NUMBER() OVER (PARTITION BY u.user_id ORDER BY s.score DESC, s.item_id) AS rank
    FROM cusers u CROSS JOIN cp_scores s
    WHERE NOT EXISTS (SELECT 1 FROM chist h WHERE h.user_id = u.user_id AND h.item_id = s.item_id)
  ) WHERE rank <= 10
)
"""

CCF = """
ccf_first AS (SELECT user_id, item_id, min(pos) AS first_pos FROM cseq GROUP BY user_id, item_id),
ccf_capped AS MATERIALIZED (
  SELECT user_id, item_id FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY first_pos DESC) AS r FROM ccf_first
  ) WHERE r <= 100
),
ccf_pop AS MATERIALIZED (SELECT item_id, CAST(count(*) AS DOUBLE) AS popularity FROM ccf_capped GROUP BY item_id),
ccf_pairs AS (
  SELECT a.item_id, b.item_id AS neighbor_id, CAST(count(*) AS DOUBLE) AS sim
  FROM ccf_capped a JOIN ccf_capped b ON a.user_id = b.user_id AND a.item_id <> b.item_id
  GROUP BY a.item_id, b.item_id
),
ccf_nbrs AS MATERIALIZED (
  SELECT * FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY sim DESC, neighbor_id) AS nrank FROM ccf_pairs
  ) WHERE nrank <= 200
),
ccf_scored AS MATERIALIZED (
  SELECT h.user_id, nb.neighbor_id AS item_id, sum(nb.sim) AS score
  FROM chist h JOIN ccf_nbrs nb ON h.item_id = nb.item_id
  WHERE NOT EXISTS (SELECT 1 FROM chist h2 WHERE h2.user_id = h.user_id AND h2.item_id = nb.neighbor_id)
  GROUP BY h.user_id, nb.neighbor_id
),
ccf_fill AS (
  SELECT u.user_id, p.item_id, p.popularity AS score
  FROM cusers u CROSS JOIN ccf_pop p
  WHERE u.user_id NOT IN (SELECT user_id FROM ccf_scored)
    AND NOT EXISTS (SELECT 1 FROM chist h WHERE h.user_id = u.user_id AND h.item_id = p.item_id)
),
crecs AS MATERIALIZED (
  SELECT * FROM (
    SELECT user_id, item_id, score, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank
    FROM (SELECT * FROM ccf_scored UNION ALL SELECT * FROM ccf_fill)
  ) WHERE rank <= 10
)
"""

CMETRICS = """
chit AS (
  SELECT t.user_id, min(r.rank) AS hit_rank FROM ctgt t LEFT JOIN crecs r ON r.user_id = t.user_id AND r.item_id = t.test_item_id
  GROUP BY t.user_id
),
cdiv AS (
  SELECT r.user_id, CAST(count(DISTINCT ci.topic) AS DOUBLE) / count(*) AS d
  FROM crecs r LEFT JOIN citems ci USING (item_id) GROUP BY r.user_id
),
cwide AS (
  SELECT
    (SELECT avg(CASE WHEN hit_rank <= 5 THEN 1.0 ELSE 0.0 END) FROM chit) AS "Recall@5",
    (SELECT avg(CASE WHEN hit_rank <= 5 THEN 1.0 / log2(hit_rank + 1.0) ELSE 0.0 END) FROM chit) AS "NDCG@5",
    (SELECT avg(CASE WHEN hit_rank <= 10 THEN 1.0 ELSE 0.0 END) FROM chit) AS "Recall@10",
    (SELECT avg(CASE WHEN hit_rank <= 10 THEN 1.0 / log2(hit_rank + 1.0) ELSE 0.0 END) FROM chit) AS "NDCG@10",
    (SELECT CAST(count(DISTINCT item_id) AS DOUBLE) FROM crecs WHERE item_id IN (SELECT item_id FROM ccatalog))
      / (SELECT count(*) FROM ccatalog) AS "Coverage",
    (SELECT coalesce(avg(d), 0.0) FROM cdiv) AS "Diversity"
),
cmetrics AS (
  SELECT metric, round(CAST(value AS DOUBLE), 6) AS value
  FROM (UNPIVOT cwide ON "Recall@5", "NDCG@5", "Recall@10", "NDCG@10", "Coverage", "Diversity" INTO NAME metric VALUE value)
)
"""

VEC = """
vec AS (SELECT CAST(vec_id AS VARCHAR) AS item_id, embedding FROM embeddings),
vexp AS MATERIALIZED (SELECT item_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS d FROM vec),
vnorm AS MATERIALIZED (SELECT item_id, greatest(sqrt(sum(x * x)), 1e-12) AS nrm FROM vexp GROUP BY item_id)
"""


EXAMPLES = """
idx AS (
  SELECT item_id, ROW_NUMBER() OVER (ORDER BY CAST(item_id AS DECIMAL(38,0))) AS item_index
  FROM (SELECT CAST(p_partkey AS VARCHAR) AS item_id FROM part UNION SELECT item_id FROM seq)
),
ttgt AS (SELECT s.user_id, i.item_index AS target_index FROM seq s JOIN idx i USING (item_id) WHERE s.pos = s.n - 1),
examples AS MATERIALIZED (
  SELECT s.user_id, CAST(s.pos - GREATEST(s.n - 2 - 64, 0) AS BIGINT) AS slot, CAST(coalesce(i.item_index, 0) AS BIGINT) AS item_index,
         CAST(CASE s.action WHEN 'short_view' THEN 1 WHEN 'valid_view' THEN 2 WHEN 'complete_view' THEN 3 WHEN 'high_interest' THEN 4 ELSE 0 END AS BIGINT) AS action_id,
         CAST(s.delta AS DOUBLE) AS time_gap, CAST(t.target_index AS BIGINT) AS target_index
  FROM seq s LEFT JOIN idx i USING (item_id) JOIN ttgt t USING (user_id)
  WHERE s.pos <= s.n - 2 AND s.pos > s.n - 2 - 64
)
"""


def cosine_scores(qexp: str) -> str:
    """Cosine of query vectors ``{qexp}(user_id, d, q)`` against every item vector."""
    return f"""
qn AS (SELECT user_id, greatest(sqrt(sum(q * q)), 1e-12) AS qnrm FROM {qexp} GROUP BY user_id),
dots AS MATERIALIZED (SELECT q.user_id, v.item_id, sum(q.q * v.x) AS dot FROM {qexp} q JOIN vexp v USING (d) GROUP BY q.user_id, v.item_id),
cos AS MATERIALIZED (
  SELECT d.user_id, d.item_id, d.dot / (qn.qnrm * vn.nrm) AS score
  FROM dots d JOIN qn USING (user_id) JOIN vnorm vn USING (item_id)
)"""


ORACLE: dict[str, str] = {
    "content_sequences": with_(CONTENT) + """
SELECT user_id, CAST(pos AS BIGINT) AS pos, CAST(n AS BIGINT) AS n, item_id, round(event_weight, 6) AS event_weight FROM cseq""",
    "ranking_metrics": with_(CONTENT, CPOP, CMETRICS) + "SELECT metric, value FROM cmetrics",
    "coverage_diversity": with_(CONTENT, CCF, CMETRICS) + "SELECT metric, value FROM cmetrics WHERE metric IN ('Coverage', 'Diversity')",
    "content_itemcf_topk": with_(CONTENT, CCF) + "SELECT user_id, CAST(rank AS BIGINT) AS rank, item_id, round(score, 6) AS score FROM crecs",
    "cosine_topk": with_(VEC, "vq AS (SELECT item_id AS user_id, d, x AS q FROM vexp)", cosine_scores("vq")) + """
SELECT user_id AS item_id, CAST(rank AS BIGINT) AS rank, item_id AS neighbor_id, round(score, 6) AS score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM cos
) WHERE rank <= 10""",
    "mean_query_topk": with_(CONTENT, VEC, """
vh AS (SELECT user_id, item_id FROM cseq WHERE pos <= n - 1),
vq AS (SELECT h.user_id, v.d, avg(v.x) AS q FROM vh h JOIN vexp v USING (item_id) GROUP BY h.user_id, v.d)""", cosine_scores("vq")) + """
SELECT user_id, CAST(rank AS BIGINT) AS rank, item_id, round(score, 6) AS score FROM (
  SELECT c.*, ROW_NUMBER() OVER (PARTITION BY c.user_id ORDER BY c.score DESC, c.item_id) AS rank FROM cos c
  WHERE NOT EXISTS (SELECT 1 FROM vh h WHERE h.user_id = c.user_id AND h.item_id = c.item_id)
) WHERE rank <= 10""",
    "contrastive_loss": with_(CONTENT, VEC, """
uq AS MATERIALIZED (
  SELECT s.user_id, v.d, avg(v.x) AS q FROM cseq s JOIN vexp v USING (item_id) WHERE s.pos <= s.n - 2 GROUP BY s.user_id, v.d
),
tv AS MATERIALIZED (SELECT s.user_id, v.d, v.x FROM cseq s JOIN vexp v USING (item_id) WHERE s.pos = s.n - 1),
pu AS (
  SELECT user_id, (ROW_NUMBER() OVER (ORDER BY user_id) - 1) // 32 AS batch_id
  FROM (SELECT DISTINCT user_id FROM uq WHERE user_id IN (SELECT user_id FROM tv))
),
logits AS MATERIALIZED (
  SELECT a.user_id AS i, b.user_id AS j, sum(q.q * t.x) / 0.07 AS z
  FROM pu a JOIN pu b ON a.batch_id = b.batch_id
  JOIN uq q ON q.user_id = a.user_id JOIN tv t ON t.user_id = b.user_id AND t.d = q.d
  GROUP BY a.user_id, b.user_id
),
per_row AS (
  SELECT i, max(z) AS m, max(CASE WHEN i = j THEN z END) AS pz FROM logits GROUP BY i
),
lse AS (
  SELECT p.i, p.m + ln(sum(exp(l.z - p.m))) - p.pz AS row_loss FROM per_row p JOIN logits l ON l.i = p.i GROUP BY p.i, p.m, p.pz
)""") + "SELECT round(avg(row_loss), 6) AS loss FROM lse",
    "training_examples": with_(WATCH, EXAMPLES) + """
SELECT user_id, slot, item_index, action_id, round(time_gap, 6) AS time_gap, target_index FROM examples""",
    "training_log_gaps": with_(WATCH, EXAMPLES) + "SELECT user_id, slot, round(ln(1 + time_gap), 6) AS log_gap FROM examples",
    "padded_examples": with_(WATCH, EXAMPLES, """
slots AS (SELECT user_id, target_index, unnest(range(1, 65)) AS slot FROM (SELECT DISTINCT user_id, target_index FROM examples))""") + """
SELECT s.user_id, string_agg(CAST(coalesce(e.item_index, 0) AS VARCHAR), ',' ORDER BY s.slot) AS item_ids,
       string_agg(CAST(coalesce(e.action_id, 0) AS VARCHAR), ',' ORDER BY s.slot) AS action_ids,
       string_agg(CAST(CAST(coalesce(e.time_gap, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY s.slot) AS time_gaps, s.target_index
FROM slots s LEFT JOIN examples e ON e.user_id = s.user_id AND e.slot = s.slot
GROUP BY s.user_id, s.target_index""",
    "mean_query_candidates_topk": with_(CONTENT, VEC, """
vh AS (SELECT user_id, item_id FROM cseq WHERE pos <= n - 1),
vq AS (SELECT h.user_id, v.d, avg(v.x) AS q FROM vh h JOIN vexp v USING (item_id) GROUP BY h.user_id, v.d)""", cosine_scores("vq")) + """
SELECT user_id, CAST(rank AS BIGINT) AS rank, item_id, round(score, 6) AS score FROM (
  SELECT c.*, ROW_NUMBER() OVER (PARTITION BY c.user_id ORDER BY c.score DESC, c.item_id) AS rank FROM cos c
  WHERE c.item_id IN (SELECT test_item_id FROM ctgt)
    AND NOT EXISTS (SELECT 1 FROM vh h WHERE h.user_id = c.user_id AND h.item_id = c.item_id)
) WHERE rank <= 10""",
    "popular_log_scores": with_(CONTENT) + """
SELECT CAST(item_id AS VARCHAR) AS item_id, round(sum(w), 6) AS score FROM pev WHERE item_id IS NOT NULL GROUP BY item_id""",
    "hit_rate_popular": with_(WATCH, POP) + """
SELECT t.user_id, round(t.test_action_weight * CASE WHEN r.rank IS NULL THEN 0 ELSE 1 END, 6) AS hit
FROM tgt t LEFT JOIN pop_recs r ON r.user_id = t.user_id AND r.item_id = t.test_item_id""",
    "itemcf_neighbors_all": with_(WATCH, """
held AS MATERIALIZED (SELECT DISTINCT user_id, item_id FROM train),
shared AS (
  SELECT a.item_id, b.item_id AS neighbor_id, CAST(count(*) AS DOUBLE) AS sim
  FROM held a JOIN held b ON a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY a.item_id, b.item_id
)""") + """
SELECT item_id, neighbor_id, round(sim, 6) AS sim,
       CAST(ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY sim DESC, neighbor_id) AS BIGINT) AS nrank FROM shared""",
    "freshness_longtail": with_(WATCH, POP.replace("rank <= 20", "rank <= 30"), CONTENT) + """
SELECT r.user_id, r.item_id, CAST(r.rank AS BIGINT) AS rank,
       round(1.0 / r.rank + CASE WHEN coalesce(ci.publish_time >= TIMESTAMP '1998-07-25 00:00:00', false) THEN 0.15 ELSE 0.0 END, 6) AS adjusted_score,
       coalesce(ci.publish_time >= TIMESTAMP '1998-07-25 00:00:00', false) AS is_fresh,
       (ci.exposure_count <= 25 AND ci.quality_score >= 0.85) AS is_long_tail
FROM pop_recs r JOIN citems ci USING (item_id)""",
    "sid_transitions": with_(WATCH, SIDS) + "SELECT src, dst, round(cnt, 6) AS cnt FROM trans",
    "sid_global_counts": with_(WATCH, SIDS) + "SELECT sid, round(cnt, 6) AS cnt FROM gcnt",
    "sid_decode": with_(WATCH, SIDS) + """
SELECT sid, item_id, CAST(ROW_NUMBER() OVER (PARTITION BY sid ORDER BY item_id) AS BIGINT) AS item_pos FROM sidmap""",
    "beam_search": with_(WATCH, BEAM) + """
SELECT user_id, array_to_string(path, '>') AS path, round(score, 6) AS score FROM best""",
    "generative_topk": with_(WATCH, BEAM, GEN) + """
SELECT user_id, CAST(rank AS BIGINT) AS rank, item_id, CASE WHEN src = 0 THEN 'generated' ELSE 'global' END AS source
FROM gen_recs""",
    "attach_actions": with_(WATCH) + """
SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(video_id AS VARCHAR) AS video_id, CAST(row_ix AS BIGINT) AS row_ix,
       round(watch_ratio, 6) AS watch_ratio, action, round(action_weight, 6) AS action_weight
FROM lw""",
    "sequence_positions": with_(WATCH) + """
SELECT user_id, CAST(pos AS BIGINT) AS pos, CAST(n AS BIGINT) AS n, item_id, action, round(action_weight, 6) AS action_weight FROM seq""",
    "time_deltas": with_(WATCH) + """
SELECT user_id, CAST(pos AS BIGINT) AS pos, CAST(ts AS BIGINT) AS ts, CAST(delta AS BIGINT) AS delta FROM seq""",
    "sequence_split": with_(WATCH) + """
SELECT user_id, validation_item_id, test_item_id, validation_action, test_action,
       round(validation_action_weight, 6) AS validation_action_weight, round(test_action_weight, 6) AS test_action_weight,
       CAST(train_length AS BIGINT) AS train_length, CAST(sequence_length AS BIGINT) AS sequence_length FROM tgt""",
    "train_view": with_(WATCH) + """
SELECT user_id, CAST(pos AS BIGINT) AS pos, CAST(n - 2 AS BIGINT) AS train_length, item_id, round(event_weight, 6) AS event_weight FROM train""",
    "candidates": with_(WATCH) + """
SELECT item_id, CAST(ROW_NUMBER() OVER (ORDER BY CASE WHEN regexp_full_match(item_id, '[0-9]+') THEN 0 ELSE 1 END,
       CASE WHEN regexp_full_match(item_id, '[0-9]+') THEN CAST(item_id AS DECIMAL(38,0)) END, item_id) AS BIGINT) AS candidate_pos
FROM cands""",
    "popular_scores": with_(WATCH, POP) + "SELECT item_id, round(score, 6) AS score FROM pop_scores",
    "popular_topk": with_(WATCH, POP) + "SELECT user_id, CAST(rank AS BIGINT) AS rank, item_id, round(score, 6) AS score FROM pop_recs",
    "eval_popular": segmented(POP.strip() + ",\nrecs AS (SELECT user_id, item_id, rank FROM pop_recs)"),
    "itemcf_neighbors": with_(WATCH, ITEMCF) + """
SELECT item_id, neighbor_id, round(sim, 6) AS sim, CAST(nrank AS BIGINT) AS nrank FROM cf_nbrs""",
    "itemcf_topk": with_(WATCH, ITEMCF) + "SELECT user_id, CAST(rank AS BIGINT) AS rank, item_id, round(score, 6) AS score FROM cf_recs",
    "itemcf_neighbors_top": with_(WATCH, ITEMCF_ALL) + """
SELECT item_id, neighbor_id, round(sim, 6) AS sim, CAST(nrank AS BIGINT) AS nrank FROM cf_nbrs WHERE nrank <= 50""",
    "itemcf_topk_all": with_(WATCH, ITEMCF_ALL) + "SELECT user_id, CAST(rank AS BIGINT) AS rank, item_id, round(score, 6) AS score FROM cf_recs",
    "eval_itemcf_all": segmented(ITEMCF_ALL.strip() + ",\nrecs AS (SELECT user_id, item_id, rank FROM cf_recs)"),
    "eval_itemcf": segmented(ITEMCF.strip() + ",\nrecs AS (SELECT user_id, item_id, rank FROM cf_recs)"),
    "item_features": with_(ITEMS) + """
SELECT item_id, title, body, topic, author_id, round(duration, 6) AS duration, round(quality_score, 6) AS quality_score,
       round(hot_score, 6) AS hot_score, caption_text, category_text FROM feat""",
    "user_features": with_(WATCH) + """
SELECT u.user_id, CAST(coalesce(c.cnt, 0) AS BIGINT) AS interaction_count,
       CASE WHEN coalesce(c.cnt, 0) < 2 THEN 'short' WHEN coalesce(c.cnt, 0) < 10 THEN 'medium' ELSE 'long' END AS activity_bucket,
       p.c_mktsegment AS user_active_degree, CAST(p.c_nationkey AS BIGINT) AS nation
FROM (SELECT CAST(user_id AS VARCHAR) AS user_id FROM wm UNION SELECT CAST(c_custkey AS VARCHAR) FROM customer) u
LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS cnt FROM wm GROUP BY 1) c USING (user_id)
LEFT JOIN customer p ON CAST(p.c_custkey AS VARCHAR) = u.user_id""",
    "popularity_buckets": with_(ITEMS) + "SELECT item_id, round(hot_score, 6) AS hot_score, bucket FROM pbucket",
    "collision_purity": with_(WATCH, SIDS, """
sm AS (SELECT m.item_id, m.sid, p.p_type AS topic FROM sidmap m JOIN part p ON CAST(p.p_partkey AS VARCHAR) = m.item_id),
dom AS (SELECT sid, max(c) AS top FROM (SELECT sid, topic, count(*) AS c FROM sm GROUP BY sid, topic) GROUP BY sid)""") + """
SELECT round(CAST((SELECT count(*) FROM sm) AS DOUBLE), 6) AS item_count,
       round(CAST((SELECT count(*) FROM dom) AS DOUBLE), 6) AS semantic_id_unique,
       round(1.0 - CAST((SELECT count(*) FROM dom) AS DOUBLE) / (SELECT count(*) FROM sm), 6) AS collision_rate,
       round(CAST((SELECT sum(top) FROM dom) AS DOUBLE) / (SELECT count(*) FROM sm), 6) AS topic_purity""",
    "bucket_collision": with_(WATCH, SIDS, ITEMS, """
bm AS (SELECT m.sid, coalesce(f.hot_score, 0.0) AS hot FROM sidmap m LEFT JOIN feat f USING (item_id)),
bq AS (SELECT quantile_cont(hot, 0.66) AS hi, quantile_cont(hot, 0.33) AS lo FROM bm),
bb AS (
  SELECT sid, hot >= hi AS is_head, hot < hi AND hot > lo AS is_middle, hot <= lo AS is_tail FROM bm, bq
)""") + """
SELECT
  round(CASE WHEN count(*) FILTER (WHERE is_head) > 0 THEN 1.0 - CAST(count(DISTINCT sid) FILTER (WHERE is_head) AS DOUBLE) / count(*) FILTER (WHERE is_head) ELSE 0.0 END, 6) AS collision_rate_head,
  round(CASE WHEN count(*) FILTER (WHERE is_middle) > 0 THEN 1.0 - CAST(count(DISTINCT sid) FILTER (WHERE is_middle) AS DOUBLE) / count(*) FILTER (WHERE is_middle) ELSE 0.0 END, 6) AS collision_rate_middle,
  round(CASE WHEN count(*) FILTER (WHERE is_tail) > 0 THEN 1.0 - CAST(count(DISTINCT sid) FILTER (WHERE is_tail) AS DOUBLE) / count(*) FILTER (WHERE is_tail) ELSE 0.0 END, 6) AS collision_rate_tail
FROM bb""",
    "protocol_violations": with_(WATCH, """
cstat AS (SELECT count(*) AS nrows, count(DISTINCT item_id) AS ndist FROM cands),
useq AS (SELECT user_id, max(n) AS n FROM seq GROUP BY user_id),
pstat AS (
  SELECT user_id, count(*) AS nrows, count(DISTINCT pos) AS dpos, min(pos) AS pmin, max(pos) AS pmax, max(n) AS nmax, min(n) AS nmin
  FROM seq GROUP BY user_id
),
checks AS (
  SELECT 'manifest.schema_version' AS rule, 0 AS violations
  UNION ALL SELECT 'manifest.protocol_name', 0
  UNION ALL SELECT 'manifest.ranking_mode', 0
  UNION ALL SELECT 'manifest.empty_universe', (SELECT CASE WHEN nrows = 0 THEN 1 ELSE 0 END FROM cstat)
  UNION ALL SELECT 'manifest.duplicate_ids', (SELECT CASE WHEN nrows <> ndist THEN 1 ELSE 0 END FROM cstat)
  UNION ALL SELECT 'manifest.count_mismatch', 0
  UNION ALL SELECT 'manifest.fit_history_field', 0
  UNION ALL SELECT 'manifest.history_field', 0
  UNION ALL SELECT 'manifest.target_field', 0
  UNION ALL SELECT 'sequence.missing_user_id', (SELECT count(*) FROM useq WHERE coalesce(user_id, '') = '')
  UNION ALL SELECT 'sequence.incomplete_split', (SELECT count(*) FROM useq WHERE n < 2)
  UNION ALL SELECT 'sequence.position_gap', (SELECT count(*) FROM pstat WHERE pmin <> 1 OR pmax <> nmax OR dpos <> nrows OR nrows <> nmax OR nmin <> nmax)
  UNION ALL SELECT 'sequence.unreachable_target', (SELECT count(*) FROM tgt WHERE test_item_id NOT IN (SELECT item_id FROM cands))
)""") + "SELECT rule, CAST(violations AS BIGINT) AS violations FROM checks",
    "recommendation_violations": with_(WATCH, POP, """
nc AS (SELECT count(DISTINCT item_id) AS nc FROM cands),
nh AS (SELECT h.user_id, count(*) AS nh FROM hist h WHERE h.item_id IN (SELECT item_id FROM cands) GROUP BY h.user_id),
got AS (SELECT user_id, count(*) AS got FROM pop_recs GROUP BY user_id),
checks AS (
  SELECT 'recs.missing_user' AS rule, (SELECT count(*) FROM users WHERE user_id NOT IN (SELECT user_id FROM pop_recs)) AS violations
  UNION ALL SELECT 'recs.extra_user', (SELECT count(DISTINCT user_id) FROM pop_recs WHERE user_id NOT IN (SELECT user_id FROM users))
  UNION ALL SELECT 'recs.duplicate_item', (SELECT count(*) FROM (SELECT user_id, item_id FROM pop_recs GROUP BY 1, 2 HAVING count(*) > 1))
  UNION ALL SELECT 'recs.outside_candidates', (SELECT count(*) FROM pop_recs WHERE item_id NOT IN (SELECT item_id FROM cands))
  UNION ALL SELECT 'recs.history_leak', (SELECT count(*) FROM pop_recs r JOIN hist h USING (user_id, item_id))
  UNION ALL SELECT 'recs.count_mismatch', (
    SELECT count(*) FROM users u LEFT JOIN nh USING (user_id) LEFT JOIN got USING (user_id), nc
    WHERE coalesce(got, 0) <> LEAST(20, nc - coalesce(nh, 0)))
)""") + "SELECT rule, CAST(violations AS BIGINT) AS violations FROM checks",
    "data_violations": with_(CONTENT, """
iv AS (SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS item_id, et, ts, dwell_time FROM ev),
cu AS (SELECT CAST(c_custkey AS VARCHAR) AS user_id FROM customer),
checks AS (
  SELECT 'items.duplicate_item_id' AS rule, (SELECT count(*) FROM (SELECT item_id FROM citems GROUP BY item_id HAVING count(*) > 1)) AS violations
  UNION ALL SELECT 'items.invalid_publish_time', 0
  UNION ALL SELECT 'items.invalid_quality_score', 0
  UNION ALL SELECT 'users.duplicate_user_id', (SELECT count(*) FROM (SELECT user_id FROM cu GROUP BY user_id HAVING count(*) > 1))
  UNION ALL SELECT 'interactions.invalid_event_type', (SELECT count(DISTINCT et) FROM iv WHERE et IS NOT NULL AND et NOT IN ('click', 'like', 'collect', 'skip'))
  UNION ALL SELECT 'interactions.invalid_event_time', 0
  UNION ALL SELECT 'interactions.invalid_dwell_time', 0
  UNION ALL SELECT 'interactions.negative_dwell_time', (SELECT count(*) FROM iv WHERE dwell_time < 0)
  UNION ALL SELECT 'interactions.unknown_item', (SELECT count(*) FROM (SELECT DISTINCT item_id FROM iv) WHERE item_id NOT IN (SELECT item_id FROM citems))
  UNION ALL SELECT 'interactions.unknown_user', (SELECT count(*) FROM (SELECT DISTINCT user_id FROM iv) WHERE user_id NOT IN (SELECT user_id FROM cu))
)""") + "SELECT rule, CAST(violations AS BIGINT) AS violations FROM checks",
}
