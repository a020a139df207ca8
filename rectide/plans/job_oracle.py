"""DuckDB SQL of the queries in ``job_queries`` and of the hashed neighbours."""

from __future__ import annotations

from rectide.plans.oracle import CMETRICS, CONTENT, CPOP, ORACLE, POP, VEC, WATCH, cosine_scores, with_

REQUESTS = """
rq AS MATERIALIZED (
  SELECT 'r' || c_custkey AS request_id, CAST(c_custkey AS VARCHAR) AS user_id, c_mktsegment AS act,
         CASE WHEN c_nationkey = 7 THEN NULL ELSE c_nationkey + 1 END AS top_k
  FROM customer
),
rh AS MATERIALIZED (SELECT 'r' || o_custkey AS user_id, CAST(o_orderkey % 1000 AS VARCHAR) AS item_id FROM orders
                    WHERE o_custkey IN (SELECT c_custkey FROM customer)),
rmean AS (SELECT h.user_id, v.d, avg(v.x) AS q FROM rh h JOIN vexp v USING (item_id) GROUP BY h.user_id, v.d),
vq AS MATERIALIZED (
  SELECT * FROM rmean
  UNION ALL SELECT r.request_id, g.d, g.q FROM rq r CROSS JOIN (SELECT d, avg(x) AS q FROM vexp GROUP BY d) g
  WHERE r.request_id NOT IN (SELECT user_id FROM rmean)
)
"""

SIDS = """
tcode AS (SELECT p_type, ROW_NUMBER() OVER (ORDER BY p_type) - 1 AS c FROM (SELECT DISTINCT p_type FROM part)),
sids AS (
  SELECT CAST(p_partkey AS VARCHAR) AS item_id,
         t.c || '-' || (CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) - 1) || '-' || (p_size % 4) AS sid
  FROM part JOIN tcode t USING (p_type)
)
"""

BROKEN = """
bitems AS (
  SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_size, CASE WHEN p_size = 17 THEN 2 ELSE 1 END AS copies FROM part
),
bev AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) * 40 AS VARCHAR) AS item_id,
         event_type, CASE WHEN event_type = 'click' THEN NULL ELSE value - 20 END AS dwell
  FROM events
),
checks AS (
  SELECT 'items.duplicate_item_id' AS rule, (SELECT count(*) FROM bitems WHERE copies > 1) AS violations
  UNION ALL SELECT 'items.invalid_publish_time', (SELECT count(*) FROM bitems WHERE p_size = 7)
  UNION ALL SELECT 'items.invalid_quality_score', (SELECT count(*) FROM bitems WHERE p_size = 11)
  UNION ALL SELECT 'items.quality_out_of_range', (SELECT count(*) FROM bitems WHERE p_size = 13)
  UNION ALL SELECT 'users.duplicate_user_id', (SELECT count(*) FROM customer WHERE c_nationkey = 3)
  UNION ALL SELECT 'interactions.invalid_event_type', (SELECT count(DISTINCT event_type) FROM bev WHERE event_type NOT IN ('click', 'like', 'collect', 'skip'))
  UNION ALL SELECT 'interactions.invalid_event_time', (SELECT count(*) FROM bev WHERE event_type = 'view')
  UNION ALL SELECT 'interactions.invalid_dwell_time', (SELECT count(*) FROM bev WHERE event_type = 'click')
  UNION ALL SELECT 'interactions.negative_dwell_time', (SELECT count(*) FROM bev WHERE dwell < 0)
  UNION ALL SELECT 'interactions.unknown_item', (SELECT count(DISTINCT item_id) FROM bev WHERE item_id NOT IN (SELECT item_id FROM bitems))
  UNION ALL SELECT 'interactions.unknown_user', (SELECT count(DISTINCT user_id) FROM bev WHERE user_id NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer))
)
"""

BROKEN_ROWS = """
lists AS (
  SELECT user_id, max(n) AS n, list(item_id ORDER BY pos) AS items FROM seq GROUP BY user_id
),
twice AS (SELECT * FROM lists UNION ALL SELECT * FROM lists WHERE n % 8 = 0),
brows AS MATERIALIZED (
  SELECT CASE WHEN n % 9 = 0 THEN '' ELSE user_id END AS user_id, n, items,
         CASE WHEN n % 6 = 0 THEN items[1] ELSE items[n - 1] END AS val,
         CASE WHEN n % 10 = 0 THEN '' WHEN n % 7 = 0 THEN 'gone' || items[n] ELSE items[n] END AS test
  FROM twice
),
cn AS (SELECT count(*) AS c FROM cands),
checks AS (
  SELECT 'manifest.schema_version' AS rule, (SELECT count(*) FROM nation WHERE n_regionkey = 0) AS violations
  UNION ALL SELECT 'manifest.protocol_name', (SELECT count(*) FROM nation WHERE n_regionkey = 1)
  UNION ALL SELECT 'manifest.ranking_mode', (SELECT count(*) FROM nation WHERE n_regionkey = 2)
  UNION ALL SELECT 'manifest.empty_universe', (SELECT count(*) FROM nation, cn WHERE c = 0)
  UNION ALL SELECT 'manifest.duplicate_ids', (SELECT count(*) FROM nation, cn WHERE c > 0)
  UNION ALL SELECT 'manifest.count_mismatch', (SELECT count(*) FROM nation, cn WHERE n_nationkey <> c + least(c, 5))
  UNION ALL SELECT 'manifest.fit_history_field', (SELECT count(*) FROM nation WHERE n_regionkey = 3)
  UNION ALL SELECT 'manifest.history_field', (SELECT count(*) FROM nation WHERE n_regionkey = 4)
  UNION ALL SELECT 'manifest.target_field', (SELECT count(*) FROM nation WHERE n_nationkey = 3)
  UNION ALL SELECT 'sequence.missing_user_id', (SELECT count(*) FROM brows WHERE user_id = '')
  UNION ALL SELECT 'sequence.incomplete_split', (SELECT count(*) FROM brows WHERE n < 2 OR val = '' OR test = '')
  UNION ALL SELECT 'sequence.train_history_leak', (SELECT count(*) FROM brows WHERE n % 3 = 0)
  UNION ALL SELECT 'sequence.validation_not_penultimate', (SELECT count(*) FROM brows WHERE val <> items[n - 1])
  UNION ALL SELECT 'sequence.test_history_mismatch', (SELECT count(*) FROM brows WHERE n % 4 = 0)
  UNION ALL SELECT 'sequence.test_not_last', (SELECT count(*) FROM brows WHERE test <> items[n])
  UNION ALL SELECT 'sequence.short_actions', (SELECT count(*) FROM brows WHERE n % 5 = 0 AND CASE WHEN n % 3 = 0 THEN n - 1 ELSE n - 2 END > 1)
  UNION ALL SELECT 'sequence.duplicate_user', (SELECT count(*) FROM (SELECT user_id FROM brows GROUP BY user_id HAVING count(*) > 1))
  UNION ALL SELECT 'sequence.unreachable_target', (SELECT count(*) FROM brows WHERE test <> '' AND test NOT IN (SELECT item_id FROM cands))
)
"""

TFIDF = """
tok AS MATERIALIZED (
  SELECT CAST(doc_id AS VARCHAR) AS item_id,
         unnest(regexp_extract_all(lower(concat_ws(' ', text, lang)), '[\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\x{200c}\\x{200d}]{2,}')) AS term
  FROM documents
),
vocab AS (SELECT term, count(DISTINCT item_id) AS df FROM tok GROUP BY term ORDER BY count(*) DESC, term LIMIT 2048),
raw AS MATERIALIZED (
  SELECT t.item_id, t.term, count(*) * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + any_value(v.df))) + 1.0) AS w
  FROM tok t JOIN vocab v USING (term) GROUP BY t.item_id, t.term
)
"""

# one row a user and place; a place goes to the best candidate whose author has
# room, another topic than the last first
GREEDY = """
enr AS MATERIALIZED (
  SELECT r.user_id, r.item_id, ci.topic, ci.author_id, ci.quality_score, ci.exposure_count,
         1.0 / r.rank + CASE WHEN coalesce(ci.publish_time >= TIMESTAMP '1998-07-25 00:00:00', false) THEN 0.15 ELSE 0.0 END AS adj,
         ci.exposure_count <= 25 AND ci.quality_score >= 0.85 AS tail
  FROM pop_recs r JOIN citems ci USING (item_id)
),
kept AS MATERIALIZED (
  SELECT * FROM enr WHERE tail QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY quality_score DESC, exposure_count, item_id) = 1
),
pool AS MATERIALIZED (
  SELECT e.*, ROW_NUMBER() OVER (PARTITION BY e.user_id ORDER BY e.adj DESC, e.topic, e.item_id) AS o
  FROM enr e WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.user_id = e.user_id AND k.item_id = e.item_id)
),
places AS (
  SELECT u.user_id, 0 AS place, 10 - CASE WHEN k.user_id IS NULL THEN 0 ELSE 1 END AS free,
         CAST([] AS VARCHAR[]) AS items, CAST([] AS VARCHAR[]) AS authors, CAST(NULL AS VARCHAR) AS topic
  FROM (SELECT DISTINCT user_id FROM enr) u LEFT JOIN kept k USING (user_id)
  UNION ALL
  SELECT user_id, place, free, items, authors, topic FROM (
    SELECT s.user_id, s.place + 1 AS place, s.free, list_append(s.items, p.item_id) AS items,
           list_append(s.authors, p.author_id) AS authors, p.topic,
           ROW_NUMBER() OVER (PARTITION BY s.user_id ORDER BY coalesce(p.topic = s.topic, false), p.o) AS best
    FROM places s JOIN pool p ON p.user_id = s.user_id
    WHERE s.place < s.free AND NOT list_contains(s.items, p.item_id)
      AND len(list_filter(s.authors, lambda a: a = p.author_id)) < 2
  ) WHERE best = 1
),
finals AS MATERIALIZED (SELECT * FROM places QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY place DESC) = 1),
chosen AS (
  SELECT user_id, unnest(items) AS item_id, unnest(range(1, len(items) + 1)) AS rerank_pos, 'ranked' AS source_reason FROM finals
  UNION ALL
  SELECT f.user_id, k.item_id, f.place + 1, 'long_tail_protection' FROM finals f JOIN kept k USING (user_id)
  WHERE f.place < 10 AND len(list_filter(f.authors, lambda a: a = k.author_id)) < 2
)
"""


def lloyd(tag: str, level: int, points: str, rounds: int = 3, starts: int = 3, k: int = 8, seed: int = 42) -> str:
    """Seeds of least md5, ``rounds`` Lloyd rounds over ``points(item_id, d, x)``, and ``{tag}book(code, d, c)`` of the best start."""
    text = f"""
{tag}seed AS (
  SELECT s.start, item_id, ROW_NUMBER() OVER (PARTITION BY s.start ORDER BY md5('{seed}:{level}:' || s.start || ':' || item_id), item_id) - 1 AS code
  FROM vec CROSS JOIN (SELECT unnest(range({starts})) AS start) s
  QUALIFY ROW_NUMBER() OVER (PARTITION BY s.start ORDER BY md5('{seed}:{level}:' || s.start || ':' || item_id), item_id) <= {k}
),
{tag}c0 AS MATERIALIZED (SELECT s.start, s.code, p.d, p.x AS c FROM {tag}seed s JOIN {points} p USING (item_id)),"""
    for r in range(rounds + 1):
        text += f"""
{tag}n{r} AS MATERIALIZED (
  SELECT p.item_id, c.start, c.code, sum((p.x - c.c) * (p.x - c.c)) AS d2 FROM {points} p JOIN {tag}c{r} c USING (d)
  GROUP BY p.item_id, c.start, c.code
  QUALIFY ROW_NUMBER() OVER (PARTITION BY p.item_id, c.start ORDER BY d2, c.code) = 1
),"""
        if r < rounds:
            text += f"""
{tag}m{r} AS (SELECT n.start, n.code, p.d, avg(p.x) AS c FROM {tag}n{r} n JOIN {points} p USING (item_id) GROUP BY n.start, n.code, p.d),
{tag}c{r + 1} AS MATERIALIZED (SELECT c.start, c.code, c.d, coalesce(m.c, c.c) AS c FROM {tag}c{r} c LEFT JOIN {tag}m{r} m USING (start, code, d)),"""
    return text + f"""
{tag}best AS (SELECT start FROM {tag}n{rounds} GROUP BY start ORDER BY round(sum(d2), 6), start LIMIT 1),
{tag}code AS MATERIALIZED (SELECT item_id, code, d2 FROM {tag}n{rounds} WHERE start = (SELECT start FROM {tag}best)),
{tag}book AS MATERIALIZED (SELECT code, d, c FROM {tag}c{rounds} WHERE start = (SELECT start FROM {tag}best))"""


INDEPENDENT = (VEC, lloyd("a", 0, "vexp"), lloyd("b", 1, "vexp"), """
coded AS (SELECT a.item_id, a.code || '-' || b.code AS sid, a.d2 + b.d2 AS error FROM acode a JOIN bcode b USING (item_id))""")
RESIDUAL = (VEC, lloyd("a", 0, "vexp"), """
rest AS MATERIALIZED (
  SELECT v.item_id, v.d, v.x - b.c AS x FROM vexp v JOIN acode a USING (item_id) JOIN abook b ON b.code = a.code AND b.d = v.d
)""", lloyd("b", 1, "rest"))
GREEDY_CODES = "coded AS (SELECT a.item_id, a.code || '-' || b.code AS sid, b.d2 AS error FROM acode a JOIN bcode b USING (item_id))"
# the four nearest codes of the first level, each with its nearest of the second
BEAM_CODES = """
firsts AS MATERIALIZED (
  SELECT v.item_id, b.code, sum((v.x - b.c) * (v.x - b.c)) AS d2 FROM vexp v JOIN abook b USING (d) GROUP BY v.item_id, b.code
  QUALIFY ROW_NUMBER() OVER (PARTITION BY v.item_id ORDER BY d2, b.code) <= 4
),
pathrest AS MATERIALIZED (
  SELECT f.item_id, f.code AS a, f.d2 AS a2, v.d, v.x - b.c AS x FROM firsts f JOIN vexp v USING (item_id) JOIN abook b ON b.code = f.code AND b.d = v.d
),
coded AS MATERIALIZED (
  SELECT p.item_id, p.a || '-' || b.code AS sid, sum((p.x - b.c) * (p.x - b.c)) AS error
  FROM pathrest p JOIN bbook b USING (d) GROUP BY p.item_id, p.a, p.a2, b.code
  QUALIFY ROW_NUMBER() OVER (PARTITION BY p.item_id ORDER BY error, p.a2, p.a, b.code) = 1
)"""
CODES_OUT = """
SELECT c.item_id, CAST(e.label AS VARCHAR) AS topic, c.sid AS semantic_id_str, round(c.error, 6) AS error
FROM coded c JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = c.item_id"""


def figures(method: str, *fragments: str) -> str:
    return with_(*fragments, """
bytopic AS (SELECT c.sid, e.label, count(*) AS n FROM coded c JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = c.item_id GROUP BY 1, 2),
tops AS (SELECT sid, max(n) AS top FROM bytopic GROUP BY sid),
q AS (SELECT (SELECT count(*) FROM coded) AS n, (SELECT avg(error) FROM coded) AS err, count(*) AS u, sum(top) AS top FROM tops)""") + f"""
SELECT '{method}' AS method, unnest(['item_count', 'semantic_id_unique', 'collision_rate', 'topic_purity', 'mean_error']) AS metric,
       round(unnest([n::DOUBLE, u::DOUBLE, 1.0 - u::DOUBLE / n, top::DOUBLE / n, err]), 6) AS value FROM q"""


JOB_ORACLE: dict[str, str] = {
    "unseen_interactions": """
WITH e AS (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, event_type FROM events)
SELECT CAST(event_id AS BIGINT) AS row_ix, CAST(user_id AS BIGINT) AS user_id, item_id,
       CASE event_type WHEN 'view' THEN 'click' WHEN 'click' THEN 'like' WHEN 'purchase' THEN 'collect' ELSE 'skip' END AS event_type
FROM e WHERE NOT EXISTS (SELECT 1 FROM e p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.item_id = e.item_id)""",
    "first_tokens": """
SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(regexp_extract(text, '[^|\\s\\x0b]+'), '') AS token,
       coalesce(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) <> '' AND lower(trim(text)) <> 'nan', false) AS has_text
FROM documents""",
    "sampled_log": """
WITH w AS (
  SELECT l_orderkey * 8 + l_linenumber AS row_ix, o_custkey AS user_id, l_partkey AS video_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
),
u AS (SELECT user_id FROM w GROUP BY user_id ORDER BY min(row_ix) LIMIT 100)
SELECT CAST(row_ix AS BIGINT) AS row_ix, CAST(user_id AS BIGINT) AS user_id, CAST(video_id AS BIGINT) AS video_id
FROM w WHERE user_id IN (SELECT user_id FROM u) ORDER BY row_ix LIMIT 1000""",
    "tokenizer_kmeans": with_(*INDEPENDENT) + CODES_OUT,
    "tokenizer_residual": with_(*RESIDUAL, GREEDY_CODES) + CODES_OUT,
    "tokenizer_beam": with_(*RESIDUAL, BEAM_CODES) + CODES_OUT,
    "tokenizer_quality": "SELECT * FROM (" + figures("tokenizer_kmeans", *INDEPENDENT) + ") UNION ALL SELECT * FROM ("
    + figures("tokenizer_residual", *RESIDUAL, BEAM_CODES) + ")",
    "tfidf_weights_all": with_(TFIDF.replace("ORDER BY count(*) DESC, term LIMIT 2048", "")) + """
SELECT item_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS weight FROM raw""",
    "tfidf_weights": with_(TFIDF) + """
SELECT item_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS weight FROM raw""",
    "rerank": with_(WATCH, POP.replace("rank <= 20", "rank <= 30"), CONTENT, GREEDY).replace("WITH ", "WITH RECURSIVE ", 1) + """
SELECT c.user_id, CAST(c.rerank_pos AS BIGINT) AS rerank_pos, c.item_id, round(e.adj, 6) AS adjusted_score, c.source_reason
FROM chosen c JOIN enr e USING (user_id, item_id)""",
    "csv_bundle_read": with_(WATCH) + """
SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(video_id AS VARCHAR) AS video_id, ts_raw AS timestamp, round(watch_ratio, 6) AS watch_ratio FROM wm""",
    "csv_captions_read": """
SELECT CAST(p_partkey AS VARCHAR) AS video_id, p_name || chr(10) || '"' || p_type || '", ' || p_brand AS caption,
       lower(p_type) || '|size' || (p_size % 5) AS feat FROM part""",
    "items_read": with_(CONTENT) + "SELECT item_id, topic, author_id, round(quality_score, 6) AS quality_score FROM citems",
    "sequence_json_read": with_(WATCH) + """
SELECT user_id, CAST(pos AS BIGINT) AS pos, CAST(n AS BIGINT) AS n, item_id, action, round(event_weight, 6) AS event_weight FROM seq""",
    "manifest_read": with_(WATCH) + """
SELECT 'sequential_next_item' AS protocol_name, 'full_sort' AS ranking_mode, count(*) AS candidate_count, count(*) AS candidates,
       CAST(count(*) * (count(*) + 1) // 2 AS BIGINT) AS pos_sum FROM cands""",
    "vectors_read": with_(VEC) + "SELECT item_id, CAST(d - 1 AS BIGINT) AS d, round(x, 6) AS x FROM vexp",
    "retriever_read": ORACLE["sid_transitions"],
    "metric_history": with_(CONTENT, CPOP, CMETRICS) + "SELECT 'popular' AS method, 'all' AS segment, metric, value FROM cmetrics",
    "evaluation_store": f"""
SELECT 'popular' AS method, segment, metric, value FROM ({ORACLE["eval_popular"]})
UNION ALL SELECT 'itemcf', segment, metric, value FROM ({ORACLE["eval_itemcf"]})""",
    "content_evaluation_store": with_(CONTENT, CPOP, CMETRICS) + "SELECT 'popular' AS method, 'all' AS segment, metric, value FROM cmetrics",
    "run_counters": with_(WATCH) + """
SELECT (SELECT count(*) FROM wm) AS interactions, (SELECT count(DISTINCT user_id) FROM seq) AS sequences, (SELECT count(*) FROM cands) AS candidates,
       (SELECT count(DISTINCT p_partkey) FROM part) AS items, (SELECT count(DISTINCT c_custkey) FROM customer) AS users""",
    "broken_data_violations": with_(BROKEN) + "SELECT rule, CAST(violations AS BIGINT) AS violations FROM checks WHERE violations > 0",
    "observed_violations": with_(BROKEN) + """SELECT rule, CAST(violations AS BIGINT) AS violations FROM checks
WHERE rule IN ('items.invalid_publish_time', 'items.invalid_quality_score', 'items.quality_out_of_range',
               'interactions.invalid_event_time', 'interactions.invalid_dwell_time', 'interactions.negative_dwell_time')""",
    "violators": with_(BROKEN) + """
SELECT 'items.duplicate_item_id' AS rule, item_id AS key, '2' AS detail FROM bitems WHERE copies > 1
UNION ALL SELECT 'items.invalid_publish_time', p_name, p_name FROM part WHERE p_size = 7
UNION ALL SELECT 'items.invalid_quality_score', p_brand, p_brand FROM part WHERE p_size = 11
UNION ALL SELECT 'items.quality_out_of_range', item_id, '1.5' FROM bitems WHERE p_size = 13
UNION ALL SELECT 'users.duplicate_user_id', CAST(c_custkey AS VARCHAR), '2' FROM customer WHERE c_nationkey = 3
UNION ALL SELECT DISTINCT 'interactions.invalid_event_type', event_type, event_type FROM bev WHERE event_type NOT IN ('click', 'like', 'collect', 'skip')
UNION ALL SELECT 'interactions.invalid_event_time', props, props FROM events WHERE event_type = 'view'
UNION ALL SELECT 'interactions.invalid_dwell_time', event_type, event_type FROM bev WHERE event_type = 'click'
UNION ALL SELECT 'interactions.negative_dwell_time', user_id, CAST(CAST(dwell AS DECIMAL(18, 6)) AS VARCHAR) FROM bev WHERE dwell < 0
UNION ALL SELECT DISTINCT 'interactions.unknown_item', item_id, item_id FROM bev WHERE item_id NOT IN (SELECT item_id FROM bitems)
UNION ALL SELECT DISTINCT 'interactions.unknown_user', user_id, user_id FROM bev WHERE user_id NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)""",
    "broken_protocol_violations": with_(WATCH, BROKEN_ROWS) + "SELECT rule, CAST(violations AS BIGINT) AS violations FROM checks",
    "vector_violations": """
WITH dims AS (SELECT CASE WHEN label = 0 THEN 3 ELSE len(embedding) END AS dim, count(*) AS cnt FROM embeddings GROUP BY 1)
SELECT 'vectors.missing_candidate' AS rule, CAST(p_partkey AS VARCHAR) AS key, CAST(p_partkey AS VARCHAR) AS detail
FROM part WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT 'vectors.ragged_dimension', CAST(dim AS VARCHAR), CAST(cnt AS VARCHAR) FROM dims WHERE (SELECT count(*) FROM dims) > 1""",
    "request_violations": """
SELECT 'request.top_k_out_of_range' AS rule, 'r' || c_custkey AS key, CAST((c_nationkey - 1) * 3 AS VARCHAR) AS detail
FROM customer WHERE c_nationkey <> 7 AND ((c_nationkey - 1) * 3 < 1 OR (c_nationkey - 1) * 3 > 50)""",
    "batch_vector": with_(VEC, SIDS, REQUESTS, cosine_scores("vq"), """
ranked AS (
  SELECT c.*, ROW_NUMBER() OVER (PARTITION BY c.user_id ORDER BY c.score DESC, c.item_id) AS rank FROM cos c
  WHERE NOT EXISTS (SELECT 1 FROM rh h WHERE h.user_id = c.user_id AND h.item_id = c.item_id)
)""") + """
SELECT r.request_id, r.user_id, k.item_id, round(k.score, 6) AS score, coalesce(s.sid, '') AS semantic_id, 'ann_transformer' AS source,
       r.act AS action_context, CAST(k.rank AS BIGINT) AS ann_rank,
       'ANN retrieved short-video candidate in topic=' || e.label || '; recent action context=' || r.act || '.' AS reason
FROM rq r JOIN ranked k ON k.user_id = r.request_id AND k.rank <= coalesce(r.top_k, 10)
JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = k.item_id LEFT JOIN sids s ON s.item_id = k.item_id""",
    "lsh_topk": with_(VEC, """
planes AS (
  SELECT p - 1 AS p, d, CAST((7919 * p * d + 104729 * p * p + 611953 * d * d) % 1000003 - 500001 AS DOUBLE) AS w
  FROM (SELECT unnest(range(1, 65)) AS p) CROSS JOIN (SELECT DISTINCT CAST(d AS BIGINT) AS d FROM vexp)
),
signs AS (SELECT v.item_id, p.p, sum(v.x * p.w) >= 0 AS up FROM vexp v JOIN planes p USING (d) GROUP BY v.item_id, p.p),
codes AS MATERIALIZED (
  SELECT item_id, p // 8 AS t, sum(CASE WHEN up THEN 1 << CAST(p % 8 AS INTEGER) ELSE 0 END) AS bucket FROM signs GROUP BY item_id, p // 8
),
pairs AS MATERIALIZED (SELECT DISTINCT a.item_id AS user_id, b.item_id FROM codes a JOIN codes b USING (t, bucket)),
vq AS (SELECT item_id AS user_id, d, x AS q FROM vexp)""", cosine_scores("vq")) + """
SELECT user_id AS item_id, CAST(rank AS BIGINT) AS rank, item_id AS neighbor_id, round(score, 6) AS score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM cos JOIN pairs USING (user_id, item_id)
) WHERE rank <= 10""",
    "lsh_probe_topk": with_(VEC, """
planes AS (
  SELECT p - 1 AS p, d, CAST((7919 * p * d + 104729 * p * p + 611953 * d * d) % 1000003 - 500001 AS DOUBLE) AS w
  FROM (SELECT unnest(range(1, 257)) AS p) CROSS JOIN (SELECT DISTINCT CAST(d AS BIGINT) AS d FROM vexp)
),
signs AS MATERIALIZED (
  SELECT v.item_id, p.p // 8 AS t, 1 << CAST(p.p % 8 AS INTEGER) AS bit, sum(v.x * p.w) AS margin
  FROM vexp v JOIN planes p USING (d) GROUP BY v.item_id, p.p
),
codes AS MATERIALIZED (SELECT item_id, t, sum(CASE WHEN margin >= 0 THEN bit ELSE 0 END)::BIGINT AS bucket FROM signs GROUP BY item_id, t),
flips AS (SELECT item_id, t, bit FROM signs QUALIFY ROW_NUMBER() OVER (PARTITION BY item_id, t ORDER BY abs(margin), bit) <= 4),
probes AS (SELECT * FROM codes UNION ALL SELECT c.item_id, c.t, xor(c.bucket, f.bit::BIGINT) FROM codes c JOIN flips f USING (item_id, t)),
pairs AS MATERIALIZED (SELECT DISTINCT a.item_id AS user_id, b.item_id FROM probes a JOIN codes b USING (t, bucket)),
vq AS (SELECT item_id AS user_id, d, x AS q FROM vexp)""", cosine_scores("vq")) + """
SELECT user_id AS item_id, CAST(rank AS BIGINT) AS rank, item_id AS neighbor_id, round(score, 6) AS score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM cos JOIN pairs USING (user_id, item_id)
) WHERE rank <= 10""",
}
