"""DuckDB SQL of the registered queries."""

from __future__ import annotations

AS_OF = 1706659200000

MS = "epoch_us(ts) // 1000"
LOG = f"""log AS (
  SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'SET' END AS op, 'user:' || user_id AS key, props AS value,
         CASE WHEN event_type = 'view' THEN 86400000::BIGINT END AS ttl_ms, {MS} AS ts_ms FROM events)"""
LOG_CLEARS = """log AS (
  SELECT event_id AS seq, CASE WHEN event_id % 5000 = 2499 THEN 'CLEAR' WHEN event_type = 'error' THEN 'DELETE' ELSE 'SET' END AS op,
         CASE WHEN event_id % 5000 <> 2499 THEN 'user:' || user_id END AS key, props AS value FROM events)"""


def _state(as_of: int | None = None) -> str:
    seen = "" if as_of is None else f"WHERE ts_ms <= {as_of}"
    live = "" if as_of is None else f"AND (expire_at_ms IS NULL OR {as_of} <= expire_at_ms)"
    return f"""{LOG},
last AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM log {seen}),
state AS (SELECT key, value, seq, ts_ms, expire_at_ms FROM (SELECT *, CASE WHEN ttl_ms <> 0 THEN ts_ms + ttl_ms END AS expire_at_ms FROM last WHERE r = 1 AND op = 'SET') WHERE true {live})"""


def _hash(x: str) -> str:
    return f"('0x' || substr(sha1({x}), 1, 8))::BIGINT"


def _ring(name: str, nodes: str) -> str:
    """Virtual nodes of a list of node ids, and the segment each owns."""
    return f"""{name}_v AS (SELECT node_id, vnode::INT AS vnode, {_hash("node_id || ':' || vnode")} AS hash FROM (SELECT unnest({nodes}) AS node_id), range(150) t(vnode)),
{name}_s AS (SELECT hash AS hi, coalesce(lag(hash) OVER (ORDER BY hash), -1) AS lo, node_id FROM {name}_v
  UNION ALL SELECT 4294967295, max(hash), arg_min(node_id, hash) FROM {name}_v)"""


THREE = "['node-1', 'node-2', 'node-3']"
KEYS = "keys AS (SELECT DISTINCT 'user:' || user_id AS key FROM events)"


def _placed(name: str, keys: str, ring: str) -> str:
    return f"{name} AS (SELECT k.*, s.node_id FROM (SELECT *, {_hash('key')} AS h FROM {keys}) k LEFT JOIN {ring}_s s ON k.h > s.lo AND k.h <= s.hi)"


#: 31-hash over ASCII keys.
KEY_HASH = """list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(key, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (h * 31 + c) % 4294967296)"""
REPLICA_IDS = "['node-1', 'node-2', 'node-3']"
TARGETS = f"""targets AS (
  SELECT *, abs(CASE WHEN raw >= 2147483648 THEN raw - 4294967296 ELSE raw END)::BIGINT AS key_hash, list_filter({REPLICA_IDS}, lambda x: x <> node_id) AS ids
  FROM (SELECT *, {KEY_HASH} AS raw FROM placed)),
chosen AS (SELECT *, [ids[(key_hash % 2 + 1)::INT], ids[((key_hash + 1) % 2 + 1)::INT]] AS chosen FROM targets)"""
REPLICAS = "(VALUES ('node-1', true), ('node-2', true), ('node-3', true), ('node-4', false)) r(node_id, is_healthy)"


def _lru(capacity: int) -> str:
    """Hit iff the key was used before and fewer than `capacity` other keys since."""
    return f"""t AS (SELECT event_id AS seq, 'user:' || user_id AS key FROM events),
w AS (SELECT seq, key, lag(seq) OVER (PARTITION BY key ORDER BY seq) AS p, lead(seq) OVER (PARTITION BY key ORDER BY seq) AS n FROM t),
d AS (SELECT a.seq, count(*) AS between_keys FROM w a JOIN w b ON b.seq > a.p AND b.seq < a.seq AND (b.n IS NULL OR b.n > a.seq) GROUP BY a.seq),
lru AS (SELECT w.seq, w.key, w.p IS NOT NULL AND coalesce(d.between_keys, 0) < {capacity} AS hit FROM w LEFT JOIN d ON d.seq = w.seq)"""


def _hit_rate(c: int) -> str:
    return f"""SELECT {c} AS capacity, hits, n - hits AS misses, n - hits - size AS evictions, size AS final_size, round(100.0::DOUBLE * hits / n, 6) AS hit_rate
FROM (WITH {_lru(c)} SELECT count(*) FILTER (hit) AS hits, count(*) AS n, least(count(DISTINCT key), {c}) AS size FROM lru)"""


DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"
L2 = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _cosine(a: str, b: str) -> str:
    d = DOT.format
    return f"coalesce({d(a=a, b=b)} / nullif(sqrt({d(a=a, b=a)}) * sqrt({d(a=b, b=b)}), 0), 0)"


VECTORS = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label FROM embeddings)"


def _top(score: str, where: str = "true", k: int = 10, extra: str = "") -> str:
    return f"""WITH {VECTORS}, q AS (SELECT x AS q FROM v WHERE id = 0)
SELECT id, round({score} + 0.0, 6) + 0.0 AS score {extra} FROM v, q WHERE {where} ORDER BY {score} DESC, id LIMIT {k}"""


def _batch(name: str, score: str, k: int, source: str = "v, q") -> str:
    return f"{name} AS (SELECT * FROM (SELECT query_id, id, {score} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, id) AS rank FROM {source}) WHERE rank <= {k})"


QV = "q AS (SELECT id AS query_id, x AS q FROM v WHERE id % 20 = 0)"
CELLS = f"""c AS (
  SELECT (row_number() OVER (ORDER BY label) - 1)::INT AS cell_id, list(m ORDER BY d) AS c FROM (
    SELECT label, d, avg(y) AS m FROM (SELECT label, unnest(x) AS y, generate_subscripts(x, 1) AS d FROM v) GROUP BY label, d) GROUP BY label),
assigned AS (SELECT id, x, cell_id FROM (
  SELECT id, x, cell_id, row_number() OVER (PARTITION BY id ORDER BY {L2.format(a='x', b='c')}, cell_id) AS r FROM v, c) WHERE r = 1)"""
PROBED = f"""probed AS (SELECT query_id, q, cell_id FROM (
  SELECT query_id, q, cell_id, row_number() OVER (PARTITION BY query_id ORDER BY {L2.format(a='q', b='c')}, cell_id) AS r FROM q, c) WHERE r <= 3),
near AS (SELECT query_id, q, id, x FROM probed JOIN assigned USING (cell_id))"""
NEGATIVE_L2 = f"-({L2.format(a='x', b='q')})"

ENTRIES = """e AS (SELECT (event_id % 4)::INT AS segment_ord, event_id // 4 AS entry_ord, user_id::VARCHAR AS id, props AS metadata, event_id AS seq, event_type = 'error' AS tombstone FROM events),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY segment_ord, id ORDER BY entry_ord DESC) AS r FROM e) WHERE r = 1),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC, segment_ord) AS r2 FROM m) WHERE r2 = 1)"""

CALLS = f"""{_ring('r', THREE)},
e AS (SELECT event_id AS seq, 'user:' || user_id AS key, event_type <> 'error' AS ok, {MS} AS ts_ms, value AS response_ms FROM events),
{_placed('calls', 'e', 'r')}"""
TRANSITIONS = """runs AS (SELECT *, sum(new) OVER (PARTITION BY node_id ORDER BY seq) AS run FROM (
  SELECT *, CASE WHEN lag(ok) OVER (PARTITION BY node_id ORDER BY seq) IS NOT DISTINCT FROM ok THEN 0 ELSE 1 END AS new FROM calls)),
reached AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id, run ORDER BY seq) AS n FROM runs) WHERE n = CASE WHEN ok THEN 2 ELSE 3 END),
changes AS (SELECT seq, node_id, ok AS is_healthy FROM (SELECT *, coalesce(lag(ok) OVER (PARTITION BY node_id ORDER BY seq), true) AS was FROM reached) WHERE was <> ok)"""
NODE_HEALTH = f"""h AS (
  SELECT n.node_id, coalesce((SELECT arg_max(is_healthy, seq) FROM changes x WHERE x.node_id = n.node_id), true) AS is_healthy,
         arg_max(response_ms, seq) AS response_ms, count(*) FILTER (NOT ok) AS errors, count(seq) AS calls
  FROM (SELECT unnest({THREE}) AS node_id) n LEFT JOIN calls c ON c.node_id = n.node_id GROUP BY n.node_id)"""
#: The breaker as a recursive fold: one row a call, all nodes at once.
BREAKER = """o AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY seq) AS i FROM calls),
b AS (
  SELECT node_id, 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::BOOLEAN AS admitted, 'CLOSED' AS state, 0::BIGINT AS failures, 0::BIGINT AS good, 0::BIGINT AS failed_at FROM (SELECT DISTINCT node_id FROM o)
  UNION ALL
  SELECT node_id, i, seq, admitted,
    CASE WHEN NOT admitted THEN state WHEN ok THEN CASE WHEN cur = 'HALF_OPEN' AND good + 1 >= 3 THEN 'CLOSED' ELSE cur END
         WHEN cur = 'HALF_OPEN' OR failures + 1 >= 5 THEN 'OPEN' ELSE cur END,
    CASE WHEN NOT admitted THEN failures WHEN ok THEN 0 ELSE failures + 1 END,
    CASE WHEN admitted AND ok AND cur = 'HALF_OPEN' THEN good + 1 ELSE good END,
    CASE WHEN admitted AND NOT ok THEN ts_ms ELSE failed_at END
  FROM (SELECT o.node_id, o.i, o.seq, o.ok, o.ts_ms, b.state, b.failures, b.failed_at,
               NOT (b.state = 'OPEN' AND o.ts_ms - b.failed_at <= 30000) AS admitted,
               CASE WHEN b.state = 'OPEN' AND o.ts_ms - b.failed_at > 30000 THEN 'HALF_OPEN' ELSE b.state END AS cur,
               CASE WHEN b.state = 'OPEN' AND o.ts_ms - b.failed_at > 30000 THEN 0 ELSE b.good END AS good
        FROM b JOIN o ON o.node_id = b.node_id AND o.i = b.i + 1))"""

CHUNKS = r"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents),
chunks AS (SELECT doc_id, chunk::INT AS chunk, array_to_string(w[(chunk * 40 + 1):(chunk * 40 + 40)], ' ') AS text FROM (SELECT doc_id, w, unnest(range(0, (len(w) + 39) // 40)) AS chunk FROM w WHERE len(w) > 0)),
docs AS (SELECT 'doc:' || doc_id || ':chunk:' || chunk AS key, doc_id, text, embedding::DOUBLE[] AS x FROM chunks JOIN embeddings ON doc_id % 500 = vec_id)"""
HITS = f"""{CHUNKS}, q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7),
hits AS (SELECT key, text, {_cosine('x', 'q')} AS score FROM docs, q WHERE starts_with(key, 'doc:1') ORDER BY score DESC, key LIMIT 5)"""


def _percentile(p: int) -> str:
    return f"round((list_sort(list(value)))[floor({p} * (count(*) - 1) / 100.0)::BIGINT + 1], 6) AS p{p}"


ORACLES = {
    "kv_replay_state": f"WITH {_state()} SELECT * FROM state",
    "kv_ttl_live_keys": f"WITH {_state(AS_OF)} SELECT key FROM state",
    "kv_get_batch": f"""WITH {_state(AS_OF)}, a AS (SELECT event_id AS seq, 'user:' || user_id || CASE WHEN event_id % 7 = 0 THEN ':none' ELSE '' END AS key FROM events)
SELECT a.seq, a.key, s.key IS NOT NULL AS found, s.value FROM a LEFT JOIN state s ON s.key = a.key""",
    "kv_lines_replay": f"WITH {_state(AS_OF)} SELECT key, value, ts_ms FROM state",
    "kv_exists_batch": f"WITH {_state(AS_OF)}, {KEYS} SELECT key FROM keys SEMI JOIN state USING (key)",
    "kv_delete_existed": f"""WITH {LOG_CLEARS}, p AS (SELECT seq, key, op, lag(op) OVER w AS was, lag(seq) OVER w AS at FROM log WHERE op <> 'CLEAR' WINDOW w AS (PARTITION BY key ORDER BY seq))
SELECT seq, key, coalesce(was = 'SET' AND NOT EXISTS (SELECT 1 FROM log c WHERE c.op = 'CLEAR' AND c.seq > p.at AND c.seq < p.seq), false) AS existed FROM p WHERE op = 'DELETE'""",
    "kv_clear_barrier": f"""WITH {LOG_CLEARS}, l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM log WHERE seq > coalesce((SELECT max(seq) FROM log WHERE op = 'CLEAR'), -1))
SELECT key, value, seq FROM l WHERE r = 1 AND op = 'SET'""",
    "kv_store_stats": f"WITH {_state()} SELECT count(*) AS total_keys, coalesce(sum(length(key) + length(value) + 100), 0)::BIGINT AS memory_usage, (SELECT count(*) FROM log) AS operations FROM state",
    "kv_key_distribution": f"""WITH {_state(AS_OF)}, {_ring('r', THREE)}, {_placed('placed', 'state', 'r')}
SELECT n.node_id, count(p.key) AS key_count, coalesce(string_agg(p.key, ',' ORDER BY p.key), '') AS keys FROM (SELECT unnest({THREE}) AS node_id) n LEFT JOIN placed p ON p.node_id = n.node_id GROUP BY n.node_id""",
    "kv_access_counts": f"WITH {_lru(50)} SELECT key, count(*) AS gets, count(*) FILTER (hit) AS cache_hits, count(*) FILTER (NOT hit) AS access_count FROM lru GROUP BY key",
    "ring_vnodes": f"WITH {_ring('r', THREE)} SELECT node_id, vnode, hash FROM r_v",
    "ring_place_keys": f"WITH {KEYS}, {_ring('r', THREE)}, {_placed('placed', 'keys', 'r')} SELECT key, node_id FROM placed",
    "ring_distribution_sample": f"""WITH s AS (SELECT 'sample_key_' || i AS key FROM range(10000) t(i)), {_ring('r', THREE)}, {_placed('placed', 's', 'r')}
SELECT node_id, count(*) AS key_count FROM placed GROUP BY node_id""",
    "ring_failover": f"WITH {KEYS}, {_ring('r', "['node-1', 'node-3']")}, {_placed('placed', 'keys', 'r')} SELECT key, node_id FROM placed",
    "ring_moved_keys": f"""WITH {KEYS}, {_ring('r', THREE)}, {_ring('f', "['node-1', 'node-2', 'node-3', 'node-4']")}, {_placed('a', 'keys', 'r')}, {_placed('b', 'keys', 'f')}
SELECT key, a.node_id AS node_before, b.node_id AS node_after FROM a JOIN b USING (key) WHERE a.node_id <> b.node_id""",
    "ring_remove_node": f"""WITH {KEYS}, {_ring('r', THREE)}, {_ring('f', "['node-1', 'node-3']")}, {_placed('a', 'keys', 'r')}, {_placed('b', 'keys', 'f')}
SELECT key, a.node_id AS node_before, b.node_id AS node_after FROM a JOIN b USING (key) WHERE a.node_id <> b.node_id""",
    "ring_stats": "SELECT 3 AS total_nodes, 2 AS healthy_nodes, 450 AS virtual_nodes",
    "replica_select": f"WITH {KEYS}, {_ring('r', THREE)}, {_placed('placed', 'keys', 'r')}, {TARGETS} SELECT key, node_id, key_hash, array_to_string(chosen, ',') AS targets FROM chosen",
    "replica_sync_stats": f"""WITH {LOG}, {_ring('r', THREE)}, {_placed('placed', 'log', 'r')}, {TARGETS}, x AS (SELECT seq, ts_ms, unnest(chosen) AS node_id FROM chosen)
SELECT r.node_id, r.is_healthy, count(x.seq) AS synced_operations, max(ts_ms) AS last_sync_ms, coalesce({AS_OF} - arg_max(ts_ms, seq), 0) AS replication_lag FROM {REPLICAS} LEFT JOIN x ON x.node_id = r.node_id GROUP BY r.node_id, r.is_healthy""",
    "replica_stats": f"""WITH {LOG}, {_ring('r', THREE)}, {_placed('placed', 'log', 'r')}, {TARGETS}, x AS (SELECT seq, ts_ms, unnest(chosen) AS node_id FROM chosen),
s AS (SELECT r.node_id, r.is_healthy, coalesce({AS_OF} - arg_max(ts_ms, seq), 0) AS lag FROM {REPLICAS} LEFT JOIN x ON x.node_id = r.node_id GROUP BY r.node_id, r.is_healthy)
SELECT count(*) AS total_replicas, count(*) FILTER (is_healthy) AS healthy_replicas, round(avg(lag) FILTER (is_healthy), 6) AS average_lag, 0 AS sync_operations, (SELECT count(*) FROM log) AS async_operations FROM s""",
    "replica_recent_ops": f"WITH {LOG}, {_ring('r', THREE)}, {_placed('placed', 'log', 'r')} SELECT seq, op, key, node_id, ts_ms, 2 AS replica_count FROM placed ORDER BY seq DESC LIMIT 10",
    "replica_log_trim": f"""WITH {LOG}, n AS (SELECT count(*) AS n FROM log)
SELECT seq, op, key FROM (SELECT *, row_number() OVER (ORDER BY seq DESC) AS r FROM log), n WHERE r <= CASE WHEN n <= 1000 THEN n ELSE 500 + (n - 1001) % 501 END""",
    "replica_membership": """SELECT * FROM (VALUES ('node-1', true, false, 0, 0, 0, 1), ('node-2', true, true, 5, 7, 1, 1), ('node-4', true, false, 0, 12, 3, 1), ('node-5', true, false, 0, 0, 4, 1))
v(node_id, is_healthy, is_master, replication_lag, synced_ops, insert_ord, failovers)""",
    "replica_promote_master": "SELECT 'node-2' AS node_id, 7 AS synced_ops",
    "lru_access_trace": f"WITH {_lru(50)} SELECT seq, key, hit FROM lru",
    "lru_hit_rate": " UNION ALL ".join(_hit_rate(c) for c in (10, 50, 100)),
    "lru_keys_in_order": "SELECT 'user:' || user_id AS key, max(event_id) AS last_seq FROM events GROUP BY user_id ORDER BY last_seq DESC LIMIT 50",
    "vec_topk_cosine": _top(_cosine("x", "q")),
    "vec_topk_dot": _top(DOT.format(a="x", b="q")),
    "vec_topk_values": f"""WITH {VECTORS}, q AS (SELECT x AS q FROM v WHERE id = 0)
SELECT id, round({DOT.format(a='x', b='q')} + 0.0, 6) + 0.0 AS score, len(x) AS dimension, round(x[1], 6) + 0.0 AS first FROM v, q ORDER BY {DOT.format(a='x', b='q')} DESC, id LIMIT 10""",
    "vec_topk_l2": _top(NEGATIVE_L2),
    "vec_topk_batch": f"WITH {VECTORS}, {QV}, {_batch('b', _cosine('x', 'q'), 5)} SELECT query_id, rank, id, round(score, 6) AS score FROM b",
    "vec_topk_filtered": _top(_cosine("x", "q"), "label = 3", 5, ", '{\"label\":' || label || '}' AS metadata"),
    "vec_upsert": "SELECT vec_id AS id, round(CASE WHEN vec_id % 3 = 0 THEN -embedding[1]::DOUBLE ELSE embedding[1]::DOUBLE END, 6) AS first, CASE WHEN vec_id % 3 = 0 THEN '{}' ELSE '{\"label\":' || label || '}' END AS metadata, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END AS seq FROM embeddings",
    "vec_delete_ids": "SELECT count(*) FILTER (vec_id % 5 <> 0) AS total_vectors, max(len(embedding)) FILTER (vec_id % 5 <> 0) AS dimension, count(*) FILTER (vec_id % 5 = 0) AS deleted FROM embeddings",
    "vec_stats": "SELECT count(*) AS total_vectors, max(len(embedding)) AS dimension FROM embeddings",
    "ivf_assign": f"WITH {VECTORS}, {CELLS} SELECT id, cell_id FROM assigned",
    "ivf_status": f"WITH {VECTORS}, {CELLS} SELECT c.cell_id, count(a.id) AS size FROM c LEFT JOIN assigned a USING (cell_id) GROUP BY c.cell_id",
    "ivf_train_step": f"""WITH {VECTORS}, {CELLS}, u AS (SELECT cell_id, unnest(x) AS y, generate_subscripts(x, 1) AS d FROM assigned)
SELECT cell_id, count(*) AS n, (d - 1)::INT AS d, round(avg(y), 6) + 0.0 AS x FROM u GROUP BY cell_id, d""",
    "ivf_search": f"WITH {VECTORS}, {CELLS}, {QV}, {PROBED}, {_batch('b', NEGATIVE_L2, 5, 'near')} SELECT query_id, rank, id, round(score, 6) + 0.0 AS score FROM b",
    "ivf_recall": f"""WITH {VECTORS}, {CELLS}, {QV}, {PROBED}, {_batch('b', NEGATIVE_L2, 10, 'near')}, {_batch('t', NEGATIVE_L2, 10)},
p AS (SELECT t.query_id, count(b.id) AS hits, count(*) AS n FROM t LEFT JOIN b ON b.query_id = t.query_id AND b.id = t.id GROUP BY t.query_id)
SELECT round(avg(hits / n), 6) AS macro, round(sum(hits) / sum(n), 6) AS micro FROM p""",
    "ivf_remove": f"WITH {VECTORS}, {CELLS} SELECT c.cell_id, count(a.id) AS size FROM c LEFT JOIN (SELECT * FROM assigned WHERE id % 4 <> 0) a USING (cell_id) GROUP BY c.cell_id",
    "ivf_add": f"WITH {VECTORS}, {CELLS} SELECT id, cell_id FROM assigned",
    "ivf_brute_force": f"WITH {VECTORS}, {QV}, {_batch('b', NEGATIVE_L2, 5)} SELECT query_id, rank, id, round(score, 6) + 0.0 AS score FROM b",
    "ivf_save_load": f"WITH {VECTORS}, {CELLS} SELECT id, cell_id, round(x[1], 6) AS first FROM assigned",
    "lsm_manager_trace": f"""WITH {ENTRIES} SELECT s + 1 AS step, s AS arrived, s = 3 AS compacted, CASE WHEN s = 3 THEN 1 ELSE s + 1 END AS segments,
  CASE WHEN s = 3 THEN (SELECT count(*) FILTER (NOT tombstone) FROM newest) END AS live FROM range(4) t(s)""",
    "lsm_segment_manifest": f"WITH {ENTRIES} SELECT segment_ord, count(*) AS entry_count, min(seq) AS min_seq, max(seq) AS max_seq FROM e GROUP BY segment_ord",
    "lsm_segment_read": f"WITH {ENTRIES} SELECT id, segment_ord, seq, metadata, tombstone FROM m WHERE id::BIGINT % 3 = 0",
    "lsm_compact": f"WITH {ENTRIES} SELECT id, segment_ord, seq, metadata FROM newest WHERE NOT tombstone",
    "lsm_compact_stats": f"WITH {ENTRIES} SELECT (SELECT count(DISTINCT segment_ord) FROM m) AS input_segments, (SELECT count(*) FROM m) - count(*) AS deduplicated, count(*) FILTER (tombstone) AS dropped_tombstones, count(*) FILTER (NOT tombstone) AS entry_count FROM newest",
    "lsm_memtable": """WITH l AS (SELECT *, last_value(CASE WHEN event_type <> 'error' THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS m, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)
SELECT user_id::VARCHAR AS id, m AS metadata, event_id AS seq, event_type = 'error' AS tombstone FROM l WHERE r = 1""",
    "health_transitions": f"WITH {CALLS}, {TRANSITIONS} SELECT * FROM changes",
    "node_health": f"WITH {CALLS}, {TRANSITIONS}, {NODE_HEALTH} SELECT * FROM h",
    "breaker_states": f"WITH RECURSIVE {CALLS}, {BREAKER} SELECT seq, node_id, admitted, state, failures FROM b WHERE i > 0",
    "ft_stats": f"""WITH RECURSIVE {CALLS}, {TRANSITIONS}, {NODE_HEALTH}, {BREAKER}, s AS (SELECT arg_max(state, i) AS state FROM b WHERE i > 0 GROUP BY node_id),
r AS (SELECT (SELECT count(*) FROM calls WHERE NOT ok) AS retries, (SELECT count(*) FROM changes WHERE is_healthy) AS recoveries)
SELECT count(*) FILTER (is_healthy) AS healthy_nodes, count(*) FILTER (NOT is_healthy) AS unhealthy_nodes, round(avg(response_ms) FILTER (is_healthy), 6) AS average_response_ms,
  (SELECT round(coalesce(retries * 100.0::DOUBLE / nullif(retries + recoveries, 0), 0), 6) FROM r) AS error_rate, (SELECT count(*) FILTER (state = 'OPEN') FROM s) AS open_breakers FROM h""",
    "partitioned_calls": f"""WITH {CALLS} SELECT seq, node_id, CASE node_id WHEN 'node-2' THEN ts_ms >= {AS_OF} - 20 * 86400000 AND ts_ms < {AS_OF} - 10 * 86400000
  WHEN 'node-3' THEN ts_ms >= {AS_OF} - 5 * 86400000 AND ts_ms < {AS_OF} - 5 * 86400000 + 10000 ELSE false END AS partitioned FROM calls""",
    "retry_schedule": "SELECT i::INT AS attempt, least(5000, 100 * 2 ** (i - 1))::BIGINT AS delay_ms, sum(least(5000, 100 * 2 ** (i - 1))) OVER (ORDER BY i)::BIGINT AS waited_ms FROM range(1, 4) t(i)",
    "latency_percentiles": f"SELECT count(*) AS n, round(avg(value), 6) AS mean, {_percentile(50)}, {_percentile(95)}, {_percentile(99)} FROM events WHERE value IS NOT NULL",
    "rag_chunk": f"WITH {CHUNKS} SELECT doc_id, chunk, text FROM chunks",
    "rag_doc_codec": f"WITH {CHUNKS} SELECT key, md5(text) AS text_md5, len(x) AS dimension, '{{\"doc_id\":' || doc_id || '}}' AS metadata FROM docs",
    "rag_prefix_topk": f"WITH {HITS} SELECT key, md5(text) AS text_md5, round(score, 6) AS score FROM hits",
    "rag_answer": f"WITH {HITS} SELECT string_agg(text, chr(10) ORDER BY score DESC, key) AS answer FROM hits",
    "kv_value_codec": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props ELSE event_type END AS value FROM events",
}
