"""Registration of queries with the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# Views over the driver's tables in SQL, in the order in which they build on each other.
VIEW_SQL = {
    "trace_run": "SELECT event_id AS trace_id, user_id, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'SUCCESS' END AS status, CAST(floor(value * 100) AS BIGINT) AS duration_ms, ts AS start_time FROM events",
    "trace_node": "SELECT event_id // 10 AS trace_id, event_id AS node_id, event_id % 10 AS depth, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'SUCCESS' END AS status, CAST(floor(value * 100) AS BIGINT) AS duration_ms, ts AS start_time FROM events",
    "chat_message": "SELECT event_id AS message_id, user_id, ts AS create_time, CASE WHEN event_type IN ('purchase', 'error') THEN 'assistant' ELSE 'user' END AS role, CASE WHEN event_type IN ('purchase', 'error') AND CAST(json_extract(props, '$.k') AS VARCHAR) = '0' THEN 1 ELSE 0 END AS no_doc FROM events",
    "session": "SELECT event_id AS session_id, user_id, ts AS create_time FROM events WHERE event_type = 'view'",
    "message": "SELECT conv_id, turn, conv_id * 1000 + turn AS id, role, text FROM conversations",
    "feedback": "SELECT event_id % 50 AS message_id, user_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END AS vote, ts AS submit_time, event_id FROM events WHERE event_type IN ('purchase', 'error')",
    "vote_event": "SELECT CASE WHEN event_id % 7 = 0 THEN -event_id ELSE event_id END AS message_id, CASE WHEN event_id % 3 = 0 THEN user_id + 1 ELSE user_id END AS user_id, CAST((n + event_id) % 3 - 1 AS INTEGER) AS vote, ts + CASE WHEN n > 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS submit_time, event_id * 3 + n AS event_id FROM events, (SELECT unnest([0, 1, 2]) AS n)",
    "vec": "SELECT vec_id, label, embedding, sqrt(list_inner_product([CAST(x AS DOUBLE) FOR x IN embedding], [CAST(x AS DOUBLE) FOR x IN embedding])) AS norm FROM embeddings",
    "unit": "SELECT vec_id, label, CASE WHEN norm > 0 THEN [CAST(x AS DOUBLE) / norm FOR x IN embedding] ELSE [CAST(x AS DOUBLE) FOR x IN embedding] END AS v FROM vec",
    "cosine": "SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, q.label AS query_label, c.label AS label, round(list_inner_product(q.v, c.v), 6) AS score FROM unit q JOIN unit c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id",
    "global_hits": "SELECT query_id, chunk_id, label, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS pos FROM cosine QUALIFY pos <= 30",
    "intent_hits": "SELECT query_id, chunk_id, label, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS pos FROM cosine WHERE label = query_label QUALIFY pos <= 20",
    "channel_rows": "SELECT query_id, 'INTENT_DIRECTED' AS channel, 1 AS priority, pos, chunk_id, score FROM intent_hits UNION ALL SELECT query_id, 'VECTOR_GLOBAL', 3, pos, chunk_id, score FROM global_hits",
    "deduped": "SELECT query_id, chunk_id, channel, score, first_pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, priority, pos) AS k, min(priority * 1000000 + pos) OVER (PARTITION BY query_id, chunk_id) AS first_pos FROM channel_rows) WHERE k = 1",
    "fused": "SELECT query_id, chunk_id, channel, round(w * CASE WHEN n = 1 OR hi = lo THEN score ELSE (score - lo) / (hi - lo) END, 6) AS fused, first_pos FROM (SELECT *, CASE channel WHEN 'INTENT_DIRECTED' THEN 1.0 ELSE 0.8 END AS w, min(score) OVER p AS lo, max(score) OVER p AS hi, count(*) OVER p AS n FROM deduped WINDOW p AS (PARTITION BY query_id, channel))",
    "label_mean": "SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i",
    "query_intent": "SELECT query_id, query_id % 4 AS sub, label AS intent, round(dot / (qn * mn), 6) AS score FROM (SELECT q.vec_id AS query_id, m.label, sum(q.x * m.m) AS dot, sqrt(sum(q.x * q.x)) AS qn, sqrt(sum(m.m * m.m)) AS mn FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings WHERE vec_id % 20 = 0) q JOIN label_mean m USING (i) GROUP BY q.vec_id, m.label)",
    "tree": "SELECT 'r' || r_regionkey AS code, NULL AS parent, r_name AS name, 0 AS lvl, 1 AS enabled FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, 1, CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE 1 END FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name, 2, 1 FROM customer",
    "sales": "SELECT r_name AS region, p_brand AS product, s_name AS sales_person, c_name AS customer, CAST(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) / 100 AS DECIMAL(18, 2)) AS amount, CAST(l_shipdate AS DATE) AS date, l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey",
    "ticket": "SELECT o_orderkey AS ticket_id, r_name AS region, c_name AS customer, c_mktsegment AS category, o_orderpriority AS priority, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'in_progress' ELSE 'closed' END AS status, n_name AS engineer, CAST(o_orderdate AS DATE) AS create_date, c_nationkey AS product FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "hyperedge": "SELECT p_partkey AS edge_id, p_brand AS equipment, p_type AS condition, 'size ' || p_size AS parameter, p_name AS name FROM part",
    "posting": "SELECT DISTINCT edge_id, unnest([equipment, condition, parameter, name]) AS entity FROM hyperedge",
    "chunk": "SELECT doc_id, lang AS collection, source AS kb_id, unnest(range(len(s))) AS chunk_index, unnest(s) AS content FROM (SELECT *, string_split(text, chr(10)) AS s FROM documents)",
    "snap_old": "SELECT doc_id, text, sha256(text) AS hash FROM documents WHERE doc_id % 10 <> 0",
    "snap_new": "SELECT doc_id, t AS text, sha256(t) AS hash FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' (revised)' ELSE text END AS t FROM documents WHERE doc_id % 7 <> 0)",
}


def _needs(text: str, found: set[str]) -> set[str]:
    import re

    for name, body in VIEW_SQL.items():
        if name not in found and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
            found.add(name)
            _needs(body, found)
    return found


def with_views(sql: str) -> str:
    """The SQL with the views it mentions put before it."""
    used = _needs(sql, set())
    ctes = [f"{name} AS ({body})" for name, body in VIEW_SQL.items() if name in used]
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[len("WITH RECURSIVE ") :]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[len("WITH ") :]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def query(name: str, sql: str | None = None):
    """Register a query under a name, with the SQL it equals where SQL can say it."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return keep
