"""What the queries give, in SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from weirflow.queries import MIN_SIM, MIN_USERS, PARTS

_SESSIONS = "ses AS (SELECT DISTINCT o_custkey AS a, l_partkey AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
_COUNTS = f"{_SESSIONS}, cnt AS (SELECT b, count(*) AS n FROM ses GROUP BY b)"
_COFREQ = f"{_COUNTS}, cof AS (SELECT x.b AS a, y.b AS b, CAST(count(*) AS DOUBLE) AS w FROM ses x JOIN ses y ON x.a = y.a AND x.b <> y.b GROUP BY 1, 2)"
_POPULAR = f"{_COFREQ}, pop AS (SELECT * FROM cof WHERE w >= 2)"
_COMPLEMENTS = f"""{_COFREQ}, com AS (
  SELECT a, b, w, aw, bw FROM (
    SELECT cof.a, cof.b, cof.w / (sqrt(CAST(ca.n AS DOUBLE)) * sqrt(CAST(cb.n AS DOUBLE))) AS w, CAST(ca.n AS DOUBLE) AS aw, CAST(cb.n AS DOUBLE) AS bw
    FROM cof JOIN cnt ca ON ca.b = cof.a JOIN cnt cb ON cb.b = cof.b WHERE cof.w >= 3) WHERE w >= 0.01)"""
_VECTORS = f"""{_POPULAR}, wei AS (
  SELECT pop.a, pop.b, pop.w * (ln(((SELECT CAST(max(b) AS DOUBLE) FROM cnt) + 1) / greatest(CAST(cnt.n AS DOUBLE), 1.0)) + 1) AS w FROM pop JOIN cnt ON cnt.b = pop.b),
ran AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS r, count(*) OVER (PARTITION BY a) AS n FROM wei),
cut AS (SELECT a, b, w FROM ran WHERE n >= 3 AND r <= 50),
vec AS (SELECT a, b, w / sqrt(sum(w * w) OVER (PARTITION BY a)) AS w FROM cut)"""
_SUBSTITUTES = f"""{_VECTORS}, sub AS (
  SELECT x.a AS a, y.a AS b, sum(CAST(CAST(x.w AS FLOAT) * CAST(y.w AS FLOAT) AS DOUBLE)) AS w FROM vec x JOIN vec y ON x.b = y.b AND x.a <> y.a GROUP BY 1, 2 HAVING sum(CAST(CAST(x.w AS FLOAT) * CAST(y.w AS FLOAT) AS DOUBLE)) >= 0.05)"""
_BEST = f"""{_SUBSTITUTES}, fir AS (
  SELECT sub.*, CAST(ca.n AS DOUBLE) AS aw, CAST(cb.n AS DOUBLE) AS bw, row_number() OVER (PARTITION BY sub.a ORDER BY w DESC, sub.b) AS r FROM sub JOIN cnt ca ON ca.b = sub.a JOIN cnt cb ON cb.b = sub.b),
bes AS (SELECT least(a, b) AS a, greatest(a, b) AS b, w, CASE WHEN a > b THEN bw ELSE aw END AS aw, CASE WHEN a > b THEN aw ELSE bw END AS bw
  FROM fir WHERE r = 1 AND aw >= {MIN_USERS} AND bw >= {MIN_USERS} AND w >= {MIN_SIM})"""
_RECIPROCAL = f"{_BEST}, pai AS (SELECT a, b, avg(w) AS w, min(aw) AS aw, min(bw) AS bw FROM bes GROUP BY a, b HAVING count(*) = 2)"
_WORDS = "wor AS (SELECT lower(substr(unnest(regexp_extract_all(text, '[A-Za-z0-9]+')), 1, 255)) AS word FROM documents)"
_HASH = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, 1 + CAST(octet_length(encode({0})) AS BIGINT)), lambda i: CAST(('0x' || substr(hex(encode({0})), CAST(2 * i - 1 AS BIGINT), 2)) AS BIGINT))), lambda h, d: (h * 131 + d) % {1})"
_EVENTS = "(VALUES ('Search', 'north'), ('Search', 'south'), ('Tools', 'anvil'), ('Tools', 'chisel'), ('Tools', 'anvil'), ('Search', 'north')) AS e(a, b)"


def _h(column: str) -> str:
    return _HASH.format(column, PARTS)


def _wide(column: str) -> str:
    """The whole 64-bit hash: folded in 128 bits, cut to 64 after every byte."""
    byte = f"CAST(('0x' || substr(hex(encode({column})), CAST(2 * i - 1 AS BIGINT), 2)) AS HUGEINT)"
    each = f"list_transform(range(1, 1 + CAST(octet_length(encode({column})) AS BIGINT)), lambda i: {byte})"
    return f"list_reduce(list_prepend(CAST(0 AS HUGEINT), {each}), lambda h, d: (h * 131 + d) % 18446744073709551616::HUGEINT)"


ORACLES: dict[str, str] = {
    "scan_parquet": "SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS total FROM orders WHERE o_orderstatus = 'F'",
    "identity_copy": "SELECT * FROM nation",
    "tokenize": "SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, lower(substr(l[i], 1, 255)) AS word FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+') AS l FROM documents))",
    "word_count": f"WITH {_WORDS} SELECT word, CAST(count(*) AS DOUBLE) AS w FROM wor GROUP BY word ORDER BY w DESC, word",
    "format_text": f"WITH {_WORDS} SELECT word || chr(9) || CAST(count(*) AS VARCHAR) AS line FROM wor GROUP BY word",
    "json_extract": "SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type IS NOT NULL AND json_extract(props, '$.k') IS NOT NULL",
    "generator_clicks": f"SELECT 1.0::DOUBLE AS w, a, b FROM {_EVENTS}, range(10)",
    "filter_route": f"WITH {_POPULAR} SELECT b AS key, a, b, w FROM pop",
    "local_id_roundtrip": f"SELECT p_partkey, CAST(p_partkey % {PARTS} AS INTEGER) AS p, p_partkey // {PARTS} AS local, p_partkey // {PARTS} * {PARTS} + p_partkey % {PARTS} AS back FROM part",
    "shuffle_bucket_counts": f"WITH {_SESSIONS} SELECT CAST(a % {PARTS} AS INTEGER) AS p, count(*) AS n FROM ses GROUP BY 1",
    "hash131_bucket": f"SELECT p_partkey, CAST({_h('p_name')} AS INTEGER) AS p FROM part",
    "round_robin_scatter": "SELECT event_id, user_id FROM events",
    "read_first_broadcast": f"SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % {PARTS} = 0",
    "all_to_all_cross": "SELECT n_nationkey, r_regionkey FROM nation CROSS JOIN region",
    "global_gather": f"SELECT count(*) AS n, count(DISTINCT l_orderkey % {PARTS}) AS parts FROM lineitem",
    "partition_health": "SELECT CAST(p AS INTEGER) AS p, count(n_nationkey) AS n, count(n_nationkey) = 0 AS empty FROM range(32) r(p) LEFT JOIN nation ON n_nationkey % 32 = p GROUP BY p",
    "sort_desc": "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey",
    "sort_within_partition": f"WITH {_SESSIONS} SELECT a, b, CAST(a % {PARTS} AS INTEGER) AS p, CAST(row_number() OVER (PARTITION BY a % {PARTS} ORDER BY a, b) - 1 AS INTEGER) AS place FROM ses",
    "sortedness_check": "SELECT CAST(0 AS BIGINT) AS violations",
    "limit_per_partition": f"SELECT o_orderkey, o_custkey, p FROM (SELECT o_orderkey, o_custkey, CAST(o_custkey % {PARTS} AS INTEGER) AS p, row_number() OVER (PARTITION BY o_custkey % {PARTS} ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 10",
    "topk_per_group": f"WITH {_POPULAR} SELECT * FROM (SELECT a, b, w, CAST(row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS INTEGER) AS rank FROM pop) WHERE rank <= 20",
    "reduce_sum": "SELECT l_partkey, sum(l_quantity) AS w FROM lineitem GROUP BY l_partkey",
    "two_phase_agg": "SELECT l_partkey, max(s) AS most, count(*) AS suppliers FROM (SELECT l_partkey, l_suppkey, sum(l_quantity) AS s FROM lineitem GROUP BY 1, 2) GROUP BY l_partkey",
    "dedup_sessions": f"WITH {_SESSIONS} SELECT * FROM ses",
    "keep_first_dict": "SELECT p_type, p_name, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_name, p_partkey) AS r FROM part) WHERE r = 1",
    "item_counts": f"WITH {_COUNTS} SELECT * FROM cnt",
    "chained_grouping": f"SELECT a, string_agg(b || ' (' || CAST(n AS VARCHAR) || ')', ', ' ORDER BY b) AS urls, CAST(sum(n) AS DOUBLE) AS total FROM (SELECT a, b, 10 * count(*) AS n FROM {_EVENTS} GROUP BY a, b) GROUP BY a",
    "group_merge_union": "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "encode_users": f"SELECT o_custkey, CAST(o_custkey % {PARTS} AS INTEGER) AS p, (row_number() OVER (PARTITION BY o_custkey % {PARTS} ORDER BY o_custkey) - 1) * {PARTS} + o_custkey % {PARTS} AS id FROM (SELECT DISTINCT o_custkey FROM orders)",
    "encode_items": f"SELECT p_name, CAST(p AS INTEGER) AS p, (row_number() OVER (PARTITION BY p ORDER BY p_name) - 1) * {PARTS} + p AS id FROM (SELECT p_name, {_h('p_name')} AS p FROM (SELECT DISTINCT p_name FROM part))",
    "item_to_users": f"WITH {_SESSIONS} SELECT b AS id, CAST(count(*) OVER (PARTITION BY b) AS INTEGER) AS n, CAST(row_number() OVER (PARTITION BY b ORDER BY a) - 1 AS INTEGER) AS pos, a AS element FROM ses",
    "user_to_items": f"WITH {_SESSIONS} SELECT a AS id, CAST(count(*) OVER (PARTITION BY a) AS INTEGER) AS n, CAST(row_number() OVER (PARTITION BY a ORDER BY b) - 1 AS INTEGER) AS pos, b AS element FROM ses",
    "enrich_left_join": f"WITH {_POPULAR}, tit AS (SELECT p_partkey, p_name FROM part WHERE p_partkey % 2 = 0) SELECT pop.a, pop.b, w, coalesce(y.p_name, CAST(pop.b AS VARCHAR)) AS b_title, coalesce(x.p_name, CAST(pop.a AS VARCHAR)) AS a_title FROM pop LEFT JOIN tit x ON x.p_partkey = pop.a LEFT JOIN tit y ON y.p_partkey = pop.b",
    "enrich_unknown": f"WITH {_COUNTS} SELECT b, n, coalesce(p_name, 'UNKNOWN') AS title FROM cnt LEFT JOIN part ON p_partkey = b AND p_partkey % 2 = 0",
    "enrich_titles": f"WITH {_POPULAR} SELECT pop.a, pop.b, w, coalesce(y.p_name, CAST(pop.b AS VARCHAR)) AS b_title, coalesce(x.p_name, CAST(pop.a AS VARCHAR)) AS a_title FROM pop LEFT JOIN part x ON x.p_partkey = pop.a LEFT JOIN part y ON y.p_partkey = pop.b",
    "enrich_unlabelled": "SELECT d.doc_id, d.source, coalesce(m.mark, 'UNKNOWN') AS quality FROM documents d LEFT JOIN (SELECT doc_id, min(CAST(quality AS VARCHAR)) AS mark FROM labels GROUP BY doc_id) m ON m.doc_id = d.doc_id",
    "loaded_partitions": f"SELECT CAST(s_suppkey % {PARTS} AS INTEGER) AS source_p, count(*) AS n, CAST(sum(s_suppkey) AS BIGINT) AS total FROM supplier GROUP BY 1",
    "master_dict": f"SELECT id, l_partkey, coalesce(p_name, 'UNKNOWN') AS title FROM (SELECT l_partkey, (row_number() OVER (PARTITION BY l_partkey % {PARTS} ORDER BY l_partkey) - 1) * {PARTS} + l_partkey % {PARTS} AS id FROM (SELECT DISTINCT l_partkey FROM lineitem)) LEFT JOIN part ON p_partkey = l_partkey",
    "broadcast_lookup": "SELECT c_custkey, c_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "semi_join_ref": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "anti_join_ref": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "cofreq_pairs": f"WITH {_COFREQ} SELECT * FROM cof",
    "cofreq_inverted": f"WITH {_POPULAR} SELECT * FROM pop",
    "complements": f"WITH {_COMPLEMENTS} SELECT a, b, round(w, 4) AS w, aw, bw FROM com",
    "complements_topk": f"WITH {_COMPLEMENTS} SELECT a, b, round(w, 4) AS w, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS INTEGER) AS rank FROM com) WHERE rank <= 20",
    "tfidf_norm": f"WITH {_VECTORS} SELECT a, b, round(w, 6) AS w FROM vec",
    "feature_lists": f"WITH {_VECTORS} SELECT b AS feature, CAST(row_number() OVER (PARTITION BY b ORDER BY a) - 1 AS INTEGER) AS pos, a AS id, round(CAST(CAST(w AS FLOAT) AS DOUBLE), 5) AS w FROM vec",
    "substitutes": f"WITH {_SUBSTITUTES} SELECT a, b, round(w, 4) AS w FROM sub",
    "substitutes_topk": f"WITH {_SUBSTITUTES} SELECT a, b, round(w, 4) AS w, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS INTEGER) AS rank FROM sub) WHERE rank <= 20",
    "rnn_top1": f"WITH {_BEST} SELECT a, b, round(w, 4) AS w, aw, bw FROM bes",
    "rnn_pairs": f"WITH {_RECIPROCAL} SELECT a, b, round(w, 4) AS w, aw, bw FROM pai",
    "topk_json": f"""WITH {_COMPLEMENTS}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS rank FROM com) WHERE rank <= 20)
SELECT a, '{{"id":' || a || ',"title":"' || x.p_name || '","recommendations":[' || string_agg('{{"id":' || b || ',"title":"' || y.p_name || '","score":"' || printf('%.4f', w) || '"}}', ',' ORDER BY rank) || ']}}' AS line
FROM top JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b GROUP BY a, x.p_name""",
    "buddies_json": f"""WITH {_RECIPROCAL} SELECT a, b, '{{"id_a":' || a || ',"title_a":"' || x.p_name || '","users_a":"' || printf('%.0f', aw) || '","id_b":' || b || ',"title_b":"' || y.p_name || '","users_b":"' || printf('%.0f', bw) || '","score":"' || printf('%.4f', w) || '"}}' AS line
FROM pai JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b""",
    "branch_union": "SELECT * FROM (VALUES (0, 'Convergence Reached: [EVEN] partition 0 goes even'), (1, 'Convergence Reached: [ODD]  partition 1 goes odd'), (2, 'Convergence Reached: [EVEN] partition 2 goes even'), (2, 'Convergence Reached: [ODD]  partition 2 goes odd')) AS t(p, str)",
    "branch_starved": "SELECT 3 AS p",
    "prev_run_delta": f"WITH {_SESSIONS} SELECT a, b FROM ses EXCEPT SELECT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate < TIMESTAMP '1997-01-01 00:00:00'",
    "hash131_five": f"SELECT p_partkey, CAST({_wide('p_name')} % 5 AS INTEGER) AS p FROM part",
    "round_robin_balance": f"SELECT CAST(p AS INTEGER) AS p, CAST((SELECT count(*) FROM events) // {PARTS} + CASE WHEN p < (SELECT count(*) FROM events) % {PARTS} THEN 1 ELSE 0 END AS BIGINT) AS n FROM range({PARTS}) r(p)",
    "word_count_graph": f"WITH {_WORDS} SELECT word, CAST(count(*) AS DOUBLE) AS w, CAST({_h('word')} AS INTEGER) AS p FROM wor GROUP BY word",
    "dedup_graph": f"WITH {_SESSIONS} SELECT a, b, CAST(a % {PARTS} AS INTEGER) AS p FROM ses",
    "union_reduce_graph": f"SELECT str, w, CAST({_h('str')} AS INTEGER) AS p FROM (SELECT 'nation ' || k AS str, CAST(count(*) AS DOUBLE) AS w FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k)",
    "sort_violations_planted": f"SELECT CAST(o_custkey % {PARTS} AS INTEGER) AS p, count(*) AS violations FROM (SELECT o_custkey, o_totalprice AS x, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS y FROM orders) WHERE y > x GROUP BY 1",
    "branch_by_table": f"SELECT CAST(p AS INTEGER) AS p, way, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM (SELECT o_orderkey % {PARTS} AS p, o_orderkey FROM orders) JOIN (VALUES (0, 'even'), (2, 'even'), (1, 'odd'), (2, 'odd')) AS v(q, way) ON p = q GROUP BY 1, 2",
    "prev_run_sessions": f"WITH {_SESSIONS} SELECT a, b FROM ses EXCEPT SELECT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate < TIMESTAMP '1997-01-01 00:00:00'",
}
