"""DuckDB SQL for the operators that SQL can express: what their queries return, by the definitions.

Mixing: Sainte-Laguë quotients are all made and ranked here; the operator makes only the open ones.
Sharding: rows are ranked by one global sort; the operator counts its way to the same places. License scans: every
block meets every template and every place every phrase; the operator indexes prefixes.
"""

from __future__ import annotations

import math
import zlib

from weirflow.llm.hilbert import BITS, BUCKETS, curve_table
from weirflow.llm.licenses import LONG, PHRASES, TEMPLATES, THRESHOLD, words_of
from weirflow.llm.mixing import BLOCKS, MOST_BLOCK, REPEAT, SEED, SHARD_WORDS, SHARE, WEIGHTS


def _fold(items: str, start: str, step: str) -> str:
    return f"list_reduce(list_prepend(CAST({start} AS BIGINT), {items}), lambda acc, i: {step})"


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, folded byte by byte over the table of one-byte remainders."""
    table = [zlib.crc32(bytes([i ^ 0xFF])) ^ 0xFF000000 for i in range(256)]
    raw = f"encode({text})"
    each = f"list_transform(range(CAST(octet_length({raw}) AS BIGINT)), lambda k: CAST(('0x' || substr(hex({raw}), 2 * k + 1, 2)) AS BIGINT))"
    step = f"xor(acc >> 8, [{', '.join(f'{x}::BIGINT' for x in table)}][xor(acc & 255, i) + 1])"
    return f"xor({_fold(each, 4294967295, step)}, 4294967295)"


def _level(column: str) -> str:
    """(value, level): 32 levels by the share of rows that sort before."""
    return f"SELECT {column} AS v, CAST(floor(CAST((sum(n) OVER (ORDER BY {column} NULLS LAST) - n) * {1 << BITS} AS DOUBLE) / sum(n) OVER ()) AS BIGINT) AS l FROM (SELECT {column}, count(*) AS n FROM d GROUP BY 1)"


def _quotas(rows: str, group: str, name: str, votes: str, seats: str) -> str:
    """(group, name, won): every quotient votes/(2s+1), the highest of each group."""
    return f"""SELECT {group} AS g, {name} AS x, CAST(count(*) AS BIGINT) AS won FROM (
  SELECT {group}, {name}, {seats}, row_number() OVER (PARTITION BY {group} ORDER BY {votes} / (2 * s + 1) DESC, {name} NULLS LAST) AS r
  FROM (SELECT *, unnest(range({seats})) AS s FROM {rows} WHERE {votes} > 0)) WHERE r <= {seats} GROUP BY 1, 2"""


MIX = rf"""WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST(('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) AS h FROM documents),
a AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([{", ".join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS DOUBLE) AS w FROM d GROUP BY source),
b AS (SELECT *, {REPEAT} * CAST(source_size AS DOUBLE) AS cap, {REPEAT} * CAST(source_size AS DOUBLE) / w AS ratio FROM a),
c AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * {SHARE} - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM b),
e AS (SELECT source, source_size, least(cap, coalesce(max(CASE WHEN level <= ratio THEN level END) OVER () * w, cap)) AS target FROM c),
f AS (SELECT *, CAST(least({MOST_BLOCK}, pow(2, length(bin(CAST(floor(coalesce(min(CASE WHEN target > 0 THEN target END) OVER (), 0) / {BLOCKS}) AS BIGINT))) - 1)) AS BIGINT) AS block,
  greatest(1, CAST(ceil(CAST(sum(source_size) OVER () AS DOUBLE) / {SHARD_WORDS}) AS BIGINT)) AS shards FROM e),
g AS (SELECT *, CAST(floor(sum(target) OVER () / block) AS BIGINT) AS seats, 1 AS one FROM f),
q AS ({_quotas("g", "one", "source", "target", "seats")}),
p AS (SELECT g.*, coalesce(q.won, 0) AS quota FROM g LEFT JOIN q ON g.source IS NOT DISTINCT FROM q.x),
k AS (SELECT d.*, p.source_size, p.target, p.block, p.quota, d.h % {1 << 20} % p.shards AS shard FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
s AS (SELECT source, shard, block, quota, CAST(sum(size) AS BIGINT) AS words FROM k GROUP BY 1, 2, 3, 4),
t AS ({_quotas("s", "source", "shard", "words", "quota")}),
u AS (SELECT s.source, s.shard, s.words, least(coalesce(t.won, 0) * s.block, {REPEAT} * s.words) AS take FROM s LEFT JOIN t ON s.source IS NOT DISTINCT FROM t.g AND s.shard = t.x),
v AS (SELECT k.*, u.words, u.take, CASE WHEN u.words > 0 THEN u.take // u.words ELSE 0 END AS passes, sum(k.size) OVER (PARTITION BY k.source, k.shard ORDER BY k.h, k.doc_id NULLS FIRST, k.size ROWS UNBOUNDED PRECEDING) - k.size AS before
  FROM k JOIN u ON k.source IS NOT DISTINCT FROM u.source AND k.shard = u.shard)
SELECT doc_id, size, source_size, target, CAST(passes * size + greatest(0, least(take - passes * words - before, size)) AS BIGINT) AS taken FROM v"""

SHARD = f"""WITH d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, {_crc32("coalesce(text, '')")} AS text_crc32, source, lang,
    CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) % {BUCKETS} AS bucket FROM documents),
x AS ({_level("source")}), y AS ({_level("lang")}),
c AS (SELECT d.*, x.l AS a, y.l AS b, least(length(bin(size)), {(1 << BITS) - 1}) AS m FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.v JOIN y ON d.lang IS NOT DISTINCT FROM y.v),
e AS (SELECT *, CAST({_fold(f"range({BITS - 1}, -1, -1)", 0, f"((acc >> 5) << 8) + [{', '.join(map(str, curve_table()))}][acc % 32 * 8 + (a >> i) % 2 * 4 + (b >> i) % 2 * 2 + (m >> i) % 2 + 1]")} >> 5 AS INTEGER) AS curve FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY curve, bucket, doc_id NULLS FIRST, size, text_crc32) - 1 AS rank, count(*) OVER () AS total FROM e)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(((rank + 1) * 24 - 1) // total AS INTEGER) AS shard,
  CAST(rank - total * (((rank + 1) * 24 - 1) // total) // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, curve FROM r"""

_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _phrase(phrase: str, label: str) -> str:
    words = phrase.split()
    return f"SELECT k, '{label}' AS label, unnest(list_filter(range(len(w)), lambda i: w[i + 1 : i + {len(words)}] = {_list(words)})) AS i FROM w"


def _template(place: int, label: str, text: str) -> str:
    words = sorted({w.decode() for w in words_of(text.encode())})
    return f"({place}, '{label}', {_list(words)}, {math.ceil(THRESHOLD * len(words) - 1e-9)})"


LICENSES = rf"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT k, doc_id, t, regexp_extract_all(t, {_WORD}) AS w FROM d),
places AS ({" UNION ALL ".join(_phrase(p, label) for p, label in PHRASES.items())}),
base AS (SELECT k, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY k),
parts AS (SELECT k, string_split(unnest(string_split_regex(t, '
[ 	]*
')), chr(10)) AS lines FROM d),
blocks AS (SELECT k, unnest(lines) AS block, true AS line FROM parts UNION ALL SELECT k, array_to_string(lines, chr(10)), false FROM parts WHERE len(lines) > 1),
sets AS (SELECT k, line, list_distinct(regexp_extract_all(block, {_WORD})) AS have FROM blocks),
templates AS (SELECT * FROM (VALUES {", ".join(_template(i, *t) for i, t in enumerate(TEMPLATES))}) AS v(place, label, need, least)),
met AS (SELECT k, place, label, max(CAST(len(list_intersect(have, need)) AS DOUBLE) / len(need)) AS share FROM sets JOIN templates ON (line OR len(need) >= {LONG}) AND len(have) >= least AND len(list_intersect(have, need)) >= least GROUP BY 1, 2, 3),
best AS (SELECT k, max(share) AS share, string_agg(CAST(place AS VARCHAR), ',' ORDER BY place) AS templates FROM met GROUP BY k),
names AS (SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT k, label FROM places UNION SELECT k, label FROM met) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(base.labels, '') AS base_labels, coalesce(names.labels, '') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score, coalesce(templates, '') AS templates
FROM w LEFT JOIN base USING (k) LEFT JOIN best USING (k) LEFT JOIN names USING (k)"""

ORACLES = {"op7_license_join": LICENSES, "op2_sainte_lague": MIX, "op5_hilbert": SHARD}
