"""The registered queries of source divergence, sharding and conversation repair, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conversation_repair import Conversations, damage
from .hilbert_shards import BITS, curve_table, hilbert_shards
from .shared import durable, table
from .source_divergence import source_divergence

SHARDS = 8


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = hilbert_shards(docs, ["lang", "source", "size"], SHARDS, tie=["doc_id", "text_crc32", "size"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, dropped = damage(table(spark, sf_dir, "conversations"))
    found = Conversations(rows, dropped=dropped)
    return found.digests(durable(found.audits()))


QUERIES = {f.__name__: f for f in (op11_source_divergence, op12_hilbert_sharding, op13_conversation_repair)}

#: crc_table.t: the 256 steps of CRC-32 by the reversed polynomial.
_CRC = """crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i)))"""


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes; crc_table must be among the tables."""
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda a, y: xor(a >> 8, t[(xor(a, y) & 255) + 1])), 4294967295)"


_WS = r"\x20\x09-\x0D"

ORACLES = {
    "op11_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT rid, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
a AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + CAST(1000000000 * (n + 1) AS HUGEINT) // (CAST(sum(n) OVER (PARTITION BY lang, source) AS HUGEINT) + v) AS p FROM a JOIN size USING (lang)),
q AS (SELECT lang, term, 1 + CAST(1000000000 * (n + 1) AS HUGEINT) // (CAST(sum(n) OVER (PARTITION BY lang) AS HUGEINT) + v) AS q FROM (SELECT lang, term, sum(n) AS n FROM a GROUP BY lang, term) JOIN size USING (lang)),
f AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
 UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= 200
""",
    "op12_hilbert_sharding": f"""
WITH {_CRC},
d AS (SELECT doc_id, lang, source, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, CAST({_crc32("coalesce(text, '')")} AS BIGINT) AS text_crc32 FROM documents, crc_table),
l AS (SELECT *, (rank() OVER (ORDER BY lang NULLS FIRST) - 1) * {1 << BITS} // count(*) OVER () AS x, (rank() OVER (ORDER BY source NULLS FIRST) - 1) * {1 << BITS} // count(*) OVER () AS y, (rank() OVER (ORDER BY size) - 1) * {1 << BITS} // count(*) OVER () AS z FROM d),
c AS (SELECT *, list_transform(range({BITS - 1}, -1, -1), lambda i: (x >> i) % 2 + (y >> i) % 2 * 2 + (z >> i) % 2 * 4) AS corners, {list(curve_table(3))} AS t FROM l),
h AS (SELECT *, list_reduce(list_prepend(CAST(0 AS BIGINT), corners), lambda a, k: ((a >> 5) * 8 + t[(a & 31) * 8 + k + 1] % 8) * 32 + t[(a & 31) * 8 + k + 1] // 8) >> 5 AS hilbert FROM c),
o AS (SELECT *, row_number() OVER (ORDER BY hilbert, doc_id NULLS FIRST, text_crc32, size) - 1 AS i, count(*) OVER () AS total, least({SHARDS}, count(*) OVER ()) AS n FROM h),
s AS (SELECT *, CASE WHEN i < total % n * (total // n + 1) THEN i // (total // n + 1) ELSE total % n + (i - total % n * (total // n + 1)) // (total // n) END AS shard FROM o)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY i) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, CAST(hilbert AS BIGINT) AS hilbert FROM s
""",
    "op13_conversation_repair": rf"""
WITH RECURSIVE {_CRC},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations, crc_table),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) FROM k WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, substring(role, 1, 1) AS ini FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^{_WS}]') THEN 'b' WHEN nth > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][{_WS}]*$') THEN 't' ELSE '' END AS fault FROM o),
ins AS (SELECT * FROM (VALUES ('E', '', 0, 'E'), ('S', '', 0, 'S'), ('U', '', 0, 'U'), ('A', '', 0, 'A'), ('E', 'I', 2, 'U'), ('S', 'I', 2, 'U'), ('U', 'I', 2, 'A'), ('A', 'I', 2, 'U'), ('E', 'II', 4, 'A'), ('S', 'II', 4, 'A'), ('U', 'II', 4, 'U'), ('A', 'II', 4, 'A')) x(s, e, c, t)),
act AS (SELECT * FROM (VALUES ('D', 'E', 'E', ''), ('D', 'S', 'S', ''), ('D', 'U', 'U', ''), ('D', 'A', 'A', ''), ('K', 'E', 'S', 's'), ('Y', 'E', 'U', 'u'), ('Y', 'S', 'U', 'u'), ('Y', 'U', 'A', 'a'), ('Y', 'A', 'U', 'u')) x(e, s, t, ini)),
v AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 'E' AS s, {{'c': CAST(0 AS BIGINT), 'a': ''}} AS w FROM k
 UNION ALL
 SELECT v.conv_id, f.i, act.t, min({{'c': CAST(w.c + ins.c + CASE WHEN act.e = 'D' THEN 3 ELSE (CASE WHEN f.ini = act.ini THEN 0 ELSE 2 END) + (CASE WHEN fault = 't' THEN 1 ELSE 0 END) END AS BIGINT), 'a': w.a || ins.e || CASE WHEN act.e = 'Y' THEN CASE WHEN f.ini = act.ini THEN 'K' ELSE 'R' END ELSE act.e END}})
 FROM v JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.i = v.i + 1 JOIN ins ON ins.s = v.s JOIN act ON act.s = ins.t
 WHERE act.e = 'D' OR (fault NOT IN ('b', 'd') AND (act.e = 'Y' OR f.ini = 's')) GROUP BY v.conv_id, f.i, act.t),
best AS (SELECT v.conv_id, min({{'c': CAST(w.c + ins.c AS BIGINT), 'a': w.a || ins.e}}) AS w FROM v JOIN ins USING (s) WHERE ins.t IN ('E', 'A') AND v.i = (SELECT coalesce(max(f.i), 0) FROM f WHERE f.conv_id IS NOT DISTINCT FROM v.conv_id) GROUP BY v.conv_id),
e AS (SELECT conv_id, w.c AS cost, w.a AS audit, unnest(range(1, length(w.a) + 1)) AS p FROM best),
g AS (SELECT *, substring(audit, CAST(p AS INTEGER), 1) AS edit, CAST(p - length(replace(substring(audit, 1, CAST(p AS INTEGER)), 'I', '')) AS BIGINT) AS inserted, length(replace(substring(audit, 1, CAST(p AS INTEGER)), 'D', '')) AS nth FROM e),
r AS (SELECT g.*, f.role, f.text, f.ini FROM g LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.i = g.p - g.inserted AND g.edit <> 'I' WHERE g.edit <> 'D'),
q AS (SELECT *, nth - max(CASE WHEN nth = 1 AND edit = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS place FROM r),
x AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS said FROM q GROUP BY conv_id),
y AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT b.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, b.w.c AS cost, b.w.a AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM best b LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN y ON y.conv_id IS NOT DISTINCT FROM b.conv_id
""",
}
