"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL where there is any."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import find_leaks
from .language_id import fit_languages, identify
from .lm_scores import stupid_backoff
from .near_duplicates import near_duplicates
from .packing import harmonic_pack
from .samples import held_out
from .secrets import PATTERNS, find_secrets
from .shared import table
from . import structure_queries
from .substring_dedup import remove_repeats
from .top_k import top_k
from .toxicity import fit_documents, score_toxicity
from .url_filter import judge_urls

#: The rules that op4 is to apply.
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stupid_backoff(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    dictionaries = fit_languages(docs.filter(~F.col("held_out")))
    return identify(docs.drop("lang"), dictionaries).select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("node", "root")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table(spark, sf_dir, "embeddings").filter(F.col("embedding").isNotNull() & ~odd).select("vec_id", whole.alias("v"))
    return top_k(rows, rows.filter(F.col("vec_id") % 100 == 0), k=10, id_col="vec_id").withColumnRenamed("id", "vec_id")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k, *_ in PATTERNS), F.sha2(said(F.filter("secrets", lambda x: x["kind"] != "entropy")), 256).alias("base_sha256"), said(F.col("secrets")).alias("spans"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    network = fit_documents(docs.filter(~F.col("held_out")), labels)
    return score_toxicity(docs, network).select("doc_id", "held_out", "score", "predicted")


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = harmonic_pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_lm_scores, op3_language_id, op4_url_filter, op5_near_duplicates, op6_top_k, op7_secret_scan, op8_toxicity, op9_harmonic_packing, op10_substring_dedup)} | structure_queries.QUERIES

ORACLES = {
    "op2_lm_scores": r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^ \t\n\x0B\x0C\r]+'), []) AS ws FROM documents),
f AS (SELECT rid, unnest(ws) AS w3, unnest(range(len(ws))) AS pos FROM t),
g AS (SELECT *, lag(w3) OVER o AS w2, lag(w3, 2) OVER o AS w1 FROM f WINDOW o AS (PARTITION BY rid ORDER BY pos)),
n AS (SELECT count(*) AS total FROM g),
size AS (SELECT rid, count(*) AS words FROM g GROUP BY rid),
c AS (SELECT *, count(*) OVER (PARTITION BY w3) - count(*) OVER (PARTITION BY rid, w3) AS c1,
      count(*) OVER (PARTITION BY w2, w3) - count(*) OVER (PARTITION BY rid, w2, w3) AS c2,
      count(*) OVER (PARTITION BY w1, w2, w3) - count(*) OVER (PARTITION BY rid, w1, w2, w3) AS c3 FROM g),
x AS (SELECT *, lag(c1) OVER p AS k1, lag(c2) OVER p AS k2 FROM c WINDOW p AS (PARTITION BY rid ORDER BY pos)),
s AS (SELECT x.rid, CASE WHEN pos >= 2 AND c3 > 0 THEN CAST(c3 AS DOUBLE) / k2 WHEN pos >= 1 AND c2 > 0 THEN power(0.4, least(pos, 2) - 1) * (CAST(c2 AS DOUBLE) / k1)
      WHEN c1 > 0 THEN power(0.4, least(pos, 2)) * (CAST(c1 AS DOUBLE) / (total - words)) ELSE power(0.4, least(pos, 2) + 1) / greatest(total - words, 1) END AS v,
      NOT (CASE WHEN pos >= 2 THEN c3 > 0 WHEN pos = 1 THEN c2 > 0 ELSE c1 > 0 END) AS off FROM x JOIN size USING (rid), n)
SELECT t.doc_id, CAST(len(t.ws) AS BIGINT) AS n_words, CAST(coalesce(sum(CAST(round_even(1e6 * log10(v), 0) AS BIGINT)), 0) AS BIGINT) AS score_micro, count(*) FILTER (off) AS n_backed_off
FROM t LEFT JOIN s ON s.rid = t.rid GROUP BY t.rid, t.doc_id, len(t.ws)
""",
    "op6_top_k": r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
x AS (SELECT vec_id, unnest(range(len(e))) AS d, unnest(e) AS c, len(e) AS n FROM v),
s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(sum(q.c * x.c) AS BIGINT) AS score FROM x q JOIN x ON q.d = x.d AND q.n = x.n AND q.vec_id <> x.vec_id
      WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id, x.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 10
""",
    "op7_secret_scan": r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT rid, 0 AS ord, 'assign' AS kind, regexp_extract_all(text, '(?s)(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+|.') AS parts FROM t WHERE regexp_matches(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]')
 UNION ALL SELECT rid, 1, 'access', regexp_extract_all(text, '(?s)AKIA[A-Z0-9]+|.') FROM t WHERE contains(text, 'AKIA')
 UNION ALL SELECT rid, 2, 'hex', regexp_extract_all(text, '(?s)[0-9a-f]+|.') FROM t WHERE regexp_matches(text, '[0-9a-f]{32}')
 UNION ALL SELECT rid, 3, 'entropy', regexp_extract_all(text, '(?s)[A-Za-z0-9+/_=-]+|.') FROM t WHERE regexp_matches(text, '[A-Za-z0-9+/_=-]{20}')),
p AS (SELECT rid, ord, kind, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM m),
q AS (SELECT *, sum(length(part)) OVER (PARTITION BY rid, ord ORDER BY i) AS stop FROM p),
r AS (SELECT rid, ord, kind, part, CAST(stop - length(part) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM q WHERE CASE ord WHEN 0 THEN length(regexp_extract(part, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 8 WHEN 1 THEN length(part) >= 16 WHEN 2 THEN length(part) >= 32 ELSE length(part) >= 20 END),
base AS (SELECT * FROM r WHERE ord < 3),
c AS (SELECT r.*, CASE WHEN regexp_full_match(part, '[0-9a-fA-F]+') THEN 3.0 WHEN NOT regexp_matches(part, '[0-9]') THEN CASE WHEN regexp_matches(part, '[a-z]') AND regexp_matches(part, '[A-Z]') THEN 3.95 ELSE 4.1 END
  WHEN regexp_full_match(part, '[0-9A-Z]+') THEN 3.5 WHEN regexp_full_match(part, '[0-9a-z]+') THEN 3.6 WHEN regexp_matches(part, '[a-z]') AND regexp_matches(part, '[A-Z]') THEN 3.8 WHEN regexp_matches(part, '[A-Za-z]') THEN 3.9 ELSE 4.1 END AS bits
 FROM r WHERE ord = 3 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = r.rid AND b.start < r.stop AND r.start < b.stop)
 AND NOT regexp_matches(part, '(?i)example|placeholder|changeme|redacted|x{6,}|^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$|^[0-9_=+/-]+$|^[a-z]+([/_-][a-z]+)*[/_-][0-9]+$')),
w AS (SELECT rid, start, stop, bits, part, unnest(range(1, length(part) - 18)) AS i FROM c),
x AS (SELECT rid, start, stop, bits, i, unnest(string_split(substring(part, i, 20), '')) AS ch FROM w),
h AS (SELECT rid, start, stop, bits, i, -sum(n / 20.0 * log2(n / 20.0)) AS e FROM (SELECT rid, start, stop, bits, i, ch, count(*) AS n FROM x GROUP BY ALL) GROUP BY ALL),
found AS (SELECT rid, ord, kind, start, stop FROM base UNION ALL SELECT rid, 3, 'entropy', start, stop FROM h GROUP BY rid, start, stop, bits HAVING max(e) >= bits - 1e-9),
a AS (SELECT rid, count(*) FILTER (ord = 0) AS n0, count(*) FILTER (ord = 1) AS n1, count(*) FILTER (ord = 2) AS n2, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (ord < 3) AS b, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS s FROM found GROUP BY rid)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans FROM t LEFT JOIN a USING (rid)
""",
    "op10_substring_dedup": r"""
WITH t AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^ \t\n\x0B\x0C\r]+'), []) AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos, len(ws) AS n FROM t),
win AS (SELECT doc_id, pos AS p, md5(array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING), ' ')) AS h
        FROM w QUALIFY pos + 35 <= n),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY h) AS c FROM win) WHERE c > 1),
gone AS (SELECT w.doc_id, w.pos, bool_or(r.p IS NOT NULL) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS g, w.word
         FROM w LEFT JOIN rep r ON r.doc_id = w.doc_id AND r.p = w.pos),
agg AS (SELECT doc_id, count(*) FILTER (g) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT g) AS kept FROM gone GROUP BY doc_id)
SELECT t.doc_id, CAST(len(t.ws) AS BIGINT) AS n_words, CAST(coalesce(a.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(a.kept, '')) AS kept_sha256
FROM t LEFT JOIN agg a ON a.doc_id = t.doc_id
""",
} | structure_queries.ORACLES
