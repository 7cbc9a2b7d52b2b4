"""Alignments: validation, joins, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment as L
from . import inputs as I
from .inputs import duck, table
from .registry import query


def _four(c: str, name: str) -> str:
    return f"round(avg({c}), 6) AS {name}_mean, " + ", ".join(f"round(quantile_cont({c}, {p / 100}), 6) AS {name}_p{p}" for p in (5, 50, 95))


@query("alignment_quality", duck("utts", f""", g AS (SELECT *, st_ms - lag(en_ms) OVER (PARTITION BY doc_id ORDER BY pos) AS gap FROM words),
e AS (SELECT doc_id, count(*) AS aligned, min(st_ms) AS first_, max_by(en_ms, pos) AS last_ FROM words GROUP BY doc_id),
r AS (SELECT u.*, aligned, last_, coalesce(aligned > 0, false) AND audio_ms > 0 AS used, last_ - first_ AS span FROM utts u LEFT JOIN e USING (doc_id)),
a AS (SELECT dataset, count(*) AS n, {_four("CASE WHEN used THEN last_ / audio_ms END", "coverage")}, {_four("CASE WHEN used AND span > 0 THEN aligned * 1000 / span END", "wps")},
 count(*) FILTER (used AND last_ > audio_ms + 100) AS out_of_bounds, count(*) FILTER (NOT used OR abs(n_words - aligned) > greatest(1, n_words * 0.1)) AS mismatches FROM r GROUP BY dataset),
b AS (SELECT dataset, {_four("gap / 1000", "gap")}, {_four("score_milli / 1000", "score")}, count(*) FILTER (gap < -20) AS "overlaps", count(gap) AS gaps FROM g JOIN r USING (doc_id) WHERE used GROUP BY dataset)
SELECT a.*, {", ".join(f"{x}_{y}" for x in ("gap", "score") for y in ("mean", "p5", "p50", "p95"))}, "overlaps", gaps, round(coalesce("overlaps", 0) / greatest(coalesce(gaps, 0), 1), 6) AS overlap_rate, round(out_of_bounds / greatest(n, 1), 6) AS oob_rate, round(mismatches / greatest(n, 1), 6) AS mismatch_rate FROM a LEFT JOIN b USING (dataset)"""))
def alignment_quality(spark, d):
    return L.alignment_quality(I.utts(spark, d), I.words(spark, d), key="doc_id")


@query("word_gaps", duck("words", "SELECT doc_id, pos, st_ms - lag(en_ms) OVER (PARTITION BY doc_id ORDER BY pos) AS gap FROM words"))
def word_gaps(spark, d):
    return L.word_gaps(I.words(spark, d), "doc_id", "st_ms", "en_ms").select("doc_id", "pos", "gap")


@query("explode_words", duck("words", "SELECT doc_id, pos, word, st_ms / 1000 AS \"start\", en_ms / 1000 AS \"end\", score_milli / 1000 AS score FROM words WHERE doc_id % 29 <> 0"))
def explode_words(spark, d):
    return L.explode_words(I.alignments(spark, d), ["doc_id"]).withColumn("pos", F.col("pos").cast("long"))


#: The issues of the alignment records of the inputs, in DuckDB.
_ISSUES = """, al AS (SELECT u.doc_id, CASE WHEN u.doc_id % 31 = 0 THEN 0 ELSE audio_ms END AS ms, count(w.pos) AS k, sum(score_milli) AS s FROM utts u LEFT JOIN words w USING (doc_id) WHERE u.doc_id % 29 <> 0 GROUP BY 1, 2),
iss AS (SELECT doc_id, CASE WHEN doc_id % 23 = 0 THEN ['missing field:split'] WHEN k = 0 THEN ['words empty'] ELSE list_concat(CASE WHEN s / 1000 / k < 0.5 THEN ['low score'] ELSE [] END, CASE WHEN ms <= 0 THEN ['bad duration'] ELSE [] END) END AS issues FROM al)
"""


@query("validate_alignment", duck("utts", _ISSUES + "SELECT doc_id, array_to_string(issues, ';') AS issues FROM iss"))
def validate_alignment(spark, d):
    # Scores are summed in whole thousandths here, so that a mean of just 0.5 is the same in every engine.
    rows = L.validate_alignment(I.alignments(spark, d), ["split", "audio_duration"])
    return rows.select("doc_id", F.array_join("issues", ";").alias("issues"))


def _manifest(spark, d):
    return I.utts(spark, d).select("doc_id", "utterance_id", (F.col("doc_id") % 4).cast("string").alias("split"))


def _status(spark, d):
    checked = L.validate_alignment(I.alignments(spark, d), ["split", "audio_duration"])
    return L.merge_with_manifest(_manifest(spark, d), checked, key="utterance_id")


_STATUS = """, man AS (SELECT doc_id, utterance_id, CAST(doc_id % 4 AS VARCHAR) AS split FROM utts),
st AS (SELECT m.*, CASE WHEN i.issues IS NULL THEN 'missing' WHEN len(i.issues) = 0 THEN 'ok' WHEN i.issues = ['low score'] THEN 'low_score' ELSE 'invalid' END AS status FROM man m LEFT JOIN iss i ON m.doc_id = i.doc_id)
"""


@query("merge_with_manifest", duck("utts", _ISSUES + _STATUS + "SELECT utterance_id, split, status FROM st"))
def merge_with_manifest(spark, d):
    return _status(spark, d).select("utterance_id", "split", "status")


@query("merge_report", duck("utts", _ISSUES + _STATUS + """, ch AS (SELECT * FROM st WHERE split IN ('0', '1', '2')),
ex AS (SELECT split, string_agg(utterance_id, ',' ORDER BY utterance_id) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY utterance_id) AS r FROM ch WHERE status = 'missing') WHERE r <= 5 GROUP BY split)
SELECT c.split, CAST(g AS TINYINT) AS "all", total, ok, missing, invalid, low_score, round_even(100.0 * ok / CASE WHEN g = 1 THEN (SELECT count(*) FROM st) ELSE total END, 2) AS coverage, coalesce(CASE WHEN g = 0 THEN examples END, '') AS examples
FROM (SELECT split, grouping(split) AS g, count(*) AS total, count(*) FILTER (status IN ('ok', 'low_score')) AS ok, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'invalid') AS invalid, count(*) FILTER (status = 'low_score') AS low_score FROM ch GROUP BY ROLLUP (split)) c LEFT JOIN ex ON ex.split = c.split"""))
def merge_report(spark, d):
    return L.merge_report(_status(spark, d), selected=["0", "1", "2"])


@query("missing_alignments", duck("utts", "SELECT utterance_id FROM utts WHERE doc_id % 29 = 0"))
def missing_alignments(spark, d):
    return L.missing_alignments(_manifest(spark, d), I.alignments(spark, d)).select("utterance_id")


@query("attach_alignments", duck("utts", "SELECT u.doc_id, CASE WHEN u.doc_id % 29 = 0 THEN NULL ELSE CAST(CASE WHEN u.doc_id % 2 = 0 THEN u.n_words ELSE 0 END AS BIGINT) END AS n_words FROM utts u"))
def attach_alignments(spark, d):
    # Counts alone are asked for, so they travel in place of the words; both records of an utterance come from one pass over the texts.
    record = lambda words, at: F.struct(F.size(words).alias("words"), F.lit(at).alias("processed_at") if isinstance(at, str) else at.alias("processed_at"))
    later = F.when(F.substring("utterance_id", -1, 1).cast("int") % 2 == 0, "2023-01-01T00:00:00").otherwise("2025-01-01T00:00:00")
    records = I.alignments(spark, d).select("utterance_id", F.explode(F.array(record("words", "2024-01-01T00:00:00"), record(F.slice("words", 1, 0), later))).alias("r"))
    rows = L.attach_alignments(I.names(spark, d), records.select("utterance_id", "r.*"))
    return rows.select("doc_id", F.col("words").cast("long").alias("n_words"))


def _sources(spark, d):
    rows = I.alignments(spark, d)
    n = lambda words: F.size(words).alias("words")  # noqa: E731 - counts alone are asked for, so they travel in place of the words
    a = rows.filter("doc_id % 3 != 0").select("utterance_id", n("words"))
    b = rows.filter("doc_id % 2 = 0").select(F.concat("utterance_id", F.lit(".opus")).alias("raw_id"), n(F.slice("words", 1, 1)))
    return L.attach_first_match(I.names(spark, d), [(a, F.col("utterance_id")), (b, F.regexp_replace("raw_id", r"\.opus$", ""))])


_FIRST = "CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 3 <> 0 THEN 0 WHEN doc_id % 2 = 0 THEN 1 END"


@query("attach_first_match", duck("utts", f"SELECT doc_id, CAST({_FIRST} AS INTEGER) AS source_no, CASE {_FIRST} WHEN 0 THEN n_words WHEN 1 THEN least(n_words, 1) END AS n FROM utts"))
def attach_first_match(spark, d):
    return _sources(spark, d).select("doc_id", "source_no", F.col("words").cast("long").alias("n"))


@query("match_rates", duck("utts", f"SELECT dataset, count(*) AS n, count({_FIRST}) AS matched, count({_FIRST}) / count(*) AS rate FROM utts GROUP BY dataset"))
def match_rates(spark, d):
    return L.match_rates(_sources(spark, d))


@query("quality_filter", duck("utts", """, e AS (SELECT doc_id, max_by(en_ms, pos) AS last_, sum(score_milli) AS s, count(*) AS k FROM words GROUP BY doc_id)
SELECT u.doc_id FROM utts u LEFT JOIN e USING (doc_id) WHERE u.doc_id % 29 <> 0 AND (k IS NULL OR (s >= 500 * k AND last_ <= CASE WHEN u.doc_id % 31 = 0 THEN 0 ELSE audio_ms END + 100))"""))
def quality_filter(spark, d):
    exact = I.alignments(spark, d).withColumn("words", F.transform("words", lambda w: w.withField("score", F.rint(w["score"] * 1000)).withField("end", F.rint(w["end"] * 1000))))
    return L.quality_filter(exact.withColumn("audio_duration", F.rint(F.col("audio_duration") * 1000)), low=500.0, over=100.0).select("doc_id")


@query("format_split_balance", duck("utts", """, h AS (SELECT dataset, ('0x' || md5(utterance_id)[1:2])::INT & 1 AS b, n_words FROM utts)
SELECT dataset, count(*) AS n, round(100 * count(*) FILTER (b = 0) / count(*), 4) AS pct_0, round(100 * count(*) FILTER (b = 1) / count(*), 4) AS pct_1, round(100 * count(*) FILTER (n_words < 2) / count(*), 4) AS pct_short FROM h GROUP BY ROLLUP (dataset)"""))
def format_split_balance(spark, d):
    return L.format_split_balance(I.utts(spark, d))


@query("attach_audio", duck("utts", "SELECT utterance_id, n_words, len(embedding) AS samples FROM utts JOIN embeddings ON doc_id = vec_id WHERE n_words < 300"))
def attach_audio(spark, d):
    corpus = table(spark, d, "embeddings").select(F.concat(F.lit("utt-"), F.lpad(F.col("vec_id").cast("string"), 7, "0")).alias("utterance_id"), F.col("embedding").alias("audio"))
    return L.attach_audio(I.utts(spark, d), corpus, where=F.col("n_words") < 300).select("utterance_id", "n_words", F.size("audio").cast("long").alias("samples"))


@query("last_wins", "SELECT l_orderkey, max(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_orderkey")
def last_wins(spark, d):
    return L.last_wins(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber"]).select("l_orderkey", "l_linenumber")
