"""Word alignments: validation, joins with utterances and manifests, quality reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import bound
from ..functions.text import hash_split
from ..storage import stored
from .order import exact_percentiles

LOW_SCORE = 0.5
#: Scores are summed in whole parts of so many, exactly, so that a mean of just the limit is not under it in any order of summing.
SCORE_PARTS = 1_000_000


def _below(scores: Column, low: float) -> Column:
    """Whether the mean of an array of scores, rounded to SCORE_PARTS, is under ``low``; not so for an empty array."""
    total = F.aggregate(scores, F.lit(0.0), lambda a, s: a + F.rint(s * SCORE_PARTS))
    return (F.size(scores) > 0) & (total < F.size(scores) * F.lit(float(round(low * SCORE_PARTS))))


def explode_words(align: DataFrame, keep: list[str], words: str = "words") -> DataFrame:
    """One row per word: the kept columns, pos from 0, word, start, end and score."""
    return align.select(*keep, F.posexplode(words).alias("pos", "w")).select(*keep, "pos", "w.word", "w.start", "w.end", "w.score")


def word_gaps(words: DataFrame, key: str = "utterance_id", start: str = "start", end: str = "end", pos: str = "pos") -> DataFrame:
    """Exploded words with ``gap``: the start less the end of the word before, null for the first."""
    return words.withColumn("gap", F.col(start) - F.lag(end).over(Window.partitionBy(key).orderBy(pos)))


def alignment_issues(required: list[str], word_fields: tuple[str, ...] = ("word", "start", "end", "score"), low: float = LOW_SCORE) -> Column:
    """The ordered issues of an alignment record, empty if it is sound; the first three end the list.

    missing field:a, words missing, words empty, then word[i] missing f / word[i] end before start, low score, bad duration.
    ``words`` is required anyway; a record of an aligner without scores passes ``word_fields`` without score.
    """
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(f"missing field:{c}")) for c in required)))
    indexed = F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w")))

    def of_word(x: Column) -> Column:
        gone = [F.when(x["w"][f].isNull(), F.concat(F.lit("word["), x["i"], F.lit(f"] missing {f}"))) for f in word_fields]
        late = F.when(F.forall(F.array(*(x["w"][f].isNotNull() for f in word_fields)), lambda b: b) & (x["w"]["end"] < x["w"]["start"]), F.concat(F.lit("word["), x["i"], F.lit("] end before start")))
        return F.array_compact(F.array(*gone, late))

    whole = F.filter("words", lambda w: F.forall(F.array(*(w[f].isNotNull() for f in word_fields)), lambda b: b))
    scores = F.transform(whole, lambda w: F.coalesce(w["score"], F.lit(0.0)))
    tail = F.array_compact(F.array(F.when(bound(scores, lambda x: _below(x, low)), "low score") if "score" in word_fields else F.lit(None).cast("string"), F.when(F.col("audio_duration") <= 0, "bad duration")))
    sound = F.concat(F.flatten(F.transform(indexed, of_word)), tail)
    return F.when(F.size(missing) > 0, missing).when(F.col("words").isNull(), F.array(F.lit("words missing"))).when(F.size("words") == 0, F.array(F.lit("words empty"))).otherwise(sound)


def validate_alignment(align: DataFrame, required: list[str], **options) -> DataFrame:
    return align.withColumn("issues", alignment_issues(required, **options))


def last_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: the last in the given order. Null keys are dropped."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return df.filter(F.col(key).isNotNull()).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def attach_alignments(utts: DataFrame, align: DataFrame, key: str = "utterance_id", order: list[str] | None = None) -> DataFrame:
    """Utterances with their ``words`` or null; of several records the last in ``order`` wins."""
    return utts.join(last_wins(align, key, order or ["processed_at"]).select(key, "words"), key, "left")


def attach_first_match(utts: DataFrame, sources: list[tuple[DataFrame, Column]], key: str = "utterance_id") -> DataFrame:
    """Utterances with the words of the first source, in list order, that has their id, and that source's number.

    Each source comes with the expression that makes the id from its own columns.
    """
    parts = [df.select(id_.alias(key), F.lit(i).alias("source_no"), "words") for i, (df, id_) in enumerate(sources)]
    found = reduce(DataFrame.unionByName, parts).filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by("words", "source_no").alias("words"), F.min("source_no").alias("source_no"))
    return utts.join(found, key, "left")


def match_rates(attached: DataFrame, by: str = "dataset", found: str = "source_no") -> DataFrame:
    """Per dataset: utterances, matched ones and their share; a whole corpus with foreign ids shows as 0."""
    return attached.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count(found).alias("matched")).withColumn("rate", F.col("matched") / F.col("n"))


def missing_alignments(manifest: DataFrame, outputs: DataFrame, key: str = "utterance_id") -> DataFrame:
    return manifest.join(outputs.select(key), key, "left_anti")


def merge_with_manifest(manifest: DataFrame, outputs: DataFrame, issues: str = "issues", key: str = "utterance_id") -> DataFrame:
    """Manifest entries with ``status``: missing, invalid, low_score (kept, and counted as sound) or ok."""
    joined = manifest.join(outputs.select(key, issues), key, "left")
    only_low = F.forall(issues, lambda x: x == "low score")
    return joined.withColumn("status", F.when(F.col(issues).isNull(), "missing").when(F.size(issues) == 0, "ok").when(only_low, "low_score").otherwise("invalid"))


def merge_report(status: DataFrame, split: str = "split", selected: list | None = None, example_key: str = "utterance_id") -> DataFrame:
    """Per split and in all (split null): total, ok (with low scores), missing, invalid, low_score, coverage in percent, and up
    to five missing examples. The grand total's coverage is of the whole manifest, unselected splits too."""
    chosen = status if selected is None else status.filter(F.col(split).isin(selected))
    n = lambda cond: F.count_if(cond)
    good = F.col("status").isin("ok", "low_score")
    rows = chosen.rollup(split).agg(F.count(F.lit(1)).alias("total"), n(good).alias("ok"), n(F.col("status") == "missing").alias("missing"), n(F.col("status") == "invalid").alias("invalid"), n(F.col("status") == "low_score").alias("low_score"), F.grouping(split).alias("all"))
    whole = F.broadcast(status.agg(F.count(F.lit(1)).alias("manifest")))
    w = Window.partitionBy(split).orderBy(example_key)
    examples = chosen.filter("status = 'missing'").withColumn("__r", F.row_number().over(w)).filter("__r <= 5").groupBy(split).agg(F.array_join(F.sort_array(F.collect_list(example_key)), ",").alias("examples"))
    out = rows.crossJoin(whole).withColumn("coverage", F.bround(100 * F.col("ok") / F.when(F.col("all") == 1, F.col("manifest")).otherwise(F.col("total")), 2))
    return out.join(examples.withColumn("all", F.lit(0).cast("tinyint")), [split, "all"], "left").select(split, "all", "total", "ok", "missing", "invalid", "low_score", "coverage", F.coalesce("examples", F.lit("")).alias("examples"))


def alignment_quality(utts: DataFrame, words: DataFrame, key: str = "utterance_id", by: str = "dataset", overlap_ms: int = -20, over_ms: int = 100) -> DataFrame:
    """Quality per dataset, from utterances (key, by, n_words, audio_ms) and their words (key, pos, st_ms, en_ms, score_milli).

    Mean, 5th, 50th and 95th percentiles of coverage (last end / duration), words per second, gaps and scores; rates of
    overlaps (of gaps), of words out of bounds and of word-count mismatches (of utterances). An utterance without words or
    duration counts as a mismatch and for nothing else.
    """
    gaps = stored(word_gaps(words, key, "st_ms", "en_ms").select(key, "pos", "st_ms", "en_ms", "gap", "score_milli"))  # read twice, like the rows below
    per_utt = gaps.groupBy(key).agg(F.count(F.lit(1)).alias("aligned"), F.min("st_ms").alias("first"), F.max_by("en_ms", "pos").alias("last"))
    rows = utts.join(per_utt, key, "left").withColumn("used", F.coalesce(F.col("aligned") > 0, F.lit(False)) & (F.col("audio_ms") > 0))
    used = lambda c: F.when(F.col("used"), c)
    span = F.col("last") - F.col("first")
    rows = rows.withColumn("coverage", used(F.col("last") / F.col("audio_ms"))).withColumn("wps", used(F.when(span > 0, F.col("aligned") * 1000 / span)))
    off = ~F.col("used") | (F.abs(F.col("n_words") - F.col("aligned")) > F.greatest(F.lit(1), F.col("n_words") * 0.1))
    rows = stored(rows.select(key, by, "used", "coverage", "wps", "last", "audio_ms", "n_words", "aligned"))
    # Milliseconds and thousandths repeat, so words leave their task as counts of values.
    words_used = gaps.join(rows.filter("used").select(key, by), key).select(by, F.explode(F.array(F.struct(F.lit("gap").alias("m"), F.col("gap").cast("double").alias("v")), F.struct(F.lit("score").alias("m"), F.col("score_milli").cast("double").alias("v")))).alias("x"))
    words_used = stored(words_used.groupBy(by, "x.m", "x.v").agg(F.count(F.lit(1)).alias("w")))
    ratio = rows.select(by, F.explode(F.array(F.struct(F.lit("coverage").alias("m"), F.col("coverage").alias("v")), F.struct(F.lit("wps").alias("m"), F.col("wps").alias("v")))).alias("x"))
    timed = words_used.select(by, "m", "v", "w")
    points = exact_percentiles(ratio.select(by, "x.m", "x.v", F.lit(1).cast("long").alias("w")).unionByName(timed), [by, "m"], "v", [0.05, 0.5, 0.95], "w").select(by, "m", "p")
    unit = {"coverage": 1, "wps": 1, "gap": 1000, "score": 1000}
    points = points.groupBy(by).agg(*(F.round(F.max(F.when(F.col("m") == m, F.col("p")[i])) / unit[m], 6).alias(f"{m}_p{p}") for m in unit for i, p in enumerate((5, 50, 95))))
    mean = lambda c, name: F.round(F.avg(c), 6).alias(f"{name}_mean")
    a = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), mean(F.col("coverage"), "coverage"), mean(F.col("wps"), "wps"), F.count_if(F.col("used") & (F.col("last") > F.col("audio_ms") + over_ms)).alias("out_of_bounds"), F.count_if(off).alias("mismatches"))
    of = lambda m, x: F.sum(F.when((F.col("m") == m) & F.col("v").isNotNull(), x))
    average = lambda m: F.round(of(m, F.col("v") * F.col("w")) / of(m, F.col("w")) / 1000, 6).alias(f"{m}_mean")
    b = words_used.groupBy(by).agg(average("gap"), average("score"), F.coalesce(of("gap", F.when(F.col("v") < overlap_ms, F.col("w"))), F.lit(0)).alias("overlaps"), F.coalesce(of("gap", F.col("w")), F.lit(0)).alias("gaps"))
    out = a.join(b, by, "left").join(points, by, "left")
    rate = lambda n, of: F.round(F.coalesce(F.col(n), F.lit(0)) / F.greatest(F.coalesce(F.col(of), F.lit(0)), F.lit(1)), 6)
    return out.withColumn("overlap_rate", rate("overlaps", "gaps")).withColumn("oob_rate", rate("out_of_bounds", "n")).withColumn("mismatch_rate", rate("mismatches", "n"))


def quality_filter(align: DataFrame, low: float = LOW_SCORE, over: float = 0.1) -> DataFrame:
    """Drops records with a mean score under ``low`` (where they have scores) or whose last word ends past the audio."""

    def sound(words: Column) -> Column:
        scores = F.filter(F.transform(words, lambda w: w["score"]), lambda s: s.isNotNull())
        late = (F.size(words) > 0) & (F.element_at(words, -1)["end"] > F.col("audio_duration") + over)
        return ~F.coalesce(bound(scores, lambda x: _below(x, low)), F.lit(False)) & ~F.coalesce(late, F.lit(False))

    return align.filter(bound(F.col("words"), sound))


def format_split_balance(utts: DataFrame, key: str = "utterance_id", by: str = "dataset", n_words: str = "n_words") -> DataFrame:
    """Per dataset and in all (null): utterances, percent of each hash half, percent with under two words."""
    half = hash_split(F.col(key))
    percent = lambda cond: F.round(100 * F.count_if(cond) / F.count(F.lit(1)), 4)
    return utts.withColumn("half", half).rollup(by).agg(F.count(F.lit(1)).alias("n"), percent(F.col("half") == 0).alias("pct_0"), percent(F.col("half") == 1).alias("pct_1"), percent(F.coalesce(F.col(n_words), F.lit(0)) < 2).alias("pct_short"))


def attach_audio(align: DataFrame, corpus: DataFrame, key: str = "utterance_id", where: Column | None = None) -> DataFrame:
    """Alignment records, filtered first, with the audio of their utterance."""
    return (align if where is None else align.filter(where)).join(corpus.select(key, "audio"), key)
