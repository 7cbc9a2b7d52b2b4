"""URL filter: rules first, then host word segmentation and naive Bayes.

Names run together in hosts and paths are split into words by a unigram Viterbi search over the counts of all words of the
pages' own texts: every run of letters is cut into its substrings, these are joined to the word counts, and the search runs
over what was found. Multinomial naive Bayes over the words of host and path, learnt from the pages that a rule decides,
judges the others: its weights are a table too, joined to the words of each run and summed for each page. Only sums over whole
tables, the lengths that words have, and keys that very many rows share go through the driver or are broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import durable, join_unskewed

#: What an unknown piece costs for each of its letters, beside the cost of the rarest word, in nats.
UNKNOWN_LETTER = 2.5
#: Substrings of up to SHORT letters occur in very many runs: they and such words are dealt to SALTS parts.
SHORT, SALTS = 2, 16
NUMBER = "0"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    get = lambda i: F.coalesce(F.regexp_extract(url, parts, i), F.lit(""))
    return F.translate(get(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), get(2)


def match_rules(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; rules are (``host/path`` text, allow or block).

    A rule fits its host and all subdomains where the path starts with the rule's. Equally long rules: the first listed.
    """
    fitting = []
    for i, (text, what) in enumerate(rules):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        fitting.append(F.when(fits, F.struct(F.lit(len(text)).alias("size"), F.lit(-i).alias("place"), F.lit(text).alias("rule"), F.lit(what).alias("verdict"))))
    if not fitting:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    best = F.array_max(F.array(*fitting))  # nulls are skipped
    return best["rule"], best["verdict"]


def word_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(word, n) of all words of all pages' visible texts."""
    visible = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*+>|&#?\w+;", " ")
    words = pages.select(F.explode(F.split(F.lower(visible), r"[^\p{L}]+")).alias("word")).filter("word != ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def likeliest(run: str, known: list[tuple[int, int, float]], rare: float) -> list[str]:
    """The likeliest split of a run of letters. known: (start, stop, log probability) of its substrings that are words; any other
    substring may be a piece too, at ``rare`` less UNKNOWN_LETTER for each letter."""
    ends: dict[int, list[tuple[int, float]]] = {}
    for start, stop, cost in known:
        ends.setdefault(stop, []).append((start, cost))
    best, back = [0.0], [0]
    unknown, since = rare, 0  # rare + best[since] + UNKNOWN_LETTER * since, the highest so far: where an unknown piece begins best
    for end in range(1, len(run) + 1):
        top, start = unknown - UNKNOWN_LETTER * end, since
        for a, cost in ends.get(end, ()):
            if (best[a] + cost, a) > (top, start):
                top, start = best[a] + cost, a
        best.append(top)
        back.append(start)
        if rare + top + UNKNOWN_LETTER * end > unknown:
            unknown, since = rare + top + UNKNOWN_LETTER * end, end
    out, end = [], len(run)
    while end:
        out.append(run[back[end] : end])
        end = back[end]
    return out[::-1]


def segment(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, words array<string>) of distinct runs of letters, by counts (word, n).

    A word costs -log(n / all), an unknown piece as much as a word that occurs once, and UNKNOWN_LETTER for each letter. Only
    substrings as long as some word are looked up; no length is left out. Without any words a run is one piece.
    """
    whole = counts.agg(F.sum("n").alias("all"), F.array_sort(F.collect_set(F.char_length("word"))).alias("lengths")).first()
    total, lengths = max(1, whole["all"] or 0), whole["lengths"] or []  # as many lengths as differ, far fewer than words
    n = F.char_length("run")
    places = lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.struct((i - 1).alias("start"), (i - 1 + k).alias("stop"), F.substring("run", i, k).alias("word")))
    pieces = runs.select("run", F.explode(F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda k: k <= n)).alias("k"))
    pieces = pieces.select("run", F.explode(places(F.col("k"))).alias("p")).select("run", "p.*")
    short = F.char_length("word") <= SHORT
    pieces = pieces.withColumn("salt", F.when(short, F.pmod(F.xxhash64("run"), F.lit(SALTS))).otherwise(0).cast("int"))
    salted = counts.withColumn("salt", F.explode(F.when(short, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    known = pieces.join(salted, ["word", "salt"]).select("run", F.struct("start", "stop", F.log(F.col("n") / total).alias("cost")).alias("known"))
    each = known.unionByName(runs.select("run", F.lit(None).cast(known.schema["known"].dataType).alias("known")))  # a run without words too

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for names, found in batches:
            yield pd.Series([likeliest(run, [(x["start"], x["stop"], x["cost"]) for x in own], -math.log(total)) for run, own in zip(names, found, strict=True)], dtype=object)

    return each.groupBy("run").agg(F.collect_list("known").alias("known")).select("run", split("run", "known").alias("words"))


def url_runs(rows: DataFrame) -> DataFrame:
    """(row, said, place, side, run): the runs of letters of host (``h``) and path (``p``), lower-cased, and NUMBER for digits."""
    runs = lambda c, side: F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|[0-9]+"), F.lit(0)), lambda r: F.struct(F.lit(side).alias("side"), F.when(F.rlike(r, F.lit("^[0-9]")), NUMBER).otherwise(r).alias("run")))
    each = rows.select("row", "said", F.posexplode(F.concat(runs("host", "h"), runs("path", "p"))).alias("place", "r"))
    return each.select("row", "said", "place", "r.side", "r.run")


def naive_bayes(runs: DataFrame, words: DataFrame) -> tuple[DataFrame, float]:
    """((side, word, weight), weight of unseen words) as log-odds of block against allow, Laplace-smoothed, from the runs whose
    page has a verdict and the words of each run."""
    counts = runs.filter("said is not null").groupBy("side", "run").agg(F.count_if(F.col("said") == "block").alias("b"), F.count_if(F.col("said") == "allow").alias("a"))
    table = counts.join(words, "run").select("side", F.explode("words").alias("word"), "b", "a").groupBy("side", "word").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    table = durable(table)
    n = table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.coalesce(F.sum("a"), F.lit(0)).alias("a")).first()
    blocked, allowed = n["b"] + n["n"] + 1, n["a"] + n["n"] + 1
    weight = F.log((F.col("b") + 1) / blocked) - F.log((F.col("a") + 1) / allowed)
    return table.select("side", "word", weight.alias("weight")), math.log(allowed / blocked)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: (id, host, path, rule, verdict, words array<string>, score double).

    verdict is the longest fitting rule's, else block if score, the naive Bayes log-odds of block, is above 0, else allow.
    Null urls and urls without ``://`` have empty host and path and are scored by the prior alone. If rules decide no page,
    or all alike, the others get what the rules said, or allow. Pages with equal or null ids are judged each for itself; null
    texts hold no words. words are those of host and path, marked ``h:`` and ``p:``; other columns of pages are ignored.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    rule, said = match_rules(F.col("host"), F.col("path"), rules)
    rows = durable(rows.withColumn("rule", rule).withColumn("said", said))
    n = {r["said"]: r["n"] for r in rows.groupBy("said").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = math.log(n["block"] / n["allow"]) if n.keys() >= {"block", "allow"} else math.inf if "block" in n else -math.inf

    runs = durable(url_runs(rows))
    distinct = runs.filter(F.col("run") != NUMBER).select("run").distinct()
    words = segment(distinct, durable(word_counts(pages, html_col)))
    words = durable(words.unionByName(words.sparkSession.createDataFrame([(NUMBER, [NUMBER])], words.schema)))
    weights, unseen = naive_bayes(runs, words)
    used = runs.select("side", "run").distinct().join(words, "run")
    each = durable(used.select("side", "run", F.posexplode("words").alias("nth", "word")))
    weighed = join_unskewed(each, weights, ["side", "word"], "left").withColumn("weight", F.coalesce("weight", F.lit(unseen)))
    ordered = F.sort_array(F.collect_list(F.struct("nth", "weight", F.concat_ws(":", "side", "word").alias("word"))))
    odds = durable(weighed.groupBy("side", "run").agg(ordered.alias("parts")))
    parts = join_unskewed(runs.select("row", "place", "side", "run"), odds, ["side", "run"]).groupBy("row").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("place", "parts"))), lambda x: x["parts"])).alias("parts"))
    scored = rows.join(parts, "row", "left").withColumn("parts", F.coalesce("parts", F.array().cast(parts.schema["parts"].dataType)))
    scored = scored.withColumn("score", F.aggregate("parts", F.lit(prior), lambda total, x: total + x["weight"])).withColumn("words", F.transform("parts", lambda x: x["word"]))
    verdict = F.coalesce("said", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "words", "score")
