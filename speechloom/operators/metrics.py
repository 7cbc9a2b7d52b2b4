"""Reports over training, evaluation and packing tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .order import global_index, portable_key, prefix_scan, seeded_key


def checkpoint_summary(parts: list[DataFrame], expected: DataFrame, key: str = "ckpt") -> DataFrame:
    """One row per expected checkpoint: wer, n_samples, elapsed, saved_ts (null: MISSING), ordered by ``turn``, with best and
    worst flags. Partial results of several workers are put together by their sums (errors, words, n, elapsed)."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    sums = whole.groupBy(key).agg(F.sum("errors").alias("errors"), F.sum("words").alias("words"), F.sum("n").alias("n_samples"), F.max("elapsed").alias("elapsed"), F.max("saved_ts").alias("saved_ts"))
    rows = expected.select(key).join(sums, key, "left").withColumn("wer", F.col("errors") / F.greatest("words", F.lit(1)))
    small = Window.partitionBy(F.lit(0))  # a row a checkpoint
    flag = lambda f: F.coalesce(F.col("wer") == f("wer").over(small), F.lit(False))
    rows = rows.withColumn("best", flag(F.min)).withColumn("worst", flag(F.max)).withColumn("status", F.when(F.col("wer").isNull(), "MISSING").otherwise("ok"))
    return rows.withColumn("turn", F.row_number().over(small.orderBy(F.asc_nulls_last("saved_ts"), key)))


def best_so_far(metrics: DataFrame, run: str = "run", step: str = "step", wer: str = "wer") -> DataFrame:
    """Metrics with the lowest earlier rate and whether this one is strictly lower (the first is). A long run is scanned by ranges
    of its steps, in many tasks; steps of one number are taken in order of their rates."""
    return prefix_scan(metrics, [run], [step, wer], wer, "best_before", "min", earlier=True).withColumn("new_best", F.col("best_before").isNull() | (F.col(wer) < F.col("best_before")))


def weighted_loss(batches: DataFrame, by: list[str], loss: str = "loss", n: str = "n_tokens", plain: bool = False) -> DataFrame:
    """Token-weighted mean loss of each group without non-finite losses, NaN if no tokens are left; ``plain``: mean of batches."""
    finite = F.col(loss).isNotNull() & ~F.isnan(loss) & (F.abs(loss) != float("inf"))
    tokens = F.sum(F.when(finite, F.col(n)))
    mean = F.avg(F.when(finite, F.col(loss))) if plain else F.when(tokens > 0, F.sum(F.when(finite, F.col(loss) * F.col(n))) / tokens)
    return batches.groupBy(*by).agg(F.coalesce(mean, F.lit(math.nan)).alias("loss"), F.coalesce(tokens, F.lit(0)).alias("tokens"))


def eos_loss_by_kind(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean teacher-forced and free loss of end and other tokens."""
    return rows.groupBy(*by, "is_eos").agg(F.count(F.lit(1)).alias("n"), F.avg("tf_loss").alias("tf_loss"), F.avg("free_loss").alias("free_loss"))


def eos_loss_report(samples: DataFrame, by: list[str]) -> DataFrame:
    """From one row a sample (gt_pos, pred_pos or null): ends predicted and missed, early, correct and late ones, mean offset of
    those predicted, the part within 3, and a histogram of offsets."""
    d = F.col("pred_pos") - F.col("gt_pos")
    n = F.count_if
    return samples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("pred_pos").alias("predicted"),
        n(F.col("pred_pos").isNull() & F.col("gt_pos").isNotNull()).alias("missed"),
        n(F.col("pred_pos").isNotNull() & F.col("gt_pos").isNull()).alias("false_alarm"),
        n(d < 0).alias("early"),
        n(d == 0).alias("correct"),
        n(d > 0).alias("late"),
        F.avg(d).alias("mean_offset"),
        (n(F.abs(d) <= 3) / F.greatest(F.count(d), F.lit(1))).alias("within_3"),
        n(d < -5).alias("below_5"),
        n(d.between(-5, -1)).alias("below_1_5"),
        n(d.between(1, 5)).alias("above_1_5"),
        n(d > 5).alias("above_5"),
    )


def token_norms(vectors: DataFrame, vector: str) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def pool_frames(clips: DataFrame, features: str = "features", dim: int = 8, out: str = "embedding") -> DataFrame:
    """Clips with the mean of their flattened frames; null for a clip without frames."""
    n = F.floor(F.size(features) / dim)
    mean = lambda d: F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, t: a + F.get(features, (t * dim + d).cast("int")).cast("double")) / n
    return clips.withColumn(out, F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), mean)))


def _grams(units: DataFrame, by: list[str]) -> DataFrame:
    """(by, s1, s2, k): the sum and the sum of squares of the cosines of all ordered pairs i != j of unit vectors u, and their
    number. Each task adds up its vectors' sum and their D x D Gram matrix, of which one row goes out for each place."""
    keys = [units.schema[c] for c in by]

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for frame in frames:
            for key, own in frame.groupby(by, dropna=False) if by else [((), frame)]:
                u = np.stack(own["u"].to_numpy()).astype(np.float64)
                u = np.concatenate([u, np.ones((len(u), 1))], 1)  # so that the last row holds the sums
                sums[key] = sums.get(key, 0) + u.T @ u
        for key, gram in sums.items():
            i, j = np.indices(gram.shape)
            yield pd.DataFrame({**{c: [v] * gram.size for c, v in zip(by, key, strict=True)}, "i": i.ravel(), "j": j.ravel(), "dim": len(gram) - 1, "x": gram.ravel()})

    schema = T.StructType([*keys, *(T.StructField(c, T.IntegerType()) for c in ("i", "j", "dim")), T.StructField("x", T.DoubleType())])
    cells = units.select(*by, "u").mapInPandas(add, schema).groupBy(*by, "dim", "i", "j").agg(F.sum("x").alias("x"))
    inner, edge = (F.col("i") < F.col("dim")) & (F.col("j") < F.col("dim")), (F.col("i") == F.col("dim")) & (F.col("j") < F.col("dim"))
    square = F.col("x") * F.col("x")
    sums = cells.groupBy(*by).agg(F.sum(F.when(edge, square)).alias("s1"), F.sum(F.when(inner, square)).alias("s2"), F.max(F.when((F.col("i") == F.col("dim")) & (F.col("j") == F.col("dim")), F.round("x"))).alias("k"))
    return sums.select(*by, (F.col("s1") - F.col("k")).alias("s1"), (F.col("s2") - F.col("k")).alias("s2"), (F.col("k") * (F.col("k") - 1)).alias("k"))


def collapse_probe(vectors: DataFrame, by: list[str], vector: str = "embedding", reference: DataFrame | None = None, reference_vector: str = "embedding") -> DataFrame:
    """Per group: norms (mean, sample std, min, max), mean and sample std of the cosines of all ordered pairs i != j, a verdict,
    and what unrelated vectors would give.

    No pairs are made: with unit vectors u, the sum of their cosines is |sum u|^2 - n and the sum of their squares that of the
    Gram matrix less n. The verdict is collapsed above 0.9, suspicious above 0.7, narrow above 0.5, else diverse. Zero
    vectors count in the norms only. Vectors are of one length. With a reference table (such as a model's token vectors) also
    norm_ratio, the mean norm over the reference's, and baseline_mean and baseline_std, the cosines of the reference's pairs.
    """
    unit = lambda df, v: df.withColumn("__norm", token_norms(df, v)).withColumn("u", F.transform(v, lambda x: x.cast("double") / F.col("__norm")))
    mean, std = F.when(F.col("k") > 0, F.col("s1") / F.col("k")), F.when(F.col("k") > 1, F.sqrt(F.greatest(F.col("s2") - F.col("s1") * F.col("s1") / F.col("k"), F.lit(0.0)) / (F.col("k") - 1)))
    rows = unit(vectors, vector)
    norms = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("__norm").alias("norm_mean"), F.stddev_samp("__norm").alias("norm_std"), F.min("__norm").alias("norm_min"), F.max("__norm").alias("norm_max"))
    cosines = _grams(rows.filter("__norm > 0"), by).select(*by, mean.alias("cos_mean"), std.alias("cos_std"))
    out = norms.join(cosines, by, "left") if by else norms.crossJoin(F.broadcast(cosines))
    c = F.col("cos_mean")
    out = out.withColumn("verdict", F.when(c > 0.9, "collapsed").when(c > 0.7, "suspicious").when(c > 0.5, "narrow").otherwise("diverse"))
    if reference is None:
        return out
    others = unit(reference, reference_vector)
    one = others.agg(F.avg("__norm").alias("__norm")).crossJoin(_grams(others.filter("__norm > 0"), []).select(mean.alias("baseline_mean"), std.alias("baseline_std")))  # a row
    return out.crossJoin(F.broadcast(one)).withColumn("norm_ratio", F.col("norm_mean") / F.col("__norm")).drop("__norm")


#: The largest sample whose pairs of vectors cosine_extremes makes.
MOST_SAMPLED = 5000


def cosine_extremes(vectors: DataFrame, n: int, seed: int, key: str, vector: str = "embedding", portable: bool = False) -> DataFrame:
    """Mean, sample std, min and max of the cosines of a seeded sample of n vectors, i != j (the sample is the feature)."""
    if n > MOST_SAMPLED:
        raise ValueError(f"a sample has at most {MOST_SAMPLED} vectors")
    place = portable_key(seed, F.col(key)) if portable else seeded_key(seed, F.col(key))
    rows = vectors.withColumn("__norm", token_norms(vectors, vector)).filter("__norm > 0").orderBy(place, key).limit(n)
    a = rows.select(F.col(key).alias("i"), F.col(vector).alias("a"), F.col("__norm").alias("na"))
    b = F.broadcast(rows.select(F.col(key).alias("j"), F.col(vector).alias("b"), F.col("__norm").alias("nb")))  # MOST_SAMPLED rows at most
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    cos = a.join(b, F.col("i") != F.col("j")).select((dot / (F.col("na") * F.col("nb"))).alias("c"))
    return cos.agg(F.avg("c").alias("mean"), F.stddev_samp("c").alias("std"), F.min("c").alias("min"), F.max("c").alias("max"))


def cumulative_progress(logs: DataFrame, n_splits: int, run: str = "run", split: str = "split_no", step: str = "step", epoch: str = "epoch") -> DataFrame:
    """Logs whose step and epoch restart with every split, with total_step (steps of the splits before added) and total_epoch
    (split number + epoch, over the number of splits)."""
    ends = logs.groupBy(run, split).agg(F.max(step).alias("__last"))
    before = F.coalesce(F.sum("__last").over(Window.partitionBy(run).orderBy(split).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return logs.join(ends.withColumn("__before", before).drop("__last"), [run, split]).withColumn("total_step", F.col("__before") + F.col(step)).withColumn("total_epoch", (F.col(split) + F.col(epoch)) / n_splits).drop("__before")


def progress_report(log: DataFrame, worker: str = "worker", status: str = "status", ts: str = "ts") -> DataFrame:
    """Per worker: done, skipped and failed, and done ones per second of its time."""
    n = lambda s: F.count_if(F.col(status) == s)
    rows = log.groupBy(worker).agg(n("done").alias("done"), n("skip").alias("skip"), n("fail").alias("fail"), (F.max(F.unix_timestamp(ts)) - F.min(F.unix_timestamp(ts))).alias("elapsed"))
    return rows.withColumn("rate", F.when(F.col("elapsed") > 0, F.col("done") / F.col("elapsed")))


def augmentation_ratio(rows: DataFrame, by: list[str], kind: str = "kind") -> DataFrame:
    """Sentences, words and words per sentence of each group."""
    out = rows.groupBy(*by).agg(F.count_if(F.col(kind) == "sentence").alias("sentences"), F.count_if(F.col(kind) == "word").alias("words"))
    return out.withColumn("ratio", F.col("words") / F.greatest("sentences", F.lit(1)))


def corpus_hours(durations: DataFrame, by: list[str], seconds: str = "seconds", estimates: DataFrame | None = None) -> DataFrame:
    """Hours of each group as measured, or as a small table (group, hours) estimates them."""
    if estimates is not None:
        return durations.select(*by).distinct().join(estimates, by, "left").withColumn("hours", F.coalesce("hours", F.lit(0.0)))
    return durations.groupBy(*by).agg((F.sum(seconds) / 3600).alias("hours"))


def plan_steps(hours: DataFrame, tokens_per_hour: float, cutoff: int, world: int, accumulation: int, fill: float = 0.8) -> DataFrame:
    """hours with packs and steps of an epoch: tokens over what a pack holds at the fill, then over ranks and accumulation."""
    packs = F.ceil(F.col("hours") * tokens_per_hour / (cutoff * fill))
    return hours.withColumn("packs", packs.cast("long")).withColumn("steps", F.greatest(F.lit(1), F.floor(F.col("packs") / (world * accumulation))).cast("long"))


def plan_steps_of_bins(bins_per_rank: DataFrame, accumulation: int, n: str = "n") -> DataFrame:
    """Steps by the bins there are: every rank makes as many as the one with the fewest."""
    return bins_per_rank.agg(F.min(n).alias("bins")).withColumn("steps", F.floor(F.col("bins") / accumulation).cast("long"))


def count_bins(bins: DataFrame, rank: str = "rank", shard: str = "shard") -> DataFrame:
    return bins.groupBy(rank, shard).agg(F.count(F.lit(1)).alias("n"))


def rank_imbalance(bins: DataFrame, rank: str = "rank", shard: str = "shard") -> DataFrame:
    """Per rank: bins, its smallest and largest shard; and over all ranks the least, the most and their difference."""
    per_rank = count_bins(bins, rank, shard).groupBy(rank).agg(F.sum("n").alias("bins"), F.min("n").alias("shard_min"), F.max("n").alias("shard_max"))
    ends = F.broadcast(per_rank.agg(F.min("bins").alias("least"), F.max("bins").alias("most")))
    return per_rank.crossJoin(ends).withColumn("difference", F.col("most") - F.col("least"))


def visit_audit(visits: DataFrame, ranks: DataFrame, shards: DataFrame, passes: DataFrame) -> DataFrame:
    """(pass_no, rank, shard, visits) that are not just one, of all expected ones. The three lists are small."""
    expected = passes.select("pass_no").crossJoin(ranks.select("rank")).crossJoin(shards.select("shard"))
    counts = visits.groupBy("pass_no", "rank", "shard").agg(F.count(F.lit(1)).alias("visits"))
    return expected.join(counts, ["pass_no", "rank", "shard"], "left").withColumn("visits", F.coalesce("visits", F.lit(0))).filter("visits != 1")


def mix_report(seqs: DataFrame, by: list[str], kinds: list[str], kind: str = "kind") -> DataFrame:
    """Share of each kind of sequence in each group."""
    rows = seqs.groupBy(*by).pivot(kind, kinds).agg(F.count(F.lit(1))).na.fill(0, kinds)
    total = sum((F.col(k) for k in kinds), F.lit(0))
    return rows.withColumn("total", total).withColumns({f"share_{k}": F.col(k) / total for k in kinds})


def diff_versions(a: DataFrame, b: DataFrame, depth: int, key: str = "key", idx: str = "idx", value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(per key prefix, keys in one only) of two tables (key, idx, value).

    The prefix is the first ``depth`` parts of the dotted key: elements, sum of absolute differences, their mean, and mean of the keys'
    L2 norms of the difference, over keys in both.
    """
    has = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    keys = has(a, "in_a").join(has(b, "in_b"), key, "full_outer")
    both = a.select(key, idx, F.col(value).alias("x")).join(b.select(key, idx, F.col(value).alias("y")), [key, idx], "full_outer").join(keys.filter("in_a and in_b").select(key), key, "left_semi")
    d = F.coalesce("y", F.lit(0.0)) - F.coalesce("x", F.lit(0.0))
    per_key = both.groupBy(key).agg(F.count(F.lit(1)).alias("elements"), F.sum(F.abs(d)).alias("sum_abs"), F.sqrt(F.sum(d * d)).alias("l2"))
    groups = per_key.groupBy(F.substring_index(key, ".", depth).alias("prefix")).agg(F.count(F.lit(1)).alias("keys"), F.sum("elements").alias("elements"), F.sum("sum_abs").alias("sum_abs"), F.avg("l2").alias("mean_l2")).withColumn("mean_abs", F.col("sum_abs") / F.col("elements"))
    only = keys.filter("in_a is null or in_b is null").select(key, F.when(F.col("in_a"), "a").otherwise("b").alias("only_in"))
    return groups, only


#: Bits of an order key that one pass of sample_rows tells apart, and rows that it then takes by a sort.
DIGIT, FEW = 12, 10_000


def sample_rows(df: DataFrame, n: int | None, seed: int, key: str, ordered: bool = False, portable: bool = False) -> DataFrame:
    """A seeded sample of n rows, the same for every partitioning; all rows if n is null or not smaller. ordered: by key.
    portable: by an order that other engines can compute too.

    The rows are the n first ones in the order of a hash. Where it is to be cut is found from counts of its leading bits, those of
    one value being counted by the next bits in turn; so the sample is a filter of df, but for the few rows at the cut.
    """
    if n is None:
        return df
    order = portable_key(seed, F.col(key)) if portable else seeded_key(seed, F.col(key))
    bits = F.conv(F.substring(order, 1, 15), 16, 10).cast("long") if portable else F.shiftright(order, 4) + (1 << 59)  # 60 of them, in the same order
    rows = df.withColumn("__o", order).withColumn("__b", bits)
    low, shift, wanted = 0, 60, n
    while shift:
        shift -= DIGIT
        digit = F.shiftright(F.col("__b") - low, shift)
        counts = sorted(tuple(r) for r in rows.filter((F.col("__b") >= low) & (digit < (1 << DIGIT))).groupBy(digit).count().collect())  # 2**DIGIT rows at most
        if shift == 60 - DIGIT and sum(c for _, c in counts) <= wanted:
            return df.orderBy(key) if ordered else df
        for value, count in counts:
            if count > wanted:
                low += value << shift
                break
            wanted -= count
        if count <= max(FEW, wanted):
            break
    at_cut = rows.filter((F.col("__b") >= low) & (F.col("__b") < low + (1 << shift)))
    if count <= FEW:
        last = at_cut.orderBy("__o", key).limit(wanted)
    else:  # rows that a hash of 60 bits doesn't tell apart, repeated keys mostly
        last = global_index(at_cut, "__o", [key], "__i").filter(F.col("__i") < wanted).drop("__i")
    out = rows.filter(F.col("__b") < low).unionByName(last).select(*df.columns)
    return out.orderBy(key) if ordered else out


def head_per_group(df: DataFrame, n: int, group: str, order: str) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("__r") <= n).drop("__r")


def evenly_spaced(df: DataFrame, k: int, total: int, idx: str = "idx") -> DataFrame:
    """Every (total / k)-th row from the first, k at most."""
    step = max(1, total // max(k, 1))
    return df.filter((F.col(idx) % step == 0) & (F.floor(F.col(idx) / step) < k))


def select_datasets(df: DataFrame, keys: list[str], known: list[str], column: str = "dataset") -> DataFrame:
    """Rows of the datasets asked for; an unknown name is an error."""
    unknown = sorted(set(keys) - set(known))
    if unknown:
        raise ValueError(f"unknown datasets: {', '.join(unknown)}; known: {', '.join(known)}")
    return df.filter(F.col(column).isin(keys))
