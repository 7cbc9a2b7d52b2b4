"""Packing sequences into bins of a fixed length: plans on (id, length) only, payload joined once."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import bound, once
from ..schemas import IGNORED_LABEL
from .order import seeded_key

BUCKETS_PER_GROUP = 50


def fill_bins(lengths: dict[int, int], cutoff: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins of the greedy knapsack over counts per length: (times, [(length, how many in each bin)]) in the order made.

    A bin takes the longest length that still fits, again and again; while enough of every length is left, the same bin is
    made again, so the work grows with the number of lengths and not of sequences.
    """
    left = {n: k for n, k in lengths.items() if 0 < n <= cutoff and k > 0}
    order = sorted(left)
    out = []
    while order:
        room, content = cutoff, []
        top = bisect_right(order, room)
        while top:
            n = order[top - 1]
            k = min(left[n], room // n)
            content.append((n, k))
            room -= n * k
            top = bisect_right(order, min(room, n - 1))
        times = min(left[n] // k for n, k in content)
        out.append((times, content))
        for n, k in content:
            left[n] -= k * times
            if not left[n]:
                del order[bisect_right(order, n) - 1]
    return out


def _knapsack(lengths: list[int], cutoff: int) -> list[tuple[int, int]]:
    """(bin, place) of each of some sequences; of equal lengths the last comes first."""
    stacks: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        stacks.setdefault(n, []).append(i)
    where: list[tuple[int, int]] = [(-1, -1)] * len(lengths)
    bin_no = 0
    for times, content in fill_bins({n: len(s) for n, s in stacks.items()}, cutoff):
        for _ in range(times):
            place = 0
            for n, k in content:
                for _ in range(k):
                    where[stacks[n].pop()] = (bin_no, place)
                    place += 1
            bin_no += 1
    return where


def _first_fit(lengths: list[int], cutoff: int) -> list[tuple[int, int]]:
    """(bin, place) by first fit, longest first; of equal lengths the first comes first. A tree over the bins' free room finds
    the first that fits."""
    size = 1
    while size < max(1, len(lengths)):
        size *= 2
    room = [0] * (2 * size)
    for i in range(size, 2 * size):
        room[i] = cutoff
    for i in range(size - 1, 0, -1):
        room[i] = cutoff
    held = [0] * size
    where: list[tuple[int, int]] = [(-1, -1)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        node = 1
        while node < size:
            node = 2 * node + (room[2 * node] < lengths[i])
        where[i] = (node - size, held[node - size])
        held[node - size] += 1
        room[node] -= lengths[i]
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return where


def _pack_buckets(seqs: DataFrame, cutoff: int, bucket: int, place, idx: str, key: str, length: str) -> DataFrame:
    """The plan of each bucket by itself. A task's group holds BUCKETS_PER_GROUP buckets, since each group costs a call."""
    kinds = dict(seqs.dtypes)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(idx)
        where = np.concatenate([np.array(place(own.tolist(), cutoff)) for _, own in rows.groupby("bucket", sort=True)[length]])
        return pd.DataFrame({key: rows[key], "len": rows[length], "bucket": rows["bucket"], "bin_no": where[:, 0], "seq_no": where[:, 1]})

    fit = seqs.filter((F.col(length) > 0) & (F.col(length) <= cutoff)).withColumn("bucket", F.floor(F.col(idx) / bucket)).withColumn("__group", F.floor(F.col("bucket") / BUCKETS_PER_GROUP))
    return fit.select(key, length, idx, "bucket", "__group").groupBy("__group").applyInPandas(pack, f"{key} {kinds[key]}, len long, bucket long, bin_no long, seq_no long")


def pack_knapsack(seqs: DataFrame, cutoff: int, bucket: int | None = 200, idx: str = "idx", key: str = "id", length: str = "len", seed: int = 0) -> DataFrame:
    """The plan (key, len, bucket, bin_no, seq_no): sequences up to cutoff in bins, by the greedy knapsack.

    Within buckets of ``bucket`` consecutive indexes, the buckets side by side; or, without a bucket, over the whole corpus:
    the driver plans on the histogram of lengths (at most cutoff rows), and sequences find their line of the plan, which is sent
    to all tasks, by their rank within their length, the highest index first; bins are then put in a seeded order. Longer sequences and empty ones are left out.
    """
    if bucket is not None:
        return _pack_buckets(seqs, cutoff, bucket, _knapsack, idx, key, length)
    fit = seqs.filter((F.col(length) > 0) & (F.col(length) <= cutoff))
    histogram = {int(r[length]): r["n"] for r in fit.groupBy(length).agg(F.count(F.lit(1)).alias("n")).collect()}
    used, lines, bins = dict.fromkeys(histogram, 0), [], 0
    for times, content in fill_bins(histogram, cutoff):
        place = 0
        for n, k in content:
            lines.append((n, used[n], bins, k, place))
            used[n] += k * times
            place += k
        bins += times
    found = _ranks(fit, idx, length).withColumn("__at", _line_of(sorted(lines))("__n_len", "__rank"))
    made = found.select(key, F.col("__n_len").alias("len"), F.lit(0).cast("long").alias("bucket"), "__at.bin_no", "__at.seq_no")
    return made.withColumn("bin_order", seeded_key(seed, F.col("bin_no")))


def _ranks(fit: DataFrame, idx: str, length: str) -> DataFrame:
    """fit with __n_len and __rank, each row's place among those of its length, the highest index first, without gathering a
    length's rows: parts of 65,536 indexes are numbered, and the sizes of the parts after them summed."""
    parted = fit.withColumn("__n_len", F.col(length).cast("long")).withColumn("__p", F.floor(F.col(idx) / 65536))
    sizes = parted.groupBy("__n_len", "__p").agg(F.count(F.lit(1)).alias("__c"))
    after = sizes.withColumn("__after", F.sum("__c").over(Window.partitionBy("__n_len").orderBy(F.desc("__p"))) - F.col("__c")).drop("__c")
    nth = F.row_number().over(Window.partitionBy("__n_len", "__p").orderBy(F.desc(idx)))
    return parted.withColumn("__n", nth).join(after, ["__n_len", "__p"]).withColumn("__rank", F.col("__after") + F.col("__n") - 1)


def _line_of(lines: list[tuple[int, int, int, int, int]]):
    """A function of (length, rank) columns to struct<bin_no,seq_no>, by the plan's sorted lines (length, first rank, first bin,
    how many in each bin, first place); a line is found by bisection."""
    table = np.array(lines, np.int64).reshape(-1, 5)

    @F.pandas_udf("bin_no long, seq_no long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lo, hi = np.searchsorted(table[:, 0], length, "left"), np.searchsorted(table[:, 0], length, "right")
        while (hi - lo > 1).any():  # the last line of the length that begins at the rank or before
            middle = (lo + hi) // 2
            here = (table[middle % max(1, len(table)), 1] <= rank) & (hi - lo > 1)
            lo, hi = np.where(here, middle, lo), np.where(here | (hi - lo <= 1), hi, middle)
        line, nth = table[lo], rank.to_numpy() - table[lo, 1]
        return pd.DataFrame({"bin_no": line[:, 2] + nth // line[:, 3], "seq_no": line[:, 4] + nth % line[:, 3]})

    return place


def pack_first_fit(seqs: DataFrame, cutoff: int, bucket: int = 200, idx: str = "idx", key: str = "id", length: str = "len") -> DataFrame:
    """The same plan by first fit with decreasing lengths."""
    return _pack_buckets(seqs, cutoff, bucket, _first_fit, idx, key, length)


def materialise_bins(plan: DataFrame, seqs: DataFrame, cutoff: int, pad: int = 0, neat: bool = True, key: str = "id", features: str | None = None, feat_len: str | None = None) -> DataFrame:
    """Bins (bucket, bin_no, input_ids, labels, attention_mask, n_seqs and the features and lengths asked for), in plan order,
    padded to the cutoff. The mask numbers sub-sequences from 1 (neat) or is 1 for all; padding has 0."""
    extra = [c for c in (features, feat_len) if c]
    rows = plan.select(key, "bucket", "bin_no", "seq_no").join(seqs.select(key, "input_ids", "labels", *extra), key)
    binned = rows.groupBy("bucket", "bin_no").agg(F.sort_array(F.collect_list(F.struct("seq_no", "input_ids", "labels", *extra))).alias("s"))
    number = (lambda x, i: i + 1) if neat else (lambda x, i: F.lit(1))
    masks = F.flatten(F.transform("s", lambda x, i: F.array_repeat(number(x, i), F.size(x["input_ids"]))))
    flat = binned.select("bucket", "bin_no", "s", F.flatten("s.input_ids").alias("input_ids"), F.flatten("s.labels").alias("labels"), masks.alias("attention_mask"))
    missing = F.lit(cutoff) - F.size("input_ids")
    padded = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), missing)).cast("array<int>").alias(c)
    more = [F.col(f"s.{features}").alias("audio_features")] if features else []
    more += [F.col(f"s.{feat_len}").cast("array<int>").alias("audio_lengths")] if feat_len else []
    return flat.select("bucket", "bin_no", padded("input_ids", pad), padded("labels", IGNORED_LABEL), padded("attention_mask", 0), F.size("s").alias("n_seqs"), *more)


def drop_short_clips(bins: DataFrame, min_frames: int, pad: int = 0, lengths: str = "audio_lengths") -> DataFrame:
    """Bins without the sub-sequences whose clip has under min_frames frames: gaps closed, sub-sequences renumbered, padded
    again. Sub-sequence i has the i-th length. Bins that lose all are left out."""
    spans = F.filter(_spans(F.col("attention_mask")), lambda s: (s["id"] > 0) & (F.get(F.col(lengths), s["id"] - 1) >= min_frames))
    rows = bins.withColumn("__n", F.size("input_ids")).select("*", once(spans).alias("__s"))
    rows = rows.filter(F.size("__s") > 0).withColumn("__k", F.aggregate("__s", F.lit(0), lambda a, s: a + s["n"]))
    taken = lambda c: F.flatten(F.transform("__s", lambda s: F.slice(c, s["start"] + 1, s["n"])))
    number = lambda s: F.size(F.filter(F.slice(lengths, F.lit(1), s["id"]), lambda n: n >= min_frames))
    masks = F.flatten(F.transform("__s", lambda s: F.array_repeat(number(s), s["n"])))
    fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), F.col("__n") - F.col("__k")))
    rows = rows.withColumns({"input_ids": fill(taken("input_ids"), pad), "labels": fill(taken("labels"), IGNORED_LABEL), "attention_mask": fill(masks, 0)})
    if "audio_features" in bins.columns:
        both = F.arrays_zip(F.col("audio_features").alias("f"), F.col(lengths).alias("n"))
        rows = rows.withColumn("audio_features", F.transform(F.filter(both, lambda x: x["n"] >= min_frames), lambda x: x["f"]))
    return rows.withColumn(lengths, F.filter(lengths, lambda n: n >= min_frames)).drop("__n", "__k", "__s")


def _spans(mask: Column) -> Column:
    """array<struct<id,start,n>>: the runs of equal values of a mask, padding's too. Each is one step's work, whatever its length."""

    def runs(m: Column) -> Column:
        starts = F.filter(F.transform(m, lambda x, i: F.when((i == 0) | (F.get(m, i - 1) != x), i)), lambda i: i.isNotNull())
        return bound(starts, lambda at: F.transform(at, lambda a, k: F.struct(F.get(m, a).alias("id"), a.alias("start"), (F.coalesce(F.get(at, k + 1), F.size(m)) - a).alias("n"))))

    return bound(mask, runs)


def pack_stats(bins: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Supervised tokens, real tokens, fill and sequences per bin."""
    real = F.size(F.filter("attention_mask", lambda m: m != 0))
    rows = bins.select(*(by or []), F.size(F.filter("labels", lambda x: x != IGNORED_LABEL)).alias("sup"), real.alias("real"), F.size("input_ids").alias("room"), F.array_max("attention_mask").alias("seqs"))
    return rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("bins"), F.sum("sup").alias("supervised"), F.sum("real").alias("tokens"), (F.sum("real") / F.sum("room")).alias("fill"), F.avg("seqs").alias("seqs_per_bin"))
