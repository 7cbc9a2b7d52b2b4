"""Cutting long sequences of rows greedily, where each cut depends on the one before it, in many tasks.

A greedy cut walks from a batch's first row to the next batch's. Rows are dealt to ranges by the running sum of their sizes, so
that no batch reaches further than into the next range. Each range works out, for every row a batch could begin with, where the
next range's first batch would begin and how many begin until then; a scan over the ranges of a lane, which holds one number,
follows the real cuts through these tables; then every range cuts its own rows. No task gets a lane, however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import durable
from .order import prefix_scan

#: Rows of a range, about.
RANGE_ROWS = 1 << 16
#: Bundles of short lanes at least.
BUNDLES = 32
RULES = ("sum", "padded", "reach")


def next_starts(rule: str, limit: int, before: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each row, if a batch began with it, the number of the first row of the next batch; ``before`` are running sums.

    ``sum``: a batch ends before its sum would pass the limit; ``padded``: before its rows times its largest would;
    ``reach``: as soon as its sum has come to the limit. A row that is over the limit by itself is a batch.
    """
    n = len(size)
    here = np.arange(n)
    if rule == "sum":
        return np.maximum(here + 1, np.searchsorted(before + size, before + limit, side="right"))
    if rule == "reach":
        return np.maximum(here + 1, np.searchsorted(before, before + limit, side="left"))
    tables = [size]  # the largest of 2**k rows
    while 2 << len(tables) - 1 <= n:
        half = 1 << len(tables) - 1
        tables.append(np.maximum(tables[-1][:-half], tables[-1][half:]))
    count, most = np.ones(n, dtype=np.int64), size.copy()
    for k in range(len(tables) - 1, -1, -1):
        at = here + count
        fits = np.flatnonzero(at + (1 << k) <= n)
        longer = np.maximum(most[fits], tables[k][at[fits]])
        good = (count[fits] + (1 << k)) * longer <= limit
        fits, longer = fits[good], longer[good]
        count[fits] += 1 << k
        most[fits] = longer
    return here + count


def _batch_numbers(rule: str, limit: int, before: np.ndarray, size: np.ndarray, at: int, begun: int) -> np.ndarray:
    """The batch of each row in order, where a batch begins with row ``at`` and ``begun`` began before it."""
    numbers = np.full(len(size), begun - 1, dtype=np.int64)
    following = next_starts(rule, limit, before, size).tolist()
    while at < len(size):
        numbers[at : following[at]] = begun
        at, begun = following[at], begun + 1
    return numbers


def _whole_lanes(rule: str, limit: int, out: str):
    """The scan of many short lanes at once."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["__lane", "__before"])
        before, size = rows["__before"].to_numpy(), rows["__size"].to_numpy()
        starts = np.flatnonzero(np.diff(rows["__lane"].to_numpy(), prepend=0) != 0) if len(rows) else np.zeros(0, dtype=np.int64)
        bounds = np.unique(np.concatenate([[0], starts, [len(rows)]])).tolist()
        numbers = [_batch_numbers(rule, limit, before[i:j], size[i:j], 0, 0) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        return rows.assign(**{out: np.concatenate(numbers)})[["__lane", "__before", out]]

    return run


def _exits(rule: str, limit: int, width: int):
    """From the rows of a range and those that a batch of it may reach: the start of the first batch after the range and the
    number of batches until then, for each start in the range; as steps, since both are the same for many starts."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__before")
        before, size = rows["__before"].to_numpy(), rows["__size"].to_numpy()
        number = int(rows["__range"].iloc[0])
        own = int(np.searchsorted(before, (number + 1) * width))
        if not own:  # rows of the next range alone
            return pd.DataFrame(columns=["__lane", "__range", "starts", "exits", "counts"])
        ends = before + size
        following = next_starts(rule, limit, before, size)[:own].tolist()
        exits, counts = [0] * own, [1] * own
        for i in range(own - 1, -1, -1):
            to = following[i]
            if to < own:
                exits[i], counts[i] = exits[to], counts[to] + 1
            else:
                exits[i] = int(ends[to - 1])
        steps = np.flatnonzero((np.diff(exits, prepend=-1) != 0) | (np.diff(counts, prepend=-1) != 0))
        found = {"__lane": [rows["__lane"].iloc[0]], "__range": [number], "starts": [before[:own][steps]], "exits": [np.array(exits)[steps]], "counts": [np.array(counts)[steps]]}
        return pd.DataFrame(found)

    return run


def _follow(width: int):
    """Entries of ranges that are sorted by (lane, range): the first batch that begins in each, none (null) where none does, and how
    many began before."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lane, entry, begun = None, 0, 0
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if lane is None or row[0] != lane:
                    lane, entry, begun = row[0], 0, 0
                if entry // width != row[1]:
                    out.append((lane, row[1], None, begun))
                    continue
                out.append((lane, row[1], entry, begun))
                step = int(np.searchsorted(row[2], entry, side="right")) - 1
                entry, begun = int(row[3][step]), begun + int(row[4][step])
            yield pd.DataFrame(out, columns=["__lane", "__range", "entry", "begun"]).astype({"entry": "Int64"})

    return run


def greedy_cuts(rows: DataFrame, lane: str, order: list[str], size: str, limit: int, rule: str, out: str = "batch_no") -> DataFrame:
    """rows with ``out``: the number, from 0 in each lane, of the batch that a greedy scan in the given order puts each in, by one
    of the rules of next_starts(). Sizes are whole numbers; null and those under 1 count as 1. The result depends on nothing
    but the order, which should tell all rows of a lane apart. Lanes are longs without nulls."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule}")
    if limit < 1:
        raise ValueError("the limit must be positive")
    weighed = rows.withColumn("__size", F.greatest(F.coalesce(F.col(size), F.lit(1)), F.lit(1)).cast("long")).withColumn("__lane", F.col(lane).cast("long"))
    scanned = durable(prefix_scan(weighed, ["__lane"], order, "__size", "__upto").withColumn("__before", F.col("__upto") - F.col("__size")).drop("__upto"))
    mean = scanned.agg(F.avg("__size").alias("m")).first()["m"] or 1
    width = limit * max(1, int(RANGE_ROWS * mean) // limit)
    number = F.floor(F.col("__before") / width)
    # Lanes within one range, which may be very many, are scanned many at once; of the others there is one to RANGE_ROWS rows at most.
    long_lanes = durable(scanned.filter(F.col("__before") >= width).select("__lane").distinct())
    short = scanned.join(F.broadcast(long_lanes), "__lane", "left_anti").select("__lane", "__before", "__size")
    bundle = F.pmod(F.xxhash64("__lane"), F.lit(scanned.count() // RANGE_ROWS + BUNDLES)).alias("__bundle")
    whole = short.groupBy(bundle).applyInPandas(_whole_lanes(rule, limit, out), f"__lane long, __before long, {out} long")
    ranged = scanned.join(F.broadcast(long_lanes), "__lane", "left_semi").withColumn("__range", number)
    reached = F.col("__before") - F.col("__range") * width < limit  # by batches of the range before
    both = F.when(reached & (F.col("__range") > 0), F.array("__range", F.col("__range") - 1)).otherwise(F.array("__range"))
    light = ranged.select("__lane", "__before", "__size", F.explode(both).alias("__range"))
    tables = light.groupBy("__lane", "__range").applyInPandas(_exits(rule, limit, width), "__lane long, __range long, starts array<long>, exits array<long>, counts array<long>")
    entries = tables.repartition("__lane").sortWithinPartitions("__lane", "__range").mapInPandas(_follow(width), "__lane long, __range long, entry long, begun long")
    kinds = {f.name: f for f in rows.schema.fields}

    def cut(key: tuple, own: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("__before")
        before = own["__before"].to_numpy()
        first, begun = entry["entry"].iloc[0], int(entry["begun"].iloc[0])
        at = len(own) if pd.isna(first) else int(np.searchsorted(before, int(first)))
        numbers = _batch_numbers(rule, limit, before, own["__size"].to_numpy(), at, begun)
        return own.assign(**{out: numbers})[["__lane", "__before", out]]

    places = ranged.select("__lane", "__range", "__before", "__size").groupBy("__lane", "__range").cogroup(entries.groupBy("__lane", "__range")).applyInPandas(cut, f"__lane long, __before long, {out} long")
    return scanned.drop(*({out} & set(kinds))).join(places.unionByName(whole), ["__lane", "__before"]).select(*(c for c in rows.columns if c != out), out)
