"""Sharding along a Hilbert curve, with DataFrame functions only.

Several metadata columns are quantised to a grid by their distribution: a value's level is the share of rows with smaller
values. Each row's cell gets its index on the Hilbert curve through the grid, the rows are put in the order of that index, and
runs of the order become shards. Neighbours on the curve are neighbours in the grid, so every file of a run spans short ranges
in all of the columns at once, and a filter on any of them skips files by their least and greatest values.

The curve is walked by a table that is built from the Gray-code rule of Hamilton's Hilbert curves for any number of dimensions:
a state is the corner where the curve enters a cell and the direction in which it leaves.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.distribute import balanced_shard
from ..operators.order import global_index, prefix_scan

#: Levels of a dimension, as a power of two.
BITS = 6


@lru_cache
def curve_table(n: int) -> tuple[int, ...]:
    """The Hilbert curve of n dimensions: at state * 2**n + corner, the next state * 2**n + the corner's place on the curve."""
    size = 1 << n
    turn = lambda x, by: ((x >> by % n) | (x << (n - by % n))) & (size - 1)  # noqa: E731, right; by -k turns left
    place = {w ^ (w >> 1): w for w in range(size)}  # of a Gray code
    entry = [0 if w == 0 else (e := 2 * ((w - 1) // 2)) ^ (e >> 1) for w in range(size)]
    ones = lambda w: (~w & (w + 1)).bit_length() - 1  # noqa: E731, trailing ones
    leaves = [0 if w == 0 else ones(w - 1 if w % 2 == 0 else w) % n for w in range(size)]
    out = []
    for state in range(size * n):
        enters, direction = divmod(state, n)
        for corner in range(size):
            w = place[turn(corner ^ enters, direction + 1)]
            out.append(((enters ^ turn(entry[w], -(direction + 1))) * n + (direction + leaves[w] + 1) % n) * size + w)
    return tuple(out)


def hilbert_index(levels: list[Column], bits: int = BITS) -> Column:
    """The index on the curve (long) of a cell, given by its level in each dimension, from 0 to 2**bits - 1."""
    n = len(levels)
    table = F.lit(list(curve_table(n)))
    bit = lambda level, i: F.floor(level / (1 << i)) % 2
    corners = F.array(*[sum((bit(x, i) * (1 << j) for j, x in enumerate(levels)), F.lit(0)).cast("int") for i in reversed(range(bits))])

    def step(at: Column, corner: Column) -> Column:
        found = F.get(table, at["state"] * (1 << n) + corner)
        return F.struct(F.floor(found / (1 << n)).cast("int").alias("state"), (at["index"] * (1 << n) + found % (1 << n)).alias("index"))

    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("index"))
    return F.aggregate(corners, start, step, lambda at: at["index"])


def level_cuts(df: DataFrame, dim: str, bits: int = BITS) -> list[tuple]:
    """(level, least value) of a dimension, by level; at most 2**bits of them, so they may pass through the driver. A value's level
    is the share of rows with smaller values, nulls among them. Values are counted before anything is sorted."""
    counts = df.groupBy(dim).agg(F.count(F.lit(1)).alias("__n"))
    upto = prefix_scan(counts, [], [dim], "__n", "__upto")
    total = counts.agg(F.sum("__n").alias("n")).first()["n"] or 1
    level = F.floor((F.col("__upto") - F.col("__n")) * (1 << bits) / total).cast("int")
    cuts = upto.filter(F.col(dim).isNotNull()).groupBy(level.alias("level")).agg(F.min(dim).alias("least"))
    return [(r["level"], r["least"]) for r in cuts.orderBy("level").collect()]


def level_of(value: Column, cuts: list[tuple]) -> Column:
    """The level of a value: that of the last cut that is not above it; of null, 0."""
    if not cuts:
        return F.lit(0)
    leasts = F.array(*[F.lit(least) for _, least in cuts])
    found = F.get(F.lit([level for level, _ in cuts]), F.size(F.filter(leasts, lambda x: x <= value)) - 1)
    return F.when(value.isNull(), 0).otherwise(F.coalesce(found, F.lit(0)))


def hilbert_shards(df: DataFrame, dims: list[str], n_shards: int, tie: list[str], law: str = "rows", size: str | None = None, bits: int = BITS) -> DataFrame:
    """df with hilbert (long), shard (int) and slot (long, gapless from 0 in a shard): the rows in the order of their cell on the
    curve and then of ``tie``, cut in n_shards runs.

    ``rows``: the runs' counts are at most one apart, the longer ones first; ``bytes``: a row belongs to the run in which the
    middle of its ``size`` lies, so that runs differ by about one row's size. With fewer rows than shards, ``rows`` leaves the
    last ones empty. Null dimensions count as least; rows that cell and tie don't tell apart are taken in any order. Columns
    named hilbert, shard or slot are replaced. An empty table gives an empty table. Only what df holds is moved: give ids and
    metadata, and join what is large afterwards.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law {law}")
    df = df.drop("hilbert", "shard", "slot")
    levels = [level_of(F.col(d), level_cuts(df, d, bits)) for d in dims]
    rows = global_index(df.withColumn("hilbert", hilbert_index(levels, bits)), "hilbert", tie, "__at")
    if law == "rows":
        total = rows.count()
        each, longer = divmod(total, max(1, min(n_shards, total)))
        shard = balanced_shard(F.col("__at"), total, n_shards)
        return rows.withColumn("shard", shard).withColumn("slot", F.col("__at") - F.col("shard") * each - F.least("shard", F.lit(longer))).drop("__at")
    rows = prefix_scan(rows, [], ["__at"], size, "__upto")
    total = rows.agg(F.sum(size).alias("n")).first()["n"] or 1
    middle = F.col("__upto") - F.col(size) / 2
    rows = rows.withColumn("shard", F.least(F.floor(middle * n_shards / total), F.lit(n_shards - 1)).cast("int"))
    first = F.broadcast(rows.groupBy("shard").agg(F.min("__at").alias("__first")))  # a row a shard
    return rows.join(first, "shard").withColumn("slot", F.col("__at") - F.col("__first")).select(*df.columns, "hilbert", "shard", "slot")


def write_shards(rows: DataFrame, path: str, files: int) -> None:
    """The rows of hilbert_shards() as folders shard=i of Parquet files, each of which is a run of the curve; about ``files`` in all."""
    rows.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def file_ranges(df: DataFrame, dims: list[str]) -> DataFrame:
    """(path, rows, least_<dim>, greatest_<dim>): what each file of a table that was read from files spans."""
    spans = [f(d).alias(f"{name}_{d}") for d in dims for name, f in (("least", F.min), ("greatest", F.max))]
    return df.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("rows"), *spans)


def may_hold(ranges: DataFrame, wanted: dict[str, tuple]) -> DataFrame:
    """The files of file_ranges() that may hold rows within (least, greatest) of all wanted dimensions."""
    for dim, (least, greatest) in wanted.items():
        ranges = ranges.filter((F.col(f"least_{dim}") <= F.lit(greatest)) & (F.col(f"greatest_{dim}") >= F.lit(least)))
    return ranges
