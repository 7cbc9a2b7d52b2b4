"""Sharding, splitting and rebalancing over an index (0-based, gapless unless said otherwise)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cuts import greedy_cuts
from .order import global_index, portable_key, ranked, seeded_key  # noqa: F401 (ranked: for callers)


def assign_round_robin(df: DataFrame, n: int, idx: str = "idx", out: str = "shard") -> DataFrame:
    return df.withColumn(out, F.pmod(F.col(idx), F.lit(n)).cast("int"))


def shard_contiguous(df: DataFrame, n: int, total: int | None = None, idx: str = "idx", out: str = "shard") -> DataFrame:
    """Shards of ceil(total / n) consecutive rows."""
    total = df.count() if total is None else total
    return df.withColumn(out, F.floor(F.col(idx) / max(1, -(-total // n))).cast("int"))


def balanced_shard(idx: Column, total: int, n: int) -> Column:
    """Shard of an index when sizes differ by one at most and the larger shards come first; n is clipped to 1..total."""
    n = max(1, min(n, total))
    size, extra = divmod(total, n)
    return F.when(idx < extra * (size + 1), F.floor(idx / (size + 1))).otherwise(extra + F.floor((idx - extra * (size + 1)) / max(size, 1))).cast("int")


def shard_balanced(df: DataFrame, n: int, total: int | None = None, idx: str = "idx", out: str = "shard") -> DataFrame:
    return df.withColumn(out, balanced_shard(F.col(idx), df.count() if total is None else total, n))


def shard_by_bytes(df: DataFrame, max_bytes: int, size: str, rank: str = "rank", pos: str = "pos", step: int = 500, out: str = "shard") -> DataFrame:
    """Within a rank, a new shard once its bytes have come to max_bytes, looked at after every ``step`` rows; the count then starts
    anew. Steps are never cut, so a shard overshoots by less than one. ``rank`` and ``pos`` are whole numbers."""
    rows = df.withColumn("__step", F.floor(F.col(pos) / step))
    steps = rows.groupBy(rank, "__step").agg(F.sum(size).alias("__b"))
    cut = greedy_cuts(steps, rank, ["__step"], "__b", max_bytes, "reach", out)
    return rows.drop(out).join(cut.select(rank, "__step", F.col(out).cast("int").alias(out)), [rank, "__step"]).drop("__step")


def write_partitioned_shards(df: DataFrame, n: int, path: str, idx: str = "idx") -> None:
    """Strided shards i::n as folders shard=i."""
    assign_round_robin(df, n, idx).write.partitionBy("shard").parquet(path)


def rank_sizes(df: DataFrame, rank: str = "rank") -> DataFrame:
    return df.groupBy(rank).agg(F.count(F.lit(1)).alias("n"))


def rebalance_trim(df: DataFrame, rank: str = "rank", pos: str = "pos") -> DataFrame:
    """Every rank cut to the smallest rank's rows; the tails go."""
    least = F.broadcast(rank_sizes(df, rank).agg(F.min("n").alias("__least")))
    return df.crossJoin(least).filter(F.col(pos) < F.col("__least")).drop("__least")


def rebalance_redistribute(df: DataFrame, rank: str = "rank", pos: str = "pos") -> DataFrame:
    """Every rank gets floor(total / ranks) rows: ranks with more give their tails, in rank order, to those with fewer, in rank
    order. Adds new_rank (null: left over) and moved. No row is lost: what remains has a null new_rank."""
    sizes = rank_sizes(df, rank)
    all_ranks = Window.partitionBy(F.lit(0))
    before = lambda c: F.coalesce(F.sum(c).over(all_ranks.orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = sizes.withColumn("__goal", F.floor(F.sum("n").over(all_ranks) / F.count(F.lit(1)).over(all_ranks)))
    plan = plan.withColumn("__over", F.greatest(F.col("n") - F.col("__goal"), F.lit(0))).withColumn("__under", F.greatest(F.col("__goal") - F.col("n"), F.lit(0)))
    plan = plan.withColumn("__first", before("__over")).withColumn("__from", before("__under"))
    rows = df.join(F.broadcast(plan.select(rank, "__goal", "__first")), rank).withColumn("__spare", F.when(F.col(pos) >= F.col("__goal"), F.col("__first") + F.col(pos) - F.col("__goal")))
    takers = plan.filter("__under > 0").select(F.col(rank).alias("__taker"), "__from", (F.col("__from") + F.col("__under")).alias("__to"))
    taken = rows.join(F.broadcast(takers), (F.col("__spare") >= F.col("__from")) & (F.col("__spare") < F.col("__to")), "left")
    new = F.when(F.col("__spare").isNull(), F.col(rank)).otherwise(F.col("__taker"))
    return taken.withColumn("new_rank", new).withColumn("moved", F.col("__spare").isNotNull() & F.col("__taker").isNotNull()).drop("__goal", "__first", "__spare", "__taker", "__from", "__to")


def rebalance_cycle(df: DataFrame, rank: str = "rank", pos: str = "pos") -> DataFrame:
    """Short ranks repeat their rows from the front until all are as long as the longest; pos is the new place."""
    sizes = rank_sizes(df, rank)
    plan = sizes.crossJoin(F.broadcast(sizes.agg(F.max("n").alias("__most"))))
    rows = df.join(F.broadcast(plan), rank)
    times = F.floor((F.col("__most") - 1 - F.col(pos)) / F.col("n"))
    return rows.withColumn("__again", F.explode(F.sequence(F.lit(0).cast("long"), times))).withColumn(pos, F.col(pos) + F.col("__again") * F.col("n")).drop("__again", "n", "__most")


def data_split(df: DataFrame, i: int, n: int, by: str = "row", total: int | None = None, idx: str = "idx") -> DataFrame:
    """The i-th of n parts: by ``row`` of floor(total / n) rows, the last taking the rest, or by ``shard`` (idx holds the shard
    numbers, 0 to total - 1) of ceil(total / n) whole shards, the last ones possibly empty."""
    if not 0 <= i < n:
        raise ValueError("the part must be in 0..n-1")
    if by == "row":
        total = df.count() if total is None else total
        size = total // n
        return df.filter((F.col(idx) >= i * size) & (F.col(idx) < (total if i == n - 1 else (i + 1) * size)))
    if by == "shard":
        total = (df.agg((F.max(idx) + 1).alias("n")).first()["n"] or 0) if total is None else total
        size = -(-total // n)
        return df.filter((F.col(idx) >= i * size) & (F.col(idx) < (i + 1) * size))
    raise ValueError(f"unknown unit {by}")


def split_order(splits: DataFrame, run_id: str, split: str = "split", portable: bool = False) -> DataFrame:
    """The splits with ``turn``: their pseudo-random order in a run, the same for every worker."""
    key = portable_key(run_id, F.col(split)) if portable else seeded_key(run_id, F.col(split))
    return splits.withColumn("turn", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(key, split)) - 1).cast("int"))


def interleave(sources: list[DataFrame], order: str, stop: str = "all") -> DataFrame:
    """One row of each source in turn: adds source_no and turn. ``all``: until every source is exhausted; ``first``: only whole
    turns, as many as the shortest source has."""
    parts = [global_index(df, order, out="turn").withColumn("source_no", F.lit(i)) for i, df in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, parts)
    if stop == "first":
        least = F.broadcast(rows.groupBy("source_no").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("__least"), F.count(F.lit(1)).alias("__sources")))
        rows = rows.crossJoin(least).filter((F.col("turn") < F.col("__least")) & (F.col("__sources") == len(sources))).drop("__least", "__sources")
    elif stop != "all":
        raise ValueError(f"unknown stop policy {stop}")
    return rows
