"""Batches by length."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import durable
from .cuts import greedy_cuts
from .order import global_index, global_shuffle, portable_key, ranked, seeded_key


def bucket_batches(lens: DataFrame, batch: int, mult: int = 100, drop_last: bool = False, key: str = "id", length: str = "len", seed: int = 0) -> DataFrame:
    """Rows with bucket, batch_id and slot: sorted by length, cut in buckets of batch * mult, shuffled inside a bucket by the
    seed, cut in batches. ``turn`` is the order of the batches, shuffled too; drop_last leaves out short batches."""
    rows = global_index(lens, length, [key], "__idx").withColumn("bucket", F.floor(F.col("__idx") / (batch * mult)))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(portable_key(seed, F.col(key)), key)) - 1
    rows = rows.withColumn("__place", place).withColumn("batch_id", F.col("bucket") * mult + F.floor(F.col("__place") / batch)).withColumn("slot", (F.col("__place") % batch).cast("int"))
    rows = rows.withColumn("turn", portable_key(f"{seed}/batch", F.col("batch_id"))).drop("__idx", "__place")
    if drop_last:
        full = rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == batch).select("batch_id")
        rows = rows.join(full, "batch_id", "left_semi")
    return rows


def token_budget_batches(lens: DataFrame, budget: int, mode: str = "padded", mult: int = 100, min_size: int = 1, key: str = "id", length: str = "len", seed: int | str = 0, lane: str | None = None, portable: bool = False) -> DataFrame:
    """(lane if given, key, len, bucket, batch_no, place): rows taken in order and cut where the budget ends; place is that in the
    order, batch_no counts from 0 in each bucket.

    ``padded``, for training: rows sorted by length fill buckets of mult * (budget / longest) rows, which are shuffled by the seed,
    and a batch closes before (n + 1) * longest would pass the budget. ``sum``: one bucket in the seed's order, a batch
    closes before its sum would pass the budget. ``sorted``, for evaluation: padded, in one bucket in order of length. A row
    over the budget is a batch by itself; batches under min_size are left out; lengths under 1 count as 1. Of a lane (a rank,
    say; a whole number), each has an order and buckets of its own. portable: orders that other engines can compute.

    The scan is sequential in a bucket, which may hold the whole table: greedy_cuts() does it in many tasks.
    """
    if mode not in ("padded", "sum", "sorted"):
        raise ValueError(f"unknown mode {mode}")
    shuffled = portable_key(seed, F.col(key)) if portable else seeded_key(seed, F.col(key))
    rows = lens.select(*([F.col(lane).cast("long").alias("__rank")] if lane else [F.lit(0).cast("long").alias("__rank")]), key, length).withColumn("__k", shuffled)
    bucket = F.lit(0).cast("long")
    if mode == "padded":
        longest = lens.agg(F.max(length).alias("m")).first()["m"] or 1
        size = max(1, budget // max(1, longest)) * mult
        rows = ranked(rows, "__rank", [length, key], "__idx")
        bucket = F.floor(F.col("__idx") / size)
    rows = durable(rows.withColumn("bucket", bucket))
    wide = (rows.agg(F.max("bucket").alias("m")).first()["m"] or 0) + 1
    rows = rows.withColumn("__bucket", F.col("__rank") * wide + F.col("bucket"))
    order = [length, key] if mode == "sorted" else ["__k", key]
    rows = ranked(rows, "__bucket", order, "place")
    rows = greedy_cuts(rows, "__bucket", ["place"], length, budget, "sum" if mode == "sum" else "padded")
    if min_size > 1:
        rows = durable(rows)
        whole = rows.groupBy("__bucket", "batch_no").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= min_size)
        rows = rows.join(whole.drop("__n"), ["__bucket", "batch_no"], "left_semi")
    return rows.select(*([F.col("__rank").alias(lane)] if lane else []), key, length, "bucket", "batch_no", "place")


def deal_batches(batches: DataFrame, replicas: int, seed: int | str = 0, portable: bool = False) -> DataFrame:
    """(bucket, batch_no, idx, replica, turn): the batches in the seed's order, the first ones again until they divide by the replicas,
    and dealt in turn. A table of batches, not of rows: join it to them by (bucket, batch_no)."""
    known = batches.select("bucket", "batch_no").distinct().withColumn("__batch", F.concat_ws("/", "bucket", "batch_no"))
    dealt = durable(global_shuffle(known, seed, "__batch", "idx", portable).drop("__batch"))
    padded = pad_to_replicas(dealt, replicas)
    return padded.withColumn("replica", F.pmod("idx", F.lit(replicas)).cast("int")).withColumn("turn", F.floor(F.col("idx") / replicas))


def pad_to_replicas(batches: DataFrame, n: int, total: int | None = None, idx: str = "idx") -> DataFrame:
    """Leading batches repeated, under new indexes, until the number of batches divides by n; none is cut."""
    total = batches.count() if total is None else total
    short = -total % n
    if not total or not short:
        return batches
    again = batches.withColumn("__turn", F.explode(F.sequence(F.lit(1), F.lit(-(-short // total)))))
    again = again.withColumn(idx, (F.col(idx) + F.col("__turn") * total).cast(dict(batches.dtypes)[idx])).filter(F.col(idx) < total + short).drop("__turn")
    return batches.unionByName(again)


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """A user function over column dicts (column -> list), which may return another number of rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame(function({c: frame[c].tolist() for c in frame.columns}))

    return df.mapInPandas(run, schema)
