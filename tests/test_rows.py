"""Samples, bounded shuffles, running results and fetches of rows."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from speechloom.operators import metrics as M
from speechloom.operators import order
from speechloom.operators.order import buffer_shuffle, prefix_scan
from speechloom.sources import files


@pytest.mark.parametrize(("digit", "few"), [(12, 10_000), (4, 3), (12, 0)])
@pytest.mark.parametrize("n", [0, 1, 50, 399, 400, 1000, None])
def test_sample_rows(spark, monkeypatch, digit, few, n):
    """The first n rows by hash and key, at any number of passes and partitions; a third of the rows have one key."""
    monkeypatch.setattr(M, "DIGIT", digit)
    monkeypatch.setattr(M, "FEW", few)
    keys = [7] * 133 + list(range(1000, 1267))
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long").repartition(5)
    got = M.sample_rows(df, n, 3, "k", portable=True)
    place = lambda k: (hashlib.md5(f"3:{k}".encode()).hexdigest(), k)
    assert sorted(r.k for r in got.collect()) == sorted(sorted(keys, key=place)[:n])
    assert len({r.i for r in got.collect()}) == min(len(keys), len(keys) if n is None else n)
    seeded = sorted(r.k for r in M.sample_rows(df, n, 3, "k").collect())
    by_hash = [r.k for r in df.withColumn("h", F.xxhash64(F.lit(3), "k")).orderBy("h", "k").collect()]
    assert seeded == sorted(by_hash[:n])
    ordered = [r.k for r in M.sample_rows(df, n, 3, "k", ordered=True).collect()]
    assert n is None or ordered == sorted(ordered)


def test_half_of_a_table_is_no_task_s_work(spark):
    """The sample is a filter but for the few rows at the cut: the plan gathers no more than these."""
    sample = M.sample_rows(spark.range(60_000).withColumnRenamed("id", "k"), 30_000, 1, "k")
    assert sample.count() == 30_000
    gathered = [int(x.split("limit=")[1].split(",")[0]) for x in sample._jdf.queryExecution().executedPlan().toString().split("TakeOrderedAndProject(")[1:]]
    assert all(x <= M.FEW for x in gathered)


def brute_buffer(rows, size, name):
    rng, held, out = random.Random(name), [], []
    for row in rows:
        if len(held) < size:
            held.append(row)
        else:
            at = rng.randrange(size)
            out.append(held[at])
            held[at] = row
    rng.shuffle(held)
    return out + held


@pytest.mark.parametrize("size", [1, 7, 100, 5000])
@pytest.mark.parametrize("batch", [3, 10_000])
def test_buffer_shuffle(spark, size, batch):
    """As a buffer of rows one by one, whatever the Arrow batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(batch))
    try:
        df = spark.range(0, 400, 1, 2).select("id", F.concat(F.lit("x"), F.col("id")).alias("t"))
        parts = buffer_shuffle(df, size, 9).withColumn("p", F.spark_partition_id()).collect()
    finally:
        spark.conf.set(key, before)
    for p, rows in enumerate((range(200), range(200, 400))):
        got = [r.id for r in parts if r.p == p]
        assert got == brute_buffer(rows, size, f"9/{p}")
        assert all(at >= i - p * 200 - size for at, i in enumerate(got)) and (size == 1 or got != list(rows))
    assert all(r.t == f"x{r.id}" for r in parts)
    assert buffer_shuffle(df.limit(0), 5, 1).collect() == []


def test_buffer_shuffle_of_a_stream(spark, tmp_path):
    from speechloom.streaming import jobs

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = buffer_shuffle(jobs.read_stream(spark, str(tmp_path / "in"), spark.range(1).schema), 10, 1)
    got = [r.id for r in jobs.run_available(stream, str(tmp_path / "out")).collect()]
    assert sorted(got) == list(range(100)) and got != list(range(100))


@pytest.mark.parametrize("how", ["sum", "min", "max"])
@pytest.mark.parametrize("earlier", [False, True])
def test_prefix_scan(spark, monkeypatch, how, earlier):
    """Running results over ranges of ten rows, of one long group, a short one and one of nulls."""
    monkeypatch.setattr(order, "RANGE_ROWS", 10)
    rng = random.Random(8)
    rows = [(g, i, rng.choice([None, *range(-9, 10)]) if g != "null" else None) for g, n in (("long", 300), ("short", 3), (None, 25), ("null", 12)) for i in range(n)]
    got = {(r.g, r.i): r.o for r in prefix_scan(spark.createDataFrame(rows, "g string, i int, v int").repartition(4), ["g"], ["i"], "v", "o", how, earlier).collect()}
    f = {"sum": sum, "min": min, "max": max}[how]
    for g, i, _ in rows:
        own = [v for h, j, v in rows if h == g and (j < i if earlier else j <= i) and v is not None]
        assert got[g, i] == (f(own) if own else None)


def test_best_so_far_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(order, "RANGE_ROWS", 16)
    rng = random.Random(9)
    rows = [("r", i, rng.random() + 1 / (i + 1)) for i in range(200)]
    best, want = None, {}
    for _, i, wer in rows:
        want[i] = (best, best is None or wer < best)
        best = wer if best is None else min(best, wer)
    got = M.best_so_far(spark.createDataFrame(rows, "run string, step int, wer double").repartition(3)).collect()
    assert {r.step: (r.best_before, r.new_best) for r in got} == want


@pytest.fixture(scope="module")
def stored_rows(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rows") / "t")
    spark.range(1000).select(F.col("id").alias("k"), F.concat(F.lit("v"), F.col("id")).alias("v")).repartitionByRange(10, "k").sortWithinPartitions("k").write.parquet(path)
    return path


def test_fetch_rows_reads_only_files_that_may_hold_them(spark, stored_rows):
    index = files.index_files(spark, [stored_rows], "k").cache()
    assert index.count() == 10 and index.agg(F.sum("rows")).first()[0] == 1000
    wanted = spark.createDataFrame([(5,), (5,), (77,), (950,), (5000,), (None,)], "k long")
    got = files.fetch_rows(spark, [stored_rows], "k", wanted, index)
    assert sorted((r.k, r.v) for r in got.collect()) == [(5, "v5"), (77, "v77"), (950, "v950")]
    assert len(got.inputFiles()) <= 3
    assert files.fetch_rows(spark, [stored_rows], "k", wanted.filter("k = 5000")).collect() == []
    assert files.fetch_rows(spark, [stored_rows], "k", wanted.limit(0)).columns == ["k", "v"]


def test_overlapping_files(spark, tmp_path):
    path = str(tmp_path / "t")
    for rows in ([0, 900], [3, 4, 5], [5, 6], [1000, 1001], [2, 950]):
        spark.createDataFrame([(k, k) for k in rows], "k long, v long").coalesce(1).write.mode("append").parquet(path)
    for wanted in ([5], [950], [3, 1001], [7], [900, 2]):
        got = files.fetch_rows(spark, [path], "k", spark.createDataFrame([(k,) for k in wanted], "k long"))
        want = sorted(k for rows in ([0, 900], [3, 4, 5], [5, 6], [1000, 1001], [2, 950]) for k in rows if k in wanted)
        assert sorted(r.k for r in got.collect()) == want


def test_fetch_positions_reads_only_files_that_hold_them(spark, stored_rows):
    in_order = [r.k for r in spark.read.parquet(stored_rows).select("k", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")).orderBy("f", "i").collect()]
    wanted = [0, 3, 3, 501, 999, 1000, -1]
    got = files.fetch_positions(spark, [stored_rows], spark.createDataFrame([(p,) for p in wanted], "position long"))
    assert sorted((r.position, r.k) for r in got.collect()) == [(p, in_order[p]) for p in (0, 3, 501, 999)]
    assert len(got.inputFiles()) <= 3 + 4  # and the stored positions
    assert files.fetch_positions(spark, [stored_rows], spark.createDataFrame([(5000,)], "position long")).collect() == []


def test_bins_of_an_empty_catalog(spark):
    with pytest.raises(ValueError):
        files.read_bins(spark, spark.createDataFrame([], "dataset string, layout string, suffix string, form string, path string, n_rows long"))
