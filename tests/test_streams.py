"""Streams: what they put out in any order of arrival, over restarts, and without further input."""

from __future__ import annotations

import datetime
import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from speechloom.streaming import jobs
from tests.test_operators import naive_knapsack


def put(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def until(check, seconds=120):
    end = time.time() + seconds
    while not check():
        assert time.time() < end, "nothing came in time"
        time.sleep(0.2)


def test_a_lone_item_comes_out_by_the_clock(spark, tmp_path):
    """No further input: an item comes out once when it is old enough, a later time puts it off, a restart neither loses nor
    repeats it."""
    schema = "name string, saved_at timestamp"
    now = datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
    old, fresh = now - datetime.timedelta(hours=1), now + datetime.timedelta(seconds=30)
    put(spark, [("old", old), ("old", old - datetime.timedelta(hours=1)), ("fresh", fresh)], schema, tmp_path / "in")
    source = lambda: jobs.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, files_per_trigger=1)
    stream = jobs.stream_new_results(source(), 4)
    got = lambda: sorted((r.name, r.seen) for r in jobs.written(stream, str(tmp_path / "cp")).collect())
    query = jobs.start(stream, str(tmp_path / "cp"), processingTime="300 milliseconds")
    try:
        until(lambda: (tmp_path / "cp/rows/_spark_metadata").exists() and got())
        assert got() == [("old", 2)]
        assert [(r.name, r.seen) for r in jobs.held_results(spark, str(tmp_path / "cp/checkpoint")).collect()] == [("fresh", 1)]
        until(lambda: len(got()) == 2)
        assert datetime.datetime.now(datetime.UTC).replace(tzinfo=None) >= fresh + datetime.timedelta(seconds=4)
    finally:
        query.stop()
    put(spark, [("old", now), ("late", old)], schema, tmp_path / "in")
    query = jobs.start(jobs.stream_new_results(source(), 4), str(tmp_path / "cp"), processingTime="300 milliseconds")
    try:
        until(lambda: len(got()) == 3)
        time.sleep(2)
    finally:
        query.stop()
    assert got() == [("fresh", 1), ("late", 1), ("old", 2)]
    assert jobs.held_results(spark, str(tmp_path / "cp/checkpoint")).collect() == []


def arrivals(n=300, files=6):
    rng = random.Random(2)
    rows = [(i, rng.randrange(0, 80)) for i in range(n)]
    return [rows[k::files] for k in range(files)]


def lanes_of(spark, batches, lanes, cutoff):
    """Sequences of each lane in the order of micro-batches, by key within one."""
    lane = {r.doc_id: r.lane for r in spark.createDataFrame([r for b in batches for r in b], "doc_id long, len long").withColumn("lane", jobs.lane_of(F.col("doc_id"), lanes)).collect()}
    out = defaultdict(list)
    for batch in batches:
        for i, n in sorted(batch):
            if 0 < n <= cutoff:
                out[lane[i]].append((i, n))
    return out


@pytest.mark.parametrize("restarts", [False, True])
def test_stream_pack_makes_the_bins_of_its_buckets(spark, tmp_path, restarts):
    """Every bucket's bins are those of the batch packer on the same sequences; the state gets what arrives and not more."""
    batches, lanes, bucket, cutoff = arrivals(), 2, 40, 64
    schema = "doc_id long, len long"
    stream = lambda: jobs.stream_pack(jobs.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, files_per_trigger=1), cutoff, bucket, lanes=lanes)
    sizes = []
    for k, batch in enumerate(batches):
        put(spark, batch, schema, tmp_path / "in")
        if restarts or k == len(batches) - 1:
            query = jobs.start(stream(), str(tmp_path / "cp"))
            query.awaitTermination()
            sizes += jobs.state_sizes(query)
    full = jobs.written(stream(), str(tmp_path / "cp")).collect()
    held = jobs.pack_held(spark, str(tmp_path / "cp/checkpoint"), cutoff).collect()
    got = defaultdict(dict)
    for r in full + held:
        got[r.lane].setdefault(r.bin_id, []).append((r.seq_no, r.doc_id))
    want = {}
    for lane, seqs in lanes_of(spark, batches, lanes, cutoff).items():
        bins = [b for at in range(0, len(seqs), bucket) for b in naive_knapsack([(i, n) for i, (_, n) in enumerate(seqs[at : at + bucket])], cutoff) for b in [[seqs[at + i][0] for i in b]]]
        want[lane] = dict(enumerate(bins))
    if restarts:  # the files' order is sure
        assert {lane: {b: [i for _, i in sorted(v)] for b, v in bins.items()} for lane, bins in got.items()} == want
    assert sorted(r.doc_id for r in full + held) == sorted(i for b in batches for i, n in b if 0 < n <= cutoff)
    assert len(sizes) >= len(batches) and all(s["bytes_written"] < 100_000 for s in sizes) and sum(s["bytes_written"] for s in sizes) > 0


def test_stream_pack_flushes_by_the_clock(spark, tmp_path):
    schema = "doc_id long, len long"
    put(spark, [(1, 5), (2, 60), (3, 20)], schema, tmp_path / "in")
    stream = jobs.stream_pack(jobs.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema), 64, 10, lanes=1, flush_ms=1500)
    query = jobs.start(stream, str(tmp_path / "cp"), processingTime="300 milliseconds")
    try:
        until(lambda: (tmp_path / "cp/rows/_spark_metadata").exists() and jobs.written(stream, str(tmp_path / "cp")).count() == 3)
    finally:
        query.stop()
    assert sorted((r.bin_id, r.seq_no, r.doc_id) for r in jobs.written(stream, str(tmp_path / "cp")).collect()) == [(0, 0, 2), (1, 0, 3), (1, 1, 1)]
    assert jobs.pack_held(spark, str(tmp_path / "cp/checkpoint"), 64).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_totals_in_any_order_of_arrival(spark, tmp_path, seed):
    """Late last steps of early splits correct what was written of the later ones; a restart in between changes nothing."""
    rng = random.Random(seed)
    last = {(run, s): rng.randrange(1, 6) for run in ("r", "q") for s in range(4)}
    rows = [(run, s, n, n / last[run, s]) for (run, s), top in last.items() for n in range(1, top + 1)]
    rng.shuffle(rows)
    schema = "run string, split_no int, step int, epoch double"
    stream = lambda: jobs.stream_split_offsets(jobs.read_stream(spark, str(tmp_path / "log"), spark.createDataFrame([], schema).schema, files_per_trigger=1))
    size = -(-len(rows) // 5)
    for at in range(0, len(rows), size):
        put(spark, rows[at : at + size], schema, tmp_path / "log")
        if at in (size, 4 * size):
            offsets = jobs.run_available(stream(), str(tmp_path / "cp"), "update")
    assert offsets.groupBy("run", "split_no").count().agg(F.max("count")).first()[0] > 1  # something was corrected
    got = {(r.run, r.split_no, r.step): (r.total_step, r.total_epoch) for r in jobs.totals(spark.createDataFrame(rows, schema), offsets, 4).collect()}
    assert got == {(run, s, n): (n + sum(last[run, t] for t in range(s)), (s + e) / 4) for run, s, n, e in rows}


def test_progress_drops_closed_windows_from_its_state(spark, tmp_path):
    start = datetime.datetime(2026, 1, 1)
    rows = [(f"w{i % 2}", ["done", "skip", "fail"][i % 3], start + datetime.timedelta(minutes=7 * i)) for i in range(40)]
    schema = "worker string, status string, ts timestamp"
    put(spark, rows, schema, tmp_path / "log")
    stream = jobs.stream_progress(jobs.read_stream(spark, str(tmp_path / "log"), spark.createDataFrame([], schema).schema))
    closed = jobs.run_available(stream, str(tmp_path / "cp")).collect()
    held = jobs.held_progress(spark, str(tmp_path / "cp/checkpoint")).collect()
    want = Counter((w, t.replace(minute=0), s) for w, s, t in rows)
    got = {(r.worker, r.start, s): r[s] for r in closed + held for s in ("done", "skip", "fail") if r[s]}
    assert got == want and 0 < len(held) <= 4 < len(closed)
    assert all(r.rate == r.done / 3600 for r in closed + held)
