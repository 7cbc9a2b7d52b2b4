"""Structured Streaming forms of preparation, packing and progress."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import words_of
from ..operators.packing import _knapsack
from .processors import Packing, Ripening, SplitOffsets


#: Groups of the items of stream_new_results; fixed, since a checkpoint knows its items by them.
RESULT_LANES = 256


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def stream_prepare(source: DataFrame, key: str = "doc_id", text: str = "text", overhead: int = 8) -> DataFrame:
    """(key, dataset, transcript, n_words, len) of arriving utterances with a text; the same projection as in batch."""
    rows = source.withColumn("__ws", words_of(F.col(text))).filter(F.size("__ws") > 0)
    return rows.select(key, F.col("lang").alias("dataset"), F.array_join("__ws", " ").alias("transcript"), F.size("__ws").alias("n_words"), (F.size("__ws") + overhead).cast("long").alias("len"))


def use_rocksdb(spark: SparkSession) -> None:
    """State of streams that start from now on lies in RocksDB and is checkpointed as a log of its changes; a stream that is started
    again keeps the kind of state that it has."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _planner(cutoff: int, key: str, length: str):
    def plan(lane: int, held: list[tuple], first_bin: int) -> tuple[pd.DataFrame, int]:
        """The plan of one bucket, its bins numbered from first_bin, and the number after the last."""
        ids, lens = [x[0] for x in held], [int(x[1]) for x in held]
        where = _knapsack(lens, cutoff)
        rows = pd.DataFrame({"lane": lane, "bin_id": [first_bin + b for b, _ in where], key: ids, length: lens, "seq_no": [s for _, s in where]})
        return rows, first_bin + max(b for b, _ in where) + 1

    return plan


def lane_of(key: Column, lanes: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(lanes)).cast("int")


def stream_pack(seqs: DataFrame, cutoff: int, bucket: int = 200, lanes: int | None = None, key: str = "doc_id", length: str = "len", flush_ms: int | None = None) -> DataFrame:
    """(lane, bin_id, key, len, seq_no): each lane holds sequences over micro-batches until it has a bucket, packs them by the
    greedy knapsack and starts anew. What it holds when the stream ends is packed by pack_held; with flush_ms a lane that
    hears nothing for so long packs it itself. Longer sequences than the cutoff are left out. As many lanes as shuffle
    partitions, unless given: each is a group of its own, and adds to its state no more than what arrives.
    """
    use_rocksdb(seqs.sparkSession)
    lanes = lanes or int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(seqs.dtypes)[key]
    fit = seqs.filter((F.col(length) > 0) & (F.col(length) <= cutoff)).withColumn("lane", lane_of(F.col(key), lanes)).select("lane", key, F.col(length).cast("long").alias(length))
    processor = Packing(_planner(cutoff, key, length), key, length, kind, bucket, flush_ms)
    return fit.groupBy("lane").transformWithStateInPandas(processor, f"lane int, bin_id long, {key} {kind}, {length} long, seq_no long", "append", "None" if flush_ms is None else "ProcessingTime")


def _state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    return spark.read.format("statestore").option("stateVarName", name).option("flattenCollectionTypes", "false").load(checkpoint)


def pack_held(spark: SparkSession, checkpoint: str, cutoff: int, key: str = "doc_id", length: str = "len") -> DataFrame:
    """The plan of what the lanes of an ended stream_pack still hold, read from the state of its checkpoint."""
    held = _state(spark, checkpoint, "held").select(F.col("key.lane").alias("lane"), F.col("list_value").alias("held"))
    made = _state(spark, checkpoint, "counts").select(F.col("key.lane").alias("lane"), "value.made")
    rows = held.filter("size(held) > 0").join(made, "lane")
    kind = held.schema["held"].dataType.elementType["id"].dataType.simpleString()
    plan = _planner(cutoff, key, length)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lane, lane_held, first in zip(frame["lane"], frame["held"], frame["made"], strict=True):
                yield plan(int(lane), [(x["id"], x["len"]) for x in lane_held], int(first))[0]

    return rows.mapInPandas(pack, f"lane int, bin_id long, {key} {kind}, {length} long, seq_no long")


def state_sizes(query: StreamingQuery) -> list[dict]:
    """For each micro-batch that a query still remembers: the rows that came, those that its state got, and the bytes written to it."""
    out = []
    for p in query.recentProgress:
        for s in p["stateOperators"]:
            out.append({"batch": p["batchId"], "rows": p["numInputRows"], "rows_updated": s["numRowsUpdated"], "bytes_written": s["customMetrics"].get("rocksdbTotalBytesWritten", 0)})
    return out


def new_results(items: DataFrame, done: DataFrame, min_age: int, now, key: str = "name", ts: str = "saved_at") -> DataFrame:
    """Batch form: items not done yet and at least min_age seconds old."""
    return items.filter(F.unix_timestamp(F.lit(now)) - F.unix_timestamp(ts) >= min_age).join(done.select(key), key, "left_anti")


def stream_new_results(source: DataFrame, min_age: int, key: str = "name", ts: str = "saved_at", forget: int | None = None) -> DataFrame:
    """(key, ts, seen): each item once, as soon as the clock has passed its latest time by min_age seconds, with no further input
    asked for, however often and over however many restarts it is heard of. A released item is remembered for ``forget``
    seconds after it was last heard of, for ever unless given. Use a trigger that goes on (processingTime): it looks at the clock.
    Items are dealt to RESULT_LANES groups, so that an item costs some entries of a map and not a group of its own.
    """
    use_rocksdb(source.sparkSession)
    kind = dict(source.dtypes)[key]
    rows = source.select(lane_of(F.col(key), RESULT_LANES).alias("__lane"), key, F.unix_millis(F.col(ts).cast("timestamp")).alias(ts))
    ripe = rows.groupBy("__lane").transformWithStateInPandas(Ripening(key, ts, kind, 1000 * min_age, None if forget is None else 1000 * forget), f"{key} {kind}, {ts} long, seen long", "append", "ProcessingTime")
    return ripe.withColumn(ts, F.timestamp_millis(ts))


def held_results(spark: SparkSession, checkpoint: str, key: str = "name", ts: str = "saved_at") -> DataFrame:
    """The items that a stream_new_results has not released yet, read from the state of its checkpoint."""
    items = spark.read.format("statestore").option("stateVarName", "waiting").load(checkpoint)
    return items.select(F.col("user_map_key.name").alias(key), F.timestamp_millis("user_map_value.at").alias(ts), F.col("user_map_value.seen").alias("seen"))


def stream_progress(log: DataFrame, late: str = "10 minutes", width: str = "1 hour", ts: str = "ts", worker: str = "worker", status: str = "status") -> DataFrame:
    """(window start, worker, done, skip, fail, rate) of tumbling windows; rate is done ones per second of the window. In append mode a
    window comes once the watermark has passed it and leaves the state; those that an ended stream still holds: held_progress."""
    n = lambda s: F.count_if(F.col(status) == s).alias(s)
    return _progress(log.withWatermark(ts, late).groupBy(F.window(ts, width), worker).agg(n("done"), n("skip"), n("fail")), worker)


def _progress(counted: DataFrame, worker: str) -> DataFrame:
    seconds = F.unix_timestamp("window.end") - F.unix_timestamp("window.start")
    return counted.select(F.col("window.start").alias("start"), worker, "done", "skip", "fail", (F.col("done") / seconds).alias("rate"))


def held_progress(spark: SparkSession, checkpoint: str, worker: str = "worker") -> DataFrame:
    """The windows that a stream_progress in append mode still holds, read from the state of its checkpoint."""
    held = spark.read.format("statestore").load(checkpoint).select(F.col("key.window").alias("window"), F.col(f"key.{worker}").alias(worker), F.col("value").cast("struct<done:bigint,skip:bigint,fail:bigint>").alias("n"))
    return _progress(held.select("window", worker, "n.*"), worker)


def stream_split_offsets(log: DataFrame, run: str = "run", split: str = "split_no", step: str = "step") -> DataFrame:
    """(run, split, before) in update mode, from arriving logs whose steps restart with every split: how many steps the splits before
    have. A late step of an earlier split brings new rows for the later ones, so the latest row of a split counts. Its state
    is a number a split."""
    use_rocksdb(log.sparkSession)
    kinds = dict(log.dtypes)
    rows = log.select(run, F.col(split).cast("long").alias(split), F.col(step).cast("long").alias(step))
    return rows.groupBy(run).transformWithStateInPandas(SplitOffsets(run, split, step), f"{run} {kinds[run]}, {split} long, before long", "update", "None")


def totals(log: DataFrame, offsets: DataFrame, n_splits: int, run: str = "run", split: str = "split_no", step: str = "step", epoch: str = "epoch") -> DataFrame:
    """(run, split, step, total_step, total_epoch) of a log, by the latest offsets that stream_split_offsets has written so far (with
    the micro-batch of each, see run_available). Whatever order the steps arrived in, the result is that of the batch form."""
    latest = offsets.groupBy(F.col(run).alias("__run"), F.col(split).alias("__split")).agg(F.max_by("before", "batch").alias("__before"))
    rows = log.join(latest, F.col(run).eqNullSafe(F.col("__run")) & (F.col(split) == F.col("__split")))
    return rows.select(run, split, step, (F.col(step) + F.col("__before")).cast("long").alias("total_step"), ((F.col(split) + F.col(epoch)) / n_splits).alias("total_epoch"))


def start(stream: DataFrame, folder: str, mode: str = "append", **trigger) -> StreamingQuery:
    """Starts a stream that writes Parquet below a shared folder, its checkpoint in ``folder``/checkpoint. In update mode each
    micro-batch has a folder batch=number, which it replaces if it is run again; in complete mode the last result stays."""
    out = f"{folder}/rows"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True}))
    if mode == "append":
        return writer.format("parquet").start(out)
    return writer.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/batch={n}" if mode == "update" else out)).start()


def written(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """What a stream that was started in this folder has written so far; in update mode with ``batch``, the micro-batch's number."""
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())]) if mode == "update" else stream.schema
    return stream.sparkSession.read.schema(schema).parquet(f"{folder}/rows")


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns what it wrote."""
    start(stream, folder, mode).awaitTermination()
    return written(stream, folder, mode)


def run_caught_up(stream: DataFrame, folder: str, every: str = "1 second") -> DataFrame:
    """Runs a stream whose state looks at the clock until a micro-batch has found nothing new, and returns what it wrote. Such
    a stream would never end by itself, not even with an availableNow trigger."""
    query = start(stream, folder, processingTime=every)
    try:
        while not any(p["numInputRows"] == 0 for p in query.recentProgress[-1:]):
            if query.awaitTermination(0.2):
                raise RuntimeError("the stream was stopped before it had caught up")
    finally:
        query.stop()
    return written(stream, folder)
