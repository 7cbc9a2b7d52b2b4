"""Exact top-k inner-product search in three phases with a uniform threshold.

Vectors are cut into ``lists`` blocks of dimensions and into chunks of rows; every (block, chunk) is a node that can score
its part of all inner products. Phase 1 gathers each list's k best partial scores and resolves those candidates, so that the
k-th best is a safe lower bound of every query's result. Phase 2 sends each node the cutoff bound / lists, and the node
answers with all entries that reach it: an entry that reaches the bound must reach the cutoff in at least one list, whatever
the signs. Phase 3 resolves exactly the entries gathered. Queries go in blocks; matrices travel as packed rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import durable

CHUNK, QUERY_BLOCK, LISTS = 4096, 256, 2
#: Query blocks are broadcast up to this size; beyond it both sides are dealt out by key.
BROADCAST_BYTES = 16 << 20


def _pack(rows: int):
    """mapInArrow function: (id, v) rows of one partition to packed matrices of one dimension each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[int, tuple[list, list]] = {}

        def out(dim: int) -> pa.RecordBatch:
            nonlocal number
            ids, vectors = held.pop(dim)
            number += 1
            return pa.RecordBatch.from_pydict({"number": [number - 1], "dim": pa.array([dim], pa.int32()), "ids": [np.array(ids, np.int64).tobytes()], "matrix": [np.concatenate(vectors).astype(np.int64).tobytes()]})

        for batch in batches:
            values = batch.column("v")
            offsets, flat = values.offsets.to_numpy(), values.values.to_numpy(zero_copy_only=False)
            for i, key in enumerate(batch.column("id").to_pylist()):
                vector = flat[offsets[i] : offsets[i + 1]]
                ids, vectors = held.setdefault(len(vector), ([], []))
                ids.append(key)
                vectors.append(vector)
                if len(ids) == rows:
                    yield out(len(vector))
        for dim in list(held):
            yield out(dim)

    return pack


def _ids(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.int64)


def _matrix(blob: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(blob, np.int64).reshape(-1, dim)


def _part(matrix: np.ndarray, j: int, lists: int) -> np.ndarray:
    return matrix[:, matrix.shape[1] * j // lists : matrix.shape[1] * (j + 1) // lists]


def _product(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """x @ q.T, exactly; by doubles where no sum can leave their whole numbers."""
    if x.size and q.size and float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] < 2**53:
        return (x.astype(np.float64) @ q.astype(np.float64).T).astype(np.int64)
    return x @ q.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by id."""
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "id", vector_col: str = "v", lists: int = LISTS, chunk: int = CHUNK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id long, rank int, id long, score long): each query's k rows of the highest inner product, ties by smaller id.

    Both tables hold an id and an array of longs whose inner products must fit a long. Rows with a null id or a null or empty
    vector take no part, nor do vectors of another length than the query's; a row with the query's own id is not its candidate. Queries
    with equal ids are answered once for each; candidates with equal ids count each for itself. Fewer candidates than k: all.
    """
    of = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<bigint>").alias("v")).filter("id is not null and v is not null and size(v) > 0")
    n_queries = of(queries).count()
    packed = "number long, dim int, ids binary, matrix binary"
    chunks = durable(of(vectors).mapInArrow(_pack(chunk), packed))
    blocks = durable(of(queries).repartition(max(1, math.ceil(n_queries / query_block))).mapInArrow(_pack(query_block), packed))
    sizes = blocks.agg(F.sum(F.length("matrix") + F.length("ids")).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    asked = blocks.select(F.col("number").alias("block"), "dim", F.col("ids").alias("q_ids"), F.col("matrix").alias("q"))

    def meet(rows: DataFrame, asked: DataFrame) -> DataFrame:
        """Every packed row with every query block of its dimension."""
        if (sizes["bytes"] or 0) <= BROADCAST_BYTES:
            return rows.join(F.broadcast(asked), "dim")
        parts = 256
        rows = rows.withColumn("part", F.pmod(F.xxhash64("number"), F.lit(parts))).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(sizes["n"] - 1))))
        asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).withColumn("turn", F.dense_rank().over(Window.partitionBy("part").orderBy("block")) - 1)
        return rows.join(asked, ["dim", "part", "turn"]).drop("part", "turn")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, x, q_ids, q = _ids(r["ids"]), _matrix(r["matrix"], r["dim"]), _ids(r["q_ids"]), _matrix(r["q"], r["dim"])
                for j in range(lists):
                    scores, out = _product(_part(x, j, lists), _part(q, j, lists)), []
                    for c, query in enumerate(q_ids.tolist()):
                        other = np.flatnonzero(ids != query)
                        out += [(r["block"], c, j, int(ids[i]), int(scores[i, c])) for i in other[_best(scores[other, c], ids[other], k)]]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["block", "nth", "list", "id", "partial"])

    local = meet(chunks, asked).mapInArrow(partial, "block long, nth int, list int, id long, partial long")
    by_list = Window.partitionBy("block", "nth", "list").orderBy(F.desc("partial"), "id")
    leaders = local.withColumn("r", F.row_number().over(by_list)).filter(F.col("r") <= k).select("block", "nth", "id").distinct()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q = _matrix(r["matrix"], r["dim"])
                yield pa.RecordBatch.from_arrays([pa.array([r["number"]] * len(q), pa.int64()), pa.array(range(len(q)), pa.int32()), pa.array(q.tolist(), pa.list_(pa.int64()))], names=["block", "nth", "q"])

    dot = F.aggregate(F.zip_with("v", "q", lambda x, y: x * y), F.lit(0).cast("bigint"), lambda s, x: s + x)
    single = of(vectors).groupBy("id").agg(F.first("v").alias("v"))
    resolved = leaders.join(single, "id").join(blocks.mapInArrow(spread, "block long, nth int, q array<bigint>"), ["block", "nth"]).filter(F.size("v") == F.size("q")).select("block", "nth", dot.alias("score"))
    bound = resolved.withColumn("r", F.row_number().over(Window.partitionBy("block", "nth").orderBy(F.desc("score")))).filter(F.col("r") == k).select("block", "nth", F.col("score").alias("bound"))
    cutoffs = bound.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("nth", "bound"))).alias("bounds"))
    cut = asked.join(cutoffs, "block", "left")

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phases 2 and 3 of a chunk for a query block: what any list sends, then its exact scores."""
        for batch in batches:
            for r in batch.to_pylist():
                ids, x, q_ids, q = _ids(r["ids"]), _matrix(r["matrix"], r["dim"]), _ids(r["q_ids"]), _matrix(r["q"], r["dim"])
                bounds = {b["nth"]: b["bound"] for b in r["bounds"] or ()}
                sent = np.zeros((len(ids), len(q_ids)), dtype=bool)
                least = np.array([bounds.get(c, 0) for c in range(len(q_ids))])
                free = np.array([c not in bounds for c in range(len(q_ids))])  # fewer than k candidates: all are sent
                for j in range(lists):
                    sent |= _product(_part(x, j, lists), _part(q, j, lists)) * lists >= least
                sent = (sent | free) & (ids[:, None] != q_ids[None, :])
                yield pa.RecordBatch.from_pydict({"number": [r["number"]], "block": [r["block"]], "sent": [np.packbits(sent).tobytes()]})

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, x, q_ids, q = _ids(r["ids"]), _matrix(r["matrix"], r["dim"]), _ids(r["q_ids"]), _matrix(r["q"], r["dim"])
                sent = np.unpackbits(np.frombuffer(r["sent"], np.uint8), count=len(ids) * len(q_ids)).reshape(len(ids), -1).astype(bool)
                out = []
                for c, query in enumerate(q_ids.tolist()):
                    rows = np.flatnonzero(sent[:, c])
                    scores = _product(x[rows], q[c : c + 1])[:, 0] if len(rows) else np.zeros(0, np.int64)
                    out += [(r["block"], c, query, int(ids[rows[i]]), int(scores[i])) for i in _best(scores, ids[rows], k)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["block", "nth", "query_id", "id", "score"])

    gathered = meet(chunks, cut).mapInArrow(reach, "number long, block long, sent binary")
    exact = gathered.join(chunks, "number").join(asked.drop("dim"), "block").mapInArrow(resolve, "block long, nth int, query_id long, id long, score long")
    ranked = exact.withColumn("rank", F.row_number().over(Window.partitionBy("block", "nth").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
