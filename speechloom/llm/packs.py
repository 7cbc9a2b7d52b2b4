"""Packed exchange of documents and fingerprints.

A pack is some MB of documents, compressed, with a number. Every pack sends the sorted distinct fingerprints of its
windows to hash buckets as delta-coded runs of a few bytes a fingerprint; a bucket answers each pack in the order sent.
One fingerprint reaches its bucket at most once a pack however often it occurs, so a hot word, passage or group of copies
makes no large group; buckets and packs both have a set size, so their number and not their size grows with the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fingerprints as fp
from .shared import durable

PACK_BYTES = 6 << 20
#: Bytes of text whose fingerprints one bucket gets.
BUCKET_BYTES = 12 << 20


def pack_documents(df: DataFrame, columns: list[str], text_col: str, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """Packs (pack long, n_docs long, n_bytes long, blob binary) of the given columns, checkpointed so that all later uses
    see the same packs. A text longer than a pack has one of its own; null texts count as empty."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as w:
                w.write_table(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_pydict({"pack": pa.array([number], pa.int64()), "n_docs": pa.array([sum(b.num_rows for b in held)], pa.int64()), "n_bytes": pa.array([size], pa.int64()), "blob": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = 0
            while at < batch.num_rows:
                to = at + max(1 if not held else 0, int(np.searchsorted(np.cumsum(lengths[at:]) + size, pack_bytes, side="right")))
                if to > at:
                    held.append(batch.slice(at, to - at))
                    size += int(lengths[at:to].sum())
                at = to
                if at < batch.num_rows:
                    yield out()
                    number, held, size = number + 1, [], 0
        if held:
            yield out()

    return durable(df.select(*columns).mapInArrow(pack, "pack long, n_docs long, n_bytes long, blob binary"))


def unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def bucket_count(packs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """As many buckets as the size of all packs asks for."""
    total = packs.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    return max(1, math.ceil(total / bucket_bytes))


def bounds(n_buckets: int, bits: int) -> np.ndarray:
    """The first fingerprint of each bucket but the first."""
    return np.array([-(-(i << bits) // n_buckets) for i in range(1, n_buckets)], dtype=np.uint64)


def slices(sorted_hashes: np.ndarray, n_buckets: int, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of each bucket that has any."""
    cut = [0, *np.searchsorted(sorted_hashes, bounds(n_buckets, bits)).tolist(), len(sorted_hashes)]
    return [(b, cut[b], cut[b + 1]) for b in range(n_buckets) if cut[b + 1] > cut[b]]


def encode(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    values = np.ascontiguousarray(values)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def decode(blob: bytes, dtype=np.uint64) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def encode_sorted(values: np.ndarray) -> bytes:
    return encode(np.diff(values, prepend=np.uint64(0)))


def decode_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(decode(blob), dtype=np.uint64)


def member(values: np.ndarray, of_sorted: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(of_sorted):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(of_sorted, values)
    at[at == len(of_sorted)] = 0
    return of_sorted[at] == values


class Words:
    """The words of a pack's documents: their spans, fingerprints and documents."""

    def __init__(self, texts: pa.ChunkedArray):
        self.data, self.offsets = fp.text_buffers(texts)
        self.starts, self.ends, self.firsts = fp.word_spans(self.data, self.offsets)
        self.hashes = fp.word_hashes(self.data, self.starts, self.ends)

    def windows(self, n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Each window's first word, and its fingerprint."""
        ok = np.flatnonzero(fp.inside(self.firsts, n))
        return ok, fp.windows(self.hashes, n, salt)[ok]


def empty_table(schema: T.StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema).empty_table()
