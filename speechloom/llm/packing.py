"""Harmonic packing of token sequences.

Class k holds lengths in (C / (k + 1), C / k] of the capacity C, and a bin of class k is made of exactly k documents of its
class. What a document has beyond a multiple of C is its length here: full sequences are cut off first. The gap that the k
documents of a bin leave is closed with a piece of a document that has to be cut anyway, one longer than C, or of the next
document of any length once too many bins wait. Every worker fills bins of its own, so no worker waits for another and
nothing is shuffled. What a worker is left with in the end, its unfinished bins of all classes, is laid end to end in full
sequences, and the rest of that in sequences whose lengths are powers of two. So no sequence is padded.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import fingerprints as fp

#: The pre-tokeniser's pattern of byte-level BPE files, as their format defines it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Runs of white space from this length on overflow the stack of the rank encoder's pattern matching.
LONG_RUN = re.compile(r"(?<!\s)\s{50000}")
#: Bins of a worker that wait for a piece to close their gap, at most (capacity ids each).
WAITING = 64
#: Pieces of a batch of results, about 2 MB of ids.
PIECES = 512


def byte_level_encoding(path: str) -> Callable[[str], list[int]]:
    """The encoder of a byte-level BPE file: text -> the ids that the tokenizers library gives without adding special tokens.

    Its vocabulary lists merges in the order of their ids, so a rank encoder over the same bytes and ids gives the same ids
    as the library itself, several times faster. Added tokens cut the text before anything else does, as in the library.
    Texts with a run of white space too long for the rank encoder go to the library.
    """
    import tiktoken
    from tokenizers import Tokenizer

    file = json.loads(Path(path).read_text(encoding="utf-8"))
    vocabulary, added = file["model"]["vocab"], {t["content"]: t["id"] for t in file["added_tokens"]}
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in file["added_tokens"]):
        raise ValueError("added tokens that take in white space or need word bounds are not supported")
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t not in added and all(c in letters for c in t)}
    fast = tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
    library: list[Tokenizer] = []

    def encode(text: str) -> list[int]:
        if len(text) < 50000 or not LONG_RUN.search(text):
            return fast.encode(text, allowed_special="all")
        if not library:
            library.append(Tokenizer.from_file(path))
        return library[0].encode(text, add_special_tokens=False).ids

    return encode


class Bins:
    """The bins of one worker; pieces are (row, start, length), a row being whatever the caller knows a document by."""

    def __init__(self, capacity: int):
        self.capacity, self.sequence = capacity, 0
        self.open: dict[int, list[tuple]] = {}
        self.waiting: list[list[tuple]] = []
        self.done: list[tuple] = []  # (row, start, length, sequence, offset)

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for row, start, length in pieces:
            self.done.append((row, start, length, self.sequence, offset))
            offset += length
        self.sequence += 1

    def add(self, row, total: int) -> None:
        """Places a document of ``total`` ids."""
        start = 0
        while self.waiting and start < total and (total - start > self.capacity or len(self.waiting) > WAITING):
            pieces = self.waiting.pop()
            room = self.capacity - sum(n for _, _, n in pieces)
            length = min(room, total - start)
            pieces.append((row, start, length))
            start += length
            if length == room:
                self._close(pieces)
            else:
                self.waiting.append(pieces)
        while total - start >= self.capacity:
            self._close([(row, start, self.capacity)])
            start += self.capacity
        if start < total:
            k = self.capacity // (total - start)
            pieces = self.open.setdefault(k, [])
            pieces.append((row, start, total - start))
            if len(pieces) == k:
                del self.open[k]
                if sum(n for _, _, n in pieces) == self.capacity:
                    self._close(pieces)
                else:
                    self.waiting.append(pieces)

    def finish(self) -> None:
        """Lays all that is left end to end; the last part goes to sequences of the powers of two that make up its length."""
        left = [p for pieces in [*self.waiting, *self.open.values()] for p in pieces]
        self.waiting, self.open = [], {}
        rest = sum(n for _, _, n in left)
        made: list[tuple] = []
        room = 0
        for row, start, length in left:
            while length:
                if not room:
                    room = self.capacity if rest >= self.capacity else 1 << (rest.bit_length() - 1)
                n = min(room, length)
                made.append((row, start, n))
                start, length, room, rest = start + n, length - n, room - n, rest - n
                if not room:
                    self._close(made)
                    made = []


def harmonic_pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: id, start long and length long (in the document's ids), ids binary (little-endian unsigned 32-bit),
    doc_tokens long, sequence_id long, offset long (in the sequence, gapless from 0).

    Each row's text (null: empty) becomes its token ids and then end_id, so an empty text is one id. Each id lies in one
    piece; every sequence is full or as long as a power of two. Rows with equal or null ids are packed as any others; an
    empty table gives no pieces. Other columns, whatever their names, are ignored. sequence_id is the worker's partition times 2**32 plus its sequence number. A worker holds
    the ids of its unfinished bins: one bin of each class and WAITING others, a few MB.
    """
    if capacity & (capacity - 1) or capacity < 1:
        raise ValueError("capacity must be a power of two")
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            *(T.StructField(c, T.LongType()) for c in ("start", "length")),
            T.StructField("ids", T.BinaryType()),
            *(T.StructField(c, T.LongType()) for c in ("doc_tokens", "sequence_id", "offset")),
        ]
    )
    names = [f.name for f in schema]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins = byte_level_encoding(tokenizer_path), Bins(capacity)
        bins.sequence = TaskContext.get().partitionId() << 32
        id_type = None

        def flush() -> pa.RecordBatch:
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            rows = [(key, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, sequence, offset) for (key, ids), start, length, sequence, offset in bins.done]
            bins.done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            fp.release_unused()
            id_type = batch.column(id_col).type
            for key, text in zip(batch.column(id_col).to_pylist(), batch.column(text_col), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4").tobytes()
                bins.add((key, ids), len(ids) // 4)
                if len(bins.done) >= PIECES:
                    yield flush()
            if bins.done:
                yield flush()
        bins.finish()
        if bins.done:
            yield flush()

    return docs.select(id_col, text_col).mapInArrow(pack, schema)
