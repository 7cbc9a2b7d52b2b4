"""Vectorised word and window fingerprints over Arrow text columns.

A word is a run of bytes other than space and \x09-\x0D, so words never cross documents. A word's 64-bit fingerprint mixes
its eight-byte lanes one after the other (BLAKE2b for words of over 64 bytes); a window's is put together from those of its
halves, each step mixed again, so that no structure of the text cancels out. Another seed gives an independent fingerprint.
Nothing loops over words in Python but for the very long ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LANES = 8
#: Words that are worked on at once.
_BLOCK = 1 << 16
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit (the public splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) and the offsets of each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]  # a slice shares its parent's buffer


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the number of words before each document. ``between`` tells which bytes are not
    of a word."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    inside = np.zeros(hi - lo + 2, dtype=bool)
    np.logical_not(between[data[lo:hi]], out=inside[1:-1])
    edge = np.zeros(hi - lo + 2, dtype=bool)  # a document begins here
    edge[offsets - lo + 1] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[1:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[2:])) + 1
    return starts + lo, ends + lo, np.searchsorted(starts, offsets - lo)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit fingerprint of each word; those of different seeds are independent. Worked out in blocks of words, so that little
    more memory is needed than for the result."""
    out = np.empty(len(starts), dtype=np.uint64)
    for at in range(0, len(starts), _BLOCK):
        first, last = int(starts[at]), int(ends[min(at + _BLOCK, len(ends)) - 1])
        out[at : at + _BLOCK] = _block_hashes(data[first:last], starts[at : at + _BLOCK] - first, ends[at : at + _BLOCK] - first, seed)
    return out


def _block_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[:-8] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each byte on
    size = (ends - starts).astype(np.int64)
    out = mix(size.astype(np.uint64) * _STEP + np.uint64(seed))
    left, at, active = size, starts, None
    for _ in range(_LANES):
        lane = lanes[at] & (np.uint64(2**64 - 1) >> (np.maximum(8 - left, 0) * 8).astype(np.uint64))
        if active is None:
            out = mix(out ^ lane)
            active = np.flatnonzero(size > 8)
            left, at = size[active] - 8, starts[active] + 8
        else:
            out[active] = mix(out[active] * _STEP ^ lane)
            on = left > 8
            active, left, at = active[on], left[on] - 8, at[on] + 8
        if not len(active):
            return out
    for i in active.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, salt=seed.to_bytes(16, "little")).digest(), "little")
    return out


def windows(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """The fingerprint of each n consecutive words, document borders ignored (see inside())."""
    out = np.empty(max(0, len(hashes) - n + 1), dtype=np.uint64)
    for at in range(0, len(out), _BLOCK):
        out[at : at + _BLOCK] = _block_windows(hashes[at : at + _BLOCK + n - 1], n, salt)
    return out


def _block_windows(hashes: np.ndarray, n: int, salt: int) -> np.ndarray:
    count = len(hashes) - n + 1
    out, power, have = None, hashes, 1  # of the first `done` words of each window; of `have` words from each word on
    done = 0
    while True:
        if n & have:
            part = power[done : done + count]
            out = part if out is None else mix(out * _STEP + part)
            done += have
        if done == n:
            return mix(out ^ np.uint64(salt + n))
        power = mix(power[:-have] * _STEP + power[have:])
        have *= 2


def inside(firsts: np.ndarray, n: int) -> np.ndarray:
    """For each start of n words: whether they lie in one document; firsts as by word_spans()."""
    total = int(firsts[-1])
    if total < n:
        return np.zeros(0, dtype=bool)
    last = np.repeat(firsts[1:], np.diff(firsts))
    return np.arange(total - n + 1) + n <= last[: total - n + 1]


def within_document(firsts: np.ndarray) -> np.ndarray:
    """Each word's number in its document."""
    return np.arange(int(firsts[-1])) - np.repeat(firsts[:-1], np.diff(firsts))


def release_unused() -> None:
    """Gives back what Arrow's pool and the process's heap (Python's and numpy's) hold and don't use: a worker that is used again keeps it otherwise."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def slices_of_bytes(batch: pa.RecordBatch, column: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about size bytes of text. Memory that earlier tasks of this worker left unused goes back first."""
    release_unused()
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cut = np.flatnonzero(np.diff(np.cumsum(lengths) // size)) + 1
    for i, j in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
        if j > i:
            yield batch.slice(i, j - i)
