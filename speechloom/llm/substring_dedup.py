"""Exact substring de-duplication by fixed-block anchors.

Every document's non-overlapping blocks of (window + 1) // 2 words are the index, and every rolling block-long window of
every document is a probe: a repeated window of ``window`` words holds a whole reference block of either of its places, so
index and probe meet in the same hash bucket. An anchor hit is then extended: all window-long contexts around it are
compared with those around the other hits, again by hash bucket, and the union of the contexts that occur twice is just the
part of the maximal exact repeats of at least ``window`` words. No pairs of occurrences are ever made, so a passage that a
third of all documents share costs as much as any other.

Anchors are compared by 48 bits, which only nominates; contexts are decided by two independent 64-bit fingerprints: among
10**13 windows the chance that any two different ones agree in both is below 10**-12.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import fingerprints as fp
from .packs import PACK_BYTES, Words, bucket_count, decode, decode_sorted, encode, encode_sorted, member, pack_documents, slices, unpack

_RUN = "bucket int, pack long, hashes binary, seconds binary, flags binary"
_BLOCK, _AGAIN = np.uint8(1), np.uint8(2)

_SECOND = 0xD6E8FEB86659FD93

#: Fingerprints: one array, or a second one beside it.
Keys = tuple[np.ndarray, ...]


def _distinct(keys: Keys, flags: np.ndarray) -> tuple[Keys, np.ndarray]:
    """Sorted distinct fingerprints; their flags together, with _AGAIN where one occurs twice."""
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    keys, flags = tuple(k[order] for k in keys), flags[order]
    if not len(flags):
        return keys, flags
    first = np.flatnonzero(np.any([np.diff(k, prepend=~k[:1]) != 0 for k in keys], axis=0))
    both = np.bitwise_or.reduceat(flags, first)
    both |= np.where(np.diff(first, append=len(flags)) > 1, _AGAIN, np.uint8(0))
    return tuple(k[first] for k in keys), both


def _held(keys: Keys, of: Keys) -> np.ndarray:
    """Which of the fingerprints are among sorted distinct ones."""
    if len(keys) == 1:
        return member(keys[0], of[0])
    out = np.zeros(len(keys[0]), dtype=bool)
    at, left = np.searchsorted(of[0], keys[0]), np.arange(len(keys[0]))
    while len(left):  # more than once only where different windows agree in the first
        left = left[at[left] < len(of[0])]
        left = left[of[0][at[left]] == keys[0][left]]
        same = of[1][at[left]] == keys[1][left]
        out[left[same]] = True
        left = left[~same]
        at[left] += 1
    return out


def _runs(pack: int, keys: Keys, flags: np.ndarray, n_buckets: int, bits: int) -> pa.Table:
    keys, flags = _distinct(keys, flags)
    cut = slices(keys[0], n_buckets, bits)
    return pa.table(
        {
            "bucket": pa.array([b for b, _, _ in cut], pa.int32()),
            "pack": pa.array([pack] * len(cut), pa.int64()),
            "hashes": pa.array([encode_sorted(keys[0][i:j]) for _, i, j in cut], pa.binary()),
            "seconds": pa.array([encode(keys[1][i:j]) if len(keys) > 1 else None for _, i, j in cut], pa.binary()),
            "flags": pa.array([encode(flags[i:j]) for _, i, j in cut], pa.binary()),
        }
    )


def _sent(runs: pa.Table) -> list[Keys]:
    both = zip(runs["hashes"].to_pylist(), runs["seconds"].to_pylist(), strict=True)
    return [(decode_sorted(x),) if y is None else (decode_sorted(x), decode(y)) for x, y in both]


def _together(keys: list[Keys]) -> Keys:
    return tuple(np.concatenate(k) for k in zip(*keys, strict=True))


def _answers(runs: pa.Table, wanted: int) -> pa.Table:
    """For each pack its fingerprints that have all wanted flags when all packs are put together."""
    sent = _sent(runs)
    keys, flags = _distinct(_together(sent), np.concatenate([decode(x, np.uint8) for x in runs["flags"].to_pylist()]))
    hot = tuple(k[(flags & np.uint8(wanted)) == wanted] for k in keys)
    found = [(p, tuple(k[held] for k in x)) for p, x in zip(runs["pack"].to_pylist(), sent, strict=True) if (held := _held(x, hot)).any()]
    return pa.table(
        {
            "pack": pa.array([p for p, _ in found], pa.int64()),
            "hashes": pa.array([encode_sorted(x[0]) for _, x in found], pa.binary()),
            "seconds": pa.array([encode(x[1]) if len(x) > 1 else None for _, x in found], pa.binary()),
        }
    )


def _answered(hot: pa.Table, n: int) -> Keys:
    """A pack's answers of all buckets, sorted."""
    if not hot.num_rows:
        return (np.zeros(0, np.uint64),) * n
    return _distinct(keys := _together(_sent(hot)), np.zeros(len(keys[0]), np.uint8))[0]


def _contexts(words: Words, window: int) -> tuple[np.ndarray, Keys]:
    """Each window's first word, and its two fingerprints: the second over a second fingerprint of the words' bytes."""
    at, first = words.windows(window)
    return at, (first, fp.windows(fp.word_hashes(words.data, words.starts, words.ends, _SECOND), window)[at])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """(id, n_words long, n_removed long, kept_text string): each row's words but those that lie in a window of ``window``
    words whose word sequence also starts anywhere else, in the same document too; kept words joined by one space.

    Windows are judged on the input. Null and empty texts have no words and kept_text ''. Rows with the same id, a null id
    or the same text count as documents of their own; other columns are ignored. An empty table gives an empty table.
    """
    block = (window + 1) // 2
    packs = pack_documents(docs, [id_col, text_col], text_col, pack_bytes)
    n_buckets = bucket_count(packs)

    def probe(batches):
        for batch in batches:
            for pack, blob in zip(batch.column("pack").to_pylist(), batch.column("blob"), strict=True):
                words = Words(unpack(blob.as_buffer())[text_col])
                at, hashes = words.windows(block)
                number = at - words.firsts[np.searchsorted(words.firsts, at, side="right") - 1]
                yield from _runs(pack, (hashes >> np.uint64(16),), np.where(number % block == 0, _BLOCK, np.uint8(0)), n_buckets, 48).to_batches()

    def anchors(runs: pa.Table) -> pa.Table:
        return _answers(runs, int(_BLOCK | _AGAIN))

    def extend(packed: pa.Table, hot: pa.Table) -> pa.Table:
        (anchor,), pack = _answered(hot, 1), packed["pack"][0].as_py()
        words = Words(unpack(packed["blob"][0].as_buffer())[text_col])
        hit = np.zeros(len(words.hashes) + 1, dtype=np.int64)
        at, hashes = words.windows(block)
        hit[at + 1] = member(hashes >> np.uint64(16), anchor)
        hit = np.cumsum(hit)
        at, keys = _contexts(words, window)
        near = hit[at + window - block + 1] > hit[at]
        return _runs(pack, tuple(k[near] for k in keys), np.zeros(int(near.sum()), np.uint8), n_buckets, 64)

    def repeats(runs: pa.Table) -> pa.Table:
        return _answers(runs, int(_AGAIN))

    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def cut(packed: pa.Table, found: pa.Table) -> pa.Table:
        rows, again = unpack(packed["blob"][0].as_buffer()), _answered(found, 2)
        words = Words(rows[text_col])
        gone = np.zeros(len(words.hashes) + 1, dtype=np.int64)
        at, keys = _contexts(words, window)
        at = at[_held(keys, again)]
        np.add.at(gone, at, 1)
        np.add.at(gone, at + window, -1)
        kept = np.cumsum(gone)[:-1] == 0
        total = np.diff(words.firsts)
        removed = total - np.diff(np.concatenate([[0], np.cumsum(kept)])[words.firsts])
        raw = words.data.tobytes()
        texts = []
        for d in range(rows.num_rows):
            i, j = words.firsts[d], words.firsts[d + 1]
            own = raw[words.offsets[d] : words.offsets[d + 1]].split()
            texts.append(b" ".join(own if not removed[d] else [w for w, k in zip(own, kept[i:j].tolist(), strict=True) if k]))
        return pa.table({id_col: rows[id_col], "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(texts, pa.binary()).cast(pa.string())})

    def answered(runs: DataFrame, f) -> DataFrame:
        return runs.groupBy("bucket").applyInArrow(f, "pack long, hashes binary, seconds binary")

    blobs = packs.select("pack", "blob")
    hot = answered(blobs.mapInArrow(probe, _RUN), anchors)
    contexts = blobs.groupBy("pack").cogroup(hot.groupBy("pack")).applyInArrow(extend, _RUN)
    found = answered(contexts, repeats)
    return blobs.groupBy("pack").cogroup(found.groupBy("pack")).applyInArrow(cut, schema)
