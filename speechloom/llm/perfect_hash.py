"""Minimal perfect hashes of (lang, term) keys, in shards of about SHARD_TERMS keys, with their keys stored.

A shard's keys are dealt to a bit array by their hash; a place that just one key got is that key's, and the others go on to the
next, smaller array. A key's slot is the number of taken places before its own. As a key that is not in the shard may hit a
place too, the slot's stored key decides. The few keys that no array could place (two with one hash) are listed by name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import fingerprints as fp

#: Keys of a shard, about.
SHARD_TERMS = 4096
LEVELS, ROOM = 24, 2
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LANG_SEED = 1

#: Columns of a shard's row: sizes and bits of its arrays, keys in the order of their slots, the last ``spare`` of them unplaced.
SHARD_SCHEMA = "shard int, sizes array<int>, bits binary, langs array<string>, terms array<string>, spare int, n_bytes long"


def _string_buffers(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = fp.text_buffers(values)
    return data, offsets[:-1], offsets[1:]


def key_hashes(lang_of: np.ndarray, langs: pa.Array, terms: pa.Array) -> np.ndarray:
    """The hash of each key: a language, given by its place in ``langs``, and a term."""
    return fp.mix(fp.word_hashes(*_string_buffers(terms)) * _STEP ^ fp.word_hashes(*_string_buffers(langs), seed=_LANG_SEED)[lang_of])


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)


def _place(hashes: np.ndarray, level: int, sizes: np.ndarray) -> np.ndarray:
    return (fp.mix(hashes + np.uint64(level * int(_STEP) % 2**64)) % sizes.astype(np.uint64)).astype(np.int64)


def build_shard(shard: int, langs: pa.Array, terms: pa.Array) -> pa.Table:
    """The row of SHARD_SCHEMA of a shard's distinct keys (plain string arrays)."""
    coded = langs.dictionary_encode()
    hashes = key_hashes(coded.indices.to_numpy(), coded.dictionary, terms)
    left, sizes, bits, order = np.arange(len(hashes)), [], [], []
    for level in range(LEVELS):
        if not len(left):
            break
        size = max(8, ROOM * len(left))
        at = _place(hashes[left], level, np.array(size))
        alone = np.bincount(at, minlength=size) == 1
        placed = alone[at]
        order.append(left[placed][np.argsort(at[placed])])
        sizes.append(size)
        bits.append(alone)
        left = left[~placed]
    slots = np.concatenate([*order, left]).astype(np.int64) if len(hashes) else np.zeros(0, np.int64)
    packed = np.packbits(np.concatenate(bits)).tobytes() if bits else b""
    row = {"shard": [shard], "sizes": [sizes], "bits": [packed], "langs": [langs.take(pa.array(slots)).to_pylist()], "terms": [terms.take(pa.array(slots)).to_pylist()], "spare": [len(left)]}
    n_bytes = len(packed) + sum(len(x) + 8 for x in row["terms"][0]) + sum(len(x) + 8 for x in row["langs"][0])
    kinds = {"shard": pa.int32(), "sizes": pa.list_(pa.int32()), "bits": pa.binary(), "langs": pa.list_(pa.string()), "terms": pa.list_(pa.string()), "spare": pa.int32()}
    return pa.table({**{c: pa.array(v, kinds[c]) for c, v in row.items()}, "n_bytes": pa.array([n_bytes], pa.int64())})


class Shards:
    """Some shards put together: looks keys of any of them up at once."""

    def __init__(self, rows: pa.Table, shards: int):
        """rows: of SHARD_SCHEMA; shards: how many there are in all."""
        self.shards = shards
        numbers = rows["shard"].to_pylist()
        sizes, bits = rows["sizes"].to_pylist(), rows["bits"].to_pylist()
        self.levels = max((len(s) for s in sizes), default=0)
        self.row_of = np.full(shards, -1, dtype=np.int32)
        self.row_of[numbers] = np.arange(len(numbers))
        self.sizes = np.ones((len(numbers), max(1, self.levels)), dtype=np.int64)
        self.starts = np.full((len(numbers), max(1, self.levels)), -1, dtype=np.int64)  # -1: no such array
        taken, total = [], 0
        for i, (own, packed) in enumerate(zip(sizes, bits, strict=True)):
            for level, size in enumerate(own):
                self.sizes[i, level], self.starts[i, level] = size, total
                total += size
            taken.append(np.unpackbits(np.frombuffer(packed, np.uint8))[: sum(own)])
        self.taken = np.concatenate([*taken, np.zeros(1, np.uint8)]).astype(bool)
        terms, langs = rows["terms"].combine_chunks(), rows["langs"].combine_chunks()
        per_row = np.array([len(x) for x in rows["terms"].to_pylist()], dtype=np.int64)
        spare = np.array(rows["spare"].to_pylist(), dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(per_row)])
        shift = np.concatenate([[0], np.cumsum(spare)])[:-1]  # unplaced keys of the rows before
        level_row = np.repeat(np.arange(len(numbers)), [sum(s) for s in sizes]) if numbers else np.zeros(0, np.int64)
        self.slot = np.cumsum(self.taken)[:-1] - 1 + shift[level_row]
        self.terms = terms.flatten().cast(pa.large_string()) if len(terms) else pa.array([], pa.large_string())
        coded = (langs.flatten() if len(langs) else pa.array([], pa.string())).dictionary_encode()
        self.langs, self.lang_of = coded.dictionary, coded.indices.to_numpy()
        self.unplaced = {}
        for i in np.flatnonzero(spare).tolist():
            for at in range(int(self.first[i + 1] - spare[i]), int(self.first[i + 1])):
                self.unplaced[self.langs[self.lang_of[at]].as_py(), self.terms[at].as_py()] = at
        self.numbers = np.array(numbers, dtype=np.int32)

    def find(self, lang_of: np.ndarray, langs: pa.Array, terms: pa.Array) -> np.ndarray:
        """The slot of each key, -1 where no shard here holds it. Slots count through all shards; see ``first``."""
        hashes = key_hashes(lang_of, langs, terms)
        row = self.row_of[shard_of(hashes, self.shards)]
        out = np.full(len(hashes), -1, dtype=np.int64)
        left = np.flatnonzero(row >= 0)
        for level in range(self.levels):
            start = self.starts[row[left], level]
            left, start = left[start >= 0], start[start >= 0]
            at = start + _place(hashes[left], level, self.sizes[row[left], level])
            hit = self.taken[at]
            out[left[hit]] = self.slot[at[hit]]
            left = left[~hit]
        known = pc.index_in(langs.cast(self.langs.type), self.langs).fill_null(-1).to_numpy(zero_copy_only=False)
        some = np.flatnonzero(out >= 0)
        same = pc.equal(self.terms.take(pa.array(out[some])), terms.take(pa.array(some)).cast(pa.large_string())).to_numpy(zero_copy_only=False)
        out[some[~(same & (self.lang_of[out[some]] == known[lang_of[some]]))]] = -1
        if self.unplaced:
            for i in np.flatnonzero((out < 0) & (row >= 0)).tolist():
                out[i] = self.unplaced.get((langs[int(lang_of[i])].as_py(), terms[i].as_py()), -1)
        return out
