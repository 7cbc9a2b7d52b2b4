"""Divergence of the sources of each language, by a recount through minimal perfect hashes.

The first pass counts in how many documents of a language each term is, exactly, and keeps those that are frequent enough.
Their keys (lang, term) get slots by sharded minimal perfect hashes with stored keys. These are broadcast in rounds of a set
size; in each, the second pass reads the documents again, turns every term into its slot and counts slots, without sending a
string. Counts leave each part of the input in a fixed number of bundles of shards, are added up for each group and bundle, and
only then cut by shard, so that the rows made grow with the input and not with input times shards. A shard's counts meet its keys and its groups' totals in one sorted stream, where they are added to a dense array of
slots for each group, from which the divergences follow. A shard has a set number of keys, so a task holds groups x SHARD_TERMS
numbers however large the input is; a hot source or language is spread over all tasks that read it and all shards.

Terms are runs of ASCII letters and characters beyond ASCII; only A to Z are lower-cased. All arithmetic is in whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import fingerprints as fp
from .perfect_hash import SHARD_SCHEMA, SHARD_TERMS, Shards, build_shard, key_hashes, shard_of
from .shared import durable

LEAST_DOCUMENTS, SCALE, TOP = 3, 1_000_000_000, 200
#: Bytes of text that are worked on at once.
SLICE_BYTES = 6 << 20
#: Bytes of hashes and stored keys that are broadcast at once: a round.
ROUND_BYTES = 48 << 20
#: Bundles in which the shards' counts leave a part of the input, and shards of a bundle and counts of a row at most.
BUNDLES, BUNDLE_SHARDS, ROW_COUNTS = 32, 1024, 4096

_BETWEEN = np.ones(256, dtype=bool)
_BETWEEN[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Terms:
    """The terms of some texts: ``codes`` into the distinct ``terms``, and each one's document."""

    def __init__(self, texts: pa.Array):
        data, offsets = fp.text_buffers(texts)
        starts, ends, firsts = fp.word_spans(data, offsets, _BETWEEN)
        letters = _LOWER[data[~_BETWEEN[data]]]
        ends_there = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends_there), pa.py_buffer(letters))
        coded = found.dictionary_encode()
        self.terms, self.codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(firsts))


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Parts of a batch of about SLICE_BYTES of text; of a longer text alone, its pieces, cut between terms, each with whether
    it is the last of its text."""
    lengths = np.diff(fp.text_buffers(batch.column("text"))[1])
    at = 0
    while at < batch.num_rows:
        to = at + max(1, int(np.searchsorted(np.cumsum(lengths[at:]), SLICE_BYTES, side="right")))
        part, at = batch.slice(at, to - at), to
        if part.num_rows > 1 or lengths[at - 1] <= SLICE_BYTES:
            yield part, True
            continue
        data, lo = fp.text_buffers(part.column("text"))[0], 0
        while lo < len(data):
            rest = np.flatnonzero(_BETWEEN[data[lo + SLICE_BYTES : lo + 2 * SLICE_BYTES]])
            hi = lo + SLICE_BYTES + int(rest[0]) if len(rest) else min(len(data), lo + 2 * SLICE_BYTES)
            while hi < len(data) and not _BETWEEN[data[hi]]:  # a term of megabytes
                hi += 1
            piece = pa.array([data[lo:hi].tobytes()], pa.large_binary()).cast(pa.large_string())
            yield pa.RecordBatch.from_pydict({"lang": part.column("lang"), "source": part.column("source"), "text": piece}), hi >= len(data)
            lo = hi


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, n): in how many documents of a part of the input a term is."""
    held: list[pa.Array] = []  # terms of the pieces of one text
    for batch in batches:
        for part, last in _slices(batch):
            found = Terms(part.column("text"))
            if held or not last:
                held = [pa.concat_arrays([*held, found.terms]).unique()]
                if last:
                    yield pa.RecordBatch.from_pydict({"lang": pa.array(part.column("lang").to_pylist() * len(held[0]), pa.string()), "term": held[0].cast(pa.string()), "n": pa.array(np.ones(len(held[0]), np.int64))})
                    held = []
                continue
            langs = part.column("lang").dictionary_encode()
            size = max(1, len(found.terms))
            pairs = np.unique(found.doc * size + found.codes)
            keys, n = np.unique(langs.indices.to_numpy()[pairs // size] * size + pairs % size, return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": langs.dictionary.take(pa.array(keys // size)), "term": found.terms.take(pa.array(keys % size)).cast(pa.string()), "n": pa.array(n)})


def frequent_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term) of the terms in at least ``least`` documents of a language."""
    counts = docs.mapInArrow(_document_counts, "lang string, term string, n long")
    return counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("lang", "term")


def hash_shards(kept: DataFrame, shards: int) -> DataFrame:
    """The perfect hashes of distinct (lang, term), a row a shard that has any keys."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column("lang").dictionary_encode()
            hashes = key_hashes(coded.indices.to_numpy(), coded.dictionary, batch.column("term"))
            yield pa.RecordBatch.from_pydict({"shard": pa.array(shard_of(hashes, shards)), "lang": batch.column("lang"), "term": batch.column("term")})

    def build(keys: pa.Table) -> pa.Table:
        return build_shard(keys["shard"][0].as_py(), keys["lang"].combine_chunks(), keys["term"].combine_chunks())

    return kept.mapInArrow(number, "shard int, lang string, term string").groupBy("shard").applyInArrow(build, SHARD_SCHEMA)


_COUNTS = "lang string, source string, shard int, slots binary, counts binary, total long"


def count_slots(docs: DataFrame, tables: pa.Table, shards: int) -> DataFrame:
    """The second pass: for each group and bundle (in the column of shards) of a part of the input, its slots (64-bit: the shard and
    the slot in it) with their counts; with shard -1 each group that occurs and the sum of its counts. ``tables`` are the
    shards of this round."""
    bundle = bundle_size(shards)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, tables.schema) as writer:
        writer.write_table(tables)
    sent = docs.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Shards(pa.ipc.open_stream(sent.value).read_all(), shards)
        for batch in batches:
            for part, _ in _slices(batch):
                yield _counted(part, hashes, bundle)

    return docs.mapInArrow(count, _COUNTS)


def bundle_size(shards: int) -> int:
    return min(BUNDLE_SHARDS, math.ceil(shards / BUNDLES))


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of count_slots, sorted by (shard, lang, source), added up and cut by shard: slots in the shard (32-bit) and 64-bit counts."""

    def added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        slot, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(slot, kind="stable")
        slot, n = slot[order], n[order]
        starts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        return slot[starts], np.add.reduceat(n, starts)

    def rows(key: tuple, held: list) -> pa.RecordBatch:
        slot, n = added(held)
        shard, local = (slot >> np.uint64(32)).astype(np.int32), (slot & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        cuts = [*np.flatnonzero(np.diff(shard, prepend=-1)).tolist(), len(slot)]
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        return pa.RecordBatch.from_pydict({"lang": pa.array([key[1]] * len(spans), pa.string()), "source": pa.array([key[2]] * len(spans), pa.string()), "shard": pa.array(shard[cuts[:-1]]), "slots": pa.array([local[i:j].tobytes() for i, j in spans], pa.binary()), "counts": pa.array([n[i:j].tobytes() for i, j in spans], pa.binary())})

    key, held, size, most = None, [], 0, 0
    for batch in batches:
        for row in batch.to_pylist():
            own = (row["shard"], row["lang"], row["source"])
            if own != key:
                if held:
                    yield rows(key, held)
                key, held, size, most = own, [], 0, 1 << 20
            held.append((np.frombuffer(row["slots"], np.uint64), np.frombuffer(row["counts"], np.uint32).astype(np.int64)))
            size += len(held[-1][0])
            if size > most:
                held = [added(held)]
                size = len(held[0][0])
                most = 2 * size + (1 << 20)
    if held:
        yield rows(key, held)


def _counted(part: pa.RecordBatch, hashes: Shards, bundle: int) -> pa.RecordBatch:
    found = Terms(part.column("text"))
    langs = part.column("lang").dictionary_encode()
    sources = part.column("source").dictionary_encode()
    width = max(1, len(sources.dictionary))
    groups, group_of = np.unique(langs.indices.to_numpy().astype(np.int64) * width + sources.indices.to_numpy(), return_inverse=True)
    size = max(1, len(found.terms))
    keys, n = np.unique(group_of[found.doc] * size + found.codes, return_counts=True)
    slot = hashes.find((groups // width)[keys // size], langs.dictionary, found.terms.take(pa.array(keys % size)))
    keys, n, slot = keys[slot >= 0] // size, n[slot >= 0], slot[slot >= 0]
    row = np.searchsorted(hashes.first, slot, side="right") - 1
    shard = hashes.numbers[row].astype(np.int64)
    place = shard << 32 | slot - hashes.first[row]
    order = np.lexsort((place, keys))
    keys, n, bundles, local = keys[order], n[order].astype(np.uint32), shard[order] // bundle, place[order].astype(np.uint64)
    runs = np.flatnonzero(np.diff(keys, prepend=-1) | np.diff(bundles, prepend=-1))
    inside = np.arange(len(keys)) - np.repeat(runs, np.diff(np.append(runs, len(keys))))
    starts = np.flatnonzero(inside % ROW_COUNTS == 0)
    stops = np.append(starts[1:], len(keys))
    who = np.concatenate([keys[starts], np.arange(len(groups))])
    spans = list(zip(starts.tolist(), stops.tolist(), strict=True))
    totals = np.concatenate([np.add.reduceat(n.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64), np.bincount(keys, weights=n, minlength=len(groups)).astype(np.int64)])
    nothing = [None] * len(groups)
    return pa.RecordBatch.from_pydict(
        {
            "lang": langs.dictionary.take(pa.array(groups[who] // width)),
            "source": sources.dictionary.take(pa.array(groups[who] % width)),
            "shard": pa.array(np.concatenate([bundles[starts], np.full(len(groups), -1)]).astype(np.int32)),
            "slots": pa.array([local[i:j].tobytes() for i, j in spans] + nothing, pa.binary()),
            "counts": pa.array([n[i:j].tobytes() for i, j in spans] + nothing, pa.binary()),
            "total": pa.array(totals),
        }
    )


def shares(counts: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exactly, by long division: no product passes 1000 * (total + terms)."""
    divisor = np.asarray(total, dtype=np.int64) + terms
    rest, out = counts + 1, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // divisor
        rest = rest % divisor
    return out + 1


def _distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    apart = p - q
    return apart * apart // q


class _Shard:
    """What a sorted stream says about one shard: keys, groups, counts."""

    def __init__(self, number: int):
        self.number, self.groups, self.slots, self.terms = number, {}, {}, []
        self.row: dict[str, dict[str, int]] = {}
        self.dense: dict[str, np.ndarray] = {}

    def key_row(self, langs: list[str], terms: list[str]) -> None:
        place = np.zeros(len(langs), dtype=np.int64)
        for i, lang in enumerate(langs):
            mine = self.slots.setdefault(lang, [])
            place[i] = len(mine)
            mine.append(i)
        self.terms, self.place = terms, place

    def group_row(self, lang: str, source: str, total: int, kept: int) -> None:
        self.groups.setdefault(lang, []).append((source, total, kept))

    def add(self, lang: str, source: str, slots: bytes, counts: bytes) -> None:
        if lang not in self.dense:
            self.row[lang] = {s: i for i, (s, _, _) in enumerate(self.groups[lang])}
            self.dense[lang] = np.zeros((len(self.groups[lang]), len(self.slots[lang])), dtype=np.int64)
        at = self.place[np.frombuffer(slots, np.uint32)]
        self.dense[lang][self.row[lang][source], at] += np.frombuffer(counts, np.int64)

    def results(self, top: int) -> Iterator[pa.RecordBatch]:
        """(lang, source, part, item, value): for each group its distance to each other source over this shard's terms, and the
        ``top`` terms here that it has more of than its language. Shard 0 names all pairs, the others those it has terms for."""
        for lang, groups in self.groups.items():
            mine = self.slots.get(lang, [])
            if not mine and self.number:
                continue
            sources, totals, kept = [g[0] for g in groups], np.array([g[1] for g in groups]), groups[0][2]
            counts = self.dense.get(lang)
            if counts is None:
                counts = np.zeros((len(groups), len(mine)), dtype=np.int64)
            p = shares(counts, totals[:, None], kept) if mine else counts
            q = shares(counts.sum(0), totals.sum(), kept) if mine else None
            terms = [self.terms[i] for i in mine]
            alphabetic = np.argsort(np.argsort(np.array([t.encode() for t in terms], dtype=object), kind="stable")) if mine else None
            for g, source in enumerate(sources):
                value = _distances(p[g], p).sum(1)
                others = [i for i in range(len(sources)) if i != g]
                if others:
                    yield _results(lang, source, "pair", [sources[i] for i in others], value[others])
                if mine:
                    more = np.flatnonzero((counts[g] > 0) & (p[g] > q))
                    if len(more):
                        far = _distances(p[g][more], q[more])
                        best = np.lexsort((alphabetic[more], -far))[:top]
                        yield _results(lang, source, "term", [terms[i] for i in more[best].tolist()], far[best])


def _results(lang: str, source: str, part: str, items: list[str], values: np.ndarray) -> pa.RecordBatch:
    n = len(items)
    return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * n), "source": pa.array([source] * n), "part": pa.array([part] * n), "item": pa.array(items, pa.string()), "value": pa.array(values, pa.int64())})


def _recount(top: int):
    """mapInArrow function over rows sorted by (shard, kind): keys, then groups, then counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            for row in batch.to_pylist():
                if shard is None or row["shard"] != shard.number:
                    if shard is not None:
                        yield from shard.results(top)
                    shard = _Shard(row["shard"])
                if row["kind"] == 0:
                    shard.key_row(row["langs"], row["terms"])
                elif row["kind"] == 1:
                    shard.group_row(row["lang"], row["source"], row["total"], row["kept"])
                else:
                    shard.add(row["lang"], row["source"], row["slots"], row["counts"])
        if shard is not None:
            yield from shard.results(top)

    return run


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP, shard_terms: int = SHARD_TERMS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(lang, source, part, item, value long, rank int): how far each source's terms lie from those of each other source of its
    language (``pair``, all of them), and which terms it has most of beside its language (``term``, the first ``top``).

    A language keeps the terms in at least ``least`` of its documents; a share is 1 + floor(10**9 * (count + 1) / (N + V)), a
    distance floor((p - q)**2 / q). Ranks are by falling value, then by item. Null texts, languages and sources count as
    empty strings; a group without terms takes part with counts of 0; rows that repeat are documents of their own; other
    columns are ignored. A language of one source has no pairs. An empty table gives an empty table.
    """
    plain = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    docs = docs.select(plain(lang_col, "lang"), plain(source_col, "source"), plain(text_col, "text"))
    kept = durable(frequent_terms(docs, least))
    shards = max(1, math.ceil(kept.count() / shard_terms))
    tables = durable(hash_shards(kept, shards))
    sizes = [(r["shard"], r["n_bytes"]) for r in tables.select("shard", "n_bytes").orderBy("shard").collect()]
    counts = None
    for first, last in _rounds(sizes, shards, round_bytes):
        now = durable(count_slots(docs, tables.filter(F.col("shard").between(first, last)).toArrow(), shards))
        counts = now if counts is None else counts.unionByName(now)
    dealt = counts.filter("shard >= 0").select("shard", "lang", "source", "slots", "counts").repartition("shard", "lang", "source").sortWithinPartitions("shard", "lang", "source")
    by_shard = dealt.mapInArrow(_by_shard, "lang string, source string, shard int, slots binary, counts binary")
    groups = counts.filter("shard = -1").groupBy("lang", "source").agg(F.sum("total").alias("total"))
    vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    groups = groups.join(vocabulary, "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    rows = (
        tables.select("shard", F.lit(0).alias("kind"), "langs", "terms")
        .unionByName(groups.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "lang", "source", "total", "kept"), allowMissingColumns=True)
        .unionByName(by_shard.select("shard", F.lit(2).alias("kind"), "lang", "source", "slots", "counts"), allowMissingColumns=True)
    )
    found = durable(rows.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_recount(top), "lang string, source string, part string, item string, value long"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    terms = found.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.unionByName(terms)


def _rounds(sizes: list[tuple[int, int]], shards: int, most: int) -> list[tuple[int, int]]:
    """The first and last shard of each round: as many shards as stay within the bytes, one at least. One round even if no shard
    has keys, which finds the groups."""
    rounds, first, held = [], 0, 0
    for shard, n in sizes:
        if held and held + n > most:
            rounds.append((first, shard - 1))
            first, held = shard, 0
        held += n
    return [*rounds, (first, shards - 1)]
