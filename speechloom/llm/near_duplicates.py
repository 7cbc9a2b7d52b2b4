"""Near-duplicate classes by ProbMinHash.

Every distinct text has its word shingles weighted by how often it has them. A shingle's arrivals are a Poisson process whose
rate is its weight; each arrival falls on a random signature component, which keeps its earliest, and a shingle is left as
soon as its next arrival is later than the latest component of the text (Ertl's ProbMinHash). Components of two texts agree
with the probability Jaccard similarity J_P of their shingles. Bands of components nominate pairs, the exact J_P of their
texts decides, and the links' connected components are the classes.

Exact copies become one node first. A bucket of up to SMALL nodes nominates all its pairs. A larger one never does: its nodes
are dealt to about sqrt(nodes) salts; in each large part every node meets the part's first node and its neighbours in one
common order, and the first nodes of large parts and the nodes of small ones meet each other in the same way. All bands use
the same order, so the members of one large group mostly nominate the same few pairs; each node's most supported pair is
verified first, and the others only where the two are not in one class yet.

A large bucket whose nodes are not all of one class then may hide links. Its nodes get a longer signature and finer bands, of
which two texts near the threshold share some all the same, but texts that are only alike hardly any: so these buckets are
small again and nominate all pairs of different classes. In those that are not, all meet the node that shares most buckets
with others, and neighbours in an order of the bucket's own, so that every band is a fresh chance.

The nodes of finer buckets that are still large and of several classes are joined exactly, by a prefix filter: J_P is at most
the mass that two texts have in common (the sum of min(p, q) over their shingles' shares p and q), so of two linked texts, with
their shingles in one order, the rarest first, each has a common shingle before its last ``threshold`` of mass. Only those
leading shingles are joined, between blocks of similar texts, and tasks compare two blocks each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fingerprints as fp
from .shared import durable, join_unskewed, marked, marks, stored

#: Two texts of J_P 0.8 share none of these bands with a probability of 7 in 10,000, of 0.85 of 2 in 100,000.
THRESHOLD, SHINGLE_WORDS, BANDS, BAND_ROWS = 0.8, 5, 24, 6
#: Buckets of up to so many nodes nominate all their pairs, so that each node has so many partners there at most.
SMALL = 16
#: Meetings that make a pair a likely link: two texts at the threshold meet in about six of the bands.
LIKELY = 4
#: The finer bands of nodes of large buckets with several classes: components of their signature and of a band. Two texts of J_P
#: 0.8 share about seven of them, and none with a probability of 6 in 10,000.
FINE, FINE_ROWS = 320, 8
#: Slots of the tables of hashed bucket sizes and of hashed counts of shingles.
SLOTS = 1 << 20
#: Texts, and their bytes, of a block of the exact join.
BLOCK, BLOCK_BYTES = 256, 4 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array, n: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, count) of the distinct shingles of all texts, by text, and a fingerprint of each text's words.

    Words are lower-cased; a text of fewer than n words has one shingle, all of them; one without words has none.
    """
    data, offsets = fp.text_buffers(pc.utf8_lower(pc.fill_null(texts, "")))
    starts, ends, firsts = fp.word_spans(data, offsets)
    hashes = fp.word_hashes(data, starts, ends)
    size = np.diff(firsts)
    whole = np.zeros(len(size), dtype=np.uint64)
    place = fp.within_document(firsts).astype(np.uint64)
    doc = np.repeat(np.arange(len(size)), size)
    if len(hashes):
        has = size > 0
        whole[has] = np.add.reduceat(fp.mix(hashes + place * _STEP), firsts[:-1][has])
    whole = fp.mix(whole + size.astype(np.uint64))
    at = np.flatnonzero(fp.inside(firsts, n))
    value, owner = fp.windows(hashes, n)[at], doc[at]
    short = (size > 0) & (size < n)
    value, owner = np.concatenate([value, whole[short]]), np.concatenate([owner, np.flatnonzero(short)])
    _, first, count = np.unique(fp.mix(value + owner.astype(np.uint64) * _STEP), return_index=True, return_counts=True)
    order = np.argsort(owner[first], kind="stable")
    return owner[first][order], value[first][order], count[order], whole.view(np.int64)


def prob_minhash(owner: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """(n, m) signatures; owner says which of the n texts each weighted shingle belongs to. Texts without any get zeros."""
    least, kept = np.full(n * m, np.inf), np.zeros(n * m, dtype=np.uint64)
    only = np.bincount(owner, minlength=n)
    alone = only[owner] == 1
    kept.reshape(n, m)[owner[alone]] = value[alone][:, None]
    value, owner, rate = value[~alone], owner[~alone], weight[~alone].astype(np.float64)
    time, seed = np.zeros(len(value)), value.copy()
    while len(value):
        seed = fp.mix(seed + _STEP)
        time -= np.log((seed >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / rate
        slot = owner * m + (fp.mix(seed ^ _STEP) % np.uint64(m)).astype(np.int64)
        earlier = np.flatnonzero(time < least[slot])
        np.minimum.at(least, slot[earlier], time[earlier])
        won = earlier[time[earlier] == least[slot[earlier]]]
        kept[slot[won]] = value[won]
        texts, which = np.unique(owner, return_inverse=True)
        on = time < least.reshape(n, m)[texts].max(1)[which]
        value, owner, rate, time, seed = value[on], owner[on], rate[on], time[on], seed[on]
    return kept.reshape(n, m)


def band_hashes(signatures: np.ndarray, rows: int) -> np.ndarray:
    """(texts, bands) hashes of consecutive rows components, another function for each band."""
    n, m = signatures.shape
    parts = signatures.reshape(n, m // rows, rows)
    out = np.tile(np.arange(1, m // rows + 1, dtype=np.uint64), (n, 1))
    for i in range(rows):
        out = fp.mix(out * _STEP + parts[:, :, i])
    return out.view(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """J_P of two (sorted distinct shingles, counts)."""
    values = np.union1d(a[0], b[0])
    wa, wb = np.zeros(len(values)), np.zeros(len(values))
    wa[np.searchsorted(values, a[0])], wb[np.searchsorted(values, b[0])] = a[1], b[1]
    both = (wa > 0) & (wb > 0)
    kinds, times = np.unique(np.stack([wa[both], wb[both]], 1), axis=0, return_counts=True)
    return float(sum(k / np.maximum(wa / x, wb / y).sum() for (x, y), k in zip(kinds, times, strict=True)))


@F.pandas_udf(T.LongType())
def text_node(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The node of a text: equal for texts with the same lower-cased words; null for one without words."""
    for texts in batches:
        batch = pa.RecordBatch.from_pydict({"t": pa.array(texts, pa.string(), from_pandas=True)})
        out = []
        for part in fp.slices_of_bytes(batch, "t"):
            data, offsets = fp.text_buffers(pc.utf8_lower(pc.fill_null(part.column("t"), "")))
            starts, ends, firsts = fp.word_spans(data, offsets)
            value, size = fp.mix(fp.word_hashes(data, starts, ends) + fp.within_document(firsts).astype(np.uint64) * _STEP), np.diff(firsts)
            whole = np.zeros(len(size), dtype=np.uint64)
            if len(value):
                whole[size > 0] = np.add.reduceat(value, firsts[:-1][size > 0])
            out.append(pd.Series(fp.mix(whole + size.astype(np.uint64)).view(np.int64)).astype("Int64").where(pd.Series(size > 0)))
        yield pd.concat(out, ignore_index=True) if out else pd.Series([], dtype="Int64")


def _sketch(n_words: int, bands: int, rows: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in fp.slices_of_bytes(batch, "text"):
                owner, value, count, whole = shingles(part.column("text"), n_words)
                has = np.bincount(owner, minlength=part.num_rows) > 0
                hashes = band_hashes(prob_minhash(owner, value, count, part.num_rows, bands * rows), rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * bands), pa.array(hashes.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(whole, mask=~has), lists], names=["id", "node", "bands"])

    return sketch


def _fine_bands(texts: DataFrame, n_words: int) -> DataFrame:
    """(node, bands array<long>): the finer bands of texts."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in fp.slices_of_bytes(batch, "text"):
                owner, value, count, _ = shingles(part.column("text"), n_words)
                signatures = prob_minhash(owner, value, count, part.num_rows, FINE)
                hashes = band_hashes(signatures, FINE_ROWS)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * hashes.shape[1]), pa.array(hashes.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("node"), lists], names=["node", "bands"])

    return texts.select("node", "text").mapInArrow(sketch, "node long, bands array<long>")


def _nominate(rows: DataFrame, n_nodes: int) -> tuple[DataFrame, DataFrame]:
    """From (node, root, bucket, place): (a, b, support), pairs of nodes, a < b, of different roots that meet in buckets, where
    support counts the meetings; and (bucket, part, node, root, n), the rows with the size of their part. place orders a bucket."""
    salts = max(1, math.isqrt(n_nodes))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(salts))).withColumn("x", F.struct("node", "root"))

    def apart(others: Column) -> Column:
        return F.transform(F.filter(others, lambda o: (o["node"] != F.col("node")) & (o["root"] != F.col("root"))), lambda o: o["node"])

    def ordered(rows: DataFrame, by: list[str], back: int) -> DataFrame:
        """rows with n (of their group), first, and others: the group's first node and the ``back`` before, if of other roots."""
        w = Window.partitionBy(*by).orderBy("place", "node")
        rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
        rows = rows.withColumn("first", F.first("node").over(w) == F.col("node"))
        return rows.withColumn("others", apart(F.array(F.first("x").over(w), *(F.lag("x", i).over(w) for i in range(1, back + 1)))))

    parts = stored(ordered(rows, ["bucket", "part"], 2).drop("x"))
    tops = parts.filter((F.col("n") <= SMALL) | F.col("first")).select("bucket", "node", "root", "place", F.struct("node", "root").alias("x"))
    tops = ordered(tops, ["bucket"], 3).filter("n > 1")
    before = F.collect_list("x").over(Window.partitionBy("bucket").orderBy("place", "node").rowsBetween(-SMALL, -1))
    tops = tops.withColumn("others", F.when(F.col("n") <= SMALL, apart(before)).otherwise(F.col("others")))
    # A node's partners are counted before they become rows, since the members of a large group meet the same few in all bands.
    met = lambda df: df.filter(F.size("others") > 0).select("node", "others")
    lists = met(parts.filter(F.col("n") > SMALL)).unionByName(met(tops)).groupBy("node").agg(F.array_sort(F.flatten(F.collect_list("others"))).alias("others"))
    times = F.transform(F.array_distinct("others"), lambda o: F.struct(o.alias("node"), F.size(F.filter("others", lambda x: x == o)).alias("times")))
    pairs = lists.select("node", F.explode(times).alias("o"))
    pairs = pairs.select(F.least("node", "o.node").alias("a"), F.greatest("node", "o.node").alias("b"), F.col("o.times").cast("long").alias("times"))
    return pairs.groupBy("a", "b").agg(F.sum("times").alias("support")), parts.select("bucket", "part", "node", "root", "n")


def _central_first(fine: DataFrame) -> DataFrame:
    """(node, root, bucket, place) from (node, root, bands): the nodes that share buckets with most others come first, and then
    each bucket has an order of its own. An original whose copies are hardly alike among themselves so comes first in its
    buckets, and all meet it. Sizes are looked up in a table of SLOTS hashed counts, which makes them a little too large at most
    where there are many more buckets than slots."""
    slots = fine.select(F.explode("bands").alias("b")).select(F.pmod("b", F.lit(SLOTS)).cast("int").alias("slot"))
    table = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).toArrow()  # SLOTS rows at most
    sizes = np.zeros(SLOTS, dtype=np.int64)
    sizes[table.column("slot").to_numpy()] = table.column("n").to_numpy()

    @F.pandas_udf(T.LongType())
    def met(bands: pd.Series) -> pd.Series:
        return pd.Series([int(sizes[np.asarray(x) % SLOTS].sum()) for x in bands], dtype="int64")

    rows = fine.withColumn("central", met("bands")).select("node", "root", "central", F.explode("bands").alias("bucket"))
    return rows.select("node", "root", "bucket", F.struct(-F.col("central"), F.xxhash64("node", "bucket")).alias("place"))


def _hiding(parts: DataFrame, roots: DataFrame) -> DataFrame:
    """(node): the nodes of buckets of more than SMALL nodes that are of more than one class by now."""
    sizes = parts.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    large = durable(sizes.join(sizes.groupBy("bucket").agg(F.sum("n").alias("all")).filter(F.col("all") > SMALL), "bucket", "left_semi").select("bucket", "part"))
    rows = durable(parts.select("bucket", "part", "node").join(large, ["bucket", "part"], "left_semi"))
    classed = rows.select("bucket", "part", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = classed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("bucket")
    spread = mixed.join(large, "bucket")  # a bucket's parts, so that no task gets a bucket
    return rows.join(spread, ["bucket", "part"], "left_semi").select("node").distinct()


def _leading_shingles(texts: DataFrame, threshold: float, n_words: int) -> DataFrame:
    """(node, n_bytes, common, leading array<long>): of each text the shingles that come before its last threshold of mass, in
    one order for all texts: that of hashed counts, a table of SLOTS numbers, so that the rarest come first, and of the shingles
    themselves where these tie; and the last shingle, its most frequent."""

    def parts(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in fp.slices_of_bytes(batch, "text"):
                yield part, *shingles(part.column("text"), n_words)[:3]

    def slot_of(value: np.ndarray) -> np.ndarray:
        return (value % np.uint64(SLOTS)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, value, _ in parts(batches):
            slot, n = np.unique(slot_of(value), return_counts=True)
            yield pa.RecordBatch.from_pydict({"slot": pa.array(slot), "n": pa.array(n.astype(np.int64))})

    table = texts.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    sizes = np.zeros(SLOTS, dtype=np.int64)
    sizes[table.column("slot").to_numpy()] = table.column("n").to_numpy()

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, owner, value, times in parts(batches):
            order = np.lexsort((value, sizes[slot_of(value)], owner))
            owner, value, times = owner[order], value[order].view(np.int64), times[order]
            cut = np.searchsorted(owner, np.arange(part.num_rows + 1))  # every node's text has a shingle
            mass = np.add.reduceat(times, cut[:-1])
            before = np.cumsum(times) - times
            before = before - before[cut[owner]]
            on = mass[owner] - before >= (threshold - 1e-9) * mass[owner]
            leading = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[on], np.arange(part.num_rows + 1)).astype(np.int32)), pa.array(value[on]))
            n_bytes = pc.binary_length(part.column("text")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("node"), n_bytes, pa.array(value[cut[1:] - 1]), leading], names=["node", "n_bytes", "common", "leading"])

    return texts.select("node", "text").mapInArrow(lead, "node long, n_bytes long, common long, leading array<long>")


def _block_links(threshold: float, n_words: int):
    """The links between two blocks of texts, or within one: common mass first, for all texts that share a shingle, and the exact
    J_P where that reaches the threshold."""

    def match(group: pa.Table) -> pa.Table:
        node, root, first = (group.column(c).to_numpy(zero_copy_only=False) for c in ("node", "root", "first"))
        owner, value, times, _ = shingles(group.column("text").combine_chunks(), n_words)
        order = np.lexsort((value, owner))
        owner, value, times = owner[order], value[order], times[order]
        cut = np.searchsorted(owner, np.arange(len(node) + 1))
        share = times / np.bincount(owner, weights=times, minlength=len(node))[owner]
        second = np.flatnonzero(~first[owner]) if not first.all() else np.arange(len(owner))
        by_value = second[np.argsort(value[second], kind="stable")]
        low, high = (np.searchsorted(value[by_value], value, side=side) for side in ("left", "right"))
        found = []
        for a in np.flatnonzero(first):
            mine = slice(cut[a], cut[a + 1])
            n = high[mine] - low[mine]
            at = by_value[np.repeat(low[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            common = np.bincount(owner[at], weights=np.minimum(np.repeat(share[mine], n), share[at]), minlength=len(node))
            for b in np.flatnonzero((common >= threshold - 1e-9) & (root != root[a])):
                if probability_jaccard((value[mine], times[mine]), (value[cut[b] : cut[b + 1]], times[cut[b] : cut[b + 1]])) >= threshold:
                    found.append((min(node[a], node[b]), max(node[a], node[b])))
        ends = np.array(sorted(set(found)), dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(ends[:, 0]), "b": pa.array(ends[:, 1])})

    return match


def _exact_links(texts: DataFrame, roots: DataFrame, threshold: float, n_words: int) -> DataFrame:
    """(a, b): every link between texts of different roots. Nodes are dealt to blocks, those with the same most frequent shingle
    together; blocks that share a leading shingle meet, with their texts, once for each such pair of blocks. No pair of nodes
    but a link leaves a task, and no task holds more than two blocks."""
    nodes = durable(_leading_shingles(texts, threshold, n_words))
    cells = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_bytes") / BLOCK_BYTES)).cast("int")
    dealt = join_unskewed(nodes, nodes.groupBy("common").agg(cells.alias("cells")), ["common"])
    dealt = durable(dealt.select("node", "leading", F.xxhash64("common", F.pmod(F.xxhash64("node"), "cells")).alias("block")))
    lists = durable(dealt.select("block", F.explode("leading").alias("shingle")).distinct())
    pairs = lists.withColumnRenamed("block", "p").join(lists.withColumnRenamed("block", "q"), "shingle").filter("p <= q")
    pairs = durable(pairs.select("p", "q").distinct())
    members = durable(texts.join(dealt.select("node", "block"), "node").join(roots, "node", "left").select("block", "node", F.coalesce("root", "node").alias("root"), "text"))
    side = lambda key, first: pairs.join(members.withColumnRenamed("block", key), key).select("p", "q", "node", "root", "text", F.lit(first).alias("first"))
    both = side("p", True).unionByName(side("q", False).filter("p != q"))
    return both.groupBy("p", "q").applyInArrow(_block_links(threshold, n_words), "a long, b long").distinct()


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float, n_words: int) -> DataFrame:
    """The pairs (a, b) whose texts have a J_P of at least the threshold."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in fp.slices_of_bytes(batch, "text_a"):
                sides = []
                for column in ("text_a", "text_b"):
                    owner, value, count, _ = shingles(part.column(column), n_words)
                    order = np.lexsort((value, owner))
                    cut = np.searchsorted(owner[order], np.arange(part.num_rows + 1))
                    sides.append([(value[order[i:j]], count[order[i:j]]) for i, j in zip(cut[:-1], cut[1:], strict=True)])
                near = np.array([probability_jaccard(x, y) for x, y in zip(*sides, strict=True)]) >= threshold
                yield part.select(["a", "b"]).filter(pa.array(near))

    rows = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return rows.select("a", "b", "text_a", "text_b").mapInArrow(exact, "a long, b long")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each linked node's component; links are (a, b). Labels spread to neighbours and then
    jump to their label's label, so a component of diameter d takes about log d rounds; each is stored."""
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        heard = both.join(labels.withColumnsRenamed({"node": "b", "root": "theirs"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("theirs"))
        spread = stored(labels.join(heard, "node").select("node", F.least("root", "theirs").alias("root"), F.col("root").alias("old")))
        jump = spread.select(F.col("node").alias("root"), F.col("root").alias("next"))
        labels = stored(join_unskewed(spread, jump, ["root"]).select("node", F.col("next").alias("root"), (F.col("next") != F.col("old")).alias("changed")))
        if labels.filter("changed").isEmpty():
            return labels.select("node", "root")
        labels = labels.select("node", "root")


def _merge(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The roots (node, root) after links (a, b) between nodes: components of the classes that they join, not of all nodes."""
    root_of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    between = links.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    joined = connected_components(between.filter("a != b").distinct())
    moved = join_unskewed(roots, joined.select(F.col("node").alias("root"), F.col("root").alias("new")), ["root"], "left")
    fresh = joined.join(roots, "node", "left_anti").select("node", "root")
    return stored(moved.select("node", F.coalesce("new", "root").alias("root")).unionByName(fresh))


def _settle(pairs: DataFrame, roots: DataFrame, texts: DataFrame, threshold: float, n_words: int) -> DataFrame:
    """The roots (node, root) of the linked nodes after the links among pairs; a node without links has no row.

    Pairs within a class need no verification, so those likeliest to be links come first: each node's most supported pair, then
    all pairs of LIKELY meetings, then the others. Each time only pairs of different classes are verified.
    """
    ranked = pairs.withColumn("rank", F.struct("support", (-F.col("a")).alias("x"), (-F.col("b")).alias("y")))
    ends = ranked.groupBy(F.col("a").alias("node")).agg(F.max("rank").alias("rank")).unionByName(ranked.groupBy(F.col("b").alias("node")).agg(F.max("rank").alias("rank")))
    best = durable(ends.groupBy("node").agg(F.max("rank").alias("rank")).select((-F.col("rank.x")).alias("a"), (-F.col("rank.y")).alias("b")).distinct())
    others = durable(pairs.join(best, ["a", "b"], "left_anti"))
    for some in (best, others.filter(F.col("support") >= LIKELY), others.filter(F.col("support") < LIKELY)):
        root_of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))  # noqa: B023, E731
        apart = some.select("a", "b").join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").filter("root_a is null or root_b is null or root_a != root_b")
        found = durable(_verify(apart.select("a", "b"), texts, threshold, n_words))
        if not found.isEmpty():
            roots = _merge(roots, found)
    return roots


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, n_words: int = SHINGLE_WORDS, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """One row per row of docs: (id, node long, root long, class_id, class_size long).

    Two texts are linked if their lower-cased word shingles, weighted by count, have J_P >= threshold; a class is a connected
    component of links. class_id is its smallest non-null id, class_size the number of its rows. node is the same for rows
    with the same lower-cased words (a 64-bit fingerprint), root the smallest node of the class. Texts that are null or have no words have a null node and root and stand
    alone: class_id is their id, class_size 1. Rows with equal or null ids are rows of their own. Other columns, whatever
    their names, are ignored; long texts are sketched one by one and compared whole. An empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("node", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    sketches = durable(rows.mapInArrow(_sketch(n_words, bands, band_rows), schema))
    members = sketches.select("id", "node")
    worded = sketches.filter("node is not null")
    nodes = durable(worded.groupBy("node").agg(F.first("bands").alias("bands")))
    n_nodes = nodes.count()
    rows_of = lambda df: df.select("node", "root", F.explode("bands").alias("bucket"))
    pairs, parts = _nominate(rows_of(nodes.withColumn("root", F.col("node"))).withColumn("place", F.xxhash64("node", F.lit("order"))), n_nodes)
    pairs = durable(pairs)
    wanted = durable(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
    texts = rows.filter(F.col("text").isNotNull()).withColumn("node", text_node("text")).filter("node is not null")
    texts = marked(texts, "node", durable(marks(wanted, "node"))).filter("__marked").select("node", "text")
    texts = durable(texts.groupBy("node").agg(F.first("text").alias("text")).join(wanted, "node", "left_semi"))  # copies go before they meet

    none = docs.sparkSession.createDataFrame([], "node long, root long")
    roots = _settle(pairs, none, texts, threshold, n_words)
    hiding = durable(_hiding(parts, roots))
    if not hiding.isEmpty():
        fine = durable(_fine_bands(texts.join(hiding, "node", "left_semi"), n_words).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
        near, parts = _nominate(_central_first(fine), n_nodes)
        near = durable(near.join(pairs, ["a", "b"], "left_anti"))
        if not near.isEmpty():
            roots = _settle(near, roots, texts, threshold, n_words)
        hiding = durable(_hiding(parts, roots))
        if not hiding.isEmpty():
            found = durable(_exact_links(durable(texts.join(hiding, "node", "left_semi")), roots, threshold, n_words))
            if not found.isEmpty():
                roots = _merge(roots, found)

    per_node = members.filter("node is not null").groupBy("node").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    per_node = durable(per_node.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    per_class = per_node.groupBy("root").agg(F.min("low").alias("class_id"), F.sum("n").alias("class_size"))
    classes = durable(join_unskewed(per_node.select("node", "root"), per_class, ["root"]))
    found = join_unskewed(members.filter("node is not null"), classes, ["node"]).select(F.col("id").alias(id_col), "node", "root", "class_id", "class_size")
    alone = members.filter("node is null").select(F.col("id").alias(id_col), "node", F.lit(None).cast("long").alias("root"), F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return found.unionByName(alone)
