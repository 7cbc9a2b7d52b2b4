"""Benchmark decontamination by template windows.

Texts of both sides become templates: numbers, units after a number and names inside a sentence turn into typed
placeholders, all else is lower-cased. Windows of template tokens are hash-joined, and the matched windows of one alignment
(one distance between the positions in document and item) must fill the item's slots consistently: a value of the item that
occurs twice has to be replaced by one and the same value. So a question with other numbers or names is found, and a text
that only looks alike is not.

An item without such a window, being too short or all numbers and names, is looked for word for word instead: as one window of
its whole length over the plain tokens. An item of one or two tokens leaks only where it is a whole text.

Before the join, document windows pass a bitmap of fixed size over the hashes of the benchmark's windows, which only saves
rows: whatever passes is decided by the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fingerprints as fp
from .shared import durable, join_unskewed

WINDOW, MIN_LITERALS, MIN_SHARE = 5, 3, 0.5
BITMAP = 1 << 23

#: Words that stand for a number, and units, which count as such right after a number.
NUMBER_WORDS = "one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million"
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams ton tons oz pound pounds lb ml l liter liters litre litres "
    "second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degrees"
)
_LITERAL, _NUMBER, _UNIT, _NAME = range(4)
_KINDS = ("", "num", "unit", "name")

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_JOINS = np.zeros(256, dtype=bool)
_JOINS[list(b".,:/-")] = True
_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(b".!?:;\n|\"")] = True
_PLAIN = np.where(_WORD, np.arange(256), 32).astype(np.uint8)  # A-Z lowered, all that is in no word a space
_PLAIN[65:91] += 32


def _known(words: str) -> np.ndarray:
    data, offsets = fp.text_buffers(pa.array([words]))
    starts, ends, _ = fp.word_spans(data, offsets)
    return np.sort(fp.word_hashes(data, starts, ends))


class Template:
    """The template tokens of some texts: fingerprints, kinds, byte spans, and tokens before each text."""

    def __init__(self, texts: pa.Array):
        data, offsets = fp.text_buffers(texts)
        lower = _PLAIN[data]
        starts, ends, _ = fp.word_spans(lower, offsets)
        lower[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)] += 32  # À to Þ
        hashes = fp.word_hashes(lower, starts, ends)
        n = len(starts)
        text = np.searchsorted(offsets, starts, side="right") - 1
        opens = np.ones(n, dtype=bool)  # first of its text
        opens[1:] = text[1:] != text[:-1]
        stops = np.concatenate([[0], np.cumsum(_ENDS[data], dtype=np.int32)])
        number = _DIGIT[data[starts]] if n else np.zeros(0, dtype=bool)
        digits_joined = np.zeros(n, dtype=bool)
        if n:
            digits_joined[1:] = number[1:] & number[:-1] & (starts[1:] - ends[:-1] == 1) & _JOINS[data[ends[:-1]]] & ~opens[1:]
            words = _known(NUMBER_WORDS)
            number |= words[np.minimum(np.searchsorted(words, hashes), len(words) - 1)] == hashes
        keep = ~digits_joined
        last = np.maximum.accumulate(np.where(keep, np.cumsum(keep) - 1, 0)) if n else np.zeros(0, dtype=np.int64)
        joined_end = ends[keep].copy()
        np.maximum.at(joined_end, last, ends)
        starts, hashes, number, opens, text = starts[keep], hashes[keep], number[keep], opens[keep], text[keep]
        before = np.zeros(len(starts), dtype=bool)  # a sentence ends before it
        if len(starts):
            before[1:] = stops[starts[1:]] > stops[joined_end[:-1]]
            raw = data[starts]
            upper = ((raw >= 65) & (raw <= 90)) | ((raw == 0xC3) & (data[np.minimum(starts + 1, len(data) - 1)] < 0x9F))
            second = data[np.minimum(starts + np.where(raw == 0xC3, 2, 1), len(data) - 1)]
            shouted = (second >= 65) & (second <= 90)
            units = _known(UNITS)
            unit = units[np.minimum(np.searchsorted(units, hashes), len(units) - 1)] == hashes
            unit[1:] &= number[:-1] & ~opens[1:]
            unit[:1] = False
            self.kinds = np.select([number, unit, upper & ~shouted & ~before & ~opens], [_NUMBER, _UNIT, _NAME], _LITERAL).astype(np.uint8)
        else:
            self.kinds = np.zeros(0, dtype=np.uint8)
        self.hashes = np.where(self.kinds == _LITERAL, hashes, self.kinds.astype(np.uint64))
        self.plain = fp.word_hashes(lower, starts, joined_end) if len(starts) else hashes
        self.firsts = np.searchsorted(text, np.arange(len(offsets)))
        self._lower, self._starts, self._ends = lower, starts, joined_end

    def slot(self, i: int) -> str:
        return f"{_KINDS[self.kinds[i]]}={self._lower[self._starts[i] : self._ends[i]].tobytes().decode('utf-8', 'replace')}"

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First tokens and fingerprints of the windows with enough literals."""
        at = np.flatnonzero(fp.inside(self.firsts, n))
        literal = np.concatenate([[0], np.cumsum(self.kinds == _LITERAL)])
        at = at[literal[at + n] - literal[at] >= min(MIN_LITERALS, n)]
        return at, fp.windows(self.hashes, n)[at] if len(at) else np.zeros(0, np.uint64)


    def verbatim(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First tokens and fingerprints of all windows of n plain tokens; of one or two only those that are a whole text."""
        at = np.flatnonzero(fp.inside(self.firsts, n))
        if n < MIN_LITERALS:
            text = np.searchsorted(self.firsts, at, side="right") - 1
            at = at[np.diff(self.firsts)[text] == n]
        return at, fp.windows(self.plain, n, salt=n)[at] if len(at) else np.zeros(0, np.uint64)


def _set_bits(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = (h % np.uint64(BITMAP)).astype(np.int64)
    return (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def _windows(n: int, bitmap: np.ndarray | None, lengths: list[int]):
    """mapInArrow function to (row long, id, pos int, h long, slots array<string>, size int); row is one for each text. size is
    null for template windows. Without a bitmap, texts are items: one that has no template window gives itself as a window of
    its size; with one they are documents, and give the plain windows of all lengths too."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in fp.slices_of_bytes(batch, "text"):
                template = Template(part.column("text"))
                whose = lambda at: np.searchsorted(template.firsts, at, side="right") - 1  # noqa: B023, E731
                at, h = template.windows(n)
                sizes = np.diff(template.firsts)
                if bitmap is None:
                    bare = np.setdiff1d(np.flatnonzero(sizes > 0), whose(at))
                    plain = [(template.firsts[bare][sizes[bare] == k], k) for k in np.unique(sizes[bare]).tolist()]
                    plain = [(a, fp.windows(template.plain, k, salt=k)[a], k) for a, k in plain]
                else:
                    hit = _set_bits(bitmap, h)
                    at, h, plain = at[hit], h[hit], []
                    for k in lengths:
                        a, g = template.verbatim(k)
                        hit = _set_bits(bitmap, g)
                        plain.append((a[hit], g[hit], k))
                slots = [[template.slot(j) for j in range(i, i + n) if template.kinds[j]] for i in at.tolist()]
                size = [None] * len(at)
                for a, g, k in plain:
                    at, h = np.concatenate([at, a]), np.concatenate([h, g])
                    slots, size = slots + [[]] * len(a), size + [k] * len(a)
                text = whose(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + text, pa.int64()),
                        part.column("id").take(pa.array(text)),
                        pa.array(at - template.firsts[text], pa.int32()),
                        pa.array(h.view(np.int64)),
                        pa.array(slots, pa.list_(pa.string())),
                        pa.array(size, pa.int32()),
                        part.column("key").take(pa.array(text)),
                    ],
                    names=["row", "id", "pos", "h", "slots", "size", "key"],
                )
                row += part.num_rows

    return find


def template_windows(df: DataFrame, id_col: str, text_col: str, n: int = WINDOW, bitmap: np.ndarray | None = None, lengths: list[int] | None = None) -> DataFrame:
    fields = (("row", T.LongType()), ("id", df.schema[id_col].dataType), ("pos", T.IntegerType()), ("h", T.LongType()), ("slots", T.ArrayType(T.StringType())), ("size", T.IntegerType()), ("key", T.LongType()))
    rows = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    return rows.mapInArrow(_windows(n, bitmap, lengths or []), T.StructType([T.StructField(*f) for f in fields]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = WINDOW, min_share: float = MIN_SHARE) -> DataFrame:
    """One row per row of docs and item that it leaks: (id, item, windows long, share double, kind string, text_key long).

    share is the part of the item's template windows that the text holds in consistent alignments, at least min_share; kind
    is ``exact`` if all slots have the item's own values, else ``reparameterised``. text_key is xxhash64 of the text, for
    joining decisions back to rows without ids. Items without a template window leak where a text holds all their tokens (of
    up to two: where it is them), with windows 1, share 1 and kind ``exact``; null items and such without a token leak
    nowhere. Null and empty texts leak nothing. Equal rows are judged and returned each for itself; items with equal ids
    are items of their own and may give a row each. Other columns are ignored; a text is held whole with its tokens, however
    long, but texts are worked on about a megabyte at a time.
    """
    items = durable(template_windows(benchmark, item_col, item_text_col, n))
    lengths = [r["size"] for r in items.filter("size is not null").select("size").distinct().collect()]  # as many as short items' lengths differ
    at = items.select(F.pmod("h", F.lit(BITMAP)).alias("at"))
    bits = np.zeros(BITMAP // 8, dtype=np.uint8)
    for r in at.groupBy(F.floor(F.col("at") / 32768).alias("slot")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits")).collect():  # 256 rows of 4 KB at most
        bits[r["slot"] * 4096 : (r["slot"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    by_hash = items.groupBy("h").agg(F.collect_list(F.struct(F.col("row").alias("item_row"), F.col("id").alias("item"), F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), F.col("size").alias("item_size"))).alias("items"))
    windows = durable(template_windows(docs, id_col, text_col, n, bits, lengths))
    found = join_unskewed(windows, by_hash, ["h"]).select("*", F.explode("items").alias("x")).select("row", "id", "key", "pos", "slots", "size", "x.*").filter(F.col("size").eqNullSafe(F.col("item_size")))
    totals = items.groupBy(F.col("row").alias("item_row")).agg(F.countDistinct("pos").alias("total"))
    pairs = F.arrays_zip(F.col("item_slots").alias("want"), F.col("slots").alias("have"))
    whose = ["row", "id", "key", "item_row", "item"]
    aligned = found.groupBy(*whose, (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.collect_set("item_pos").alias("places"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("slots"))
    steady = aligned.filter(F.size(F.array_distinct(F.transform("slots", lambda s: s["want"]))) == F.size("slots"))
    steady = steady.withColumn("same", ~F.exists("slots", lambda s: s["want"] != s["have"]))
    all_places = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    held = steady.groupBy(*whose).agg(all_places(F.col("places")).cast("long").alias("windows"), all_places(F.when(F.col("same"), F.col("places"))).alias("exact"))
    judged = held.join(totals, "item_row").withColumn("share", F.col("windows") / F.col("total")).filter(F.col("share") >= min_share)
    kind = F.when(F.col("exact") == F.col("windows"), "exact").otherwise("reparameterised")
    return judged.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "windows", "share", kind.alias("kind"), F.col("key").alias("text_key"))
