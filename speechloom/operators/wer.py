"""Word error rates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUNCTUATION = r"""[!-/:-@\[-`{-~]"""
#: Cells of the tables of one batch of word_diff; a pair with more keeps only some rows of its table.
CELLS = 1 << 22
#: Pairs that a task holds the operations of at once.
PAIRS = 1 << 13


def wer_words(text: Column, mode: str = "plain") -> Column:
    """Words for scoring. ``plain``: lower case, split at white space; ``normalised``: punctuation removed before."""
    text = F.lower(F.coalesce(text, F.lit("")))
    if mode == "normalised":
        text = F.regexp_replace(text, PUNCTUATION, "")
    elif mode != "plain":
        raise ValueError(f"unknown mode {mode}")
    return F.filter(F.split(F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " ")), " "), lambda w: w != "")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two arrays of codes begin with alike."""
    n = min(len(a), len(b))
    unlike = np.flatnonzero(a[:n] != b[:n])
    return int(unlike[0]) if len(unlike) else n


def long_distance(ref: np.ndarray, hyp: np.ndarray) -> int:
    """The edit distance of two arrays of codes, bit by bit over the whole reference at once (Myers), in one large integer."""
    same = _common(ref, hyp)
    ref, hyp = ref[same:], hyp[same:]
    same = _common(ref[::-1], hyp[::-1])
    ref, hyp = ref[: len(ref) - same], hyp[: len(hyp) - same]
    n = len(ref)
    if not n or not len(hyp):
        return max(n, len(hyp))
    where: dict[int, int] = {}
    for i, code in enumerate(ref.tolist()):
        where[code] = where.get(code, 0) | 1 << i
    every, top = (1 << n) - 1, 1 << n - 1
    up, down, score = every, 0, n
    for code in hyp.tolist():
        equal = where.get(code, 0)
        across = ((((equal & up) + up) ^ up) | equal) & every
        rise, fall = down | (every & ~(across | up)), up & across
        score += bool(rise & top) - bool(fall & top)
        rise, fall = (rise << 1 | 1) & every, fall << 1 & every
        equal |= down
        up, down = fall | (every & ~(equal | rise)), rise & equal
    return score


def _short_distances(keys: np.ndarray, r_at: np.ndarray, r_size: np.ndarray, h_keys: np.ndarray, h_at: np.ndarray, h_size: np.ndarray) -> np.ndarray:
    """The same for many pairs at once, whose references have 1 to 64 words. Keys tell words and pairs apart."""
    one = np.uint64(1)
    whose = np.repeat(np.arange(len(r_at)), r_size)
    place = np.arange(len(whose)) - np.repeat(np.cumsum(r_size) - r_size, r_size)
    own = keys[r_at[whose] + place]
    order = np.argsort(own, kind="stable")
    known, first = np.unique(own[order], return_index=True)
    masks = np.append(np.bitwise_or.reduceat(one << place[order].astype(np.uint64), first), np.uint64(0))
    at = np.minimum(np.searchsorted(known, h_keys), len(known) - 1)
    equals = masks[np.where(known[at] == h_keys, at, len(known))]
    by_size = np.argsort(-h_size, kind="stable")
    top = one << (r_size[by_size] - 1).astype(np.uint64)
    up, down = np.full(len(top), np.uint64(2**64 - 1)), np.zeros(len(top), np.uint64)
    score, start = r_size[by_size].astype(np.int64), h_at[by_size]
    active = np.searchsorted(-h_size[by_size], -np.arange(int(h_size.max(initial=0))), side="left")
    for j, k in enumerate(active.tolist()):
        equal, u, d = equals[start[:k] + j], up[:k], down[:k]
        across = (((equal & u) + u) ^ u) | equal
        rise, fall = d | ~(across | u), u & across
        score[:k] += ((rise & top[:k]) != 0).astype(np.int64) - ((fall & top[:k]) != 0)
        rise, fall = rise << one | one, fall << one
        equal = equal | d
        up[:k], down[:k] = fall | ~(equal | rise), rise & equal
    out = np.empty(len(top), np.int64)
    out[by_size] = score
    return out


def edit_distances(refs: pa.ListArray, hyps: pa.ListArray) -> np.ndarray:
    """The edit distance of each pair of lists, in time of words times words / 64. Null lists count as empty, null words as
    one word."""
    (ra, rw), (ha, hw) = ((x.offsets.to_numpy().astype(np.int64), x.values) for x in (refs, hyps))
    coded = pa.concat_arrays([rw.cast(pa.string()), hw.cast(pa.string())]).dictionary_encode()
    codes = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
    r_codes, h_codes = codes[: len(rw)], codes[len(rw) :]
    r_size, h_size = np.diff(ra), np.diff(ha)
    out = np.where(r_size == 0, h_size, 0)
    short = np.flatnonzero((r_size > 0) & (r_size <= 64))
    if len(short):
        width = len(coded.dictionary) + 1
        keyed = lambda words, at, size: words + np.repeat(np.arange(len(size)), size) * width
        r_keys, h_keys = keyed(r_codes[ra[0] : ra[-1]], ra, r_size), keyed(h_codes[ha[0] : ha[-1]], ha, h_size)
        out[short] = _short_distances(r_keys, ra[short] - ra[0], r_size[short], h_keys, ha[short] - ha[0], h_size[short])
    for i in np.flatnonzero(r_size > 64).tolist():
        out[i] = long_distance(r_codes[ra[i] : ra[i + 1]], h_codes[ha[i] : ha[i + 1]])
    return out


@F.arrow_udf(T.LongType())
def word_distance(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """Edit distance of two word arrays of any length; null where either is."""
    none = pc.or_(pc.is_null(ref), pc.is_null(hyp))
    plain = lambda x: pa.ListArray.from_arrays(x.offsets, x.values)
    return pc.if_else(none, pa.scalar(None, pa.int64()), pa.array(edit_distances(plain(_compact(ref)), plain(_compact(hyp))), pa.int64()))


def _compact(lists: pa.Array) -> pa.ListArray:
    return pa.concat_arrays([lists.fill_null([])]).cast(pa.list_(pa.string()))


def pair_errors(pairs: DataFrame, ref: str = "rw", hyp: str = "hw") -> DataFrame:
    """Pairs of word arrays with errs and ref_words, the words that the pair counts for: at least one. Both are null where an
    array is."""
    rows = pairs.withColumn("errs", word_distance(F.col(ref), F.col(hyp)))
    return rows.withColumn("ref_words", F.when(F.col("errs").isNotNull(), F.greatest(F.size(ref), F.lit(1))).cast("long"))


def corpus_wer(scored: DataFrame, by: list[str]) -> DataFrame:
    """Micro word error rate of each group: summed errors over summed words of its pairs; pairs without errs count in n alone."""
    sums = scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("errs"), F.lit(0)).alias("errors"), F.coalesce(F.sum("ref_words"), F.lit(0)).alias("words"))
    return sums.withColumn("wer", F.col("errors") / F.greatest("words", F.lit(1)))


def running_wer(scored: DataFrame, run: str, batch: str) -> DataFrame:
    """The word error rate of each run after each batch."""
    per_batch = scored.groupBy(run, batch).agg(F.coalesce(F.sum("errs"), F.lit(0)).alias("e"), F.coalesce(F.sum("ref_words"), F.lit(0)).alias("w"))
    w = Window.partitionBy(run).orderBy(batch)
    return per_batch.select(run, batch, F.sum("e").over(w).alias("errors"), F.sum("w").over(w).alias("words")).withColumn("wer", F.col("errors") / F.greatest("words", F.lit(1)))


_MATCH, _SUB, _DEL, _INS = range(4)
_OPS = pa.array(["match", "sub", "del", "ins"])


def _rows(ref: np.ndarray, hyp: np.ndarray, above: np.ndarray, first: int, out: np.ndarray) -> None:
    """Fills out (steps, pairs, m + 1) with the rows of the edit tables that follow ``above``, that of number ``first``."""
    place = np.arange(hyp.shape[1] + 1)
    for k in range(len(out)):
        row = np.empty_like(above)
        row[:, 0] = first + k + 1
        np.minimum(above[:, :-1] + (hyp != ref[:, first + k, None]), above[:, 1:] + 1, out=row[:, 1:])
        above = np.minimum.accumulate(row - place, axis=1) + place  # an insertion costs one for each place
        out[k] = above


def align_words(ref: np.ndarray, ref_size: np.ndarray, hyp: np.ndarray, hyp_size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(operation or -1, word of ref, word of hyp), each (pairs, steps), of one shortest edit path of each pair of padded rows of
    word numbers. From the end, a match goes before a substitution before a deletion before an insertion.

    All pairs move together. Of the tables every so many rows are kept, and the rows between are worked out again when the path
    comes by, so memory grows with the square root of a pair's words times its words.
    """
    pairs, n = ref.shape
    m = hyp.shape[1]
    block = n + 1 if pairs * (n + 1) * (m + 1) <= CELLS else max(1, int(np.sqrt(n)))
    kept = [np.tile(np.arange(m + 1, dtype=np.int32), (pairs, 1))]
    table, base = np.empty((0, pairs, m + 1), np.int32), 0

    def rows(from_: int) -> np.ndarray:
        out = np.empty((min(block, n - from_ * block), pairs, m + 1), np.int32)
        _rows(ref, hyp, kept[from_], from_ * block, out)
        return np.concatenate([kept[from_][None], out])

    for b in range(-(-n // block)):
        table, base = rows(b), b * block
        kept.append(table[-1])
    if not len(table):
        table = kept[0][None]
    i, j, at = ref_size.astype(np.int64), hyp_size.astype(np.int64), np.arange(pairs)
    ops, refs, hyps = [], [], []
    while True:
        on = (i > 0) | (j > 0)
        if not on.any():
            break
        while base and (i[on] - 1).max() < base:  # the whole batch has left the block
            base -= block
            table = rows(base // block)
        here = on & (i - 1 >= base) if base else on
        a, c = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        row, up = np.clip(i - base, 0, len(table) - 1), np.clip(a - base, 0, len(table) - 1)
        cost, diagonal, above = table[row, at, j], table[up, at, c], table[up, at, j]
        both = (i > 0) & (j > 0)
        match = both & (ref[at, np.minimum(a, max(n - 1, 0))] == hyp[at, np.minimum(c, max(m - 1, 0))]) & (cost == diagonal) if n and m else both
        sub = both & ~match & (cost == diagonal + 1)
        gone = ~match & ~sub & (i > 0) & (cost == above + 1)
        op = np.where(match, _MATCH, np.where(sub, _SUB, np.where(gone, _DEL, _INS)))
        ops.append(np.where(here, op, -1))
        refs.append(a)
        hyps.append(c)
        i = i - (here & (op != _INS))
        j = j - (here & (op != _DEL))
    flip = lambda x: np.array(x[::-1], np.int64).reshape(len(x), pairs).T
    return flip(ops), flip(refs), flip(hyps)


def _bit_paths(ref: np.ndarray, ref_size: np.ndarray, hyp: np.ndarray, hyp_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(1 where a step takes a word of ref, plus 2 where it takes one of hyp, and 0 before the first; edit distance) of the paths of
    align_words, of padded rows whose references have up to 63 words; hypotheses come longest first.

    A column of a pair's edit table is two 64-bit numbers, of where it rises and falls (Myers). The path needs only where words
    are equal, where the table stays the same along its diagonal, and where it rises: two bits of a cell say which words it takes.
    """
    one = np.uint64(1)
    pairs, m = hyp.shape
    wide = np.pad(ref, ((0, 0), (0, 64 - ref.shape[1])), constant_values=-1)
    equals = np.packbits((hyp[:, :, None] == wide[:, None, :]).ravel(), bitorder="little").view("<u8").reshape(pairs, m).T
    stays, rises = np.empty((m, pairs), np.uint64), np.empty((m + 1, pairs), np.uint64)
    rises[0] = ~np.uint64(0)
    down = np.zeros(pairs, np.uint64)
    active = np.searchsorted(-hyp_size, -np.arange(m), side="left")
    for j, k in enumerate(active.tolist()):
        equal, u, d = equals[j, :k], rises[j, :k], down[:k]
        same = (((equal & u) + u) ^ u) | equal | d
        rise = (d | ~(same | u)) << one | one
        stays[j, :k], rises[j + 1, :k] = same, ((u & same) << one) | ~(same | rise)
        down[:k] = rise & same
    own = (one << ref_size.astype(np.uint64)) - one
    score = hyp_size + np.bitwise_count(rises[hyp_size, np.arange(pairs)] & own).astype(np.int64) - np.bitwise_count(down & own)
    takes = np.empty((m + 1, pairs, 2), np.uint64)  # a cell's row is the bit's number, so the first row has bit 0
    takes[0] = ~np.uint64(0) << one, 0
    either = equals | ~stays
    takes[1:, :, 0], takes[1:, :, 1] = (either | rises[1:]) << one, (either | ~rises[1:]) << one | one
    takes = takes.reshape(-1, 2).view(np.complex128).ravel()  # both at once
    i, cell = ref_size.astype(np.uint64), hyp_size * pairs + np.arange(pairs)
    steps = np.empty((int((ref_size + hyp_size).max(initial=0)), pairs), np.uint8)
    for step in range(len(steps)):
        took = takes[cell].view(np.uint64).reshape(-1, 2) >> i[:, None] & one
        steps[step] = took[:, 0] + (took[:, 1] << one)
        i -= took[:, 0]
        cell -= took[:, 1].view(np.int64) * pairs
        if step % 8 == 7 and not steps[step].any():
            steps = steps[: step + 1]
            break
    return steps[::-1].T, score


def _paths(r: np.ndarray, ra: np.ndarray, h: np.ndarray, ha: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(steps of all pairs one after the other, how many each has, edit distance of each) of the pairs of a batch: codes of words,
    and where each pair's begin and end. A step is 1 where it takes a word of the reference, plus 2 where it takes one of the other."""
    r_size, h_size = np.diff(ra), np.diff(ha)
    short, largest = r_size <= 63, np.maximum(r_size, h_size)
    order = np.lexsort((largest, ~short))
    n_short, r_padded, h_padded = int(short.sum()), np.append(r, -1).astype(np.int32), np.append(h, -2).astype(np.int32)
    errs, sizes, done, lo = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64), [], 0
    while lo < len(order):
        end = n_short if lo < n_short else len(order)
        cells = (np.maximum.accumulate(np.maximum(r_size[order[lo:end]], 63)) + 1) * (np.maximum.accumulate(h_size[order[lo:end]]) + 1) * np.arange(1, end - lo + 1)
        own = order[lo : lo + max(1, int(np.searchsorted(cells, CELLS, side="right")))]
        lo += len(own)
        own = own[np.argsort(-h_size[own], kind="stable")]
        padded = lambda codes, at, size: codes[np.where((p := np.arange(size[own].max(initial=0)))[None, :] < size[own][:, None], at[:-1][own][:, None] + p, len(codes) - 1)]
        sides = padded(r_padded, ra, r_size), r_size[own], padded(h_padded, ha, h_size), h_size[own]
        if lo <= n_short:
            steps, errs[own] = _bit_paths(*sides)
        else:
            op = align_words(*sides)[0]
            steps, errs[own] = np.where(op < 0, 0, (op != _INS) + 2 * (op != _DEL)).astype(np.uint8), (op > _MATCH).sum(1)
        real = steps > 0
        sizes[own] = real.sum(1)
        done.append((own, steps[real]))
    upto = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(upto[-1], np.uint8)
    for own, steps in done:
        n = sizes[own]
        out[np.repeat(upto[:-1][own] - (np.cumsum(n) - n), n) + np.arange(len(steps))] = steps
    return out, sizes, errs


_WORD = np.ones(256, bool)
_WORD[[*b" \t\n\r\f\x0b", *(c for c in range(33, 127) if not chr(c).isalnum())]] = False


def _cut(texts: pa.Array) -> tuple[np.ndarray, pa.StringArray]:
    """Lower-cased texts cut at white space and punctuation: (where each text's words begin and end, words)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    real = _WORD[data]
    begins, ends = real.copy(), real.copy()
    begins[1:] &= ~real[:-1]
    ends[:-1] &= ~real[1:]
    at = offsets[offsets < len(data)]  # a text's first letter begins a word, and the letter before ends one
    begins[at] = real[at]
    ends[at[at > 0] - 1] = real[at[at > 0] - 1]
    if len(data):
        ends[-1] = real[-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    spelt = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int32)
    return np.searchsorted(starts, offsets), pa.StringArray.from_buffers(len(starts), pa.py_buffer(spelt), pa.py_buffer(data[real]))


class _Diff:
    """The operations of the pairs of a batch, from where each side's words begin and end, and its words."""

    def __init__(self, ra: np.ndarray, ref: pa.StringArray, ha: np.ndarray, hyp: pa.StringArray) -> None:
        self.ref, self.hyp = ref, hyp
        coded = pa.concat_arrays([self.ref, self.hyp]).dictionary_encode()
        codes, self.words = coded.indices.to_numpy(), coded.dictionary
        self.r_codes, self.h_codes = codes[: len(self.ref)], codes[len(self.ref) :]
        steps, sizes, self.errs = _paths(self.r_codes, ra, self.h_codes, ha)
        self.upto, self.ref_words = np.concatenate([[0], np.cumsum(sizes)]), np.diff(ra)
        self.has_ref, self.has_hyp = (steps & 1).astype(bool), (steps & 2).astype(bool)
        self.r, self.h = np.cumsum(self.has_ref) - 1, np.cumsum(self.has_hyp) - 1  # a step takes the next word of its sides
        self.op = np.where(self.has_ref, np.where(self.has_hyp, _SUB, _DEL), _INS)
        both = np.flatnonzero(steps == 3)
        self.op[both[self.r_codes[self.r[both]] == self.h_codes[self.h[both]]]] = _MATCH

    def _side(self, words: pa.StringArray, at: np.ndarray, has: np.ndarray) -> pa.Array:
        return words.take(pa.array(np.where(has, at, 0), mask=~has)) if len(words) else pa.nulls(len(at), pa.string())

    def ops(self) -> pa.Array:
        steps = [_OPS.take(pa.array(self.op)), self._side(self.ref, self.r, self.has_ref), self._side(self.hyp, self.h, self.has_hyp)]
        return pa.ListArray.from_arrays(pa.array(self.upto, pa.int32()), pa.StructArray.from_arrays(steps, names=["op", "ref", "hyp"]))

    def said(self) -> list[pa.Array]:
        """ref_said, hyp_said and n_errors."""
        spelt = lambda words, at, has: pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has)])[self.upto], pa.int32()), words.take(pa.array(at[has]))), " ")
        errors = np.concatenate([[0], np.cumsum(self.op != _MATCH)])[self.upto]
        return [spelt(self.ref, self.r, self.has_ref), spelt(self.hyp, self.h, self.has_hyp), pa.array(np.diff(errors))]

    def counts(self) -> list[pa.Array]:
        """op, ref, hyp and n of the operations that are no match."""
        wrong, none = self.op != _MATCH, len(self.words)
        side = lambda codes, at, has: np.where(has[wrong], np.append(codes, none)[at[wrong]], none).astype(np.int64)
        key = (self.op[wrong] * np.int64(none + 1) + side(self.r_codes, self.r, self.has_ref)) * (none + 1) + side(self.h_codes, self.h, self.has_hyp)
        key, n = np.unique(key, return_counts=True)
        word = lambda at: self.words.take(pa.array(np.where(at < none, at, 0), mask=at == none)) if none else pa.nulls(len(at), pa.string())
        return [_OPS.take(pa.array(key // (none + 1) ** 2)), word(key // (none + 1) % (none + 1)), word(key % (none + 1)), pa.array(n)]


def _diffs(refs: pa.ListArray, hyps: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(ops, errs, ref_words) of the pairs of a batch of lists of words."""
    made = _Diff(*(x for side in (refs, hyps) for x in (side.offsets.to_numpy().astype(np.int64) - side.offsets[0].as_py(), side.flatten().cast(pa.string()))))
    return made.ops(), made.errs, made.ref_words


def _lowered(text: str) -> Column:
    """Punctuation parts words, which tells in lower case only where a sigma ends one."""
    text = F.coalesce(F.col(text), F.lit(""))
    return F.lower(F.when(F.contains(text, F.lit("Σ")), F.regexp_replace(text, PUNCTUATION, " ")).otherwise(text))


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, PAIRS):
            yield batch.slice(lo, PAIRS)


def word_diff(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp", keep: list[str] | None = None, spelt: bool = False) -> DataFrame:
    """Pairs, or their columns to ``keep``, with ops array<struct<op,ref,hyp>>, errs and ref_words; here punctuation becomes a space.
    Null texts have no words. ``spelt``: in place of ops what the operations say: ref_said and hyp_said, the words of either
    side, and n_errors, how many are no match."""
    kept = pairs.columns if keep is None else keep

    def diff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            made = _Diff(*_cut(batch.column("__r")), *_cut(batch.column("__h")))
            columns = [*batch.columns[:-2], *(made.said() if spelt else [made.ops()]), pa.array(made.errs), pa.array(made.ref_words)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *more, "errs", "ref_words"])

    more = {"ref_said": "string", "hyp_said": "string", "n_errors": "long"} if spelt else {"ops": "array<struct<op:string,ref:string,hyp:string>>"}
    rows = pairs.select(*kept, _lowered(ref).alias("__r"), _lowered(hyp).alias("__h"))
    kinds = dict(pairs.dtypes)
    return rows.mapInArrow(diff, ", ".join(f"`{c}` {t}" for c, t in ({c: kinds[c] for c in kept} | more | {"errs": "long", "ref_words": "long"}).items()))


def error_confusion(diffs: DataFrame) -> DataFrame:
    """How often each word stands for each other, from word_diff rows."""
    return diffs.select(F.explode("ops").alias("o")).filter("o.op != 'match'").groupBy("o.op", "o.ref", "o.hyp").agg(F.count(F.lit(1)).alias("n"))


def count_errors(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """error_confusion of the word_diff of pairs, counted in batches first, so that no operation becomes a row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            yield pa.RecordBatch.from_arrays(_Diff(*_cut(batch.column("__r")), *_cut(batch.column("__h"))).counts(), names=["op", "ref", "hyp", "n"])

    rows = pairs.select(_lowered(ref).alias("__r"), _lowered(hyp).alias("__h")).mapInArrow(count, "op string, ref string, hyp string, n long")
    return rows.groupBy("op", "ref", "hyp").agg(F.sum("n").alias("n"))


def error_browser(scored: DataFrame, query: str = "", mode: str = "all", sort: str = "index", k: int = 50, idx: str = "idx", ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """The first k pairs whose reference or hypothesis holds the query (any case); ``errors`` or ``perfect`` ones only; by index
    or by errors, most first."""
    rows = scored
    if query:
        rows = rows.filter(F.contains(F.lower(ref), F.lit(query.lower())) | F.contains(F.lower(hyp), F.lit(query.lower())))
    if mode != "all":
        rows = rows.filter({"errors": F.col("errs") > 0, "perfect": F.col("errs") == 0}[mode])
    order = [F.desc("errs"), F.asc(idx)] if sort == "errors" else [F.asc(idx)]
    return rows.orderBy(*order).limit(k)


def export_results(pairs: DataFrame, path: str, fmt: str = "csv", wer: float | None = None) -> None:
    """Writes idx, ref and hyp as csv, plain text or a markdown table, the last two after a line with the rate."""
    rows = pairs.select("idx", "ref", "hyp").orderBy("idx")
    if fmt == "csv":
        rows.write.option("header", True).option("escape", '"').csv(path)
        return
    head = "WER: " + ("n/a" if wer is None else f"{100 * wer:.2f}%")
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|")
    if fmt == "markdown":
        line, lead = F.concat(F.lit("| "), F.concat_ws(" | ", cell("idx"), cell("ref"), cell("hyp")), F.lit(" |")), [head, "", "| idx | ref | hyp |", "|---|---|---|"]
    elif fmt == "text":
        line, lead = F.concat(F.lit("["), F.col("idx"), F.lit("] REF: "), F.coalesce("ref", F.lit("")), F.lit("\n["), F.col("idx"), F.lit("] HYP: "), F.coalesce("hyp", F.lit(""))), [head]
    else:
        raise ValueError(f"unknown format {fmt}")
    spark = pairs.sparkSession
    top = spark.createDataFrame([(-len(lead) + i, t) for i, t in enumerate(lead)], "i long, value string")
    top.unionByName(rows.select(F.col("idx").cast("long").alias("i"), line.alias("value"))).orderBy("i").select("value").write.text(path)


