"""Stupid-backoff language-model scores of documents, from n-gram counts of the whole corpus.

The n-grams of every document are counted in hash buckets (each bucket holds its part of the count table of every order),
joined back to the n-grams of the documents and summed per document. A document's own n-grams are taken off the counts, so
it is judged by the rest of the corpus. Runs of distinct n-grams and their counts travel instead of one row an n-gram, see
packs. An n-gram of three or more words is only sent where other rows hold both of its parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packs import PACK_BYTES, Words, bucket_count, decode, decode_sorted, encode, encode_sorted, pack_documents, slices, unpack

_RUN = "bucket int, pack long, n int, hashes binary, counts binary"


def stupid_backoff(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, alpha: float = 0.4, pack_bytes: int = 2 * PACK_BYTES) -> DataFrame:
    """(id, n_words long, score_micro long, n_backed_off long) for each row.

    score_micro is the sum over the text's words of round(10**6 * log10 S), S being the stupid-backoff score of the word
    after at most order-1 words of the same text: count(n-gram) / count(context) for the longest n-gram that the *other*
    rows hold, times alpha for each order given up; a word that no other row has scores alpha / (words of other rows), at
    least 1, times alpha for each order given up. Words are runs of bytes other than space and \\x09-\\x0D, unchanged.
    n_backed_off counts words not scored by their longest n-gram. Null and empty texts: 0 words, score 0. Rows with the
    same or a null id are documents of their own; other columns, whatever their names, are ignored. A text longer than a pack has
    a pack of its own, which one task holds. An empty table gives an empty table.
    """
    packs = pack_documents(docs, [id_col, text_col], text_col, pack_bytes)
    n_buckets = bucket_count(packs)

    def total_words(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(Words(unpack(b.as_buffer())[text_col]).hashes) for b in batch.column("blob")], pa.int64())})

    total = packs.select("blob").mapInArrow(total_words, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0

    def others(words: Words, answers: list[tuple], known: int) -> np.ndarray:
        """(order, first word) -> how often the other rows hold the n-gram, for orders up to known."""
        doc = np.repeat(np.arange(len(words.firsts) - 1), np.diff(words.firsts)).astype(np.uint64)
        out = np.zeros((order + 2, len(words.hashes) + order), dtype=np.int64)
        for n in range(1, known + 1):
            at, hashes = candidates(words, n, out)
            if len(at):
                _, where = np.unique(hashes, return_inverse=True)
                totals = np.concatenate([decode(x) for m, _, x in answers if m == n]).astype(np.int64)
                _, own, times = np.unique(hashes + doc[at] * np.uint64(0x9E3779B97F4A7C15), return_inverse=True, return_counts=True)
                out[n, at] = totals[where] - times[own]
        return out

    def candidates(words: Words, n: int, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words and fingerprints of the n-grams that other rows may hold: from order 3 on only those whose two parts
        of n-1 words they hold."""
        at, hashes = words.windows(n, salt=n)
        if n >= 3:
            may = (shared[n - 1, at] > 0) & (shared[n - 1, at + 1] > 0)
            at, hashes = at[may], hashes[may]
        return at, hashes

    def runs(pack: int, words: Words, n: int, shared: np.ndarray) -> pa.RecordBatch:
        hashes, counts = np.unique(candidates(words, n, shared)[1], return_counts=True)
        cut = slices(hashes, n_buckets, 64)
        return pa.RecordBatch.from_pydict(
            {
                "bucket": pa.array([b for b, _, _ in cut], pa.int32()),
                "pack": pa.array([pack] * len(cut), pa.int64()),
                "n": pa.array([n] * len(cut), pa.int32()),
                "hashes": pa.array([encode_sorted(hashes[i:j]) for _, i, j in cut], pa.binary()),
                "counts": pa.array([encode(counts[i:j].astype(np.uint64)) for _, i, j in cut], pa.binary()),
            }
        )

    def count(batches):
        """The runs of orders 1 and 2."""
        for batch in batches:
            for pack, blob in zip(batch.column("pack").to_pylist(), batch.column("blob"), strict=True):
                words = Words(unpack(blob.as_buffer())[text_col])
                for n in range(1, min(order, 2) + 1):
                    yield runs(pack, words, n, np.zeros((1, 0)))

    def answered(found: pa.Table) -> list[tuple]:
        return sorted(zip(found["n"].to_pylist(), found["bucket"].to_pylist(), found["totals"].to_pylist(), strict=True), key=lambda x: x[:2])

    def count_next(n: int):
        def f(packed: pa.Table, found: pa.Table) -> pa.Table:
            words = Words(unpack(packed["blob"][0].as_buffer())[text_col])
            return pa.Table.from_batches([runs(packed["pack"][0].as_py(), words, n, others(words, answered(found), n - 1))])

        return f

    def add(sent_runs: pa.Table) -> pa.Table:
        orders = sent_runs["n"].to_numpy()
        out: list[tuple] = []
        for n in np.unique(orders).tolist():
            own = sent_runs.filter(pa.array(orders == n))
            sent = [decode_sorted(x) for x in own["hashes"].to_pylist()]
            hashes, where = np.unique(np.concatenate(sent), return_inverse=True)
            sums = np.zeros(len(hashes), dtype=np.uint64)
            np.add.at(sums, where, np.concatenate([decode(x) for x in own["counts"].to_pylist()]))
            ends = np.cumsum([len(x) for x in sent])
            out += [(p, n, b, encode(sums[where[e - len(x) : e]])) for p, b, x, e in zip(own["pack"].to_pylist(), own["bucket"].to_pylist(), sent, ends.tolist(), strict=True)]
        return pa.table({"pack": pa.array([x[0] for x in out], pa.int64()), "n": pa.array([x[1] for x in out], pa.int32()), "bucket": pa.array([x[2] for x in out], pa.int32()), "totals": pa.array([x[3] for x in out], pa.binary())})

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("n_words", "score_micro", "n_backed_off"))])

    def score(packed: pa.Table, found: pa.Table) -> pa.Table:
        rows = unpack(packed["blob"][0].as_buffer())
        words = Words(rows[text_col])
        size = np.diff(words.firsts)
        n_words = len(words.hashes)
        shared = others(words, answered(found), order)
        place = np.arange(n_words) - np.repeat(words.firsts[:-1], size)
        rest = (total - np.repeat(size, size)).astype(np.float64)
        top = np.minimum(place + 1, order)  # the longest n-gram that ends here
        value = alpha ** top.astype(np.float64) / np.maximum(rest, 1)
        got = np.zeros(n_words, dtype=np.int64)
        for n in range(1, order + 1):
            start = np.arange(n_words) - (n - 1)
            seen = (top >= n) & (shared[n, start] > 0)
            context = rest if n == 1 else shared[n - 1, start].astype(np.float64)
            value[seen] = alpha ** (top[seen] - n).astype(np.float64) * (shared[n, start][seen] / context[seen])
            got[seen] = n
        micro = np.rint(1e6 * np.log10(value)).astype(np.int64)
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[words.firsts])
        return pa.table({id_col: rows[id_col], "n_words": pa.array(size, pa.int64()), "score_micro": pa.array(sums(micro), pa.int64()), "n_backed_off": pa.array(sums((got < top).astype(np.int64)), pa.int64())})

    blobs = packs.select("pack", "blob")
    table = "pack long, n int, bucket int, totals binary"
    totals = blobs.mapInArrow(count, _RUN).groupBy("bucket").applyInArrow(add, table)
    for n in range(3, order + 1):
        more = blobs.groupBy("pack").cogroup(totals.groupBy("pack")).applyInArrow(count_next(n), _RUN)
        totals = totals.unionByName(more.groupBy("bucket").applyInArrow(add, table))
    return blobs.groupBy("pack").cogroup(totals.groupBy("pack")).applyInArrow(score, schema)
