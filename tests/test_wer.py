"""Edit distances against the plain table."""

from __future__ import annotations

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from speechloom.operators import wer as W


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], min(before + (x != y), row[j] + 1, row[j + 1] + 1)
    return row[-1]


def word_pairs(n, sizes, seed=1, letters="abcdefgh"):
    rng = random.Random(seed)
    some = lambda more: [rng.choice(letters + more) for _ in range(rng.choice(sizes))]
    return [(some(""), some("xyzü")) for _ in range(n)]


@pytest.mark.parametrize("sizes", [[0, 1, 2, 5, 20], [63, 64, 65], [0, 64, 130, 200], [1]])
def test_edit_distances(sizes):
    pairs = word_pairs(150, sizes)
    pairs += [(a, a) for a, _ in pairs[:9]] + [(["p"] * 3 + a + ["q"] * 70, ["p"] * 3 + b + ["q"] * 70) for a, b in pairs[:9]]
    lists = lambda i: pa.array([p[i] for p in pairs], pa.list_(pa.string()))
    want = [plain_distance(a, b) for a, b in pairs]
    assert W.edit_distances(lists(0), lists(1)).tolist() == want
    assert W.edit_distances(lists(0).slice(3, 40), lists(1).slice(3, 40)).tolist() == want[3:43]
    assert W.edit_distances(lists(0)[:0], lists(1)[:0]).tolist() == []


def test_ten_thousand_words():
    """Known by construction: words that occur nowhere else are substituted, left out and put in."""
    rng = np.random.default_rng(2)
    ref = rng.permutation(10_000)
    hyp = ref.copy()
    hyp[::10] = -1 - np.arange(1000)
    hyp = np.insert(np.delete(hyp, np.arange(5, 10_000, 1000)), np.arange(3, 9000, 900), 20_000)
    began = time.time()
    assert W.long_distance(ref, hyp) == 1000 + 10 + 10
    assert W.long_distance(ref, rng.permutation(10_000) + 10_000) == 10_000
    assert time.time() - began < 20
    a, b = rng.integers(0, 40, 700), rng.integers(0, 40, 650)
    assert W.long_distance(a, b) == plain_distance(a.tolist(), b.tolist())


def test_pair_errors(spark):
    rows = [(1, ["a", "b"], ["a"]), (2, [], ["x"]), (3, None, ["x"]), (4, ["x"], None), (5, [], []), (6, ["a"] * 100, ["a"] * 99 + ["b"]), (7, ["a", None], ["a", None]), (8, [None], ["a"])]
    got = W.pair_errors(spark.createDataFrame(rows, "id int, rw array<string>, hw array<string>").repartition(2)).collect()
    assert {r.id: (r.errs, r.ref_words) for r in got} == {1: (1, 2), 2: (1, 1), 3: (None, None), 4: (None, None), 5: (0, 1), 6: (1, 100), 7: (0, 2), 8: (1, 1)}
    scored = W.corpus_wer(W.pair_errors(spark.createDataFrame(rows, "id int, rw array<string>, hw array<string>")).withColumn("g", F.lit("x")), ["g"]).first()
    assert (scored.n, scored.errors, scored.words) == (8, 4, 107)
