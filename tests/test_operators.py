"""Invariants and hand-computed cases of operators that SQL can't express."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from speechloom.operators import alignment as L
from speechloom.operators import batching as B
from speechloom.operators import cuts
from speechloom.operators import distribute as D
from speechloom.operators import metrics as M
from speechloom.operators import order
from speechloom.operators import packing as P
from speechloom.operators import plugins as G
from speechloom.operators import sequences as S
from speechloom.operators import wer as W
from speechloom.operators.order import exact_percentiles, global_index, global_shuffle
from speechloom.schemas import ALIGNMENT
from speechloom.sources import files
from speechloom.streaming import jobs


def lengths(spark, n=300, seed=1, top=130):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, rng.randrange(0, top), i) for i in range(n)], "id long, len long, idx long")


def naive_knapsack(items, cutoff):
    """Again and again the largest that fits; of equal ones that with the highest index."""
    left, bins = sorted((n, i) for i, n in items if 0 < n <= cutoff), []
    while left:
        room, own = cutoff, []
        while fits := [x for x in left if x[0] <= room]:
            own.append(fits[-1])
            left.remove(fits[-1])
            room -= fits[-1][0]
        bins.append([i for _, i in own])
    return bins


def bins_of(plan):
    out = defaultdict(list)
    for r in plan.collect():
        out[(r.bucket, r.bin_no)].append((r.seq_no, r.id, r.len))
    assert all([s for s, _, _ in sorted(v)] == list(range(len(v))) for v in out.values())
    return {k: [i for _, i, _ in sorted(v)] for k, v in out.items()}


def test_knapsack(spark):
    rows = lengths(spark)
    items = [(r.id, r.len) for r in rows.collect()]
    got = bins_of(P.pack_knapsack(rows, 100, bucket=60))
    for b in range(5):
        assert [got[k] for k in sorted(got) if k[0] == b] == naive_knapsack(items[60 * b : 60 * b + 60], 100)
    whole = bins_of(P.pack_knapsack(rows, 100, bucket=None))
    assert [whole[k] for k in sorted(whole)] == naive_knapsack(items, 100)
    again = bins_of(P.pack_knapsack(rows.repartition(7), 100, bucket=None))
    assert again == whole


def test_first_fit(spark):
    rows = lengths(spark)
    items = [(r.id, r.len) for r in rows.collect() if 0 < r.len <= 100]
    bins = []
    for i, n in sorted(items, key=lambda x: -x[1]):
        for b in bins:
            if b[0] + n <= 100:
                b[0] += n
                b[1].append(i)
                break
        else:
            bins.append([n, [i]])
    got = bins_of(P.pack_first_fit(rows, 100, bucket=1000))
    assert [got[k] for k in sorted(got)] == [b[1] for b in bins]


def test_materialise_and_drop(spark):
    rng = random.Random(2)
    rows = [(i, i, [i * 100 + k for k in range(n)], [-100] * (n // 2) + [7] * (n - n // 2), n % 5, n) for i, n in enumerate(rng.randrange(1, 30) for _ in range(40))]
    seqs = spark.createDataFrame(rows, "id long, idx long, input_ids array<int>, labels array<int>, feat_len int, len long")
    bins = P.materialise_bins(P.pack_knapsack(seqs.select("id", "idx", "len"), 64, bucket=None), seqs, 64, feat_len="feat_len")
    seen = Counter()
    for b in bins.collect():
        assert len(b.input_ids) == len(b.labels) == len(b.attention_mask) == 64
        real = [m for m in b.attention_mask if m]
        assert b.attention_mask[len(real) :] == [0] * (64 - len(real)) and sorted(set(real)) == list(range(1, b.n_seqs + 1))
        assert all(x == -100 for x, m in zip(b.labels, b.attention_mask, strict=True) if not m)
        seen.update(t // 100 for t, m in zip(b.input_ids, b.attention_mask, strict=True) if m)
    assert seen == Counter({r[0]: r[5] for r in rows})
    kept = Counter()
    for b in P.drop_short_clips(bins, 2).collect():
        assert all(n >= 2 for n in b.audio_lengths) and len(b.input_ids) == 64 and max(b.attention_mask) == len(b.audio_lengths)
        kept.update(t // 100 for t, m in zip(b.input_ids, b.attention_mask, strict=True) if m)
    assert kept == Counter({r[0]: r[5] for r in rows if r[4] >= 2})
    flat = P.materialise_bins(P.pack_knapsack(seqs.select("id", "idx", "len"), 64), seqs, 64, neat=False)
    assert flat.agg(F.max(F.array_max("attention_mask"))).first()[0] == 1


def scanned(sizes, limit, rule):
    """Batch numbers of a scan through the rows one by one."""
    out, no, held = [], 0, []
    for size in (max(1, x or 1) for x in sizes):
        over = {"sum": sum(held) + size > limit, "padded": (len(held) + 1) * max([*held, size]) > limit, "reach": sum(held) >= limit}[rule]
        if held and over:
            no, held = no + 1, []
        held.append(size)
        out.append(no)
    return out


@pytest.mark.parametrize("rule", ["sum", "padded", "reach"])
def test_next_starts(rule):
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.choice([1, 2, 3, rng.randrange(1, 40), 500]) for _ in range(rng.randrange(1, 60))]
        before = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        following = cuts.next_starts(rule, 60, before, np.array(sizes))
        for i in range(len(sizes)):
            numbers = scanned(sizes[i:], 60, rule)
            assert following[i] == i + numbers.count(0)


@pytest.mark.parametrize("rule", ["sum", "padded", "reach"])
@pytest.mark.parametrize(("range_rows", "parts"), [(1, 1), (7, 5), (1 << 16, 3)])
def test_greedy_cuts(spark, monkeypatch, rule, range_rows, parts):
    """Batches are those of a sequential scan, whatever the ranges and partitions, with rows of many times the limit and no size."""
    monkeypatch.setattr(cuts, "RANGE_ROWS", range_rows)
    rng = random.Random(range_rows)
    lanes = {lane: [rng.choice([None, 0, 1, 3, rng.randrange(1, 30), rng.randrange(1, 30), rng.choice([50, 700])]) for _ in range(n)] for lane, n in ((0, 400), (3, 1), (5, 90))}
    lanes[9] = [4] * 200  # starts that never meet
    rows = [(lane, i, size) for lane, sizes in lanes.items() for i, size in enumerate(sizes)]
    df = spark.createDataFrame(rows, "lane long, pos long, size int").repartition(parts)
    got = {(r.lane, r.pos): r.batch_no for r in cuts.greedy_cuts(df, "lane", ["pos"], "size", 50, rule).collect()}
    assert got == {(lane, i): no for lane, sizes in lanes.items() for i, no in enumerate(scanned(sizes, 50, rule))}


def test_short_lanes_are_scanned_together():
    """Lanes of one frame, in any order of its rows, are as if each were alone; a lane may be 0 or below."""
    rng = random.Random(3)
    lanes = {lane: [rng.randrange(1, 30) for _ in range(rng.randrange(1, 40))] for lane in range(-20, 20)}
    rows = [(lane, sum(sizes[:i]), size) for lane, sizes in lanes.items() for i, size in enumerate(sizes)]
    rng.shuffle(rows)
    for rule in cuts.RULES:
        got = cuts._whole_lanes(rule, 50, "no")(pd.DataFrame(rows, columns=["__lane", "__before", "__size"]))
        want = {(lane, sum(sizes[:i])): no for lane, sizes in lanes.items() for i, no in enumerate(scanned(sizes, 50, rule))}
        assert {(r[0], r[1]): r[2] for r in got.itertuples(index=False)} == want


def test_greedy_cuts_of_nothing(spark):
    empty = spark.createDataFrame([], "lane long, pos long, size int")
    assert cuts.greedy_cuts(empty, "lane", ["pos"], "size", 5, "sum").collect() == []
    with pytest.raises(ValueError):
        cuts.greedy_cuts(empty, "lane", ["pos"], "size", 0, "sum")


@pytest.mark.parametrize("mode", ["padded", "sum", "sorted"])
def test_token_budget(spark, monkeypatch, mode):
    monkeypatch.setattr(cuts, "RANGE_ROWS", 20)
    rows = lengths(spark, top=60).withColumn("rank", F.col("id") % 2)
    got = B.token_budget_batches(rows, 200, mode, mult=15, lane="rank")
    assert got.columns == ["rank", "id", "len", "bucket", "batch_no", "place"]
    buckets, ranks = defaultdict(list), defaultdict(list)
    for r in got.collect():
        buckets[r.rank, r.bucket].append((r.place, r.len, r.batch_no, r.id))
        ranks[r.rank].append((r.len, r.id, r.bucket))
    longest = max(x[0] for v in ranks.values() for x in v)
    for v in ranks.values():
        assert [b for *_, b in sorted(v)] == ([i // (200 // longest * 15) for i in range(150)] if mode == "padded" else [0] * 150)
    for v in buckets.values():
        v.sort()
        assert [x[0] for x in v] == list(range(len(v)))
        assert [x[2] for x in v] == scanned([x[1] for x in v], 200, "sum" if mode == "sum" else "padded")
        assert ([x[1] for x in v] == sorted(x[1] for x in v)) == (mode == "sorted")
    again = B.token_budget_batches(rows.repartition(7), 200, mode, mult=15, lane="rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
    kept = B.token_budget_batches(rows, 200, mode, mult=15, lane="rank", min_size=4).groupBy("rank", "bucket", "batch_no").count().collect()
    sizes = [n for v in buckets.values() for n in Counter(x[2] for x in v).values()]
    assert sorted(r["count"] for r in kept) == sorted(n for n in sizes if n >= 4)


def test_deal_batches(spark):
    batches = B.token_budget_batches(lengths(spark, top=60), 200, mult=15)
    n = batches.select("bucket", "batch_no").distinct().count()
    dealt = B.deal_batches(batches, 7, seed=4).collect()
    assert len(dealt) == -(-n // 7) * 7 and len({(r.bucket, r.batch_no) for r in dealt}) == n
    assert Counter(r.replica for r in dealt) == {i: -(-n // 7) for i in range(7)} and all((r.idx % 7, r.idx // 7) == (r.replica, r.turn) for r in dealt)
    first = {r.idx: (r.bucket, r.batch_no) for r in dealt}
    assert all(first[i] == first[i - n] for i in range(n, len(dealt)))


def test_bucket_batches_drop_last(spark):
    rows = lengths(spark, n=105).drop("idx")
    assert {r["count"] for r in B.bucket_batches(rows, 10, 3, drop_last=True).groupBy("batch_id").count().collect()} == {10}
    assert B.bucket_batches(rows, 10, 3).count() == 105


def test_index_and_shuffle(spark):
    rows = lengths(spark)
    assert [r.k for r in global_index(rows, "len", ["id"], "k").orderBy("len", "id").collect()] == list(range(300))
    a, b = ({r.id: r.p for r in global_shuffle(x, 5, "id", "p").collect()} for x in (rows, rows.repartition(9)))
    assert a == b and sorted(a.values()) == list(range(300)) and a != {i: i for i in a}
    assert global_index(rows.limit(0), "len").collect() == []


def test_shard_sizes(spark):
    rows = lengths(spark)
    sizes = [r["count"] for r in D.shard_balanced(rows, 7).groupBy("shard").count().orderBy("shard").collect()]
    assert sizes == [43] * 6 + [42]
    assert D.shard_balanced(rows.limit(3), 10).select("shard").distinct().count() == 3
    ranked = rows.withColumn("rank", F.lit(0)).withColumn("pos", F.col("idx"))
    by_shard = D.shard_by_bytes(ranked, 1000, "len", step=10).groupBy("shard").agg(F.sum("len").alias("b")).orderBy("shard").collect()
    assert all(1000 <= r.b <= 1000 + 10 * 130 for r in by_shard[:-1]) and [r.shard for r in by_shard] == list(range(len(by_shard)))


def test_tag_spans_nested(spark):
    rows = spark.createDataFrame([([1, 1, 5, 2, 5, 2, 9],), ([1, 5, 5, 5, 5, 5, 5, 2],), ([2, 1, 2],)], "l array<int>")
    got = [r.m for r in rows.select(S.mask_tag_spans(F.col("l"), [1], 2).alias("m")).collect()]
    assert got == [[-100] * 6 + [9], [1, 5, 5, 5, 5, 5, 5, 2], [2, -100, -100]]


def test_word_diff(spark):
    rows = spark.createDataFrame([("a b c", "a x c d"), ("", "x"), ("Hi, you", "hi you"), ("a", ""), (None, None)], "ref string, hyp string")
    got = W.word_diff(rows).collect()
    assert [[o.op for o in r.ops] for r in got] == [["match", "sub", "match", "ins"], ["ins"], ["match", "match"], ["del"], []]
    assert [(r.errs, r.ref_words) for r in got] == [(2, 3), (1, 0), (0, 2), (1, 1), (0, 0)]
    pairs = rows.select(W.wer_words(F.col("ref"), "normalised").alias("rw"), W.wer_words(F.col("hyp"), "normalised").alias("hw"))
    assert [r.errs for r in W.pair_errors(pairs).collect()] == [2, 1, 0, 1, 0]


def test_weighted_loss(spark):
    rows = spark.createDataFrame([("a", 1.0, 1), ("a", 4.0, 2), ("a", float("nan"), 9), ("b", float("inf"), 3), ("a", None, 5)], "k string, loss double, n_tokens long")
    got = {r.k: r.loss for r in M.weighted_loss(rows, ["k"]).collect()}
    assert got["a"] == 3.0 and got["b"] != got["b"]
    assert {r.k: r.loss for r in M.weighted_loss(rows, ["k"], plain=True).collect()}["a"] == 2.5


def test_retokenise(spark):
    src = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, word string")
    dst = spark.createDataFrame([("a", [10]), ("b", [20, 21]), ("c", [30])], "word string, ids array<int>")
    bins = spark.createDataFrame([(0, [1, 151655, 2, 3, 0, 0], [-100, -100, 2, 3, -100, -100], [1, 1, 1, 2, 0, 0], "x"), (1, [2, 2, 2, 2], [2, 2, 2, 2], [1, 1, 1, 1], "y")], "bin int, input_ids array<int>, labels array<int>, attention_mask array<int>, extra string")
    made, dropped = S.retokenise_bins(bins, src, dst, 7)
    r = made.first()
    assert (r.input_ids, r.labels, r.attention_mask, r.extra) == ([10, 151655, 20, 21, 30, 0, 0], [-100, -100, 20, 21, 30, -100, -100], [1, 1, 1, 1, 2, 0, 0], "x")
    assert [(d.bin, d.len) for d in dropped.collect()] == [(1, 8)]


def test_pad_modes(spark):
    rows = spark.createDataFrame([(0, [5, 6, 7]), (0, [8])], "b int, ids array<int>")
    got = {m: [r.padded for r in S.pad_batch(rows, "b", m, most=3).orderBy(F.size("ids").desc()).collect()] for m in ("right", "eos_before", "eos_after", "left")}
    assert got == {"right": [[5, 6, 7], [8, 0, 0]], "eos_before": [[5, 6, 2], [8, 2, 0]], "eos_after": [[5, 6, 2], [8, 0, 2]], "left": [[5, 6, 7], [0, 0, 8]]}


def test_issues(spark):
    word = lambda w, a, b, s: {"word": w, "start": a, "end": b, "score": s}
    rows = [("a", "s", 1.0, [word("x", 0.0, 0.5, 0.9)]), ("b", None, 1.0, []), ("c", "s", 1.0, None), ("d", "s", 1.0, []), ("e", "s", 0.0, [word("x", 0.5, 0.1, 0.2), word(None, 0.0, 1.0, 0.9)])]
    df = spark.createDataFrame([dict(zip(("utterance_id", "split", "audio_duration", "words"), r, strict=True)) for r in rows], ALIGNMENT)
    got = {r.utterance_id: r.issues for r in L.validate_alignment(df, ["split"]).collect()}
    assert got == {"a": [], "b": ["missing field:split"], "c": ["words missing"], "d": ["words empty"], "e": ["word[0] end before start", "word[1] missing word", "low score", "bad duration"]}


def test_plugins(spark):
    rows = spark.createDataFrame([("a", "t", [1.0] * 40), ("b", "t", None), ("c", "t", [-1.0] * 20), ("d", "t", [])], "utterance_id string, text string, audio array<float>")

    def fussy():
        encode = G.framing_statistics(4, 10)

        def run(batch):
            if len(batch) > 1:
                raise MemoryError("too large")
            if batch[0][0] < 0:
                raise ValueError("negative")
            return encode(batch)

        return run

    got = {r.utterance_id: (r.feat_len, r.error) for r in G.featurise(rows, fussy).collect()}
    assert got == {"a": (4, None), "b": (0, "empty"), "c": (0, "ValueError: negative"), "d": (0, "empty")}
    texts = spark.createDataFrame([("a", "one three", 2.0), ("b", " ", 1.0), ("c", None, 1.0)], "utterance_id string, transcript string, audio_duration double")
    aligned = {r.utterance_id: r for r in G.align_batches(texts).collect()}
    assert [(w.start, w.end) for w in aligned["a"].words] == [(0.0, 0.75), (0.75, 2.0)] and aligned["b"].error == aligned["c"].error == "empty transcript"


def test_files(spark, tmp_path):
    folder = tmp_path / "dev" / "12" / "34"
    folder.mkdir(parents=True)
    (folder / "12-34.trans.txt").write_text("12-34-0 HELLO  WORLD\n\n12-34-1 X\n12-34-2\n")
    (folder / "12-34-0.flac").write_bytes(b"abc")
    manifest = files.read_transcripts(spark, str(tmp_path), ["dev"])
    rows = {r.utterance_id: r for r in manifest.collect()}
    assert sorted(rows) == ["12-34-0", "12-34-1", "12-34-2"] and rows["12-34-0"].transcript == "hello  world" and rows["12-34-2"].transcript == "" and rows["12-34-1"].speaker_id == "12"
    assert [r.utterance_id for r in files.keep_existing_files(manifest, files.list_files(spark, str(tmp_path), "*.flac")).collect()] == ["12-34-0"]
    bundle = files.ingest_audio_bundle(spark, str(tmp_path), manifest)
    assert [(r.utterance_id, bytes(r.audio.bytes)) for r in bundle.collect()] == [("12-34-0", b"abc")]
    files.write_bundle(bundle, str(tmp_path / "bundle"))
    assert spark.read.parquet(str(tmp_path / "bundle")).count() == 1

    (tmp_path / "json" / "a").mkdir(parents=True)
    (tmp_path / "json" / "a" / "1.json").write_text('{"utterance_id": "u1", "audio_duration": 1, "words": [{"word": "x", "start": 0, "end": 1}]}')
    (tmp_path / "json" / "2.json").write_text("{broken")
    good, bad = files.merge_json_records(spark, str(tmp_path / "json"), ALIGNMENT)
    assert [(r.utterance_id, r.words[0].score) for r in good.collect()] == [("u1", None)] and bad.count() == 1

    some = spark.range(25).withColumn("shard_key", F.col("id"))
    files.to_columnar(some.coalesce(1), str(tmp_path / "col"), 10)
    assert len(list((tmp_path / "col").glob("*.parquet"))) == 3
    located = files.locate_rows(spark, [str(tmp_path / "col")], "id")
    assert located.select("file").distinct().count() == 3 and located.agg(F.max("row")).first()[0] == 9
    assert files.fetch_rows(spark, [str(tmp_path / "col")], "id", some.filter("id < 3")).count() == 3
    D.write_partitioned_shards(global_index(some, "id"), 4, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).filter("shard = 1").count() == 6
    for _ in range(2):
        files.append_rows(some.limit(2), str(tmp_path / "log"))
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 4


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a|b", 'say "x"\ny'), (0, "c", None)], "idx int, ref string, hyp string")
    W.export_results(rows, str(tmp_path / "md"), "markdown", 0.5)
    lines = [r.value for r in spark.read.text(str(tmp_path / "md")).collect()]
    assert lines[0] == "WER: 50.00%" and any(r"a\|b" in x for x in lines)
    W.export_results(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert {r.ref: r.hyp for r in back.collect()} == {"a|b": 'say "x"\ny', "c": None}
    W.export_results(rows, str(tmp_path / "txt"), "text", 0.25)
    assert "REF: a|b" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "txt")).collect())


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(i, " ".join(["w"] * (i % 40)), "en") for i in range(300)], "doc_id long, text string, lang string")
    rows.repartition(6).write.parquet(str(tmp_path / "in"))
    source = jobs.read_stream(spark, str(tmp_path / "in"), rows.schema, files_per_trigger=2)
    seqs = jobs.stream_prepare(source).select("doc_id", "len")
    full = jobs.run_available(jobs.stream_pack(seqs, 64, 20, lanes=2), str(tmp_path / "cp")).collect()
    held = jobs.pack_held(spark, str(tmp_path / "cp/checkpoint"), 64).collect()
    assert 0 < len(held) < 2 * 20 and len(full) % 20 == 0  # whole buckets only, over three micro-batches
    assert sorted(r.doc_id for r in full + held) == [i for i in range(300) if i % 40]
    fill = Counter()
    for r in full + held:
        fill[(r.lane, r.bin_id)] += r.len
    assert max(fill.values()) <= 64 and all(sorted(b for lane_, b in fill if lane_ == lane) == list(range(sum(lane_ == lane for lane_, _ in fill))) for lane in (0, 1))


def test_unknown_names(spark):
    with pytest.raises(ValueError):
        M.select_datasets(spark.createDataFrame([("x",)], "dataset string"), ["y"], ["x"])
    with pytest.raises(ValueError):
        D.data_split(spark.range(3), 3, 3, idx="id")


def test_downmix(spark):
    from speechloom.functions.audio import downmix

    rows = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0]],), ([[1.0, 2.0]],), ([[3.0], [6.0], [0.0]],)], "c array<array<float>>")
    assert [r.m for r in rows.select(downmix(F.col("c")).alias("m")).collect()] == [[2.0, 4.0], [1.0, 2.0], [3.0]]


def test_index_of_any_key(spark):
    keys = ["zeta", "alpha", "0x", "Zed", "gamma", "utt-1", "beta", None, "", "é"]
    got = [r.k for r in global_index(spark.createDataFrame([(k,) for k in keys], "k string"), "k").orderBy("idx").collect()]
    assert got == [None, *sorted(k for k in keys if k is not None)]
    zipf = spark.range(3000).select("id", (F.lit(3000) / (F.col("id") + 1)).cast("long").alias("n"))
    want = sorted((3000 // (i + 1), i) for i in range(3000))
    assert [(r.n, r.id) for r in global_index(zipf, "n", ["id"], ranges=7).orderBy("idx").collect()] == want
    same = global_index(spark.range(1_000_000).withColumn("k", F.lit(1)), "k", ["id"])
    assert same.filter("idx != id").isEmpty() and same.count() == 1_000_000


def test_ranked(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") > 3, F.col("id") % 3).alias("rank"))
    got = D.ranked(rows, "rank", "id").groupBy("rank").agg(F.sort_array(F.collect_list("pos")).alias("p")).collect()
    assert {r["rank"]: r.p == list(range(len(r.p))) for r in got} == {None: True, 0: True, 1: True, 2: True}


@pytest.mark.parametrize("bins", [2, 7, 1 << 12])
def test_percentiles(spark, monkeypatch, bins):
    """Equal to numpy's at any number of bins, for ties, far outliers, neighbouring doubles, single values and a null group."""
    monkeypatch.setattr(order, "BINS", bins)
    rng = np.random.default_rng(4)
    near = [1.7e9 + i * 2.0**-22 for i in range(60)]
    kinds = {"a": rng.integers(0, 50, 999), "b": rng.normal(size=400), "far": [*rng.normal(size=50), 1e300, -1e300], "near": near, "two": [1.0] * 50 + [2.0] * 50}
    rows = [(g, float(x)) for g, xs in kinds.items() for x in xs] + [("c", 7.0), ("c", None), (None, 1.0), (None, 2.0), ("odd", float("nan")), ("odd", float("inf")), ("odd", 3.0), ("none", None)]
    got = {r.g: (r.n, r.p) for r in exact_percentiles(spark.createDataFrame(rows, "g string, v double").repartition(3), ["g"], "v", [0.0, 0.05, 0.5, 0.95, 1.0]).collect()}
    for g in (*kinds, "c", None, "odd"):
        own = [v for k, v in rows if k == g and v is not None and np.isfinite(v)]
        assert got[g][0] == len(own) and got[g][1] == pytest.approx(list(np.percentile(own, [0, 5, 50, 95, 100])), rel=1e-12, abs=1e-12)
    assert "none" not in got
    assert exact_percentiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", [0.5]).collect() == []


def test_percentiles_of_counted_values(spark):
    """A row that counts many times is as many rows."""
    rng = np.random.default_rng(5)
    rows = [(g, float(v), int(rng.integers(1, 9))) for g in "ab" for v in range(40)]
    got = {r.g: (r.n, r.p) for r in exact_percentiles(spark.createDataFrame(rows, "g string, v double, w long"), ["g"], "v", [0.05, 0.5, 0.95], "w").collect()}
    for g in "ab":
        own = [v for k, v, w in rows if k == g for _ in range(w)]
        assert got[g][0] == len(own) and got[g][1] == pytest.approx(list(np.percentile(own, [5, 50, 95])))


def test_empty_references_count_a_word(spark):
    pairs = spark.createDataFrame([("g", [], ["x", "y"]), ("g", ["a"], ["a"]), ("h", [], [])], "g string, rw array<string>, hw array<string>")
    got = {r.g: (r.n, r.errors, r.words, r.wer) for r in W.corpus_wer(W.pair_errors(pairs), ["g"]).collect()}
    assert got == {"g": (2, 2, 2, 1.0), "h": (1, 0, 1, 0.0)}


def test_many_distinct_words(spark):
    many = [f"w{i}" for i in range(40_000)]
    rows = spark.createDataFrame([(many[:3000], [*many[:1500], "x", *many[1501:3000]]), (many, many)], "rw array<string>, hw array<string>")
    assert sorted((r.errs, r.ref_words) for r in W.pair_errors(rows).collect()) == [(0, 40_000), (1, 3000)]


def naive_path(ref, hyp):
    """One shortest path; from the end a match goes before a substitution before a deletion before an insertion."""
    cost = {(i, 0): i for i in range(len(ref) + 1)} | {(0, j): j for j in range(len(hyp) + 1)}
    for i in range(1, len(ref) + 1):
        for j in range(1, len(hyp) + 1):
            cost[i, j] = min(cost[i - 1, j - 1] + (ref[i - 1] != hyp[j - 1]), cost[i - 1, j] + 1, cost[i, j - 1] + 1)
    out, i, j = [], len(ref), len(hyp)
    while i or j:
        diagonal = cost.get((i - 1, j - 1), -9)
        if i and j and ref[i - 1] == hyp[j - 1] and cost[i, j] == diagonal:
            out.append(("match", ref[i - 1], hyp[j - 1]))
        elif i and j and cost[i, j] == diagonal + 1:
            out.append(("sub", ref[i - 1], hyp[j - 1]))
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            out.append(("del", ref[i - 1], None))
        else:
            out.append(("ins", None, hyp[j - 1]))
        i, j = i - (out[-1][0] != "ins"), j - (out[-1][0] != "del")
    return out[::-1]


@pytest.mark.parametrize("cells", [1 << 22, 400, 20])
def test_word_paths(spark, monkeypatch, cells):
    """All operations against a table worked out cell by cell, with tables kept whole and in parts."""
    import pyarrow as pa

    monkeypatch.setattr(W, "CELLS", cells)
    rng = random.Random(cells)
    some = lambda: [rng.choice("abc") for _ in range(rng.randrange(12))]
    pairs = [(some(), some()) for _ in range(300)]
    ops, errs, words = W._diffs(*(pa.array([p[k] for p in pairs], pa.list_(pa.string())) for k in (0, 1)))
    for (ref, hyp), own, e, n in zip(pairs, ops.to_pylist(), errs, words, strict=True):
        want = naive_path(ref, hyp)
        assert [(o["op"], o["ref"], o["hyp"]) for o in own] == want and n == len(ref) and e == sum(o[0] != "match" for o in want)


def test_error_confusion(spark):
    rows = spark.createDataFrame([("a b c", "a x c"), ("b", "x"), ("b", ""), ("", "b")], "ref string, hyp string")
    got = {(r.op, r.ref, r.hyp): r.n for r in W.error_confusion(W.word_diff(rows)).collect()}
    assert got == {("sub", "b", "x"): 2, ("del", "b", None): 1, ("ins", None, "b"): 1}


def test_tokens_of_large_vocabularies(spark, monkeypatch):
    """The join that spreads frequent words gives what the broadcast gives."""
    rows = spark.createDataFrame([(i, "the the cat " + "the " * i) for i in range(60)] + [(99, None), (98, "")], "doc_id int, text string")
    vocab = spark.createDataFrame([("the", 1), ("cat", 2)], "word string, id int")
    want = {r.doc_id: r.token_ids for r in S.tokenise(rows, vocab).collect()}
    monkeypatch.setattr(S, "BROADCAST_WORDS", 1)
    ids = S.tokenise(rows, vocab)
    assert {r.doc_id: r.token_ids for r in ids.collect()} == want and want[2] == [1, 1, 2, 1, 1] and want[99] == []
    assert {r.doc_id: r.text for r in S.detokenise(ids.drop("text"), vocab).collect()}[1] == "the the cat the"


def test_tokens_are_looked_up_by_chunks(spark, monkeypatch):
    """A word has a row a chunk in the join, not one for each time that it stands in a text; chunks, nulls and unknown ids change nothing."""
    vocab = spark.createDataFrame([("the", 1), ("cat", 2), (None, 7)], "word string, id int")
    rows = spark.createDataFrame([(i, [1, 2] * i + [None, 5, 7]) for i in range(20)] + [(98, None), (99, [])], "doc_id int, token_ids array<int>").coalesce(1)
    for size in (1 << 18, 5):
        monkeypatch.setattr(S, "CHUNK_VALUES", size)
        text = S.detokenise(rows, vocab)
        assert "FlatMapCoGroupsInArrow" in text._jdf.queryExecution().toString() and "posexplode(token_ids" not in text._jdf.queryExecution().toString()
        assert {r.doc_id: r.text for r in text.collect()} == {i: " ".join(["the cat"] * i) for i in range(20)} | {98: "", 99: ""}
        ids = S.tokenise(text.filter("doc_id in (2, 98)").select("doc_id", F.concat("text", F.lit(" dog")).alias("text")), vocab, unknown=9)
        assert {r.doc_id: r.token_ids for r in ids.collect()} == {2: [1, 2, 1, 2, 9], 98: [9]}


def test_transcribe_isolates_failures(spark):
    def load():
        def recognise(batch):
            if "bad" in batch:
                raise ValueError("no")
            return [t.upper() for t in batch]

        return recognise

    rows = spark.createDataFrame([(i, "r", "bad" if i == 3 else f"t{i}") for i in range(8)], "idx int, ref string, audio string")
    got = {r.idx: (r.hyp, r.error) for r in G.transcribe(rows, load, batch=4).collect()}
    assert got == {i: (None, "ValueError: no") if i == 3 else (f"T{i}", None) for i in range(8)}


def test_write_pending(spark, tmp_path):
    path, work = str(tmp_path / "done"), spark.range(10).withColumn("shard_key", F.col("id") % 2)
    made = lambda todo: todo.withColumn("ok", F.col("id") != 4)
    assert {r.valid: r.n for r in files.write_pending(work.filter("id < 5"), made, path, "id", F.col("ok")).collect()} == {True: 4, False: 1}
    with pytest.raises(Exception, match="broken"):
        files.write_pending(work, lambda todo: todo.withColumn("ok", F.raise_error(F.lit("broken")).cast("boolean")), path, "id", F.col("ok"))
    assert spark.read.parquet(path).count() == 4  # a failed run adds nothing
    assert {r.valid: r.n for r in files.write_pending(work, made, path, "id", F.col("ok")).collect()} == {True: 5, False: 1}
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3, 5, 6, 7, 8, 9]


def test_knapsack_lines(spark):
    """Plans of a corpus of few lengths, whose lines are long, and of many."""
    for top, n in ((4, 2000), (900, 1500)):
        rows = lengths(spark, n, top, top)
        items = [(r.id, r.len) for r in rows.collect()]
        got = bins_of(P.pack_knapsack(rows, 1000, bucket=None))
        assert [got[k] for k in sorted(got)] == naive_knapsack(items, 1000)


def test_spans_of_many_ids(spark):
    rows = spark.createDataFrame([(0, [1] * 3 + [2] * 2 + [3] + [0] * 2), (1, [0, 0]), (2, [5] * 4)], "bin int, attention_mask array<int>")
    got = sorted((r.bin, r.id, r.start, r.n, r.pairs) for r in S.attention_spans(rows).collect())
    assert got == [(0, 1, 0, 3, 6), (0, 2, 3, 2, 3), (0, 3, 5, 1, 1), (2, 5, 0, 4, 10)]
    assert [r.p for r in rows.orderBy("bin").select(S.position_ids(F.col("attention_mask")).alias("p")).collect()] == [[0, 1, 2, 0, 1, 0, 0, 0], [0, 0], [0, 1, 2, 3]]
