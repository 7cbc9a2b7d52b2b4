"""What grew faster than its input, or came out otherwise on larger tables."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from speechloom.operators import alignment as L
from speechloom.operators import packing as P
from speechloom.operators import plugins as G
from speechloom.operators import sequences as S
from speechloom.plans import inputs as I
from speechloom.streaming import jobs

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["words", "utts", "alignments"])
def test_inputs_shuffle_nothing(spark, name):
    assert "Exchange" not in plan_of(getattr(I, name)(spark, SF))


def test_segments_leave_the_document_behind(spark):
    """Rows that wait for Python hold their segment's words, not the whole document's."""
    lines = plan_of(entry.queries()["error_browser"](spark, SF)).splitlines()
    python = [k for k, line in enumerate(lines) if "ArrowEvalPython" in line]
    made = max(k for k, line in enumerate(lines) if "posexplode" in line)
    assert python and max(python) < made and not any("ws#" in line for line in lines[:made])


def test_errors_are_planted_in_batches(spark):
    """word_diff, error_confusion, corpus_wer and running_wer: no expression is worked out for each word and checkpoint."""
    lines = plan_of(entry.queries()["corpus_wer"](spark, SF)).splitlines()
    assert any("MapInArrow said" in line for line in lines) and not any("zzins" in line for line in lines)


def test_a_mean_of_just_the_limit_is_not_low(spark):
    """Sums of doubles come out below it."""
    rng, scores = random.Random(1), []
    while len(scores) < 20:
        one = [rng.randrange(1000) for _ in range(6)]
        one.append(3500 - sum(one))
        if 0 <= one[-1] < 1000 and sum(x / 1000 for x in one) / 7 < 0.5:
            scores.append([x / 1000 for x in one])
    rows = [(i, [("w", 0.0, 1.0, x) for x in s], 9.0) for i, s in enumerate([*scores, [0.5, 0.499999]])]
    align = spark.createDataFrame(rows, "id int, words array<struct<word:string,start:double,end:double,score:double>>, audio_duration double")
    assert [r.issues for r in L.validate_alignment(align, []).orderBy("id").collect()] == [[]] * 20 + [["low score"]]
    assert sorted(r.id for r in L.quality_filter(align).collect()) == list(range(20))


def test_positions_over_several_files(spark, tmp_path):
    for k in range(3):
        spark.range(1000 * k, 1000 * k + 500 + k).select(F.col("id").alias("o_orderkey"), F.col("id").alias("doc_id")).coalesce(1).write.parquet(str(tmp_path / f"part-{k}"))
    for name in ("orders", "documents"):
        (tmp_path / f"{name}.parquet").mkdir()
        for k in range(3):
            file = next((tmp_path / f"part-{k}").glob("*.parquet"))
            (tmp_path / f"{name}.parquet" / f"{k}.parquet").write_bytes(file.read_bytes())
    want = [1000 * k + i for k in range(3) for i in range(500 + k)]
    got = entry.queries()["fetch_positions"](spark, str(tmp_path)).collect()
    assert sorted((r.position, r.o_orderkey) for r in got) == [(i, x) for i, x in enumerate(want) if i % 97 == 0]
    got = entry.queries()["locate_rows"](spark, str(tmp_path)).collect()
    assert sorted((r.row, r.doc_id) for r in got) == list(enumerate(want))


def naive_spans(labels, opens, close, reach):
    out = list(labels)
    for i in [i for i, x in enumerate(labels) if x in opens]:
        for j in range(i + 1, min(i + reach, len(out) - 1) + 1):
            if out[j] == close:
                out[i : j + 1] = [-100] * (j + 1 - i)
                break
    return out


def test_tag_spans_of_long_labels(spark):
    rng = random.Random(3)
    rows = [[rng.choice([1, 2, 2, 5, None, -100]) for _ in range(rng.randrange(40))] for _ in range(300)] + [[rng.choice([1, 2, 9]) for _ in range(100_000)]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)] + [(len(rows), None)], "id int, l array<int>")
    for close in (2, -100):
        got = {r.id: r.m for r in df.select("id", S.mask_tag_spans(F.col("l"), [1], close).alias("m")).collect()}
        assert got == {i: naive_spans(r, [1], close, 6) for i, r in enumerate(rows)} | {len(rows): None}


def test_short_clips_of_a_long_bin(spark):
    """2,000 clips of 30 tokens: work for each clip, not for each token and clip."""
    n, clips = 30, 2000
    mask = [c + 1 for c in range(clips) for _ in range(n)] + [0] * 7
    ids = list(range(len(mask)))
    bins = spark.createDataFrame([(0, ids, [-i for i in ids], mask, [c % 3 for c in range(clips)])], "bin_no int, input_ids array<int>, labels array<int>, attention_mask array<int>, audio_lengths array<int>")
    row = P.drop_short_clips(bins, 2).first()
    kept = [c for c in range(clips) if c % 3 == 2]
    real = [c * n + i for c in kept for i in range(n)]
    fill = [0] * (len(mask) - len(real))
    assert row.input_ids == real + fill and row.labels == [-i for i in real] + [-100] * len(fill)
    assert row.attention_mask == [k + 1 for k in range(len(kept)) for _ in range(n)] + fill and row.audio_lengths == [2] * len(kept)


def test_batch_aligner_gives_the_row_aligners_numbers(spark):
    rng = random.Random(4)
    rows = [(str(i), " ".join("x" * rng.randrange(1, 9) for _ in range(rng.randrange(9))), rng.randrange(100_000) / 1000) for i in range(300)] + [("n", None, 1.0)]
    df = spark.createDataFrame(rows, "utterance_id string, transcript string, audio_duration double")
    by_row = G.align_batches(df, lambda: lambda part: [G.proportional_aligner(t, d) for t, d in part])
    assert sorted(map(str, G.align_batches(df).collect())) == sorted(map(str, by_row.collect()))


def test_many_items_come_once(spark, tmp_path):
    """Whole-number keys, repeated in a file and over files, with one that waits."""
    old, later = datetime.datetime(2020, 1, 1), datetime.datetime(2100, 1, 1)
    rows = [(i % 3000, old + datetime.timedelta(seconds=i)) for i in range(6000)] + [(9999, later), (None, old)]
    spark.createDataFrame(rows, "name long, saved_at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.stream_new_results(jobs.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], "name long, saved_at timestamp").schema), 60)
    got = jobs.run_caught_up(stream, str(tmp_path / "cp")).collect()
    assert sorted((r.name, r.seen) for r in got if r.name is not None) == [(i, 2) for i in range(3000)] and [r.seen for r in got if r.name is None] == [1]
    assert [(r.name, r.seen) for r in jobs.held_results(spark, str(tmp_path / "cp/checkpoint")).collect()] == [(9999, 1)]


def test_lengths_split_no_text_again(spark):
    """Plans and orders read lengths several times: from stored rows, not from the texts."""
    rows = I.lengths(spark, SF)
    assert rows.count() == I.table(spark, SF, "documents").count()
    assert not [f for f in rows.inputFiles() if "documents.parquet" in f]


def texts_read(plan: str) -> int:
    """How often a plan reads the documents' texts."""
    return sum("text:string" in line for line in plan.splitlines() if "FileScan" in line)


@pytest.mark.parametrize("name", ["build_interleaved", "interleaved_lengths", "word_crops"])
def test_words_stay_with_their_utterance(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    assert "Exchange" not in plan and texts_read(plan) == 1


@pytest.mark.parametrize(("name", "times"), [("route_format", 1), ("attach_first_match", 2), ("attach_alignments", 1)])
def test_ids_are_matched_without_texts_and_words(spark, name, times):
    """Each source reads the texts once, utterances none, and no array of words is sorted with its key."""
    plan = plan_of(entry.queries()[name](spark, SF))
    assert texts_read(plan) == times and "SortAggregate" not in plan


def timed_words(spark):
    """Rows of words, and the same in arrays: ties of rounding, times out of order, past the clip or null, blank words, utterances without any."""
    rng, rows = random.Random(5), []
    for i in range(60):
        at = 0
        for pos in range(rng.choice([0, 1, 5, 80])):
            at += rng.randrange(-40, 400, 20)
            n = rng.choice([0, 1, 2, 3, 4, 9])
            rows.append((i, pos, "x" * n, None if rng.random() < 0.02 else at, None if rng.random() < 0.02 else at + 60 * n, n))
    words = spark.createDataFrame(rows, "doc_id long, pos long, word string, at long, until long, letters long")
    clips = spark.createDataFrame([(i, None if i % 13 == 0 else rng.randrange(400)) for i in range(60)], "doc_id long, feat_len long")
    lists = words.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "at", "until", "letters"))).alias("w"))
    arrays = clips.join(lists, "doc_id", "left").select("doc_id", "feat_len", *(F.col(f"w.{c}").alias(c) for c in ("at", "until", "letters")))
    rows = words.join(clips, "doc_id").withColumn("start", F.col("at") / 1000).withColumn("end", F.col("until") / 1000).withColumn("n_text", F.ceil(F.col("letters") / 3))
    return clips, rows, arrays


def listed(df):
    return sorted(map(str, df.collect()))


def test_crops_of_arrays_are_those_of_rows(spark):
    clips, rows, arrays = timed_words(spark)
    made = S.crop_arrays(arrays, 25, start="at", end="until", unit=1000, whole=True).select("doc_id", F.explode("crops").alias("c")).select("doc_id", "c.*")
    want = S.word_crops(rows, 25, whole=clips).select(*made.columns)
    assert listed(made) == listed(want) and made.count() > 300
    made = S.crop_arrays(arrays, 25, start="at", end="until", unit=1000).select("doc_id", F.explode("crops").alias("c")).select("doc_id", "c.*")
    assert listed(made) == listed(want.filter("pos is not null"))


def test_chunks_of_arrays_are_those_of_rows(spark):
    _, rows, arrays = timed_words(spark)
    chunks = S.chunk_arrays(arrays, 25, 4, 3, 5, 300, start="at", end="until", unit=1000, per_token=3)
    made = chunks.select("doc_id", F.explode("chunks").alias("c")).select("doc_id", "c.*")
    by_row = S.interleaved_chunks(rows, 25, 4, 3, 5, 300)
    assert listed(made) == listed(by_row.select(*made.columns)) and made.count() > 300
    assert listed(S.chunk_array_lengths(chunks)) == listed(S.interleaved_lengths(by_row))
    ids = lambda n: F.array_repeat(F.lit(7), n.cast("int"))
    want = S.build_interleaved(by_row.withColumn("text_ids", ids(F.col("n_text"))), [1, 2], [3], 9)
    assert listed(S.build_chunk_arrays(chunks, [1, 2], [3], 9, lambda x: ids(x["n_text"]))) == listed(want)


def test_frames_are_rounded_half_to_even(spark):
    """rint gives what bround gave."""
    rows = spark.range(200_000).select((F.col("id") * 10 / 1000).alias("s"))
    assert rows.filter(S._frames(F.col("s"), 25) != F.bround(F.col("s") * 25, 0).cast("long")).count() == 0
    assert "bround" not in plan_of(rows.select(S._frames(F.col("s"), 25)))


def test_timed_words_of_odd_documents(spark, tmp_path):
    """Null and empty texts, null and negative ids, letters of several bytes, a tag between words."""
    docs = [(1, "Äb  <b>çd</b>\tx"), (2, None), (3, ""), (None, "a b"), (-5, "one two three"), (29, "gone"), (4, " <p> ")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    split = {1: ["äb", "çd", "x"], 2: None, 3: [], None: ["a", "b"], -5: ["one", "two", "three"], 29: ["gone"], 4: []}
    want, records = {}, {}
    for doc, ws in split.items():
        at, out = 0, []
        for i, w in enumerate(ws or []):
            out.append((w, at, at + 60 * len(w)))
            at += 60 * len(w) + (-30 if doc is not None and (doc * 31 + i) % 97 == 0 else 40)
        want[doc] = None if ws is None else out
        records[doc] = [(w, a / 1000, b / 1000) for w, a, b in out]
    got = {r.doc_id: None if r.ws is None else list(zip(r.ws, r.at, r.until, strict=True)) for r in I.timed(spark, str(tmp_path)).collect()}
    assert got == want
    utts = I.utts(spark, str(tmp_path))
    audio = {r.doc_id: r.audio_ms for r in utts.collect()}
    assert listed(I.timed_utts(spark, str(tmp_path)).select(*utts.columns)) == listed(utts)
    found = I.alignments(spark, str(tmp_path)).collect()
    assert {r.doc_id: [tuple(w)[:3] for w in r.words] for r in found} == {k: v for k, v in records.items() if k is not None and k % 29}
    assert [w.score for r in found if r.doc_id == -5 for w in r.words] == [-0.035, -0.022, -0.009]
    assert {r.doc_id: r.audio_duration for r in found} == {k: v / 1000 for k, v in audio.items() if k is not None and k % 29}


def test_looked_up_words_never_go_through_the_driver(spark, monkeypatch):
    """Spark takes the rows that come out of chunks for few: it broadcast them, and failed by the driver's memory on 0.1 GB."""
    monkeypatch.setattr(S, "BROADCAST_WORDS", 1)
    rows = spark.createDataFrame([(i, f"w{i} the cat <b>w{i % 7}</b>", i * 2) for i in range(40)], "doc_id int, text string, more int")
    vocab = S.vocabulary(rows.select(F.explode(S.words_of(F.col("text"))).alias("word")), by="word")
    ids = S.tokenise(rows, vocab)
    text = S.detokenise(ids, vocab)
    for df in (ids, text):
        plan = plan_of(df)
        joins = [line for line in plan.splitlines() if "Join" in line and ("[word#" in line or "[id#" in line)]
        assert joins and all("SortMergeJoin" in line for line in joins) and "LeftOuter" not in plan  # and no column is joined on again
    assert {r.doc_id: (r.text, r.more) for r in text.collect()} == {i: (f"w{i} the cat w{i % 7}", i * 2) for i in range(40)}
    tokens = spark.createDataFrame([(0, 1), (0, 2), (1, 1)], "k int, t int")
    joins = [line for line in plan_of(S._looked_up(tokens, spark.createDataFrame([(1, "a"), (2, "b")], "t int, word string"), "t", "inner")).splitlines() if "Join [t#" in line and "Inner" in line]
    assert any("SortMergeJoin" in line for line in joins)


def test_small_vocabularies_are_small_in_bytes(spark, monkeypatch):
    vocab = spark.createDataFrame([("x" * 100, 1), ("y" * 100, 2)], "word string, id int")
    assert S._sided(vocab)[1]
    monkeypatch.setattr(S, "BROADCAST_BYTES", 150)
    assert not S._sided(vocab)[1] and S._sided(vocab.select("id"))[1] and S._sided(vocab.limit(0))[1]
