"""Plug-ins, files and streams over the given tables."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from ..operators import batching as B
from ..operators import plugins as G
from ..operators import wer as W
from ..schemas import ALIGNMENT
from ..sources import files
from ..storage import new_folder
from ..streaming import jobs
from . import inputs as I
from .inputs import checked_plan, duck, table
from .registry import query


@query("featurise", "SELECT CAST(vec_id AS VARCHAR) AS utterance_id, CAST(CASE WHEN vec_id % 50 = 0 THEN 0 ELSE (len(embedding) + 15) // 16 END AS INTEGER) AS feat_len, CASE WHEN vec_id % 50 <> 0 THEN CAST((len(embedding) + 15) // 16 * 8 AS INTEGER) END AS size, CASE WHEN vec_id % 50 = 0 THEN 'empty' END AS error FROM embeddings")
def featurise(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("utterance_id"), F.lit("").alias("text"), F.when(F.col("vec_id") % 50 != 0, F.col("embedding")).alias("audio"))
    out = G.featurise(rows, lambda: G.framing_statistics(8, 16))
    return out.select("utterance_id", "feat_len", F.when(F.col("features").isNotNull(), F.size("features")).alias("size"), "error")


@query("align_batches", duck("utts", "SELECT utterance_id, CASE WHEN n_words > 0 THEN CAST(n_words AS INTEGER) END AS n_words, CASE WHEN n_words > 0 THEN greatest(audio_ms, 0) / 1000 END AS \"end\", CASE WHEN n_words = 0 THEN 'empty transcript' END AS error FROM utts"))
def align_batches(spark, d):
    rows = I.utts(spark, d).select("utterance_id", "transcript", (F.greatest(F.col("audio_ms"), F.lit(0)) / 1000).alias("audio_duration"))
    return G.align_batches(rows).select("utterance_id", F.when(F.col("words").isNotNull(), F.size("words")).alias("n_words"), F.element_at("words", -1)["end"].alias("end"), "error")


@query("transcribe", "SELECT doc_id AS idx, CASE WHEN doc_id % 13 <> 0 THEN md5(lower(coalesce(text, ''))) END AS hyp, CASE WHEN doc_id % 13 = 0 THEN 'ValueError: unlucky' END AS error FROM documents")
def transcribe(spark, d):
    """A recogniser that lowers its text and fails on every 13th document."""

    def load():
        def recognise(batch):
            if any(t.startswith("!") for t in batch):
                raise ValueError("unlucky")
            return [t.lower()[1:] for t in batch]

        return recognise

    mark = F.when(F.col("doc_id") % 13 == 0, "!").otherwise(".")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("idx"), F.col("text").alias("ref"), F.concat(mark, F.coalesce("text", F.lit(""))).alias("audio"))
    return G.transcribe(rows, load).select("idx", F.md5(F.col("hyp").cast("binary")).alias("hyp"), "error")


@query("map_batches", r"SELECT item_id, unnest(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS word FROM benchmark")
def map_batches(spark, d):
    return B.map_batches(table(spark, d, "benchmark").select("item_id", "text"), lambda b: {"item_id": [i for i, t in zip(b["item_id"], b["text"], strict=True) for _ in t.split()], "word": [w for t in b["text"] for w in t.split()]}, "item_id long, word string")


@query("locate_rows", "SELECT doc_id, row_number() OVER () - 1 AS row FROM documents")
def locate_rows(spark, d):
    return files.locate_rows(spark, [f"{d}/documents.parquet"], "doc_id").select("doc_id", F.col("position").alias("row"))


@query("fetch_positions", "SELECT i AS position, o_orderkey FROM (SELECT o_orderkey, row_number() OVER () - 1 AS i FROM orders) WHERE i % 97 = 0")
def fetch_positions(spark, d):
    wanted = spark.range(0, table(spark, d, "orders").count(), 97).withColumnRenamed("id", "position")
    return files.fetch_positions(spark, [f"{d}/orders.parquet"], wanted).select("position", "o_orderkey")


@query("fetch_rows", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def fetch_rows(spark, d):
    """Orders with a large line, from files of consecutive orders."""
    path = new_folder(spark, "by-key")
    table(spark, d, "orders").select("o_orderkey", "o_custkey").repartitionByRange(8, "o_orderkey").write.parquet(path)
    wanted = table(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return files.fetch_rows(spark, [path], "o_orderkey", wanted)


@query("read_transcripts", duck("utts", "SELECT utterance_id, transcript, CAST(doc_id % 2 AS VARCHAR) AS split, CAST(doc_id % 5 AS VARCHAR) AS speaker_id, CAST(doc_id % 3 AS VARCHAR) AS chapter_id FROM utts WHERE n_words > 0"))
def read_transcripts(spark, d):
    """Transcripts written as the tree of text files that the reader scans, and read back."""
    path = new_folder(spark, "transcripts")
    part = lambda n: (F.col("doc_id") % n).cast("string")
    lines = I.utts(spark, d).filter("n_words > 0").select(F.concat("utterance_id", F.lit(" "), F.translate("transcript", string.ascii_lowercase, string.ascii_uppercase)).alias("value"), part(2).alias("split"), part(5).alias("speaker"), part(3).alias("chapter"))
    lines.unionByName(lines.withColumn("value", F.lit(" ")).limit(3)).write.partitionBy("split", "speaker", "chapter").text(path)
    manifest = files.read_transcripts(spark, path, ["split=0", "split=1"], pattern="*.txt")
    value = lambda c: F.regexp_extract(c, "=(.*)", 1).alias(c)
    return manifest.select("utterance_id", "transcript", value("split"), value("speaker_id"), value("chapter_id"))


@query("ingest_audio_bundle", "SELECT CAST(page_id % 8 AS VARCHAR) AS utterance_id, CAST(sum(octet_length(encode(html)) + 1) AS BIGINT) AS bytes FROM pages WHERE page_id % 8 <> 3 GROUP BY 1")
def ingest_audio_bundle(spark, d):
    """Pages written as one file for each of eight ids, bundled as bytes for a manifest of seven, written and read back."""
    path = new_folder(spark, "audio")
    pages = table(spark, d, "pages").select(F.col("html").alias("value"), (F.col("page_id") % 8).alias("id"))
    pages.repartition(8, "id").write.partitionBy("id").text(path)
    listing = files.list_files(spark, path, "*.txt")
    manifest = listing.select("audio_path", F.regexp_extract("audio_path", "/id=([0-9]+)/", 1).alias("utterance_id")).filter("utterance_id != '3'")
    files.write_bundle(files.ingest_audio_bundle(spark, path, manifest, "*.txt"), f"{path}-bundle", max_bytes=1_000_000)
    return spark.read.parquet(f"{path}-bundle").groupBy("utterance_id").agg(F.sum(F.length("audio.bytes")).alias("bytes"))


@query("merge_json_records", "SELECT CAST(item_id AS VARCHAR) AS utterance_id, CAST(len(text) AS DOUBLE) AS audio_duration, 'good' AS kind FROM benchmark WHERE item_id % 7 <> 0 UNION ALL SELECT CAST(item_id AS VARCHAR), NULL, 'bad' FROM benchmark WHERE item_id % 7 = 0")
def merge_json_records(spark, d):
    """Benchmark items written as one JSON record a file, every seventh cut off, and merged."""
    path = new_folder(spark, "json")
    record = F.to_json(F.struct(F.col("item_id").cast("string").alias("utterance_id"), F.length("text").cast("double").alias("audio_duration")))
    rows = table(spark, d, "benchmark").select(F.when(F.col("item_id") % 7 == 0, F.substring(record, 1, 12)).otherwise(record).alias("value"), "item_id")
    rows.repartition("item_id").write.partitionBy("item_id").text(path)
    good, bad = files.merge_json_records(spark, path, ALIGNMENT)
    good = good.select("utterance_id", "audio_duration", F.lit("good").alias("kind"))
    return good.unionByName(bad.select(F.regexp_extract("file", "item_id=([0-9]+)/", 1).alias("utterance_id"), F.lit(None).cast("double").alias("audio_duration"), F.lit("bad").alias("kind")))


@query("to_columnar", "SELECT o_orderkey, o_custkey, true AS small FROM orders")
def to_columnar(spark, d):
    path = new_folder(spark, "columnar")
    files.to_columnar(table(spark, d, "orders").select("o_orderkey", "o_custkey"), path, 1000)
    rows = spark.read.parquet(path).select("o_orderkey", "o_custkey", F.col("_metadata.file_path").alias("file"))
    sizes = rows.groupBy("file").agg((F.count(F.lit(1)) <= 1000).alias("small"))
    return rows.join(F.broadcast(sizes), "file").select("o_orderkey", "o_custkey", "small")  # a row a file


@query("write_pending", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'first' ELSE 'again' END AS made FROM supplier WHERE s_suppkey % 5 <> 0")
def write_pending(spark, d):
    """Two runs over suppliers: the first makes a third of them, the second the rest; every fifth is never valid."""
    path, work = new_folder(spark, "done"), table(spark, d, "supplier").select("s_suppkey")
    valid = F.col("s_suppkey") % 5 != 0
    files.write_pending(work.filter("s_suppkey % 3 = 0"), lambda todo: todo.withColumn("made", F.lit("first")), path, "s_suppkey", valid).collect()
    files.write_pending(work, lambda todo: todo.withColumn("made", F.lit("again")), path, "s_suppkey", valid).collect()
    return spark.read.parquet(path)


@query("export_results", duck("utts", "SELECT CAST(doc_id AS VARCHAR) AS idx, transcript AS ref, CASE WHEN doc_id % 3 <> 0 THEN 'a|\"b\", ' || doc_id END AS hyp FROM utts"))
def export_results(spark, d):
    path = new_folder(spark, "export")
    rows = I.utts(spark, d).select(F.col("doc_id").alias("idx"), F.col("transcript").alias("ref"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit('a|"b", '), F.col("doc_id").cast("string"))).alias("hyp"))
    W.export_results(rows, path)
    return spark.read.option("header", True).option("escape", '"').csv(path)


@query("read_bins", "SELECT o_custkey % 3 AS dataset, CASE o_custkey % 3 WHEN 0 THEN 'sentence' WHEN 1 THEN 'interleaved' ELSE 'plain' END AS layout, o_orderkey FROM orders")
def read_bins(spark, d):
    """Each dataset's bins in layouts of which the best that has data is read."""
    path, orders = new_folder(spark, "bins"), table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 3).alias("dataset"))
    catalog = []
    for n, layouts in enumerate((("sentence", "plain"), ("interleaved", "plain"), ("plain",))):
        for layout in layouts:
            own = f"{path}/{n}-{layout}"
            orders.filter(F.col("dataset") == n).withColumn("layout", F.lit(layout)).write.parquet(own)
            catalog.append((n, layout, "", "packed", own, 1))
        catalog.append((n, "sentence_only", "", "packed", f"{path}/none", 0))
    return files.read_bins(spark, spark.createDataFrame(catalog, "dataset int, layout string, suffix string, form string, path string, n_rows long"))


@query("append_rows", "SELECT CAST(s_suppkey AS VARCHAR) AS step, CAST(s_suppkey % 4 AS VARCHAR) AS half FROM supplier")
def append_rows(spark, d):
    path, rows = new_folder(spark, "metrics"), table(spark, d, "supplier").select(F.col("s_suppkey").alias("step"), (F.col("s_suppkey") % 4).alias("half"))
    for i in range(4):
        files.append_rows(rows.filter(F.col("half") == i), path)
    return spark.read.option("header", True).csv(path)


@query("verify_layout", "SELECT CAST(o_orderkey % 5 AS VARCHAR) AS file, CASE WHEN o_orderkey % 5 <> 1 THEN count(*) + CASE WHEN o_orderkey % 5 = 2 THEN 1 ELSE 0 END END AS expected, CASE WHEN o_orderkey % 5 <> 3 THEN count(*) END AS present, CASE o_orderkey % 5 WHEN 1 THEN 'EXTRA' WHEN 2 THEN 'DIFFERENT' WHEN 3 THEN 'MISSING' ELSE 'OK' END AS status FROM orders GROUP BY o_orderkey % 5")
def verify_layout(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_orderkey") % 5).alias("k"))
    expected = rows.filter("k != 1").groupBy(F.col("k").cast("string").alias("file")).agg((F.count(F.lit(1)) + F.max((F.col("k") == 2).cast("int"))).alias("rows"))
    return files.verify_layout(expected, rows.filter("k != 3").select(F.col("k").cast("string").alias("file")))


@query("merge_metadata", "SELECT CAST(s_suppkey AS VARCHAR) AS file, CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END AS rows FROM supplier")
def merge_metadata(spark, d):
    old = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("file"), F.lit(1).alias("rows"))
    return files.merge_metadata(old, old.filter("cast(file as int) % 2 = 0").withColumn("rows", F.lit(2)))


@query("new_results", "SELECT CAST(event_id AS VARCHAR) AS name FROM events WHERE epoch(TIMESTAMP '2100-01-01') - floor(epoch(ts)) >= 60 AND event_id NOT IN (SELECT doc_id FROM documents)")
def new_results(spark, d):
    items = table(spark, d, "events").select(F.col("event_id").cast("string").alias("name"), F.col("ts").alias("saved_at"))
    return jobs.new_results(items, table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("name")), 60, "2100-01-01 00:00:00").select("name")


def _stream(spark, d, name):
    return jobs.read_stream(spark, f"{d}/{name}.parquet*", table(spark, d, name).schema)


@query("stream_prepare", duck("utt_tokens", "SELECT t.doc_id, lang AS dataset, array_to_string(ws, ' ') AS transcript, CAST(len(ws) AS INTEGER) AS n_words, CAST(len(ws) + 8 AS BIGINT) AS len FROM utt_tokens t JOIN documents d ON t.doc_id = d.doc_id WHERE len(ws) > 0"))
def stream_prepare(spark, d):
    return jobs.run_available(jobs.stream_prepare(_stream(spark, d, "documents")), new_folder(spark, "prepared"))


@query("stream_pack", duck("utt_tokens", "SELECT doc_id, CAST(len(ws) + 8 AS BIGINT) AS len, true AS fits, true AS in_order FROM utt_tokens WHERE len(ws) > 0 AND len(ws) + 8 <= 4096"))
def stream_pack(spark, d):
    folder = new_folder(spark, "packed")
    seqs = jobs.stream_prepare(_stream(spark, d, "documents")).select("doc_id", "len")
    full = jobs.run_available(jobs.stream_pack(seqs, 4096, 50), folder)
    return checked_plan(full.unionByName(jobs.pack_held(spark, f"{folder}/checkpoint", 4096)), 4096, ["lane", "bin_id"], "doc_id")


def _status():
    return F.element_at(F.array(*map(F.lit, ("done", "skip", "fail"))), F.least((F.col("event_id") % 5).cast("int"), F.lit(2)) + 1)


@query("stream_progress", "SELECT date_trunc('hour', ts) AS \"start\", user_id AS worker, count(*) FILTER (event_id % 5 = 0) AS done, count(*) FILTER (event_id % 5 = 1) AS skip, count(*) FILTER (event_id % 5 > 1) AS fail, count(*) FILTER (event_id % 5 = 0) / 3600 AS rate FROM events GROUP BY 1, 2")
def stream_progress(spark, d):
    folder = new_folder(spark, "progress")
    log = _stream(spark, d, "events").select(F.col("user_id").alias("worker"), _status().alias("status"), F.col("ts").cast("timestamp").alias("ts"))
    closed = jobs.run_available(jobs.stream_progress(log), folder)
    return closed.unionByName(jobs.held_progress(spark, f"{folder}/checkpoint"))


@query("stream_totals", """WITH l AS (SELECT user_id AS run, event_id // 100 AS split_no, event_id % 100 + 1 AS step FROM events), e AS (SELECT run, split_no, sum(max(step)) OVER (PARTITION BY run ORDER BY split_no) - max(step) AS before FROM l GROUP BY 1, 2)
SELECT run, split_no, step, CAST(step + before AS BIGINT) AS total_step, (split_no + step / 100) / 4 AS total_epoch FROM l JOIN e USING (run, split_no)""")
def stream_totals(spark, d):
    log = lambda rows: rows.select(F.col("user_id").alias("run"), F.floor(F.col("event_id") / 100).alias("split_no"), (F.col("event_id") % 100 + 1).alias("step"), ((F.col("event_id") % 100 + 1) / 100).alias("epoch"))
    offsets = jobs.run_available(jobs.stream_split_offsets(log(_stream(spark, d, "events"))), new_folder(spark, "totals"), "update")
    return jobs.totals(log(table(spark, d, "events")), offsets, 4)


@query("stream_new_results", "SELECT CAST(event_id AS VARCHAR) AS name, date_trunc('millisecond', max(ts)) AS saved_at, count(*) AS seen FROM events GROUP BY 1")
def stream_new_results(spark, d):
    folder = new_folder(spark, "results")
    items = _stream(spark, d, "events").select(F.col("event_id").cast("string").alias("name"), F.col("ts").cast("timestamp").alias("saved_at"))
    due = jobs.run_caught_up(jobs.stream_new_results(items, 60), folder)
    return due.unionByName(jobs.held_results(spark, f"{folder}/checkpoint"))  # by now all are old enough
