"""Reading corpora and writing results."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import coalesce_text, normalise_utterance_id
from ..schemas import MANIFEST
from ..storage import stored


def read_transcripts(spark: SparkSession, root: str, splits: list[str], suffix: str = ".flac", pattern: str = "*.trans.txt") -> DataFrame:
    """The manifest of ``split/speaker/chapter/*.trans.txt`` files, or such that match another pattern: the first token of a line is the utterance's id, the rest,
    lower-cased, its transcript; blank lines are skipped."""
    lines = spark.read.text([f"{root}/{s}/*/*/{pattern}" for s in splits]).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file")).filter("line != ''")
    folder = F.regexp_replace("file", "/[^/]*$", "")
    part = lambda i: F.element_at(F.split(folder, "/"), i)
    utt = F.regexp_extract("line", r"^(\S+)", 1)
    rows = lines.select(F.concat(folder, F.lit("/"), utt, F.lit(suffix)).alias("audio_path"), F.lower(F.trim(F.regexp_replace("line", r"^\S+", ""))).alias("transcript"), part(-3).alias("split"), part(-2).alias("speaker_id"), part(-1).alias("chapter_id"), utt.alias("utterance_id"))
    return rows.select(*MANIFEST.fieldNames())


def keep_existing_files(manifest: DataFrame, listing: DataFrame, path: str = "audio_path") -> DataFrame:
    """Entries whose file is in the listing (a table with that path column, such as of list_files)."""
    return manifest.join(listing.select(path), path, "left_semi")


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Paths and sizes of all files under a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select(F.col("path").alias("audio_path"), "length")


def read_corpora(sources: dict[str, tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """(dataset, utterance_id, text, audio) of several corpora: name -> (table, id column, text columns in order of preference).
    ``audio`` is taken where a table has it."""

    def one(name: str, df: DataFrame, id_: str, texts: list[str]) -> DataFrame:
        audio = F.col("audio") if "audio" in df.columns else F.lit(None).cast("struct<bytes:binary,path:string>")
        return df.select(F.lit(name).alias("dataset"), normalise_utterance_id(F.col(id_).cast("string")).alias("utterance_id"), coalesce_text(*(F.col(t) for t in texts)).alias("text"), audio.alias("audio"))

    return reduce(DataFrame.unionByName, [one(name, *x) for name, x in sources.items()])


def ingest_audio_bundle(spark: SparkSession, root: str, manifest: DataFrame, pattern: str = "*.flac") -> DataFrame:
    """Manifest rows with ``audio struct<bytes,path>``, undecoded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return manifest.join(files.select(F.col("path").alias("audio_path"), F.struct(F.col("content").alias("bytes"), F.col("path").alias("path")).alias("audio")), "audio_path")


def write_bundle(df: DataFrame, path: str, max_bytes: int = 500_000_000, size: Column | None = None) -> None:
    """Parquet files of about max_bytes: rows per file by the mean row size."""
    size = F.length("audio.bytes") if size is None else size
    mean = df.agg(F.avg(size).alias("m")).first()["m"] or 1
    df.write.option("maxRecordsPerFile", max(1, int(max_bytes / mean))).parquet(path)


def merge_json_records(spark: SparkSession, root: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(records, bad files) of a folder tree with one JSON record a file."""
    whole = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    text = spark.read.option("recursiveFileLookup", True).option("wholetext", True).text(root).select("value", F.col("_metadata.file_path").alias("file"))
    rows = text.select("file", F.from_json("value", whole, {"mode": "PERMISSIVE"}).alias("r")).withColumn("bad", F.col("r").isNull() | F.col("r._corrupt_record").isNotNull())
    return rows.filter("not bad").select(*(F.col("r")[c].alias(c) for c in schema.fieldNames())), rows.filter("bad").select("file")


def to_columnar(df: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)


def pending_only(work: DataFrame, done: DataFrame, key: str, valid: Column | None = None) -> DataFrame:
    """Rows of work without a (valid) output."""
    return work.join((done if valid is None else done.filter(valid)).select(key), key, "left_anti")


def write_pending(work: DataFrame, make: Callable[[DataFrame], DataFrame], done_path: str, key: str, valid: Column) -> DataFrame:
    """Makes the outputs that a table at done_path lacks and adds those that are valid: (valid, n) of what was made.

    Outputs are first written beside the table; only when that has succeeded are the valid ones appended, by Spark's own commit,
    so a run that fails leaves the table as it was, and its work is done again by the next.
    """
    spark = work.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(done_path)
    exists = there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
    todo = pending_only(work, spark.read.parquet(done_path), key, valid) if exists else work
    staged = stored(make(todo).withColumn("__valid", F.coalesce(valid, F.lit(False))))
    staged.filter("__valid").drop("__valid").write.mode("append").parquet(done_path)
    return staged.groupBy(F.col("__valid").alias("valid")).agg(F.count(F.lit(1)).alias("n"))


def verify_layout(expected: DataFrame, files: DataFrame) -> DataFrame:
    """Per file (name, expected, present, status OK, MISSING, DIFFERENT or EXTRA) from a metadata table (file, rows) and the rows of a layout
    read with their ``file``."""
    have = files.groupBy("file").agg(F.count(F.lit(1)).alias("present"))
    both = expected.select("file", F.col("rows").alias("expected")).join(have, "file", "full_outer")
    status = F.when(F.col("present").isNull(), "MISSING").when(F.col("expected").isNull(), "EXTRA").when(F.col("present") != F.col("expected"), "DIFFERENT").otherwise("OK")
    return both.withColumn("status", status)


def merge_metadata(old: DataFrame, new: DataFrame, key: str = "file") -> DataFrame:
    """Metadata rows by key, the newer winning."""
    w = Window.partitionBy(key).orderBy(F.desc("__v"))
    return old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1))).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r", "__v")


def locate_rows(spark: SparkSession, paths: list[str], key: str) -> DataFrame:
    """(key, file, row, position): where each row lies, in its file and over all files in the order of their paths; only the key
    column is read."""
    rows = spark.read.parquet(*paths).select(key, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    first = F.broadcast(index_files(spark, paths, key).select("file", "first"))  # a row a file
    return rows.join(first, "file").select(key, "file", "row", (F.col("first") + F.col("row")).alias("position"))


def index_files(spark: SparkSession, paths: list[str], key: str) -> DataFrame:
    """(file, first, rows, least, greatest): what each file holds, in the order of their paths: the position of its first row over all
    files, its rows, and the range of its keys. Only the key column is read. Write it beside the files to use it again."""
    rows = spark.read.parquet(*paths)
    sizes = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("least"), F.max(key).alias("greatest"))
    before = F.sum("rows").over(Window.partitionBy(F.lit(0)).orderBy("file")) - F.col("rows")  # a row a file
    return sizes.select("file", before.alias("first"), "rows", "least", "greatest")


def _only(spark: SparkSession, schema: T.StructType, files: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema).select("*", F.lit(None).cast("struct<file_path:string,row_index:bigint>").alias("_metadata"))


def fetch_rows(spark: SparkSession, paths: list[str], key: str, wanted: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Whole rows of the wanted keys. Only files whose range of keys (see index_files) holds a wanted key are read, and of them only
    row groups within the range of all wanted keys."""
    index = index_files(spark, paths, key) if index is None else index
    schema = spark.read.parquet(*paths).schema
    wanted = wanted.select(key).distinct()
    ranges = sorted((r["least"], r["greatest"], r["file"]) for r in index.filter("least is not null").collect())  # a row a file
    if not ranges:
        return _only(spark, schema, []).select(*schema.names)
    leasts, greatest_yet, top = [r[0] for r in ranges], [], None
    for _, greatest, _ in ranges:
        top = greatest if top is None else max(top, greatest)
        greatest_yet.append(top)

    def hit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: set[int] = set()
        for frame in frames:
            for value in frame[key].tolist():
                at = bisect.bisect_right(leasts, value) - 1
                while at >= 0 and greatest_yet[at] >= value:  # ranges may overlap
                    if ranges[at][1] >= value:
                        found.add(at)
                    at -= 1
        yield pd.DataFrame({"at": sorted(found)}, dtype="int64")

    chosen = wanted.filter(F.col(key).isNotNull()).mapInPandas(hit, "at long").distinct().collect()
    ends = wanted.agg(F.min(key).alias("a"), F.max(key).alias("b")).first()
    rows = _only(spark, schema, [ranges[r["at"]][2] for r in chosen]).select(*schema.names)
    return rows.filter(F.col(key).between(F.lit(ends["a"]), F.lit(ends["b"]))).join(wanted, key, "left_semi").select(*schema.names)


def fetch_positions(spark: SparkSession, paths: list[str], positions: DataFrame, position: str = "position", index: DataFrame | None = None) -> DataFrame:
    """Whole rows of the wanted global positions, 0-based over the files in the order of their paths, with the position. Only files
    that hold a wanted position are read. index: of index_files, if there is one; else the files' rows are counted."""
    schema = spark.read.parquet(*paths).schema
    if index is None:
        index = index_files(spark, paths, schema.names[0])
    files = sorted((r["first"], r["rows"], r["file"]) for r in index.select("first", "rows", "file").collect())  # a row a file
    starts = np.array([f[0] for f in files], dtype=np.int64)
    total = files[-1][0] + files[-1][1] if files else 0

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = np.searchsorted(starts, frame[position].to_numpy(), side="right") - 1
            yield pd.DataFrame({position: frame[position], "__at": at, "__row": frame[position].to_numpy() - starts[at]})

    asked = positions.select(F.col(position).cast("long").alias(position)).filter(F.col(position).between(0, total - 1)).distinct()
    placed = asked.mapInPandas(place, f"{position} long, __at long, __row long") if files else asked.withColumn("__at", F.lit(0)).withColumn("__row", F.lit(0))
    placed = stored(placed)
    chosen = [r["__at"] for r in placed.select("__at").distinct().collect()]
    names = spark.createDataFrame([(i, files[i][2]) for i in chosen], "__at long, __file string")
    rows = _only(spark, schema, [files[i][2] for i in chosen]).select(*schema.names, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return rows.join(placed.join(F.broadcast(names), "__at").drop("__at"), ["__file", "__row"]).select(*schema.names, position)  # names: a row a file


#: Bin layouts in the order in which a run prefers them.
LAYOUTS = ("sentence", "sentence_only", "interleaved", "plain")


def choose_layout(catalog: DataFrame, suffix: str = "") -> DataFrame:
    """The best layout that has data, of each (dataset): layouts with the model's suffix first, then by LAYOUTS, then per-dataset
    packed before sharded before single. catalog: (dataset, layout, suffix, form, path, n_rows)."""
    place = F.array_position(F.array(*map(F.lit, LAYOUTS)), F.col("layout"))
    form = F.array_position(F.array(*map(F.lit, ("packed", "sharded", "single"))), F.col("form"))
    rank = F.struct((F.col("suffix") != suffix).alias("a"), place.alias("b"), form.alias("c"), F.col("path").alias("d"))
    usable = catalog.filter((F.col("n_rows") > 0) & F.col("suffix").isin(suffix, "") & (place > 0))
    return usable.groupBy("dataset").agg(F.min_by("path", rank).alias("path"), F.min_by("layout", rank).alias("layout"))


def read_bins(spark: SparkSession, catalog: DataFrame, suffix: str = "") -> DataFrame:
    """Bins of the chosen layout of every dataset (the catalog is small)."""
    paths = [r["path"] for r in choose_layout(catalog, suffix).collect()]
    if not paths:
        raise ValueError("no layout of the catalog has data")
    return spark.read.parquet(*paths)


def append_rows(df: DataFrame, path: str) -> None:
    """Metric rows added to a table of CSV files, each with its header."""
    df.write.mode("append").option("header", True).csv(path)
