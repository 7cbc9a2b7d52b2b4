"""The corpus pipeline: language identification, near-duplicates, decontamination, secrets, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechloom.llm.decontamination import find_leaks
from speechloom.llm.language_id import fit_languages, identify
from speechloom.llm.near_duplicates import near_duplicates, text_node
from speechloom.llm.packing import harmonic_pack
from speechloom.llm.secrets import redact
from speechloom.llm.shared import durable, marked, marks, new_folder, small_batches, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language the compressor is sure of; texts that are null or have no letter go."""
    small_batches(spark)
    return identify(docs, fit_languages(docs)).filter(~F.col("rejected")).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class: that with the smallest id (one row of it, where rows repeat), null ids
    last. Texts that are null or without words, which have no class, all stay.

    Most rows are the only one of their id and stay, so the rows to drop and the rows that repeat are marked in a bitmap; only
    marked rows, with their texts, go through a shuffle.
    """
    small_batches(spark)
    last = lambda: F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).alias("id")
    classes = durable(near_duplicates(docs).filter("node is not null").select(last(), "node", "root").groupBy("root", "id", "node").agg(F.count(F.lit(1)).alias("times")))
    first = classes.groupBy("root").agg(F.min(F.struct("id", "node")).alias("one")).select("one.id", "one.node")
    first = durable(first.join(classes.select("id", "node", "times"), ["id", "node"]))
    other = classes.join(first.filter("times = 1"), ["id", "node"], "left_anti").select(F.xxhash64("id", "node").alias("key"))
    rows = docs.withColumn("node", text_node(F.coalesce("text", F.lit("")))).withColumn("id", last())
    rows = marked(rows.withColumn("key", F.xxhash64("id", "node")), "key", durable(marks(other, "key")))
    kept = rows.filter("node is not null and __marked").join(first.select("id", "node"), ["id", "node"], "left_semi").dropDuplicates(["id", "node"])
    return rows.filter("node is null or not __marked").select(*COLUMNS).unionByName(kept.select(*COLUMNS))


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that leak a benchmark item; null and empty texts stay, and all if there are no items.

    Leaking texts are marked in a bitmap; only marked rows go through a shuffle, where text hash and id decide.
    """
    leaks = durable(find_leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("text_key").alias("leaked"), F.col("doc_id").alias("leaked_id")).distinct())
    rows = marked(docs.withColumn("key", F.xxhash64("text")), "key", durable(marks(leaks, "leaked")))
    kept = rows.filter("__marked").join(leaks, (F.col("key") == F.col("leaked")) & F.col("doc_id").eqNullSafe(F.col("leaked_id")), "left_anti")
    return rows.filter("not __marked").select(*COLUMNS).unionByName(kept.select(*COLUMNS))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret; n_chars follows the text. Null texts and their n_chars stay."""
    return redact(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens; null texts count as empty, and rows with equal or null
    ids are documents of their own."""
    small_batches(spark)
    pieces = harmonic_pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", one_of_each),
    ("decontamination", no_benchmark),
    ("secrets", no_secrets),
    ("packing", sequences),
]

#: No stage but the fourth can be put in SQL; the tests hold run() against cases planted for each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written as Parquet to the shared folder and read again."""
    folder = new_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
