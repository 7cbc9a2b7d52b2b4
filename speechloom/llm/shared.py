"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import join_unskewed
from ..storage import durable, new_folder, stored

__all__ = ["durable", "join_unskewed", "marked", "marks", "new_folder", "small_batches", "stored", "table"]


#: Bits of a table of marks, 4 MB in all, and of one of its rows.
MARKS, _ROW = 1 << 25, 1 << 15


def marks(keys: DataFrame, key: str) -> DataFrame:
    """(slot int, bits binary): a bitmap of MARKS bits over the hashes of a long column, in at most MARKS / _ROW rows."""
    at = keys.select(F.pmod(F.xxhash64(key, F.lit("mark")), F.lit(MARKS)).alias("at"))
    return at.groupBy(F.floor(F.col("at") / _ROW).cast("int").alias("slot")).agg(F.bitmap_construct_agg(F.col("at") % _ROW).alias("bits"))


def marked(rows: DataFrame, key: str, table: DataFrame, out: str = "__marked") -> DataFrame:
    """rows with a boolean: whether the long column's mark is set in a table of marks, as it is for all keys that the table was
    made from, and by chance for a few others (for all, where there are far more keys than bits)."""
    at = F.pmod(F.xxhash64(key, F.lit("mark")), F.lit(MARKS))
    byte = F.conv(F.hex(F.substring("__bits", (F.floor((at % _ROW) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftright(__byte, cast(__at % 8 as int)) & 1")
    found = rows.withColumn("__slot", F.floor(at / _ROW).cast("int")).join(F.broadcast(table.toDF("__slot", "__bits")), "__slot", "left")
    found = found.withColumn("__byte", byte).withColumn("__at", at).withColumn(out, F.coalesce(bit == 1, F.lit(False)))
    return found.select(*rows.columns, out)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Rows here are whole texts: batches of so many rows at most keep Python workers and Arrow buffers small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
