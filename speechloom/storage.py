"""Intermediate data in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data: the context's checkpoint folder, else that which ``spark.checkpoint.dir`` names. With
    neither, only a local session gets a folder of its own, below the warehouse."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/.checkpoints")
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path for a new folder there."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again: for loops. A checkpoint keeps the plan's size estimate, which joins multiply, so
    that its digits would double in each round; files have their own size."""
    path = new_folder(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
