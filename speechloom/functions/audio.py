"""Lengths of audio in samples, frames and tokens, and encoder settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RATE = 16000
MAX_BATCH_TOKENS = 8000


def encoders(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """The encoder dimension table: (encoder, out_dim, rate, hop, strides)."""
    return spark.createDataFrame(rows, "encoder string, out_dim int, rate int, hop int, strides array<int>")


def encoder_config(requests: DataFrame, table: DataFrame, max_samples: int = 30 * RATE) -> DataFrame:
    """requests with samples_per_token, fps, max_audio_tokens and max_batch_tokens of their encoder; unknown encoders: nulls."""
    stride = F.aggregate("strides", F.lit(1), lambda a, s: a * s)
    config = table.withColumn("samples_per_token", F.floor(F.col("hop") * RATE * stride / F.col("rate")).cast("long")).withColumn("fps", F.col("rate") / F.col("hop"))
    config = config.withColumn("max_audio_tokens", F.floor(F.lit(max_samples) / F.col("samples_per_token")).cast("long")).withColumn("max_batch_tokens", F.lit(MAX_BATCH_TOKENS))
    return requests.join(config, "encoder", "left")


def estimate_samples(frames: Column, rate: Column, n_chars: Column, max_samples: int) -> Column:
    """Samples at 16 kHz by the header's frames and rate, else by 14 characters a second; at most max_samples."""
    by_header = F.floor(frames * RATE / rate)
    return F.least(F.coalesce(by_header, F.floor(n_chars * RATE / 14)), F.lit(max_samples)).cast("long")


def estimate_tokens(samples: Column, samples_per_token: Column, max_text: int) -> Column:
    return (F.floor(samples / samples_per_token) + max_text).cast("long")


def estimate_tokens_of_frames(frames: Column, stride: int, max_text: int) -> Column:
    return (F.ceil(frames / stride) + max_text + 6).cast("long")


def frame_count(samples: Column, rate: Column, hop: Column, most: Column) -> Column:
    """Valid frames of a padded clip: ceil(trunc(samples * rate / 16000) / hop), at most ``most``."""
    return F.least(F.ceil(F.floor(samples * rate / RATE) / hop), most).cast("long")


def frame_mask(valid: Column, most: Column) -> Column:
    """Booleans for frames 1..most: whether each is valid."""
    return F.when(most > 0, F.transform(F.sequence(F.lit(1).cast("long"), most.cast("long")), lambda i: i <= valid)).otherwise(F.array().cast("array<boolean>"))


def projected_len(n: Column, mode: str, step: int = 1) -> Column:
    """Length after the projector, by one of four conventions."""
    if mode == "ceil":
        return F.ceil(n / step).cast("long")
    if mode == "floor_min1":
        return F.greatest(F.lit(1), F.floor(n / step)).cast("long")
    if mode == "floor":
        return F.floor(n / step).cast("long")
    if mode == "two_convs":
        return F.ceil(F.ceil(n / 2) / 2).cast("long")
    raise ValueError(f"unknown mode {mode}")


def limit_audio(df: DataFrame, audio: str, most: int, policy: str = "truncate") -> DataFrame:
    """``truncate``: cut the array at ``most`` samples; ``drop``: leave out rows that have more."""
    if policy == "truncate":
        return df.withColumn(audio, F.slice(audio, 1, most))
    if policy == "drop":
        return df.filter(F.coalesce(F.size(audio), F.lit(0)) <= most)
    raise ValueError(f"unknown policy {policy}")


def downmix(channels: Column) -> Column:
    """Mean of all channels; a single channel as it is."""
    n = F.size(channels)
    total = F.aggregate(F.slice(channels, F.lit(2), F.size(channels)), channels[0], lambda a, c: F.zip_with(a, c, lambda x, y: (x + y).cast("float")))
    return F.when(n > 1, F.transform(total, lambda x: (x / n).cast("float"))).otherwise(channels[0])
