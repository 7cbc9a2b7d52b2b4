"""Lengths of encoded audio from its headers: FLAC, WAV and Ogg (Vorbis, Opus), by built-in functions over a binary column.

Only the few bytes that say the length are looked at; nothing is decoded. What isn't one of these formats, is cut off within
its header or doesn't say its length has a null header, and its length is estimated from the transcript.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .audio import estimate_samples

#: Chunks of a WAV file among which its format and data are looked for.
WAV_CHUNKS = 64
#: No Ogg page is longer.
OGG_PAGE = 65_307
_UNKNOWN = 0xFFFFFFFF


def _bytes(content: Column, at: Column | int, n: int) -> Column:
    return F.substring(content, (F.lit(at) if isinstance(at, int) else at).cast("int") + 1, F.lit(n))


def _big(content: Column, at: Column | int, n: int) -> Column:
    """An unsigned number of n < 8 bytes, the highest first; null where the bytes are not all there."""
    part = _bytes(content, at, n)
    return F.when(F.octet_length(part) == n, F.conv(F.hex(part), 16, 10).cast("long"))


def _little(content: Column, at: Column | int, n: int) -> Column:
    """The same, the lowest first."""
    at = F.lit(at) if isinstance(at, int) else at
    reversed_ = F.concat(*[F.hex(_bytes(content, at + i, 1)) for i in reversed(range(n))])
    return F.when(F.octet_length(_bytes(content, at, n)) == n, F.conv(reversed_, 16, 10).cast("long"))


def _header(kind: str, rate: Column, channels: Column, frames: Column) -> Column:
    good = (rate > 0) & (channels > 0) & (frames > 0)
    return F.when(good, F.struct(F.lit(kind).alias("kind"), rate.cast("long").alias("rate"), channels.cast("int").alias("channels"), frames.cast("long").alias("frames")))


def _is(content: Column, at: Column | int, text: str) -> Column:
    return _bytes(content, at, len(text)) == F.lit(text.encode())


def flac_header(content: Column, at: int = 0) -> Column:
    """STREAMINFO, always the first block: 20 bits of rate, 3 of channels, 5 of depth, 36 of frames. A length of 0 is unknown."""
    info = at + 18
    rate = F.floor(_big(content, info, 3) / 16)
    channels = F.floor(_big(content, info + 2, 1) / 2) % 8 + 1
    frames = _big(content, info + 3, 5) % (1 << 36)
    return F.when(_is(content, at, "fLaC") & (_big(content, at + 4, 1) % 128 == 0), _header("flac", rate, channels, frames))


def wav_header(content: Column) -> Column:
    """The chunks up to the data, whatever others lie between; RF64 has the data's size in a chunk of its own."""
    none = F.lit(None).cast("long")
    start = F.struct(F.lit(12).cast("long").alias("at"), none.alias("rate"), none.alias("channels"), none.alias("align"), none.alias("large"), none.alias("data"))

    def step(acc: Column, _: Column) -> Column:
        at = acc["at"]
        size = _little(content, at + 4, 4)
        named = lambda name, value, old: F.when(_is(content, at, name), value).otherwise(acc[old])
        found = F.struct(
            (at + 8 + size + size % 2).alias("at"),
            named("fmt ", _little(content, at + 12, 4), "rate").alias("rate"),
            named("fmt ", _little(content, at + 10, 2), "channels").alias("channels"),
            named("fmt ", _little(content, at + 20, 2), "align").alias("align"),
            named("ds64", _little(content, at + 16, 7), "large").alias("large"),
            named("data", size, "data").alias("data"),
        )
        return F.when(acc["data"].isNotNull() | at.isNull() | (at >= F.octet_length(content)), acc).otherwise(found)

    def done(acc: Column) -> Column:
        data = F.when(acc["data"] == _UNKNOWN, acc["large"]).otherwise(acc["data"])
        return _header("wav", acc["rate"], acc["channels"], F.when(acc["align"] > 0, F.floor(data / acc["align"])))

    riff = (_is(content, 0, "RIFF") | _is(content, 0, "RF64")) & _is(content, 8, "WAVE")
    return F.when(riff, F.aggregate(F.sequence(F.lit(1), F.lit(WAV_CHUNKS)), start, step, done))


def ogg_header(content: Column) -> Column:
    """Rate and channels of the first packet; the length is the position that the stream's last page ends with (at 48 kHz for
    Opus, less what is to be skipped)."""
    packet = _big(content, 26, 1) + 27
    # a character for each byte; the last page begins within the last OGG_PAGE of them
    tail = F.decode(F.substring(content, F.greatest(F.octet_length(content) - OGG_PAGE, F.lit(0)) + 1, F.lit(OGG_PAGE)), "ISO-8859-1")
    pages = F.transform(F.split(tail, "OggS"), lambda p: F.encode(p, "ISO-8859-1"))
    serial = _bytes(content, 14, 4)
    none = F.lit(b"\xff" * 8)  # no packet ends on this page
    own = F.filter(pages, lambda p: (_bytes(p, 10, 4) == serial) & (_bytes(p, 0, 1) == F.lit(b"\0")) & (_bytes(p, 2, 8) != none))
    last = F.when(F.size(own) > 0, _little(F.element_at(own, -1), 2, 7))
    vorbis = _header("vorbis", _little(content, packet + 12, 4), _little(content, packet + 11, 1), last)
    opus = _header("opus", F.lit(48_000), _little(content, packet + 9, 1), last - _little(content, packet + 10, 2))
    return F.when(_is(content, 0, "OggS"), F.when(_is(content, packet, "\x01vorbis"), vorbis).when(_is(content, packet, "OpusHead"), opus))


def audio_header(content: Column) -> Column:
    """struct<kind, rate, channels, frames> of encoded audio; null for null content, other formats and broken headers."""
    return F.coalesce(flac_header(content), wav_header(content), ogg_header(content))


def measure(df: DataFrame, content: str, text: Column, max_samples: int, out: str = "samples") -> DataFrame:
    """df with ``header`` and the samples at 16 kHz: by the header, else by 14 characters of the text a second; at most
    max_samples. The content itself is left out."""
    rows = df.withColumn("header", audio_header(F.col(content))).drop(content)
    return rows.withColumn(out, estimate_samples(F.col("header.frames"), F.col("header.rate"), F.char_length(F.coalesce(text, F.lit(""))), max_samples))


