"""Headers of made files of each format, and broken ones."""

from __future__ import annotations

import io
import struct
import wave

import pytest
from pyspark.sql import functions as F

from speechloom.functions.audio_headers import audio_header, measure


def flac(rate=44_100, channels=2, frames=123_456, kind=0, depth=16):
    packed = rate << 44 | (channels - 1) << 41 | (depth - 1) << 36 | frames
    return b"fLaC" + bytes([kind | 0x80]) + (34).to_bytes(3, "big") + b"\x10\x00" * 2 + bytes(6) + packed.to_bytes(8, "big") + bytes(16) + b"\xff\xf8frames"


def wav(rate=16_000, channels=1, frames=321, width=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(bytes(frames * channels * width))
    return out.getvalue()


def chunks(*parts, riff=b"RIFF"):
    body = b"WAVE" + b"".join(name + struct.pack("<I", len(data) if size is None else size) + data + b"\0" * (len(data) % 2) for name, data, size in parts)
    return riff + struct.pack("<I", len(body)) + body


def fmt(rate=8_000, channels=2, align=4):
    return b"fmt ", struct.pack("<HHIIHH", 1, channels, rate, rate * align, align, 16), None


def page(granule, payload, serial=7, number=0, first=False):
    return b"OggS" + struct.pack("<BBqIII", 0, 2 if first else 0, granule, serial, number, 0) + bytes([1, len(payload)]) + payload


def vorbis(rate=22_050, channels=1, last=99_999, more=b""):
    head = b"\x01vorbis" + struct.pack("<IBIiiiBB", 0, channels, rate, 0, 0, 0, 0xB8, 1)
    return page(0, head, first=True) + page(50, b"x" * 200, number=1) + page(last, b"y" * 100, number=2) + more


def opus(channels=2, skip=312, last=48_000):
    return page(0, b"OpusHead" + struct.pack("<BBHIhB", 1, channels, skip, 44_100, 0, 0), first=True) + page(last, b"z" * 9, number=1)


LARGE = 5_000_000_000
MADE = {
    "flac": (flac(), ("flac", 44_100, 2, 123_456)),
    "long flac": (flac(655_350, 8, (1 << 36) - 1), ("flac", 655_350, 8, (1 << 36) - 1)),
    "flac of unknown length": (flac(frames=0), None),
    "flac without streaminfo": (flac(kind=4), None),
    "cut flac": (flac()[:24], None),
    "wav": (wav(), ("wav", 16_000, 1, 321)),
    "stereo wav": (wav(48_000, 2, 11, 3), ("wav", 48_000, 2, 11)),
    "wav with other chunks": (chunks((b"LIST", b"odd", None), (b"junk", bytes(70_000), None), fmt(), (b"fact", bytes(4), None), (b"data", bytes(40), None)), ("wav", 8_000, 2, 10)),
    "wav whose samples are elsewhere": (chunks(fmt(), (b"data", b"", 400)), ("wav", 8_000, 2, 100)),
    "wav without format": (chunks((b"data", bytes(40), None)), None),
    "wav without data": (chunks(fmt()), None),
    "wav of no step": (chunks(fmt(align=0), (b"data", bytes(40), None)), None),
    "large wav": (chunks((b"ds64", struct.pack("<QQQI", 0, LARGE, 0, 0), None), fmt(), (b"data", b"", 0xFFFFFFFF), riff=b"RF64"), ("wav", 8_000, 2, LARGE // 4)),
    "streamed wav": (chunks(fmt(), (b"data", b"", 0xFFFFFFFF)), None),
    "cut wav": (wav()[:30], None),
    "vorbis": (vorbis(), ("vorbis", 22_050, 1, 99_999)),
    "vorbis with another stream": (vorbis(more=page(5, b"", serial=8) + page(-1, b"no packet ends", number=3)), ("vorbis", 22_050, 1, 99_999)),
    "long vorbis": (vorbis(last=1 << 40, more=b"").replace(b"x" * 200, b"x" * 200 + b"\0" * 70_000), ("vorbis", 22_050, 1, 1 << 40)),
    "opus": (opus(), ("opus", 48_000, 2, 48_000 - 312)),
    "empty opus": (opus(last=312), None),
    "ogg of another codec": (page(0, b"fishead\0" + bytes(60), first=True), None),
    "cut ogg": (vorbis()[:20], None),
    "text": (b"hello", None),
    "nothing": (b"", None),
    "null": (None, None),
}


@pytest.fixture(scope="module")
def made(spark):
    return spark.createDataFrame([(name, None if data is None else bytearray(data), "y" * 28) for name, (data, _) in MADE.items()], "name string, content binary, text string")


def test_headers(made):
    got = {r.name: r.h for r in made.select("name", audio_header(F.col("content")).alias("h")).collect()}
    assert {n: h and tuple(h) for n, h in got.items()} == {n: want for n, (_, want) in MADE.items()}


def test_measure(made):
    got = measure(made, "content", F.col("text"), 600_000)
    assert got.columns == ["name", "text", "header", "samples"]
    by_text = 28 * 16_000 // 14
    want = {n: by_text if h is None else min(600_000, h[3] * 16_000 // h[1]) for n, (_, h) in MADE.items()}
    assert {r.name: r.samples for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
