"""User functions over batches of audio: encoders, aligners, recognisers. The defaults are simple and deterministic."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

FEATURED = "utterance_id string, text string, features array<float>, feat_len int, error string"
ALIGNED = "utterance_id string, transcript string, audio_duration double, words array<struct<word:string,start:double,end:double,score:double>>, error string"


def framing_statistics(dim: int = 8, hop: int = 320) -> Callable:
    """An encoder without a model: for each hop of samples dim numbers (means of equal parts of the frame)."""

    def encode(batch: list[list[float]]) -> list[list[list[float]]]:
        out = []
        for samples in batch:
            frames = [samples[i : i + hop] for i in range(0, len(samples), hop)]
            out.append([[sum(f[len(f) * d // dim : len(f) * (d + 1) // dim]) / max(1, len(f) * (d + 1) // dim - len(f) * d // dim) for d in range(dim)] for f in frames])
        return out

    return encode


def featurise(df: DataFrame, load: Callable[[], Callable], batch: int = 16, key: str = "utterance_id", audio: str = "audio", text: str = "text") -> DataFrame:
    """FEATURED rows: flattened frames of each utterance, or an error (``empty`` or what the encoder raised).

    ``load`` gives the encoder, once a worker. A batch that raises MemoryError is tried again row by row; any other failure
    is the rows' error, so one bad utterance never stops the job.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()

        def tried(rows: list) -> list[tuple]:
            try:
                return [(f, None) for f in encode(rows)]
            except MemoryError as e:
                if len(rows) == 1:
                    return [(None, f"memory: {e}")]
                return [x for r in rows for x in tried([r])]
            except Exception as e:  # noqa: BLE001  the row's error is the result
                if len(rows) == 1:
                    return [(None, f"{type(e).__name__}: {e}")]
                return [x for r in rows for x in tried([r])]

        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                clips = [None if a is None else list(a) for a in part[audio]]
                full = [c for c in clips if c]
                got = iter(tried(full) if full else [])
                rows = []
                for k, t, clip in zip(part[key], part[text], clips, strict=True):
                    features, error = next(got) if clip else (None, "empty")
                    rows.append((k, t, [float(x) for f in features for x in f] if features is not None else None, len(features) if features is not None else 0, error))
                yield pd.DataFrame(rows, columns=["utterance_id", "text", "features", "feat_len", "error"])

    return df.select(key, text, audio).mapInPandas(run, FEATURED)


def proportional_aligner(transcript: str, duration: float) -> list[dict]:
    """Words timed in proportion to their characters."""
    words = transcript.split()
    total, at, out = sum(map(len, words)), 0, []
    for w in words:
        out.append({"word": w, "start": round(duration * at / total, 4), "end": round(duration * (at + len(w)) / total, 4), "score": 1.0})
        at += len(w)
    return out


def _rounded(x: np.ndarray) -> np.ndarray:
    """round(x, 4) of each; Python decides where a value is all but in the middle."""
    scaled = x * 1e4
    out = np.rint(scaled) / 1e4
    for i in np.flatnonzero(np.abs(np.abs(scaled - np.floor(scaled)) - 0.5) < 1e-4).tolist():
        out[i] = round(float(x[i]), 4)
    return out


def _proportional(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """proportional_aligner over whole batches of (id, transcript, seconds), the same numbers."""
    for batch in batches:
        said, seconds = batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
        words = [(t or "").split() for t in said]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        flat = [w for own in words for w in own]
        letters = np.array([len(w) for w in flat], dtype=np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        upto = np.concatenate([[0], np.cumsum(letters)])
        base, total = np.repeat(upto[offsets[:-1]], sizes), np.repeat(upto[offsets[1:]] - upto[offsets[:-1]], sizes)
        length = np.repeat(seconds, sizes)
        time = lambda n: pa.array(_rounded(length * n / total))  # noqa: B023, E731
        timed = pa.StructArray.from_arrays([pa.array(flat, pa.string()), time(upto[:-1] - base), time(upto[1:] - base), pa.array(np.ones(len(flat)))], names=["word", "start", "end", "score"])
        none = pa.array(sizes == 0)
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), timed)
        lists = pc.if_else(none, pa.scalar(None, lists.type), lists)
        error = pc.if_else(none, pa.scalar("empty transcript"), pa.scalar(None, pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pc.fill_null(batch.column(1), ""), batch.column(2).cast(pa.float64()), lists, error], names=["utterance_id", "transcript", "audio_duration", "words", "error"])


def align_batches(df: DataFrame, load: Callable[[], Callable[[list[tuple[str, float]]], list]] | None = None, batch: int = 16, key: str = "utterance_id", transcript: str = "transcript", duration: str = "audio_duration") -> DataFrame:
    """ALIGNED rows by an aligner over lists of (transcript, seconds); empty transcripts are skipped with an error, and a batch
    that fails is tried again row by row. Without ``load`` words are timed in proportion to their characters."""
    if load is None:
        return df.select(key, transcript, duration).mapInArrow(_proportional, ALIGNED)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        align = load()

        def tried(rows: list) -> list[tuple]:
            try:
                return [(w, None) for w in align(rows)]
            except Exception as e:  # noqa: BLE001
                return [(None, f"{type(e).__name__}: {e}")] if len(rows) == 1 else [x for r in rows for x in tried([r])]

        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                rows = [(t or "", d) for t, d in zip(part[transcript], part[duration], strict=True)]
                full = [r for r in rows if r[0].strip()]
                got = iter(tried(full) if full else [])
                out = [(k, t, d, *(next(got) if t.strip() else (None, "empty transcript"))) for k, (t, d) in zip(part[key], rows, strict=True)]
                yield pd.DataFrame(out, columns=["utterance_id", "transcript", "audio_duration", "words", "error"])

    return df.select(key, transcript, duration).mapInPandas(run, ALIGNED)


def transcribe(df: DataFrame, load: Callable[[], Callable[[list], list[str]]], batch: int = 16, idx: str = "idx", audio: str = "audio", ref: str = "ref") -> DataFrame:
    """(idx, ref, hyp, error) by a recogniser over lists of audio; the idx column keeps the order. A batch that fails is tried
    again row by row; a row that fails has a null hyp and what was raised."""
    kinds = dict(df.dtypes)
    plain = lambda a: list(a) if hasattr(a, "__iter__") and not isinstance(a, str | bytes) else a

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recognise = load()

        def tried(rows: list) -> list[tuple]:
            try:
                return [(h, None) for h in recognise(rows)]
            except Exception as e:  # noqa: BLE001  the row's error is the result
                return [(None, f"{type(e).__name__}: {e}")] if len(rows) == 1 else [x for r in rows for x in tried([r])]

        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                got = tried([plain(a) for a in part[audio]])
                yield pd.DataFrame({"idx": part[idx].to_numpy(), "ref": part[ref].to_numpy(), "hyp": [h for h, _ in got], "error": [e for _, e in got]})

    return df.select(idx, ref, audio).mapInPandas(run, f"idx {kinds[idx]}, ref string, hyp string, error string")
