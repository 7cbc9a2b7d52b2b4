"""Language identification by compression.

Every language has a zstandard raw-content dictionary cut from sampled texts. A text's letters are all encoded with each
dictionary, block by block so that a long text can't serve as its own dictionary; the language whose dictionary leaves the
fewest bytes wins, and the answer is rejected when the runner-up is about as short.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import bounded_sample

UNKNOWN = "und"
#: Languages' dictionaries are at most this long (but for a language of which no text fits), from about so many texts.
DICT_BYTES, SAMPLE_TEXTS = 96 << 10, 200
#: Of the encoder, and the bytes of a block.
LEVEL, BLOCK = 12, 1024
#: Stands before each block and is in no dictionary: by itself a short block would be stored as it is.
FILLER = bytes(128 + (37 * i * i + 91 * i) % 127 for i in range(64))
_NO_LETTERS = re.compile(r"[\W\d_]+")


def _plain(text: str) -> bytes:
    """The text's words in lower case with one space around each."""
    return f" {_NO_LETTERS.sub(' ', text.lower()).strip()} ".encode("utf-8", "replace")


def fit_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dict_bytes: int = DICT_BYTES, sample_texts: int = SAMPLE_TEXTS) -> dict[str, bytes]:
    """language -> dictionary, from a bounded sample: about sample_texts different texts of each language, whole, in the order of
    their hashes as long as they fit into dict_bytes; a text that doesn't fit is passed over. If none fits it is the shortest.

    Rows with a null language, or a text that is null or has no letter, teach nothing; repeated texts count once.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(F.col("lang").isNotNull() & F.rlike("text", F.lit(r"\p{L}"))).withColumn("h", F.xxhash64("text"))
    sample = bounded_sample(rows, "lang", "h", sample_texts).groupBy("lang", "h").agg(F.any_value("text").alias("text"))
    texts: dict[str, list[bytes]] = {}
    for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["h"])):
        texts.setdefault(r["lang"], []).append(_plain(r["text"]))
    out = {}
    for lang, own in sorted(texts.items(), key=lambda x: (-len(x[1]), x[0])):
        size, kept = 0, []
        for t in own:
            if size + len(t) <= dict_bytes:
                kept.append(t)
                size += len(t)
        out[lang] = b"".join(kept) or min(own, key=len)
    return out


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", min_margin: float = 0.005) -> DataFrame:
    """The rows and columns of docs with lang_pred string, score double (0 to 1), margin double and rejected boolean.

    margin is the part of the runner-up's bytes that the winner saves; score is the winner's share when each language weighs
    2 ** (-8 * bytes / scale), scale growing with the square root of the length. Texts that are null or have no letter get
    ``und``, score 0, margin 0 and are rejected, as is anything when no language is known; so are answers with a margin under
    min_margin. Ties go to the language whose dictionary comes first. Columns of these names are replaced. Rows are worked on alone.
    """
    langs = list(dictionaries)

    @F.pandas_udf("lang_pred string, score double, margin double")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coders = []
        for lang in langs:
            raw = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False, write_dict_id=False, write_checksum=False))
        for texts in batches:
            out = []
            for text in texts:
                if not langs or not isinstance(text, str) or not any(map(str.isalpha, text)):
                    out.append((UNKNOWN, 0.0, 0.0))
                    continue
                plain = _plain(text)
                blocks = [FILLER + plain[i : i + BLOCK] for i in range(0, len(plain), BLOCK)]
                sizes = np.array([sum(len(c.compress(b)) for b in blocks) for c in coders], dtype=np.float64)
                first = int(np.argmin(sizes))
                next_ = np.partition(sizes, 1)[1] if len(sizes) > 1 else 2 * sizes[0]
                weight = np.exp2(-8 * (sizes - sizes[first]) / (4 + math.sqrt(len(plain))))
                out.append((langs[first], float(1 / weight.sum()), float(1 - sizes[first] / next_)))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "margin"])

    got = docs.drop("lang_pred", "score", "margin", "rejected").withColumn("__best", best(F.col(text_col)))
    return got.select("*", "__best.*").drop("__best").withColumn("rejected", (F.col("lang_pred") == UNKNOWN) | (F.col("margin") < min_margin))
