"""Column functions over transcripts, ids and names; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Corpus slug -> split name.
SPLIT_NAMES = {"ls100": "train.clean.100", "ls360": "train.clean.360", "ls500": "train.other.500"}


def clean_text(text: Column, mode: str = "space") -> Column:
    """``space``: tags become a space, lower case, white space collapsed. ``drop``: tags vanish, stripped and lower-cased only."""
    if mode == "space":
        return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, "<[^>]+>", " ")), r"[ \t\n\r]+", " "))
    if mode == "drop":
        return F.lower(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), r"^[ \t\n\r]+|[ \t\n\r]+$", ""))
    raise ValueError(f"unknown mode {mode}")


def words_of(text: Column) -> Column:
    """The words of a cleaned text; an empty text has none."""
    return F.filter(F.split(clean_text(text), " "), lambda w: w != "")


def coalesce_text(*texts: Column) -> Column:
    """The first text that is neither null nor empty, else ''."""
    return F.coalesce(*(F.nullif(t, F.lit("")) for t in texts), F.lit(""))


def normalise_utterance_id(raw: Column) -> Column:
    """The id without one trailing ``.opus``."""
    return F.regexp_replace(raw, r"\.opus$", "")


def file_stem(path: Column, row: Column) -> Column:
    """The file's name without folder and last extension; the row number where there is no name."""
    stem = F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
    return F.coalesce(F.nullif(stem, F.lit("")), row.cast("string"))


def map_split_name(slug: Column, back: bool = False) -> Column:
    """Corpus slug to split name, or back; others stay as they are."""
    pairs = [(b, a) if back else (a, b) for a, b in SPLIT_NAMES.items()]
    out = slug
    for a, b in pairs:
        out = F.when(slug == a, b).otherwise(out)
    return out


def hash_split(utterance_id: Column) -> Column:
    """0 or 1: the lowest bit of the first byte of the id's md5; 0 for a null id."""
    return F.coalesce(F.conv(F.substring(F.md5(utterance_id.cast("binary")), 1, 2), 16, 10).cast("int").bitwiseAND(1), F.lit(0))


def model_tag(name: Column, default: str) -> Column:
    """``_family_size`` of a model's name for output folders; '' for the default model or a name without both."""
    family = F.lower(F.regexp_extract(name, r"^(?:.*/)?([A-Za-z]+[0-9.]*)", 1))
    size = F.lower(F.regexp_extract(name, r"(?i)[-_]([0-9.]+[bm])(?:$|[-_])", 1))
    return F.when((name == default) | (family == "") | (size == ""), "").otherwise(F.concat(F.lit("_"), family, F.lit("_"), size))


def char_targets(text: Column) -> Column:
    """a-z as 1-26, space as 27, other characters dropped; [27] if nothing is left."""
    kept = F.regexp_replace(F.lower(text), "[^a-z ]", "")
    codes = F.transform(F.filter(F.split(kept, ""), lambda c: c != ""), lambda c: F.when(c == " ", 27).otherwise(F.ascii(c) - 96))
    return F.when(F.coalesce(F.length(kept), F.lit(0)) == 0, F.array(F.lit(27))).otherwise(codes)


def pad_targets(targets: Column, size: int) -> Column:
    """The first ``size`` targets, with zeros to the right."""
    return F.slice(F.concat(targets, F.array_repeat(F.lit(0), size)), 1, size)


def round_words(words: Column) -> Column:
    """Word records with times and score rounded to 4 decimals (half to even; missing: 0.0) and the word trimmed."""
    number = lambda c: F.coalesce(F.bround(c, 4), F.lit(0.0))
    return F.transform(words, lambda w: F.struct(F.trim(w["word"]).alias("word"), number(w["start"]).alias("start"), number(w["end"]).alias("end"), number(w["score"]).alias("score")))
