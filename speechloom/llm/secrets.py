"""Secret scans with DataFrame and SQL functions only.

Patterns give the base spans. Beside them, candidate strings (runs of at least 20 token characters) that no base span touches
are scanned by a sliding window: a fold keeps the counts of the window's characters in one short string, takes off the
character that leaves, adds the one that enters and so updates sum(c * log2 c), from which the window's Shannon entropy
follows. Every class of characters has its own threshold, and an allow-list suppresses what looks random but is not secret.
All steps take time in proportion to the text's length, but for redact(), see there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds in the order that breaks ties, with their patterns and the group and length that a match needs.
PATTERNS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: Cheap patterns that every match of the kind also has; hex runs too short to count are not worth cutting the text for.
_PRESENT = {"assign": PATTERNS[0][1], "access": "AKIA[A-Z0-9]{12}", "hex": "[0-9a-f]{32}"}
_EXACT = {"access": "AKIA[A-Z0-9]{12,}", "hex": "[0-9a-f]{32,}"}  # the same matches as +, short ones left out

WIDTH = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Stands for each character of an assignment while candidates are looked for: a run beside it was touched by a base span.
_GONE = "\uffff"
CANDIDATE = rf"(?<![A-Za-z0-9+/_={_GONE}-])[A-Za-z0-9+/_=-]{{{WIDTH},}}+(?!{_GONE})"
_LONG_RUN = rf"[A-Za-z0-9+/_=-]{{{WIDTH}}}"
#: Character classes: what all of a candidate must match, and the bits of entropy that a window of it needs. The first that
#: fits counts. Letters alone need more, since long words and joined names come near to what is random.
CLASSES = (
    ("hex", ("^[0-9a-fA-F]+$",), 3.0),
    ("upper", ("[0-9]", "^[0-9A-Z]+$"), 3.5),
    ("lower", ("[0-9]", "^[0-9a-z]+$"), 3.6),
    ("base64", ("[0-9]", "[a-z]", "[A-Z]"), 3.8),
    ("marked", ("[0-9]", "[A-Za-z]"), 3.9),
    ("letters", ("[a-z]", "[A-Z]"), 3.95),
    ("other", (), 4.1),
)
#: What is never a secret: placeholders, UUIDs, dates and plain numbers, paths of words; and what a base span covers.
ALLOWED = r"(?i)example|placeholder|changeme|redacted|x{6,}|^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$|^[0-9_=+/-]+$|^[a-z]+([/_-][a-z]+)*[/_-][0-9]+$"
_BASED = "AKIA[A-Z0-9]{12}|[0-9a-f]{32}"
_CHUNK = 64


def _bound(value: Column, use) -> Column:
    """use(value), with the value worked out once: a lambda's own expressions are worked out again for every element."""
    return F.transform(F.array(value), use)[0]


def _parts(text: Column, pattern: str, group: int) -> Column:
    """array<struct<gap, hit, value>>: what lies before each match, the match and its group; last the rest, without a match."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), values.alias("value"))


def _located(text: Column, pattern: str, group: int) -> Column:
    """array<struct<start, stop, value>> of all matches, in characters: what split() leaves between the matches says how far
    each is from the one before. Matches are added to chunks and these to the result, so that few are copied often."""
    kind = "array<struct<start:bigint,stop:bigint,value:string>>"
    none, zero = F.from_json(F.lit("[]"), kind), F.lit(0).cast("bigint")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        stop = start + F.char_length(x["hit"])
        one = F.array(F.struct(start.alias("start"), stop.alias("stop"), x["value"].alias("value")))
        return F.struct(F.coalesce(stop, start).alias("at"), F.when(x["hit"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], one)).alias("found"))

    def chunk(parts: Column):
        def add(acc: Column, c: Column) -> Column:
            inner = F.aggregate(F.slice(parts, c * _CHUNK + 1, F.lit(_CHUNK)), F.struct(acc["at"].alias("at"), none.alias("found")), step)
            return _bound(inner, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["found"], F.array(r["found"])).alias("found")))

        return add

    start = F.struct(zero.alias("at"), F.from_json(F.lit("[]"), f"array<{kind}>").alias("found"))
    return _bound(_parts(text, pattern, group), lambda parts: F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / _CHUNK).cast("int")), start, chunk(parts), lambda acc: acc["found"])))


def _window_entropy(value: Column, width: int = WIDTH) -> Column:
    """The highest Shannon entropy, in bits, of any window of ``width`` characters of the value, all of them in ALPHABET; null
    for shorter values. The counts are the characters of a string, one for each of the alphabet."""
    plogp = F.array(*[F.lit(0.0), *[F.lit(c) * F.log2(F.lit(float(c))) for c in range(1, width + 1)]])
    slots = F.transform(F.split(value, "", F.char_length(value)), lambda c: F.instr(F.lit(ALPHABET), c))

    def moves(s: Column) -> Column:
        """array<struct<slot, by, full>>: each character leaving (from the first full window on) and entering."""
        enter = lambda x, i: F.struct(x.alias("slot"), F.lit(1).alias("by"), (i >= width - 1).alias("full"))
        leave = lambda i: F.struct(F.get(s, i - width).alias("slot"), F.lit(-1).alias("by"), F.lit(False).alias("full"))
        return F.flatten(F.transform(s, lambda x, i: F.when(i < width, F.array(enter(x, i))).otherwise(F.array(leave(i), enter(x, i)))))

    def step(acc: Column, x: Column) -> Column:
        n = F.ascii(F.substring(acc["counts"], x["slot"], F.lit(1))) - 65
        total = acc["sum"] + F.get(plogp, n + x["by"]) - F.get(plogp, n)
        counts = F.overlay(acc["counts"], F.chr(n + x["by"] + 65), x["slot"], F.lit(1))
        return F.struct(counts.alias("counts"), total.alias("sum"), F.when(x["full"], F.least(acc["least"], total)).otherwise(acc["least"]).alias("least"))

    start = F.struct(F.lit("A" * len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("least"))
    return _bound(slots, lambda s: F.aggregate(moves(s), start, step, lambda acc: F.log2(F.lit(float(width))) - acc["least"] / width))


def _random(value: Column) -> Column:
    """Whether a window of the value reaches its class's entropy and nothing allows it."""
    needed = F.lit(None).cast("double")
    for _, fits, bits in reversed(CLASSES):
        all_fit = F.lit(True)
        for pattern in fits:
            all_fit = all_fit & F.rlike(value, F.lit(pattern))
        needed = F.when(all_fit, F.lit(bits)).otherwise(needed)
    return F.when(F.rlike(value, F.lit(ALLOWED)) | F.rlike(value, F.lit(_BASED)), False).otherwise(_window_entropy(value) >= needed - 1e-9)


def _at_least(n: int):
    return lambda x: F.char_length(x["value"]) >= n


def secret_spans(text: Column) -> Column:
    """array<struct<start bigint, ord int, kind string, stop bigint>> of a text's secrets, by start and then kind.

    The base kinds are those of PATTERNS. The method adds kind ``entropy``: candidates with a window of WIDTH characters that
    reaches their class's threshold, aren't allowed and don't overlap a base span. Null text has none.
    """
    text = F.coalesce(text, F.lit(""))
    none = F.from_json(F.lit("[]"), "array<struct<start:bigint,ord:int,kind:string,stop:bigint>>")
    span = lambda ord_, kind: lambda x: F.struct(x["start"].alias("start"), F.lit(ord_).alias("ord"), F.lit(kind).alias("kind"), x["stop"].alias("stop"))
    found = []
    for ord_, (kind, pattern, group, least) in enumerate(PATTERNS):
        long_enough = F.filter(_located(text, _EXACT.get(kind, pattern), group), _at_least(least))
        found.append(F.when(F.rlike(text, F.lit(_PRESENT[kind])), F.transform(long_enough, span(ord_, kind))).otherwise(none))
    _, pattern, group, least = PATTERNS[0]
    hidden = lambda p: F.when(F.char_length(p["value"]) >= least, F.repeat(F.lit(_GONE), F.char_length(p["hit"]))).otherwise(p["hit"])
    masked = F.when(F.rlike(text, F.lit(pattern)), F.array_join(F.transform(_parts(text, pattern, group), lambda p: F.concat(p["gap"], F.coalesce(hidden(p), F.lit("")))), "")).otherwise(text)
    added = F.transform(F.filter(_bound(masked, lambda m: _located(m, CANDIDATE, 0)), lambda x: _random(x["value"])), span(len(PATTERNS), "entropy"))
    return F.array_sort(F.concat(*found, F.when(F.rlike(text, F.lit(_LONG_RUN)), added).otherwise(none)))


def find_secrets(docs: DataFrame, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """The rows and columns of docs with an array column ``out`` of secret spans (see secret_spans), empty where none.

    Null text counts as empty; ids, other columns and repeated rows don't matter; a clashing column named ``out`` is
    replaced. Each row is worked on alone: no shuffle.
    """
    return docs.withColumn(out, secret_spans(docs[text_col]))


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """docs with every secret span of the text replaced by the mask; overlapping spans become one mask. Null text stays.

    Time grows with a text's length times its spans, since cutting text at a character means to walk to it.
    """
    text, zero = docs[text_col], F.lit(0).cast("bigint")

    def merged(acc: Column, x: Column) -> Column:
        """Spans (start, stop) that don't overlap, the last in ``open``."""
        joins = x["start"] < acc["open"]["stop"]
        grown = F.struct(acc["open"]["start"].alias("start"), F.greatest(acc["open"]["stop"], x["stop"]).alias("stop"))
        fresh = F.struct(x["start"].alias("start"), x["stop"].alias("stop"))
        return F.struct(F.when(joins, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"), F.when(joins, grown).otherwise(fresh).alias("open"))

    start = F.struct(F.from_json(F.lit("[]"), "array<struct<start:bigint,stop:bigint>>").alias("done"), F.struct(zero.alias("start"), zero.alias("stop")).alias("open"))
    cuts = F.aggregate("__spans", start, merged, lambda acc: F.concat(acc["done"], F.array(acc["open"])))  # first an empty one
    piece = lambda s, i: F.substring(text, F.get(s, i)["stop"].cast("int") + 1, F.coalesce(F.get(s, i + 1)["start"] - F.get(s, i)["stop"], F.lit(2**31 - 1)).cast("int"))
    cleaned = _bound(cuts, lambda s: F.array_join(F.transform(s, lambda x, i: piece(s, i)), mask))
    return docs.withColumn("__spans", secret_spans(text)).withColumn(text_col, F.when(F.size("__spans") > 0, cleaned).otherwise(F.col(text_col))).drop("__spans")
