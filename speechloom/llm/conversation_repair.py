"""Conversation structure repair by Wagner-Fischer target alignment.

A conversation should read ``(s?(ua)+)?`` in role initials. Its turns are aligned to the grammar's strings of each feasible
length: a matrix of edit costs for each target, only its Ukkonen band of cells from which the incumbent cost can still be
reached, and a walk through the matrix that takes the ASCII-least of the cheapest edits. Targets are tried from the likeliest
length on, a length whose least cost is over the incumbent's is left out, and of equal costs the least audit wins.

Conversations of over PART turns are aligned part by part, between all pairs of grammar states at the parts' borders, and
joined: time and memory grow with a conversation's turns, not with their square. Texts are never held: a first pass sorts
conversations by (id, turn) with a digest of each turn, and keeps a character and a digest a turn; a second one streams the
texts past the finished audits. So one conversation may be of any length, but its turns pass through one task, as its audit
(one string) and the digest of its text (one running hash) ask for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Turns that are aligned at once.
PART = 16
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
_INF = 1 << 60
#: Characters of a text by which turns of equal number and role are ordered, before its digest.
_HEAD = 32
_SPACES = r"\x20\x09-\x0D"
#: Grammar states: nothing yet, after s, after u, after a.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
_NAMES = {"u": "user", "a": "assistant"}


def _next(state: int) -> str:
    """The initial that follows a state, an opening s apart."""
    return "a" if state == USER else "u"


def _alternation(first: str, length: int) -> str:
    return ("ua" if first == "u" else "au") * (length // 2) + first * (length % 2)


def _apart(e: int) -> int:
    """The least cost of a target that is e initials longer than the turns that may stay."""
    return INSERT * e if e >= 0 else -DELETE * e


def _fit(turns: str, target: str, bound: int, last: bool) -> tuple[int, str] | None:
    """The cost of aligning turns with a target and the ASCII-least audit of that cost; None if it is over the bound.

    A turn is its initial (s, u, a; x for any other), in upper case where it is truncated, or d where it must be deleted.
    Insertions come before a turn; after the last turn only where ``last``.
    """
    n, m = len(turns), len(target)
    stay = [0]
    for t in turns:
        stay.append(stay[-1] + (t != "d"))
    spare, e = bound - DELETE * (n - stay[n]), m - stay[n]
    if _apart(e) > spare:
        return None
    least, most = -((spare - INSERT * e) // (DELETE + INSERT)), (spare + DELETE * e) // (DELETE + INSERT)
    lows, costs = [0] * (n + 1), [[]] * (n + 1)
    for i in range(n, -1, -1):
        lo, hi = max(0, stay[i] + least), min(m, stay[i] + most)
        row = [_INF] * max(0, hi - lo + 1)
        lows[i], costs[i] = lo, row
        turn = turns[i] if i < n else ""
        for j in range(hi, lo - 1, -1):
            best = 0 if i == n and j == m else _INF
            if j < hi and target[j] != "s" and (i < n or last):
                best = min(best, INSERT + row[j + 1 - lo])
            if i < n:
                at, below = j - lows[i + 1], costs[i + 1]
                if 0 <= at < len(below):
                    best = min(best, DELETE + below[at])
                if turn != "d" and j < m and 0 <= at + 1 < len(below):
                    best = min(best, _keep(turn, target[j]) + below[at + 1])
            row[j - lo] = best
    cost = costs[0][-lows[0]] if lows[0] <= 0 < lows[0] + len(costs[0]) else _INF
    if cost > bound:
        return None

    def rest(i: int, j: int) -> int:
        return costs[i][j - lows[i]] if i <= n and 0 <= j - lows[i] < len(costs[i]) else _INF

    audit, i, j = [], 0, 0
    while (i, j) != (n, m):
        left = rest(i, j)
        if i < n and DELETE + rest(i + 1, j) == left:
            audit.append("D")
            i += 1
        elif j < m and target[j] != "s" and (i < n or last) and INSERT + rest(i, j + 1) == left:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if turns[i].lower() == target[j] else "R")
            i, j = i + 1, j + 1
    return cost, "".join(audit)


def _keep(turn: str, initial: str) -> int:
    """The cost of a turn that becomes an initial of the target."""
    initial_of = turn.lower()
    if initial_of != initial and initial == "s":
        return _INF
    return (REROLE if initial_of != initial else 0) + (TRUNCATED if turn != initial_of else 0)


@lru_cache(1 << 16)
def _aligned(turns: str, start: int, last: bool) -> dict[int, tuple[int, str]]:
    """For each grammar state that turns can lead to from a start: the least cost and the ASCII-least audit of that cost."""
    best: dict[int, tuple[int, str]] = {}

    def attempt(target: str, end: int) -> None:
        found = _fit(turns, target, best[end][0] if end in best else _INF >> 1, last)
        if found is not None and (end not in best or found < best[end]):
            best[end] = found

    stay = sum(t != "d" for t in turns)
    forced = DELETE * (len(turns) - stay)
    attempt("", start)
    openings = [""]
    if start == EMPTY and ("s" in turns or "S" in turns):
        attempt("s", SYSTEM)
        openings.append("s")
    first = _next(start)
    for opening in openings:
        step = 0
        while True:
            lengths = {n for n in (stay - len(opening) - step, stay - len(opening) + step) if n > 0}
            for length in sorted(lengths):
                end = USER if (length % 2 == 1) == (first == "u") else ASSISTANT
                if not (last and end == USER) and forced + _apart(length + len(opening) - stay) <= best.get(end, (_INF,))[0]:
                    attempt(opening + _alternation(first, length), end)
            ends = [ASSISTANT] if last else [USER, ASSISTANT]
            if all(x in best and forced + INSERT * step > best[x][0] for x in ends):
                break
            step += 1
    return best


def align_turns(turns: str) -> tuple[int, str]:
    """The least cost of repairing a conversation and the ASCII-least audit of that cost. Turns are written as in _fit()."""
    reached, back = {EMPTY: (0, 0)}, []  # state: cost, place among the audits so far
    parts = [turns[i : i + PART] for i in range(0, len(turns), PART)]
    for k, part in enumerate(parts):
        ways: dict[int, tuple[int, int, str, int]] = {}
        for state, (cost, place) in reached.items():
            for end, (more, audit) in _aligned(part, state, k == len(parts) - 1).items():
                way = (cost + more, place, audit, state)
                if end not in ways or way < ways[end]:
                    ways[end] = way
        order = sorted({way[1:3] for way in ways.values()})
        reached = {end: (way[0], order.index(way[1:3])) for end, way in ways.items()}
        back.append({end: (way[3], way[2]) for end, way in ways.items()})
    cost, _, state = min((cost, place, state) for state, (cost, place) in reached.items() if state in (EMPTY, ASSISTANT))
    audit = []
    for steps in reversed(back):
        state, piece = steps[state]
        audit.append(piece)
    return cost, "".join(reversed(audit))


def _turns(rows: DataFrame, conv: str, turn: str, role: str, text: str, dropped: Column) -> DataFrame:
    """The columns that order and judge turns, and their roles and texts (null: one space)."""
    said = F.coalesce(F.col(text).cast("string"), F.lit(" "))
    name = F.coalesce(F.col(role).cast("string"), F.lit(" "))
    initial = F.substring(name, 1, 1)
    return rows.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        name.alias("role"),
        F.substring(said, 1, _HEAD).alias("head"),
        F.unhex(F.sha2(F.concat(F.length(name).cast("string"), F.lit(":"), name, said), 256)).alias("key"),
        F.when(dropped, F.lit("-")).when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
        F.when(~said.rlike(f"[^{_SPACES}]"), F.lit("b")).when(~said.rlike(rf"[.!?][{_SPACES}]*\z"), F.lit("t")).otherwise("").alias("fault"),
        said.alias("text"),
    )


_ORDER = ("turn", "role", "head", "key")


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_AUDIT = [("gaps", T.LongType()), ("blank", T.LongType()), ("duplicate", T.LongType()), ("truncated", T.LongType()), ("illegal", T.LongType()), ("cost", T.LongType()), ("audit", T.StringType())]


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """A row (conv, *_AUDIT) for each conversation of turns sorted by (conv, *_ORDER)."""
    conv, begun = None, False
    turns, seen, counts, initials, numbers = [], set(), {}, "", [0, 0, None]

    def finished() -> tuple:
        cost, audit = align_turns("".join(turns)) if turns else (0, "")
        gaps = numbers[1] - numbers[0] + 1 - numbers[2] if numbers[2] else 0
        return (conv, gaps, counts.get("b", 0), counts.get("d", 0), counts.get("t", 0), counts.get("illegal", 0), cost, audit)

    for batch in batches:
        for key_of, turn, initial, fault, key in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "initial", "fault", "key")), strict=True):
            if not begun or key_of != conv:
                if begun:
                    yield finished()
                conv, begun = key_of, True
                turns, seen, counts, initials, numbers = [], set(), {}, "", [0, 0, None]
            if initial == "-":
                continue
            if fault != "b" and key in seen:
                fault = "d"
            seen.add(key)
            if fault:
                counts[fault] = counts.get(fault, 0) + 1
            turns.append("d" if fault in ("b", "d") and fault else initial.upper() if fault else initial)
            if initials and initials + initial not in ("su", "ua", "au"):
                counts["illegal"] = counts.get("illegal", 0) + 1
            initials = initial
            if turn is not None:
                if numbers[2] is None:
                    numbers = [turn, turn, 1]
                elif turn != numbers[1]:
                    numbers = [numbers[0], turn, numbers[2] + 1]
    if begun:
        yield finished()


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(record, None, None, None) for each conversation's record, followed by (None, edit, role, text) of its repaired turns.
    Rows are sorted so that a conversation's record, which holds its audit, comes before its turns."""
    audit, at, state = "", 0, EMPTY

    def insert() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            initial = _next(state)
            at, state = at + 1, USER if initial == "u" else ASSISTANT
            yield None, "I", _NAMES[initial], ""

    open_record = False
    for batch in batches:
        columns = batch.schema.names
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            row = dict(zip(columns, row, strict=True))
            if not row["is_turn"]:
                if open_record:
                    yield from insert()
                audit, at, state, open_record = row["audit"], 0, EMPTY, True
                yield row, None, None, None
                continue
            yield from insert()
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            initial, role = row["initial"], row["role"]
            if edit == "R":
                initial = _next(state)
                role = _NAMES[initial]
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[initial]
            yield None, edit, role, row["text"]
    if open_record:
        yield from insert()


class Conversations:
    """The turns of conversations, in order of (conv, turn); and what is found in and made of them.

    ``dropped`` tells which rows only say that their conversation exists. Null turns come first; turns of equal number are
    ordered by role and text (by its first 32 characters and then a digest). Null roles and texts are one space; a null id is a
    conversation of its own; other columns are ignored. An empty table gives empty tables.
    """

    def __init__(self, rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", dropped: Column | None = None):
        self.conv, self.kind = conv, rows.schema[conv].dataType
        self.turns = _turns(rows, conv, turn, role, text, F.lit(False) if dropped is None else dropped)

    def _sorted(self, rows: DataFrame, *order: str) -> DataFrame:
        return rows.repartition("conv").sortWithinPartitions("conv", *order)

    def audits(self) -> DataFrame:
        """One row a conversation: gaps in its numbers, turns that are blank, duplicates or truncated (the first that fits
        counts), adjacent roles that are illegal, the least cost of repair and the ASCII-least audit of that cost."""
        schema = T.StructType([T.StructField(self.conv, self.kind)] + [T.StructField(*f) for f in _AUDIT])
        arrow = to_arrow_schema(schema)
        light = self._sorted(self.turns.drop("text"), *_ORDER)
        return light.mapInArrow(lambda batches: _batches(_judge(batches), arrow), schema)

    def _with_audits(self, audits: DataFrame) -> DataFrame:
        records = audits.select(F.col(self.conv).alias("conv"), *(c for c, _ in _AUDIT), F.lit(False).alias("is_turn"))
        turns = self.turns.filter("initial <> '-'").drop("fault").withColumn("is_turn", F.lit(True))
        return self._sorted(records.unionByName(turns, allowMissingColumns=True), "is_turn", *_ORDER)

    def repaired(self, audits: DataFrame) -> DataFrame:
        """(conv, place, edit, role, text): the repaired turns, in order of place."""
        schema = T.StructType([T.StructField(self.conv, self.kind), T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
        arrow = to_arrow_schema(schema)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            conv, place = None, 0
            for record, edit, role, text in _rewritten(batches):
                if record is not None:
                    conv, place = record["conv"], 0
                else:
                    yield conv, place, edit, role, text
                    place += 1

        return self._with_audits(audits).mapInArrow(lambda batches: _batches(rows(batches), arrow), schema)

    def digests(self, audits: DataFrame) -> DataFrame:
        """The audits with repaired_sha256: of the repaired turns as role:text, joined by newlines."""
        schema = T.StructType([T.StructField(self.conv, self.kind)] + [T.StructField(*f) for f in _AUDIT] + [T.StructField("repaired_sha256", T.StringType())])
        arrow = to_arrow_schema(schema)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            open_record, digest, between = None, None, b""
            for record, _, role, text in _rewritten(batches):
                if record is not None:
                    if open_record is not None:
                        yield (open_record["conv"], *(open_record[c] for c, _ in _AUDIT), digest.hexdigest())
                    open_record, digest, between = record, hashlib.sha256(), b""
                else:
                    digest.update(between + f"{role}:{text}".encode())
                    between = b"\n"
            if open_record is not None:
                yield (open_record["conv"], *(open_record[c] for c, _ in _AUDIT), digest.hexdigest())

        return self._with_audits(audits).mapInArrow(lambda batches: _batches(rows(batches), arrow), schema)


def damage(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Conversations with faults, by crc32(conv_id:turn) % 20 (null: one space): 0 drops a turn, 1 empties its text, 2 takes its
    ``[.!?]`` away, 3 repeats it, 4 makes its role user. Dropped turns stay as rows that the second value marks."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", plain("conv_id"), plain("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), kind.alias("__kind"))
    text = F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("__kind") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.lit(0), F.when(F.col("__kind") == 3, 2).otherwise(1))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "__kind", F.explode(times).alias("__again"))
    return rows, F.col("__kind") == 0
