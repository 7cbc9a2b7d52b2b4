"""A global row order without a one-partition sort."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import durable

#: Rows of a range of running totals.
RANGE_ROWS = 1 << 16
#: Bins of a histogram of values.
BINS = 1 << 12


def seeded_key(seed: int | str, *ids: Column) -> Column:
    """A pseudo-random 64-bit order key of a seed and ids; the same for every run and partitioning."""
    return F.xxhash64(F.lit(seed), *ids)


def portable_key(seed: int | str, id_: Column) -> Column:
    """An order key that other engines can compute too: the md5 of seed:id in hex."""
    return F.md5(F.concat(F.lit(f"{seed}:"), id_.cast("string")).cast("binary"))


def global_index(df: DataFrame, key: str, tie: list[str] | None = None, out: str = "idx", ranges: int | None = None) -> DataFrame:
    """df with ``out``, 0-based, in the order of key and tie (null keys first), for any key that can be ordered.

    Spark deals the rows to ranges of (key, tie), cut by a sample so that they hold alike many rows, and sorts each; a row's
    index is its place in its range and the sizes of the ranges before. So skewed keys spread, and equal keys too where a tie
    tells them apart. Rows that key and tie don't tell apart are numbered in any order. The sorted rows are stored, since a
    sample drawn again could cut other ranges. Without ``ranges`` there are as many as shuffle partitions, small ones put together.
    """
    order = [F.col(c) for c in (key, *(tie or []))]
    dealt = df.repartitionByRange(*order) if ranges is None else df.repartitionByRange(ranges, *order)
    rows = durable(dealt.sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))  # range number and place
    rows = rows.withColumn("__range", F.shiftright("__m", 33))
    sizes = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__range", (F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__range")) - F.col("__n")).alias("__before"))
    numbered = rows.join(F.broadcast(before), "__range").withColumn(out, F.col("__before") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)))
    return numbered.select(*df.columns, out)


def global_shuffle(df: DataFrame, seed: int, key: str, out: str = "idx", portable: bool = False) -> DataFrame:
    """df with a uniform pseudo-random permutation's position, the same for every partitioning; portable: of an order that other
    engines can compute too."""
    place = portable_key(seed, F.col(key)) if portable else seeded_key(seed, F.col(key))
    return global_index(df.withColumn("__k", place), "__k", [key], out).drop("__k")


def buffer_shuffle(df: DataFrame, size: int, seed: int) -> DataFrame:
    """The rows in a pseudo-random order of limited reach, for streams too: each task fills a buffer of ``size`` rows, then puts every
    row that comes in the place of a random one, which goes out, and at the end empties the buffer in random order. So a row goes
    out ``size`` rows earlier than it came at most. Memory is the buffer and an Arrow batch; the seed and a task's number and
    rows fix its order. Nothing is moved between tasks: for a uniform order of a table take global_shuffle().
    """
    if size < 1:
        raise ValueError("the buffer must hold a row")

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = random.Random(f"{seed}/{TaskContext.get().partitionId()}")
        buffer = None
        for batch in batches:
            held = 0 if buffer is None else buffer.num_rows
            both = pa.Table.from_batches([batch] if buffer is None else [buffer, batch])
            places, out = list(range(held)), []
            for row in range(held, both.num_rows):
                if len(places) < size:
                    places.append(row)
                else:
                    at = rng.randrange(size)
                    out.append(places[at])
                    places[at] = row
            yield from both.take(pa.array(out, pa.int64())).to_batches()
            buffer = both.take(pa.array(places, pa.int64())).combine_chunks().to_batches()[0] if places else None
        if buffer is not None:
            places = list(range(buffer.num_rows))
            rng.shuffle(places)
            yield buffer.take(pa.array(places, pa.int64()))

    return df.mapInArrow(shuffle, df.schema)


def prefix_scan(df: DataFrame, by: list[str], order: list[str], value: str, out: str, how: str = "sum", earlier: bool = False) -> DataFrame:
    """df with ``out``: the running sum, minimum or maximum of a column up to each row of its group, or with ``earlier`` up to the
    row before it (null for the first).

    All groups' rows are put in one order by ranges; every (group, range) is combined by itself, the few results of a group's
    ranges are scanned, and each range starts from what came before it. So one long group is the work of many tasks. Null
    values are passed over; rows that ``by`` and ``order`` don't tell apart are taken in any order.
    """
    combine = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    columns = [*by, *order]
    rows = global_index(df, columns[0], columns[1:], "__i").withColumn("__range", F.floor(F.col("__i") / RANGE_ROWS))
    one = [F.lit(0), *(F.col(c) for c in by)]
    parts = rows.groupBy(*by, "__range").agg(combine(value).alias("__part"))
    parts = parts.select(*(F.col(c).alias(f"__by_{c}") for c in by), F.col("__range").alias("__in"), combine("__part").over(Window.partitionBy(F.lit(0), *(F.col(c) for c in by)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    here = combine(value).over(Window.partitionBy(*one[1:], "__range").orderBy("__i").rowsBetween(Window.unboundedPreceding, -1 if earlier else 0))
    rows = rows.withColumn("__here", here)
    same = [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]
    rows = rows.join(parts, [*same, F.col("__range") == F.col("__in")])
    if how == "sum":
        joined = F.when(F.col("__here").isNotNull() | F.col("__before").isNotNull(), F.coalesce("__here", F.lit(0)) + F.coalesce("__before", F.lit(0)))
    else:
        joined = (F.least if how == "min" else F.greatest)("__here", "__before")
    return rows.withColumn(out, joined.cast(combine_type(df, value, how))).select(*df.columns, out)


def combine_type(df: DataFrame, value: str, how: str) -> str:
    """The type of a running result: sums of whole numbers are longs."""
    kind = dict(df.dtypes)[value]
    return "bigint" if how == "sum" and kind in ("tinyint", "smallint", "int") else "double" if how == "sum" and kind == "float" else kind


def ranked(df: DataFrame, rank: str, order: str | list[str], out: str = "pos") -> DataFrame:
    """df with each row's 0-based place in its rank, by the index over (rank, order); no task gets a whole rank."""
    rows = global_index(df, rank, [order] if isinstance(order, str) else order, "__idx")
    first = F.broadcast(rows.groupBy(F.col(rank).alias("__of")).agg(F.min("__idx").alias("__first")))  # a row a rank
    return rows.join(first, F.col(rank).eqNullSafe(F.col("__of"))).withColumn(out, F.col("__idx") - F.col("__first")).select(*df.columns, out)


def exact_percentiles(values: DataFrame, by: list[str], value: str, points: list[float], weight: str | None = None) -> DataFrame:
    """(by, n, p array<double>): the percentiles of each group's finite values, between two values in proportion.

    Values are counted in BINS bins between their least and greatest, and the bins that hold a wanted place are counted again in
    bins of their own, until each holds one value: two or three passes, in which every task sends at most BINS counts a
    group and wanted place. Nothing is sorted and no group is held. Read from stored rows, if they are costly to work out.
    ``weight``: how many times each row counts, a whole number of at least 1.
    """
    rows = values.select(*by, F.col(value).cast("double").alias("__v"), (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("__w")).filter(F.col("__v").isNotNull() & ~F.isnan("__v") & (F.abs("__v") != float("inf")))
    groups = durable(rows.groupBy(*by).agg(F.sum("__w").alias("n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")))
    places = F.explode(F.array_distinct(F.flatten(F.array(*[F.array(F.floor(F.lit(p) * (F.col("n") - 1)), F.ceil(F.lit(p) * (F.col("n") - 1))) for p in points]))))
    asked = groups.select(*by, "__lo", "__hi", F.lit(0).cast("long").alias("__before"), places.alias("__rank"))
    of = [f"__of_{c}" for c in by]
    same = [F.col(c).eqNullSafe(F.col(o)) for c, o in zip(by, of, strict=True)]
    while not asked.filter("__lo < __hi").isEmpty():
        bins = asked.filter("__lo < __hi").select(*(F.col(c).alias(o) for c, o in zip(by, of, strict=True)), F.col("__lo").alias("__l"), F.col("__hi").alias("__h")).distinct()
        hits = rows.join(F.broadcast(bins), [*same, F.col("__v").between(F.col("__l"), F.col("__h"))])  # two bins a group and point at most
        width = F.col("__h") / 2 - F.col("__l") / 2
        number = F.least(F.floor((F.col("__v") / 2 - F.col("__l") / 2) / width * BINS), F.lit(BINS - 1))
        counts = hits.groupBy(*of, "__l", "__h", number.alias("__bin")).agg(F.sum("__w").alias("__c"), F.min("__v").alias("__least"), F.max("__v").alias("__most"))
        counts = counts.withColumn("__upto", F.sum("__c").over(Window.partitionBy(*of, "__l", "__h").orderBy("__bin"))).drop("__bin")
        place = F.col("__rank") - F.col("__before")
        found = (F.col("__lo") == F.col("__l")) & (F.col("__hi") == F.col("__h")) & (place < F.col("__upto")) & (place >= F.col("__upto") - F.col("__c"))
        refined = asked.join(counts, [*same, found], "left")
        asked = durable(refined.select(*by, F.coalesce("__least", "__lo").alias("__lo"), F.coalesce("__most", "__hi").alias("__hi"), (F.col("__before") + F.coalesce(F.col("__upto") - F.col("__c"), F.lit(0))).alias("__before"), "__rank"))
    at = asked.groupBy(*(F.col(c).alias(o) for c, o in zip(by, of, strict=True))).agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__lo"))).alias("__at"))  # some places a group

    def between(p: float) -> Column:
        x = F.lit(p) * (F.col("n") - 1)
        low = F.element_at("__at", F.floor(x))
        return low + (F.element_at("__at", F.ceil(x)) - low) * (x - F.floor(x))

    return groups.join(at, same).select(*by, "n", F.array(*map(between, points)).alias("p"))
