"""Joins of which no task gets all rows of a frequent key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored

#: A key is hot where it has more than one in so many of the rows; so there are fewer hot keys than this.
HOT_PARTS = 2000


def join_unskewed(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left joined (``inner`` or ``left``) with a table that has each key once, however often left has it.

    Keys that make up more than 1 / HOT_PARTS of left, of which there are fewer than HOT_PARTS, are joined by broadcast, so no
    task gets the rows of one of them; all other keys by shuffle. left is read three times: store it first. Rows with a null
    key find nothing, as in any join, and should be few.
    """
    counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    hot = stored(counts.filter(F.col("__n") > max(1, left.count() // HOT_PARTS)).select(*on))
    spread = left.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(right.join(F.broadcast(hot), on, "left_semi")), on, how)
    return spread.unionByName(left.join(F.broadcast(hot), on, "left_anti").join(right, on, how))
