"""Working an array expression out once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once a row: what a lambda's body takes from outside is worked out again for every
    element, but a lambda's own argument is not."""
    return F.transform(F.array(value), use)[0]


def once(value: Column) -> Column:
    """value, for a select of its own: worked out once a row, whatever is filtered or derived from it. Spark puts a column's
    expression in the place of its name in filters and further columns, but not through a generator."""
    return F.explode(F.array(value))
