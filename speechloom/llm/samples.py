"""Bounded, reproducible samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents that nothing may be learnt from; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def bounded_sample(df: DataFrame, label_col: str, order_col: str, per_label: int) -> DataFrame:
    """About ``per_label`` rows of each label, all of them where there are fewer: those whose order_col, a hash spread over all
    longs, lies lowest. Counted and cut without bringing a label's rows together."""
    counts = {r[label_col]: r["n"] for r in df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).collect()}
    keep = F.lit(False)
    for label, n in counts.items():
        share = min(1.0, per_label / n)
        below = int(share * (1 << 64)) - (1 << 63)
        keep = keep | ((F.col(label_col) == F.lit(label)) & (F.col(order_col) <= F.lit(min(below, (1 << 63) - 1))))
    return df.filter(keep)
