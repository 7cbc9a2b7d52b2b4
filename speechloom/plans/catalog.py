"""All registered queries of the library with their DuckDB twins."""

from . import align_queries, bin_queries, report_queries, rest_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
