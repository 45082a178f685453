"""All queries of the engine by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from . import batch_queries, corridor_queries, field_queries, join_queries, passage_queries, raster_queries, report_queries, row_queries, scalar_queries, survey_queries, table_queries  # noqa: F401  they register their queries
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
