"""queries() and oracle_sql() of the library's own operators."""

from __future__ import annotations

from . import composites, copies, filters_joins, genetics, grouping, ordering, phylogeny, reading, reports, science, statistics, streams, texts, units  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
