"""All queries by name, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import plans  # noqa: F401  registers the queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
