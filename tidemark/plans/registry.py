"""Every registered query and its DuckDB counterpart."""

from __future__ import annotations

from tidemark.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
