"""The queries of the library's operators by name, and the SQL that gives the same rows."""

from __future__ import annotations

from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
