"""All registered queries of the panel engine and their oracle SQL."""

from __future__ import annotations

from . import grids, runtime, sequences, statistics, tables  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
