"""Queries by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
