"""All queries over the vector operators, by name, and the SQL that they are held against."""

from __future__ import annotations

from quiverdf.plans import cluster, quantise, vectors  # noqa: F401  (these register their queries)
from quiverdf.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
