"""Registered queries, one for each operator, over the derived tables."""

from tactuslab.queries import core, ranges, scans, stages, structure  # noqa: F401
from tactuslab.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
