"""Registered queries over the given tables, each with the SQL that must give the same rows."""

from workloads import cleaning, components, correspondence, factor, mixed, relations, tables  # noqa: F401
from workloads.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
