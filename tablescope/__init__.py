"""Audit of one table and its multivariate structure, as Spark jobs."""

from tablescope.analysis import TableAnalysis
from tablescope.operators.profile import Detection, column_profile, detect, routing_df
from tablescope.operators.sanitize import SanitizationReport, SanitizedTable, check_minimum_requirements, sanitize

__all__ = [
    "Detection",
    "SanitizationReport",
    "SanitizedTable",
    "TableAnalysis",
    "check_minimum_requirements",
    "column_profile",
    "detect",
    "routing_df",
    "sanitize",
]
