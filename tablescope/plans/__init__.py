"""Whole-audit flows and the tables behind charts and findings."""
