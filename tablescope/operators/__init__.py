"""Distributed operators: each reduces the rows to small statistics or is a narrow projection."""
