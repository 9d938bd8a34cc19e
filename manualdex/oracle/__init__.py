"""Equivalent SQL for every registered query, written for DuckDB."""
