"""Registered queries over the test warehouse, their DuckDB oracles, and a checker."""
