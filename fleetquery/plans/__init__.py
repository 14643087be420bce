"""Queries over the benchmark tables, each an operator on a stand-in for its
fleet table, with the same result in DuckDB's SQL."""
