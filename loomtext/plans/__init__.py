"""Queries over the test tables, with DuckDB SQL."""
