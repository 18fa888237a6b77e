"""Streaming replay of call ledgers."""
