"""Readers, sinks and contracts."""
