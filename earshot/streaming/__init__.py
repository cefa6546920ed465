"""Incremental scoring of arriving predictions."""
