"""Incremental and streaming forms of the history."""
