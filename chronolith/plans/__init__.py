"""Bindings of the engine to tables, its named queries and their SQL."""
