"""Readers of commit logs, trees, diffs, rule decks and settings; writers of result tables."""
