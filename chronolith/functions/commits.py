"""Commit-level expressions: who wrote it, and why it may be noise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BOT_AUTHORS, NOISE_SUBJECTS, STEP_SIZES, Settings
from .paths import any_of


def author_id(author: Column, email: Column) -> Column:
    given = lambda c: F.when(c != "", c)
    return F.lower(F.trim(F.coalesce(given(email), given(author), F.lit("unknown"))))


def noise_reason(author: Column, email: Column, subject: Column, files: Column, source_files: Column, settings: Settings) -> Column:
    """The first reason that holds; null for a commit that counts."""
    who = F.concat(F.coalesce(author, F.lit("")), F.lit(" <"), F.coalesce(email, F.lit("")), F.lit(">"))
    return (
        F.when(who.rlike(f"(?i){any_of(BOT_AUTHORS)}"), "bot_author")
        .when(F.coalesce(subject, F.lit("")).rlike(f"(?i){any_of(NOISE_SUBJECTS)}"), "maintenance_subject")
        .when(files > settings.max_files, "bulk_changeset")
        .when(source_files == 0, "no_source_files")
    )


def step_size(files: Column) -> Column:
    """The size label of an update step."""
    out = F.lit(STEP_SIZES[-1][1])
    for most, label in reversed(STEP_SIZES[:-1]):
        out = F.when(files <= most, label).otherwise(out)
    return F.when(files < 0, STEP_SIZES[0][1]).otherwise(out)


def maintainability(nloc: Column, complexity: Column) -> Column:
    """A 0-100 score from size and summed complexity."""
    raw = 171.0 - 0.23 * F.greatest(F.lit(1), complexity) - 16.2 * F.log(F.greatest(F.lit(1), nloc).cast("double"))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw * 100.0 / 171.0))
