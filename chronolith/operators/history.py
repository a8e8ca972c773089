"""From file changes to per-module history: the base fact, its totals, and the gap-filled calendar axis.

`changes` has one row per commit and file: hash, ts, author, email, subject, path, added, deleted; old_path is optional.
Everything is derived from it, so redoing a batch of the same commits changes nothing.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.commits import author_id, noise_reason
from ..functions.paths import is_source, module_of
from ..functions.periods import last_closed, period_index, period_key

_COMMIT = ("ts", "author", "email", "subject")


def touches(changes: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per commit and counted module, and one per commit for the files that no module counts (module null).

    Each carries the commit's own columns and totals (files, added and deleted over all its files; source_files; modules;
    noise_reason). A commit without files, a row with a null path, has none. Files are added up before commits are brought together, so a huge commit moves one row per module.
    """
    module = F.when(is_source(F.col("path")), module_of(F.col("path"), settings))
    rows = changes.withColumn("module", module).groupBy("hash", "module").agg(
        *(F.first(c).alias(c) for c in _COMMIT), F.count("path").alias("m_files"), F.coalesce(F.sum("added"), F.lit(0)).cast("long").alias("m_added"), F.coalesce(F.sum("deleted"), F.lit(0)).cast("long").alias("m_deleted")
    )
    commit = Window.partitionBy("hash")
    counted = F.col("module").isNotNull()
    rows = rows.withColumns({
        "files": F.sum("m_files").over(commit), "added": F.sum("m_added").over(commit), "deleted": F.sum("m_deleted").over(commit),
        "source_files": F.coalesce(F.sum(F.when(counted, F.col("m_files"))).over(commit), F.lit(0)), "modules": F.count("module").over(commit),
    })
    return rows.withColumn("noise_reason", noise_reason(F.col("author"), F.col("email"), F.col("subject"), F.col("files"), F.col("source_files"), settings))


def commit_totals(touched: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per commit."""
    columns = [*_COMMIT, "files", "added", "deleted", "source_files", "modules", "noise_reason"]
    one = touched.groupBy("hash").agg(*(F.first(c).alias(c) for c in columns))
    return one.withColumns({"is_noise": F.col("noise_reason").isNotNull(), "period": period_key(period_index(F.col("ts"), settings.scale), settings.scale)})


def commit_modules(touched: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per commit that counts and module: what every signal is made of."""
    rows = touched.where(F.col("module").isNotNull() & F.col("noise_reason").isNull())
    return rows.select(
        "hash", "module", "ts", author_id(F.col("author"), F.col("email")).alias("author"), "subject", period_index(F.col("ts"), settings.scale).alias("idx"),
        F.col("m_files").alias("files"), F.col("m_added").alias("added"), F.col("m_deleted").alias("deleted"), "modules",
    )


def renames(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("old_path").isNotNull() & (F.col("old_path") != F.col("path"))).select("old_path", "path", "hash", "ts").dropDuplicates(["old_path", "path", "hash"])


def module_period(facts: DataFrame) -> DataFrame:
    """One row per module and period with a commit: commits, added, deleted, files, authors."""
    return facts.groupBy("module", "idx").agg(
        F.count(F.lit(1)).alias("commits"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.sum("files").alias("files"), F.count_distinct("author").alias("authors")
    )


def module_authors(facts: DataFrame) -> DataFrame:
    """One row per module, period and author: commits."""
    return facts.groupBy("module", "idx", "author").agg(F.count(F.lit(1)).alias("commits"))


def module_axis(periods: DataFrame, now: datetime, settings: Settings = Settings()) -> DataFrame:
    """One row per module and closed period since its first commit, with zeros in the gaps.

    A row stretches over the gap behind it, so that no calendar has to be joined. Modules that began in the open period
    have no row.
    """
    closed = last_closed(now, settings.scale)
    after = F.coalesce(F.lead("idx").over(Window.partitionBy("module").orderBy("idx")) - 1, F.lit(closed))
    rows = periods.where(F.col("idx") <= closed).withColumn("until", after).withColumn("at", F.explode(F.sequence("idx", "until")))
    there = F.col("at") == F.col("idx")
    values = [F.when(there, F.col(c)).otherwise(0).alias(c) for c in ("commits", "added", "deleted", "files", "authors")]
    return rows.select("module", F.col("at").alias("idx"), *values)


def recent_commits(facts: DataFrame, newest: int = 3) -> DataFrame:
    """The newest commits of each module, by time and then hash."""
    order = Window.partitionBy("module").orderBy(F.desc("ts"), F.desc("hash"))
    rows = facts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= newest)
    return rows.select("module", "rank", "hash", "ts", F.substring(F.coalesce("subject", F.lit("")), 1, 80).alias("subject"), "added", "deleted")
