"""Modules that change together: counts, time-decayed weights, partners."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.periods import last_closed
from ..functions.trend import direction, mann_kendall


def cochange_counts(facts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per pair (module_a < module_b) and period: commits, and the last one of them.

    Changesets of too many modules are left out before pairs are made, so a commit makes a bounded number of them; the
    pairs come from the commit's own array, without a self-join.
    """
    small = facts.where(F.col("modules").between(2, settings.max_modules))
    sets = small.groupBy("hash").agg(F.first("ts").alias("ts"), F.first("idx").alias("idx"), F.array_sort(F.collect_set("module")).alias("m"))
    pairs = F.flatten(F.transform("m", lambda a, i: F.transform(F.slice(F.col("m"), i + 2, F.size("m")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    rows = sets.select("hash", "ts", "idx", F.explode(pairs).alias("p"))
    last = F.max(F.struct("ts", "hash"))
    return rows.groupBy(F.col("p.a").alias("module_a"), F.col("p.b").alias("module_b"), "idx").agg(F.count(F.lit(1)).alias("count"), last.alias("last")).select("module_a", "module_b", "idx", "count", F.col("last.ts").alias("last_ts"), F.col("last.hash").alias("last_hash"))


def decayed(count: Column, idx: Column, closed: int, settings: Settings) -> Column:
    """A count's weight by age in periods; the open period has age 0."""
    return count * F.pow(F.lit(0.5), F.greatest(F.lit(0), F.lit(closed) - idx) / max(0.1, settings.half_life))


def pair_sums(counts: DataFrame, now: datetime, settings: Settings = Settings()) -> DataFrame:
    """One row per pair: weight, lifetime, periods_active, the last commit, and the counts that make its trend."""
    closed = last_closed(now, settings.scale)
    late = F.col("idx") > closed - settings.window
    return counts.groupBy("module_a", "module_b").agg(
        F.sum(decayed(F.col("count"), F.col("idx"), closed, settings)).alias("weight"), F.sum("count").alias("lifetime"), F.count(F.lit(1)).alias("periods_active"),
        F.max(F.struct("last_ts", "last_hash")).alias("last"), F.min("idx").alias("first"), F.map_from_entries(F.collect_list(F.when(late, F.struct("idx", "count")))).alias("by_period"),
    ).select("module_a", "module_b", "weight", "lifetime", "periods_active", F.col("last.last_ts").alias("last_ts"), F.col("last.last_hash").alias("last_hash"), "first", "by_period")


def with_trend(rows: DataFrame, now: datetime, settings: Settings = Settings()) -> DataFrame:
    """The trend of the counts over the window since the pair's first period, in place of the counts."""
    closed = last_closed(now, settings.scale)
    axis = F.sequence(F.greatest("first", F.lit(closed - settings.window + 1)), F.lit(closed))
    series = F.transform(axis, lambda i: F.coalesce(F.col("by_period")[i], F.lit(0)))
    trend = F.when(closed - F.col("first") < 2, "flat").otherwise(direction(mann_kendall(series, settings.alpha, slope=False)["trend"]))
    return rows.withColumn("trend", trend).drop("first", "by_period")


def partners(sums: DataFrame, now: datetime, settings: Settings = Settings(), top: int | None = None) -> DataFrame:
    """One row per module and reported partner, heaviest first; top 0 reports all above the least weight.

    A share counts the partners below the least weight too; a trend is only made for those that are reported.
    """
    sides = F.array(*(F.struct(F.col(x).alias("module"), F.col(y).alias("partner")) for x, y in (("module_a", "module_b"), ("module_b", "module_a"))))
    both = sums.withColumn("side", F.explode(sides)).select("side.*", "*").drop("side", "module_a", "module_b")
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("module"))
    rows = both.withColumn("share", F.coalesce(share, F.lit(0.0))).where(F.col("weight") >= settings.min_weight)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("module").orderBy(F.desc("weight"), "partner")))
    top = settings.top_partners if top is None else top
    return with_trend(rows.where(F.col("rank") <= top) if top else rows, now, settings)


def strongest_couplings(reported: DataFrame, each: int = 3) -> DataFrame:
    """The distinct pairs among each module's first partners."""
    rows = reported.where(F.col("rank") <= each)
    key = [F.least("module", "partner").alias("module_a"), F.greatest("module", "partner").alias("module_b")]
    return rows.select(*key, F.round("weight", 2).alias("weight"), "lifetime", "trend").dropDuplicates(["module_a", "module_b"])
