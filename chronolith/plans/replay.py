"""Update steps as rows, and their medians and nearest-rank percentiles by mode and size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.commits import step_size


def summarised(steps: DataFrame) -> DataFrame:
    """(mode, files, total_ms) to n, median and p95 (value at rank floor(0.95 (n - 1))) by mode and size of the step.

    Ranks come from running counts over the distinct values, so that no group is held as a whole.
    """
    values = steps.withColumn("size", step_size(F.col("files"))).groupBy("mode", "size", "total_ms").agg(F.count(F.lit(1)).alias("here"))
    group = Window.partitionBy("mode", "size")
    rows = values.withColumns({"n": F.sum("here").over(group), "upto": F.sum("here").over(group.orderBy("total_ms"))})

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") > rank, F.col("total_ms")))

    n = F.col("n")
    one = rows.groupBy("mode", "size", "n").agg(at(F.floor((n - 1) / 2)).alias("low"), at(F.floor(n / 2)).alias("high"), at(F.floor(0.95 * (n - 1))).alias("p95"))
    return one.select("mode", "size", "n", F.round((F.col("low") + F.col("high")) / 2, 1).alias("median_total_ms"), F.round("p95", 1).alias("p95_total_ms"))
