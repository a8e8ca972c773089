"""Lifecycle phases from trailing windows, for every period of every module in one pass."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.periods import period_key
from ..functions.trend import critical, direction, mann_kendall

GROWTH, STABILIZING, DECLINE, NO_DATA = "growth", "stabilizing", "decline", "no_data"


def phase_features(axis: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The trailing features that end at each period of the axis; all windows share one sort."""
    s, w = settings, Window.partitionBy("module").orderBy("idx")
    upto, last, recent = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1 - s.window, 0), w.rowsBetween(1 - s.recent, 0)
    before, remembered = w.rowsBetween(Window.unboundedPreceding, -s.recent), w.rowsBetween(-s.recent - s.memory, -s.recent)
    rows = axis.withColumns({"n": F.row_number().over(w), "net": F.col("added") - F.col("deleted")})
    rows = rows.withColumns({"size": F.sum("net").over(upto), "busy": F.max(F.when(F.col("commits") > s.low_churn, F.col("n"))).over(upto)})
    return rows.withColumns({
        "churn_window": F.collect_list("commits").over(last), "size_window": F.collect_list("size").over(last), "net_window": F.collect_list("net").over(last),
        "level": F.sum("commits").over(recent) / s.recent, "low_streak": F.col("n") - F.coalesce("busy", F.lit(0)),
        "authors_recent": F.max("authors").over(recent), "authors_prior": F.coalesce(F.max("authors").over(remembered), F.lit(0)),
        "earlier_mean": F.coalesce(F.avg("commits").over(before), F.lit(0.0)), "net_recent": F.sum("net").over(recent), "net_most": F.max("net").over(recent),
    }).drop("busy")


def phase_labels(features: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The label at each period, its confidence and the reasons for it."""
    s = settings
    rows = features.withColumns({"churn": mann_kendall(F.col("churn_window"), s.alpha, slope=False), "growth_": mann_kendall(F.col("size_window"), s.alpha, slope=False)})
    strong = F.greatest(F.abs(F.col("churn.z")), F.abs(F.col("growth_.z"))) >= critical(0.05)
    started = F.greatest(F.lit(1), F.col("size") - F.col("net_recent"))
    shrank = (F.col("net_recent") < 0) & (F.col("net_most") <= 0) & (F.abs("net_recent") >= 0.05 * started)
    churn_up, churn_down = F.col("churn.trend") == "increasing", F.col("churn.trend") == "decreasing"
    size_up, size_down = F.col("growth_.trend") == "increasing", (F.col("growth_.trend") == "decreasing") | shrank
    leaving = (F.col("authors_recent") < F.col("authors_prior")) & (F.col("authors_recent") <= F.greatest(F.lit(1), F.floor(F.col("authors_prior") / 2)))
    votes = F.array_compact(F.array(F.when(churn_down, "churn falling"), F.when(size_down, "net deletions"), F.when(leaving, "authors leaving")))
    rows = rows.withColumns({"votes": votes, "strong": strong})
    decline = (F.col("earlier_mean") > s.low_churn) & (F.col("level") < F.col("earlier_mean")) & (F.size("votes") >= 2)
    calm = (F.col("low_streak") >= s.recent) & ~churn_up & ~size_down
    active = churn_up | size_up | (F.col("level") > s.low_churn)
    young = F.col("n") < s.min_periods

    def by_case(no_data, declining, stable, growing, unclear) -> Column:
        return F.when(young, no_data).when(decline, declining).when(calm, stable).when(active, growing).otherwise(unclear)

    level, trends = F.format_string("%.1f", "level"), [F.concat(F.lit("churn "), direction(F.col("churn.trend"))), F.concat(F.lit("size "), direction(F.col("growth_.trend")))]
    confidence = by_case(
        F.lit(None).cast("string"), F.when(F.col("strong") & (F.size("votes") == 3), "high").otherwise("medium"), F.when(F.col("low_streak") >= s.recent + 2, "high").otherwise("medium"),
        F.when((churn_up | size_up) & F.col("strong"), "high").when(F.col("level") > 2 * s.low_churn, "medium").otherwise("low"), F.lit("low"),
    )
    reasons = by_case(
        F.array(F.concat(F.lit("only "), F.col("n"), F.lit(f" closed period(s) of history; need {s.min_periods}"))),
        F.concat(F.col("votes"), F.array(F.concat(F.lit("churn "), level, F.lit("/period vs "), F.format_string("%.1f", "earlier_mean"), F.lit(" earlier")))),
        F.array(F.concat(F.col("low_streak").cast("string"), F.lit(f" consecutive low-churn periods (<= {s.low_churn:g} commits)")), trends[1]),
        F.array(*trends, F.concat(level, F.lit(" commits/period"))),
        F.array(F.lit("mixed signals; defaulting to growth (fail-safe against a false stabilizing label)")),
    )
    return rows.withColumns({
        "phase": by_case(F.lit(NO_DATA), F.lit(DECLINE), F.lit(STABILIZING), F.lit(GROWTH), F.lit(GROWTH)), "confidence": confidence, "reasons": reasons,
        "churn_trend": F.when(young, "flat").otherwise(direction(F.col("churn.trend"))), "size_trend": F.when(young, "flat").otherwise(direction(F.col("growth_.trend"))),
        "p_churn": F.when(~young, F.round("churn.p", 4)), "p_size": F.when(~young, F.round("growth_.p", 4)),
    }).drop("churn", "growth_", "votes", "strong")


def phases(labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The last label of each module and since when it holds.

    Going back, one period of another label does not end a run; two in a row do.
    """
    w = Window.partitionBy("module").orderBy("idx")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = labels.withColumns({"final": F.last("phase").over(whole), "total": F.count(F.lit(1)).over(whole)})
    rows = rows.withColumn("same", (F.col("phase") == F.col("final")) & (F.col("n") >= settings.min_periods))
    broken = ~F.col("same") & ~F.lead("same", 1, True).over(w)
    rows = rows.withColumn("edge", F.coalesce(F.max(F.when(broken, F.col("n"))).over(whole), F.lit(0)))
    rows = rows.withColumn("since_idx", F.min(F.when(F.col("same") & (F.col("n") > F.col("edge")), F.col("idx"))).over(whole))
    one = rows.where(F.col("n") == F.col("total"))
    return one.withColumn("since", F.when(F.col("phase") != NO_DATA, period_key(F.col("since_idx"), settings.scale))).drop("final", "total", "same", "edge")


def classified(facts: DataFrame, now: datetime, settings: Settings = Settings()) -> DataFrame:
    """One row per module with a commit: phase, since, confidence, reasons and evidence."""
    from .history import module_axis, module_period

    periods = module_period(facts)
    last = phases(phase_labels(phase_features(module_axis(periods, now, settings), settings), settings), settings)
    columns = ["phase", "since", "confidence", "reasons", "churn_trend", "size_trend", "level", "low_streak", "authors_recent", "authors_prior", "n", "churn_window", "net_window", "p_churn", "p_size"]
    out = periods.select("module").distinct().join(last.select("module", *columns), "module", "left")
    none = F.array(F.lit(f"only 0 closed period(s) of history; need {settings.min_periods}"))
    return out.withColumns({"phase": F.coalesce("phase", F.lit(NO_DATA)), "reasons": F.coalesce("reasons", none), "churn_trend": F.coalesce("churn_trend", F.lit("flat")), "size_trend": F.coalesce("size_trend", F.lit("flat")), "level": F.coalesce("level", F.lit(0.0)), "n": F.coalesce("n", F.lit(0))})
