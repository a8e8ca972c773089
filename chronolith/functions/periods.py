"""The calendar axis: period numbers (consecutive periods differ by one), their keys and first days, as columns."""

from __future__ import annotations

from datetime import UTC, date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SCALES

#: Days from 0001-01-01, day 1, to 1970-01-01.
_EPOCH = 719163


def _check(scale: str) -> None:
    if scale not in SCALES:
        raise ValueError(f"unknown scale {scale!r}; expected one of {SCALES}")


def period_index(ts: Column, scale: str) -> Column:
    _check(scale)
    if scale == "weekly":
        return F.floor((F.unix_date(F.to_date(F.date_trunc("week", ts))) + _EPOCH) / 7).cast("int")
    year = F.year(ts)
    return {"monthly": year * 12 + F.month(ts) - 1, "quarterly": year * 4 + F.quarter(ts) - 1, "yearly": year}[scale]


def period_start(index: Column, scale: str) -> Column:
    """The first day of a period."""
    _check(scale)
    if scale == "weekly":
        return F.date_from_unix_date((index * 7 + 1 - _EPOCH).cast("int"))
    per = {"monthly": 12, "quarterly": 4, "yearly": 1}[scale]
    return F.make_date(F.floor(index / per).cast("int"), (F.pmod(index, F.lit(per)) * (12 // per) + 1).cast("int"), F.lit(1))


def period_key(index: Column, scale: str) -> Column:
    """Sortable text, such as 2026-W05, 2026-03, 2026-Q1 or 2026."""
    start = period_start(index, scale)
    if scale == "weekly":
        return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), start).cast("int"), F.weekofyear(start))
    if scale == "monthly":
        return F.format_string("%d-%02d", F.year(start), F.month(start))
    if scale == "quarterly":
        return F.format_string("%d-Q%d", F.year(start), F.quarter(start))
    return F.year(start).cast("string")


def index_of(when: datetime | date, scale: str) -> int:
    """The same number for a value of the driver."""
    _check(scale)
    if isinstance(when, datetime) and when.tzinfo:
        when = when.astimezone(UTC)
    if scale == "weekly":
        return (when.toordinal() - 1) // 7
    per = {"monthly": 12, "quarterly": 4, "yearly": 1}[scale]
    return when.year * per + (when.month - 1) * per // 12


def last_closed(now: datetime | date, scale: str) -> int:
    return index_of(now, scale) - 1


def choose_scale(times: DataFrame, ts: str, now: datetime, years: float = 3.0) -> DataFrame:
    """One row: the finest scale with at least four periods and none empty over the last years; else yearly.

    All times count if none is recent; no time at all gives monthly.
    """
    cutoff = F.lit(now.replace(tzinfo=None)).cast("timestamp_ntz") - F.expr(f"INTERVAL {round(years * 365.25 * 86400)} SECOND")
    at = F.col(ts).cast("timestamp_ntz")
    numbers = times.select((at >= cutoff).alias("recent"), *(period_index(at, s).alias(s) for s in SCALES))

    def spans(rows: Column) -> list[Column]:
        return [F.struct(F.count_distinct(F.when(rows, F.col(s))).alias("n"), (F.max(F.when(rows, F.col(s))) - F.min(F.when(rows, F.col(s))) + 1).alias("span")) for s in SCALES]

    every, recent = F.array(*spans(F.lit(True))), F.array(*spans(F.col("recent")))
    one = numbers.agg(F.count(F.lit(1)).alias("times"), F.coalesce(F.count_if("recent"), F.lit(0)).alias("n_recent"), every.alias("every"), recent.alias("some"))
    spans_ = F.when(F.col("n_recent") > 0, F.col("some")).otherwise(F.col("every"))
    fits = F.filter(F.arrays_zip(spans_.alias("x"), F.array(*map(F.lit, SCALES)).alias("scale")), lambda z: (z["x"]["n"] >= 4) & (z["x"]["n"] == z["x"]["span"]))
    return one.select(F.when(F.col("times") == 0, "monthly").otherwise(F.coalesce(F.get(F.transform(fits, lambda z: z["scale"]), F.lit(0)), F.lit("yearly"))).alias("scale"))
