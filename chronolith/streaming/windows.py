"""Streams of events: tumbling counts with a watermark, and escalation of warnings with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Settings


def streamed_churn(events: DataFrame, key: str, ts: str = "ts", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events by key and tumbling window; a window closes once the watermark passes it."""
    rows = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count(F.lit(1)).alias("events"))
    return rows.select(F.col("w.start").alias("window_start"), key, "events")


def streamed_escalations(events: DataFrame, settings: Settings = Settings(), late: str = "1 hour") -> DataFrame:
    """The verdict on each streamed warning (id, ts, module, rule, resolves), as gate.escalations gives it in batch.

    The state of a module is its open warnings of the escalation period; it goes once the watermark has passed that.
    """
    span = pd.Timedelta(hours=settings.escalation_hours)
    limit = settings.escalation_count - 1

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rules, times = (list(x) for x in state.get) if state.exists else ([], [])
        rows = pd.concat(list(batches)).sort_values(["ts", "id"], kind="stable")
        out = []
        for r in rows.itertuples():
            at = pd.Timestamp(r.ts).value
            if r.resolves:
                rules, times = [], []
                continue
            kept = [(x, t) for x, t in zip(rules, times, strict=True) if t >= at - span.value]
            rules, times = [x for x, _ in kept], [t for _, t in kept]
            open_ = rules.count(r.rule)
            out.append((r.id, r.ts, key[0], r.rule, open_, "block" if open_ >= limit else "warn"))
            rules.append(r.rule)
            times.append(at)
        state.update((rules, times))
        latest = max([*times, pd.Timestamp(rows["ts"].max()).value])
        state.setTimeoutTimestamp(max(latest + span.value, 0) // 1_000_000 + 1)
        yield pd.DataFrame(out, columns=["id", "ts", "module", "rule", "open", "verdict"])

    kinds = dict(events.dtypes)
    schema = f"id {kinds['id']}, ts timestamp, module {kinds['module']}, rule string, open int, verdict string"
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy("module").applyInPandasWithState(step, schema, "rules array<string>, times array<long>", "append", GroupStateTimeout.EventTimeTimeout)
