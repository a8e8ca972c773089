"""The three answers as DataFrames: the packet of a module, the overview of a repository, the check of a change."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..session import written
from . import cochange, gate, history, packages, phase


@dataclass
class Repository:
    """Signals of one history, made when asked for; `edges` are imports and `metrics` module metrics, if there are any.

    With `store`, the base fact is written to the shared folder when it is first needed: answers that come from several
    signals read it instead of going through the changes once for each.
    """

    changes: DataFrame
    now: datetime
    settings: Settings = Settings()
    edges: DataFrame | None = None
    metrics: DataFrame | None = None
    store: bool = False

    def __post_init__(self) -> None:
        spark = self.changes.sparkSession
        if self.edges is None:
            self.edges = spark.createDataFrame([], "src_path string, src_module string, dst_module string")
        if self.metrics is None:
            self.metrics = spark.createDataFrame([], "module string, files long, nloc long, functions long, ccn_avg double, ccn_max long, maintainability double, classes long, abstract_classes long")

    @cached_property
    def touched(self) -> DataFrame:
        rows = history.touches(self.changes, self.settings)
        return written(rows, "touches") if self.store else rows

    @cached_property
    def commits(self) -> DataFrame:
        return history.commit_totals(self.touched, self.settings)

    @cached_property
    def facts(self) -> DataFrame:
        return history.commit_modules(self.touched, self.settings)

    @cached_property
    def periods(self) -> DataFrame:
        return history.module_period(self.facts)

    @cached_property
    def phases(self) -> DataFrame:
        return phase.classified(self.facts, self.now, self.settings)

    @cached_property
    def pair_sums(self) -> DataFrame:
        return cochange.pair_sums(cochange.cochange_counts(self.facts, self.settings), self.now, self.settings)

    @cached_property
    def pairs(self) -> DataFrame:
        return cochange.with_trend(self.pair_sums, self.now, self.settings)

    @cached_property
    def all_partners(self) -> DataFrame:
        return cochange.partners(self.pair_sums, self.now, self.settings, top=0)

    @cached_property
    def partners(self) -> DataFrame:
        return self.all_partners.where(F.col("rank") <= self.settings.top_partners)

    @cached_property
    def fans(self) -> DataFrame:
        return packages.fan_in_out(self.edges)

    @cached_property
    def connected(self) -> DataFrame:
        return packages.connectedness(self.periods, self.fans, self.all_partners, self.settings)

    @cached_property
    def successors(self) -> DataFrame:
        return gate.successors(self.phases, self.partners, self.edges)

    def check(self, files: DataFrame, deck: gate.RuleDeck = gate.RuleDeck(), log: DataFrame | None = None, also: DataFrame | None = None) -> DataFrame:
        """Decided findings of diffs (diff_id, path, added, deleted, is_deleted); `log` has open warnings, see gate, and
        `also` findings from elsewhere, as `gate.fail_safe` has them."""
        found = gate.findings(gate.diff_modules(files, self.settings), self.phases, self.connected, self.pair_sums, self.settings)
        if also is not None:
            found = found.unionByName(also)
        return gate.decided(found, deck, self.now.date(), log, self.settings)

    def context(self) -> DataFrame:
        """One row per module: phase, evidence, connectedness, partners, metrics, newest commits, advice."""
        listed = self.partners.groupBy("module").agg(F.array_sort(F.collect_list(F.struct("rank", "partner", F.round("weight", 2).alias("weight"), "lifetime", "periods_active", "last_ts", "trend", F.round("share", 3).alias("share")))).alias("co_changes_with"))
        recent = history.recent_commits(self.facts).groupBy("module").agg(F.array_sort(F.collect_list(F.struct("rank", F.substring("hash", 1, 10).alias("hash"), F.to_date("ts").alias("when"), "subject", "added", "deleted"))).alias("reference_commits"))
        seen = self.periods.groupBy("module").agg(F.sum("commits").alias("commits_analyzed"))
        package = packages.package_metrics(self.fans, self.metrics).select("module", F.struct("ca", "ce", *(F.round(c, 3).alias(c) for c in ("instability", "abstractness", "distance"))).alias("package_metrics"))
        measured = self.metrics.select("module", F.struct(F.col("maintainability").alias("composite"), "files", "nloc", "functions", "ccn_avg", "ccn_max").alias("maintainability"))
        rows = self.phases.withColumn("level", F.round("level", 2)).join(self.connected, "module", "left").join(listed, "module", "left").join(measured, "module", "left").join(package, "module", "left").join(seen, "module", "left").join(recent, "module", "left")
        return rows.withColumn("advice", advice(F.col("module"), F.col("phase"), F.col("status"), F.get("co_changes_with", F.lit(0))["partner"]))

    def authority(self, files: DataFrame, judged: DataFrame) -> DataFrame:
        """(diff_id, module): where each of the diffs that `check` judged may go freely."""
        return gate.authority(gate.diff_modules(files, self.settings), self.phases, judged, self.partners)

    def packets(self) -> DataFrame:
        """The contexts, with the successor of each declining module."""
        return self.context().join(self.successors, "module", "left")

    def overview(self) -> DataFrame:
        """One row per module: the phase map."""
        rows = self.phases.select("module", "phase", "since", "confidence", F.round("level", 2).alias("churn_level"), "churn_trend", "size_trend")
        return rows.join(self.connected.select("module", "status", "fan_in", "partners"), "module", "left").join(self.metrics.select("module", "nloc", "maintainability"), "module", "left")

    def phase_table(self, top: int = 8) -> DataFrame:
        return self.overview().orderBy("phase", F.desc("churn_level"), "module").limit(max(4 * top, 40))

    def phase_histogram(self) -> DataFrame:
        return self.phases.groupBy("phase").agg(F.count(F.lit(1)).alias("modules"))

    def couplings(self, top: int | None = 8) -> DataFrame:
        rows = cochange.strongest_couplings(self.all_partners)
        return rows.orderBy(F.desc("weight"), "module_a", "module_b").limit(top) if top else rows

    def hotspots(self, top: int | None = 8) -> DataFrame:
        return packages.hotspots(self.periods, self.metrics, self.now, self.settings, top)

    def summary(self) -> DataFrame:
        """One row: commits, noise, first and last commit, modules by phase."""
        c = self.commits.agg(F.count(F.lit(1)).alias("commits"), F.count_if("is_noise").alias("noise_commits"), F.to_date(F.min("ts")).alias("first_commit"), F.to_date(F.max("ts")).alias("last_commit"))
        p = self.phases.agg(F.count(F.lit(1)).alias("modules"), *(F.count_if(F.col("phase") == x).alias(x) for x in (phase.GROWTH, phase.STABILIZING, phase.DECLINE, phase.NO_DATA)))
        return c.join(F.broadcast(p))  # one row each


def payload(rows: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("payload"))


def advice(module: Column, label: Column, status: Column, partner: Column) -> Column:
    say = lambda *parts: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in parts))
    return (
        F.when((label == phase.STABILIZING) & partner.isNotNull(), say("Prefer extending a caller (", partner, ") over adding code to ", module, "; it has been stable and others depend on it."))
        .when(label == phase.STABILIZING, say("Prefer extending a caller over adding code to ", module, "; it has been stable."))
        .when(label == phase.DECLINE, say(module, " is being withdrawn from (shrinking, fewer authors). Route new behaviour to its successor; keep changes here to fixes and removals."))
        .when(label == phase.NO_DATA, say("Too little history to judge ", module, "; treat as new code and add tests with any change."))
        .when(status == "isolated", say(module, " is in active development; nothing in the repository imports it or changes with it, so it is an entry point or new code — new code belongs here, keep it decoupled."))
        .otherwise(say(module, " is in active development; new code belongs here. Keep coupling to its usual partners only."))
    )
