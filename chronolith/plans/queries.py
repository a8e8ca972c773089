"""The engine's queries on the bound tables, by name. Each takes (spark, sf_dir) and covers whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SCALES
from ..functions.commits import maintainability
from ..functions.paths import extension, is_ignored, is_source, is_test_module, language_of, module_of
from ..functions.periods import choose_scale, last_closed, period_index, period_key, period_start
from ..functions.trend import direction, mann_kendall
from ..operators import cochange, content, gate, history, packages, phase
from . import binding as b
from .replay import summarised

S, NOW = b.SETTINGS, b.NOW


def _key(name: str = "idx"):
    return period_key(F.col(name), S.scale).alias("period")


def period_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = b.table(spark, d, "orders").select("o_orderkey", *(period_index(F.col("o_orderdate"), s).alias(f"{s}_idx") for s in SCALES))
    return rows.select("*", *(period_key(F.col(f"{s}_idx"), s).alias(f"{s}_key") for s in SCALES), *(period_start(F.col(f"{s}_idx"), s).cast("string").alias(f"{s}_start") for s in SCALES))


def scale_choice(spark: SparkSession, d: str) -> DataFrame:
    return choose_scale(b.table(spark, d, "orders"), "o_orderdate", NOW)


def path_modules(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    rows = b.part_paths(spark, d).select("path").unionByName(b.table(spark, d, "pages").select(F.regexp_replace("url", r"^[a-z]+://|[?#].*$", "").alias("path")))
    return rows.distinct().select("path", module_of(p, S).alias("module"), extension(p).alias("extension"), language_of(p).alias("language"), is_source(p).alias("is_source"), is_ignored(p).alias("is_ignored"), F.coalesce(is_test_module(module_of(p, S)), F.lit(False)).alias("is_test"))


def noise_reasons(spark: SparkSession, d: str) -> DataFrame:
    return b.repository(spark, d).commits.groupBy(F.coalesce("noise_reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("commits"), F.sum("files").alias("files"))


def commit_totals(spark: SparkSession, d: str) -> DataFrame:
    return b.repository(spark, d).commits.select("hash", "ts", "period", "files", "added", "deleted", "source_files", "modules", "is_noise", "noise_reason")


def commit_modules(spark: SparkSession, d: str) -> DataFrame:
    return b.repository(spark, d).facts.select("hash", "module", "author", _key(), "files", "added", "deleted")


def module_period(spark: SparkSession, d: str) -> DataFrame:
    return b.repository(spark, d).periods.select("module", _key(), "commits", "added", "deleted", "files", "authors")


def module_authors(spark: SparkSession, d: str) -> DataFrame:
    return history.module_authors(b.repository(spark, d).facts).select("module", _key(), "author", "commits")


def _axis(spark: SparkSession, d: str) -> DataFrame:
    return history.module_axis(b.repository(spark, d).periods, NOW, S)


def module_axis(spark: SparkSession, d: str) -> DataFrame:
    return _axis(spark, d).select("module", _key(), "commits", "added", "deleted", "files", "authors")


def phase_features(spark: SparkSession, d: str) -> DataFrame:
    rows = phase.phase_features(_axis(spark, d), S)
    joined = lambda c: F.array_join(c, ",").alias(c)
    return rows.select("module", _key(), "n", "size", "level", "low_streak", "authors_recent", "authors_prior", F.round("earlier_mean", 6).alias("earlier_mean"), "net_recent", "net_most", joined("churn_window"), joined("size_window"))


def mann_kendall_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = phase.phase_features(_axis(spark, d), S).select("module", _key(), mann_kendall(F.col("churn_window"), S.alpha).alias("t"))
    return rows.select("module", "period", "t.trend", "t.n", "t.s", F.round("t.z", 6).alias("z"), F.round("t.p", 5).alias("p"), F.round("t.slope", 6).alias("slope"), direction(F.col("t.trend")).alias("direction"))


def phase_labels(spark: SparkSession, d: str) -> DataFrame:
    return phase.phase_labels(phase.phase_features(_axis(spark, d), S), S).select("module", _key(), "phase", "confidence")


def phase_since(spark: SparkSession, d: str) -> DataFrame:
    return b.repository(spark, d, store=True).phases.select("module", "phase", "since", "confidence", "churn_trend", "size_trend", F.col("n").alias("periods"), "low_streak")


def phase_histogram(spark: SparkSession, d: str) -> DataFrame:
    return b.repository(spark, d, store=True).phase_histogram()


def cochange_counts(spark: SparkSession, d: str) -> DataFrame:
    return cochange.cochange_counts(b.repository(spark, d).facts, S).select("module_a", "module_b", _key(), "count", "last_ts", "last_hash")


def cochange_decayed(spark: SparkSession, d: str) -> DataFrame:
    return b.repository(spark, d).pairs.select("module_a", "module_b", F.round("weight", 6).alias("weight"))


def pair_lifetime(spark: SparkSession, d: str) -> DataFrame:
    return b.repository(spark, d).pairs.select("module_a", "module_b", "lifetime", "periods_active", "last_ts", "last_hash", "trend")


def partners_topk(spark: SparkSession, d: str) -> DataFrame:
    return b.repository(spark, d).partners.select("module", "partner", "rank", F.round("weight", 6).alias("weight"), F.round("share", 6).alias("share"), "lifetime")


def strongest_couplings(spark: SparkSession, d: str) -> DataFrame:
    return b.repository(spark, d).couplings(top=None).select("module_a", "module_b", "lifetime", "trend")


def fan_in_out(spark: SparkSession, d: str) -> DataFrame:
    return b.repository(spark, d).fans


def package_metrics(spark: SparkSession, d: str) -> DataFrame:
    rounded = (F.round(c, 6).alias(c) for c in ("instability", "abstractness", "distance"))
    repo = b.repository(spark, d)
    return packages.package_metrics(repo.fans, repo.metrics).select("module", "ca", "ce", *rounded)


def connectedness(spark: SparkSession, d: str) -> DataFrame:
    return b.repository(spark, d, store=True).connected.select("module", "status", "fan_in", "fan_out", "partners")


def hotspots(spark: SparkSession, d: str) -> DataFrame:
    return b.repository(spark, d).hotspots(top=None).select("module", "commits", "lines", F.round("score", 6).alias("score"))


def recent_commits(spark: SparkSession, d: str) -> DataFrame:
    return history.recent_commits(b.repository(spark, d).facts)


def module_content(spark: SparkSession, d: str) -> DataFrame:
    files = b.blobs(spark, d)
    out = content.module_metrics(content.file_state(files, S), content.blob_metrics(files))
    return out.select("module", "files", "nloc")


def blob_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Native: lines that are not blank, and maintainability, once per content."""
    files = b.blobs(spark, d)
    one = files.groupBy("blob").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("files"), F.any_value("content").alias("content"))
    nloc = F.size(F.filter(F.split("content", "\n"), lambda x: F.trim(x) != "")).cast("bigint")
    return one.select("blob", "path", "files", nloc.alias("nloc"), F.round(maintainability(nloc, F.lit(0)), 4).alias("mi"))


def link_extract(spark: SparkSession, d: str) -> DataFrame:
    links = b.table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), 1)).alias("link"))
    return links.groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))


def gate_escalation(spark: SparkSession, d: str) -> DataFrame:
    return gate.escalations(b.gate_events(spark, d), S)


def gate_summary(spark: SparkSession, d: str) -> DataFrame:
    from datetime import datetime

    return gate.log_summary(b.gate_events(spark, d).where("not resolves"), datetime(2024, 2, 1), 30)


def gate_rules(spark: SparkSession, d: str) -> DataFrame:
    return b.repository(spark, d, store=True).check(b.proposed(spark, d)).select("diff_id", "rule", "module", "severity", "deviation", "other", F.coalesce("lifetime", F.lit(-1)).alias("lifetime"))


def gate_verdicts(spark: SparkSession, d: str) -> DataFrame:
    diffs = b.proposed(spark, d)
    rows = gate.verdicts(diffs, b.repository(spark, d, store=True).check(diffs))
    return rows.select("diff_id", "verdict", "deviation", F.array_join("rules_fired", ",").alias("rules_fired"))


def explain_modules(spark: SparkSession, d: str) -> DataFrame:
    return b.repository(spark, d, store=True).overview().select("module", "phase", "since", "status", "fan_in", "partners", "churn_level", "nloc")


def context_packets(spark: SparkSession, d: str) -> DataFrame:
    rows = b.repository(spark, d, store=True).context()
    return rows.select("module", "phase", "since", "status", "commits_analyzed", F.size(F.coalesce("co_changes_with", F.array())).alias("reported"), "advice")


def repository_summary(spark: SparkSession, d: str) -> DataFrame:
    return b.repository(spark, d, store=True).summary().withColumns({c: F.col(c).cast("string") for c in ("first_commit", "last_commit")})


def step_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Commits as update steps; their lines stand for milliseconds."""
    commits = b.repository(spark, d).commits
    return summarised(commits.select(F.lit("shared").alias("mode"), "files", (F.col("added") + F.col("deleted")).cast("double").alias("total_ms")))


def closed_period(spark: SparkSession, d: str) -> DataFrame:
    """The last closed period of each scale, and how many of the bound commits come after it."""
    at = [F.struct(F.lit(s).alias("scale"), F.lit(last_closed(NOW, s)).alias("idx"), period_key(F.lit(last_closed(NOW, s)), s).alias("period"), period_index(F.col("o_orderdate"), s).alias("own")) for s in SCALES]
    rows = b.table(spark, d, "orders").select(F.explode(F.array(*at)).alias("s")).select("s.*")
    return rows.groupBy("scale", "idx", "period").agg(F.count_if(F.col("own") > F.col("idx")).alias("open_commits"))


QUERIES = {f.__name__: f for f in (
    period_keys, scale_choice, closed_period, path_modules, noise_reasons, commit_totals, commit_modules, module_period, module_authors, module_axis, phase_features, phase_labels, phase_since,
    phase_histogram, cochange_counts, cochange_decayed, pair_lifetime, partners_topk, strongest_couplings, fan_in_out, package_metrics, connectedness, hotspots, recent_commits, module_content,
    blob_dedupe, link_extract, gate_escalation, gate_summary, gate_rules, gate_verdicts, explain_modules, context_packets, repository_summary, step_sizes,
)} | {"mann_kendall": mann_kendall_windows}
