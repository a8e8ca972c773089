"""Checking proposed changes: diffs, rules as data, suppressions, escalation.

Everything works on many diffs at once; a diff is a group of rows with one `diff_id`.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.paths import is_source, module_of
from .phase import DECLINE, GROWTH, NO_DATA, STABILIZING

# Rules (id, name, severity, family, description).
RULES = (
    ("SL-F00", "no_index", "warn", "F", "No index exists for this repository."),
    ("SL-F01", "index_stale", "warn", "F", "The index is behind HEAD."),
    ("SL-F02", "history_rewritten", "warn", "F", "The bookmark is no longer an ancestor of HEAD."),
    ("SL-W01", "add_to_stabilizing", "warn", "W", "The change adds code to a module in the stabilizing phase."),
    ("SL-W02", "add_to_declining", "warn", "W", "The change adds code to a module in the decline phase."),
    ("SL-W03", "new_coupling", "warn", "W", "The change couples modules that have never changed together, one of them stable or load-bearing."),
    ("SL-W04", "coupling_against_trend", "warn", "W", "The change re-couples modules whose co-change had faded."),
    ("SL-I01", "no_data", "info", "I", "A touched module has too little history for a phase."),
    ("SL-I02", "unknown_module", "info", "I", "A touched path belongs to no module in the index."),
)
SEVERITIES = ("warn", "info", "off")
_SUPPRESSION = ("rule", "module", "reason", "by", "until")


@dataclass(frozen=True)
class RuleDeck:
    """Severities by rule and suppressions, first ones first."""

    severities: dict[str, str] = field(default_factory=dict)
    suppressions: tuple[tuple[str, str, str, str, date], ...] = ()

    @classmethod
    def from_toml(cls, text: str) -> RuleDeck:
        """Unknown rules and severities, and suppressions that lack a field, are ignored."""
        data, known = tomllib.loads(text), {r[0] for r in RULES}
        chosen = {k: v["severity"] for k, v in data.get("rules", {}).items() if k in known and isinstance(v, dict) and v.get("severity") in SEVERITIES}
        kept = []
        for s in data.get("suppress", []):
            try:
                until = s["until"] if isinstance(s["until"], date) else date.fromisoformat(str(s["until"]))
                kept.append((*(str(s[k]) for k in _SUPPRESSION[:4]), until))
            except (KeyError, TypeError, ValueError):
                continue
        return cls(chosen, tuple(kept))

    def rules(self, spark: SparkSession) -> DataFrame:
        rows = [(i, n, self.severities.get(i, s), f, d) for i, n, s, f, d in RULES]
        return spark.createDataFrame(rows, "rule string, name string, severity string, family string, description string")

    def suppressed(self, spark: SparkSession, today: date) -> DataFrame:
        """Suppressions in force: rule, module, position, reason, by, until."""
        rows = [(r, m, k, why, by, until) for k, (r, m, why, by, until) in enumerate(self.suppressions) if today <= until]
        return spark.createDataFrame(rows, "rule string, module string, position int, reason string, by string, until date")

    def expired(self, today: date) -> list[tuple]:
        return [s for s in self.suppressions if s[4] < today]


def parsed_diffs(diffs: DataFrame) -> DataFrame:
    """(diff_id, text) to one row per file: path, old_path, added, deleted, is_new, is_deleted.

    A deleted line that begins with `-- ` reads as a header and an added one with `++ ` as a path, as in the text format's
    own ambiguity.
    """
    lines = diffs.select("diff_id", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    line, header = F.col("line"), r"^diff --git a/(.*?) b/(.*)$"
    lines = lines.withColumn("file", F.sum(line.rlike(header).cast("int")).over(Window.partitionBy("diff_id").orderBy("pos"))).where("file > 0")
    head = line.rlike(header)
    minus, plus = ~head & line.startswith("--- "), ~head & line.startswith("+++ ")
    named = F.trim(F.substring(line, 5, 1 << 30))
    path = (
        F.when(head, F.regexp_extract(line, header, 2))
        .when(plus & (F.trim(line) != "+++ /dev/null"), F.regexp_replace(named, "^b/", ""))
        .when(~minus & ~plus & line.startswith("rename to "), F.trim(F.substring(line, 11, 1 << 30)))
    )
    first, second = F.regexp_extract(line, header, 1), F.regexp_extract(line, header, 2)
    old = F.when(head & (first != second), first).when(line.startswith("rename from "), F.trim(F.substring(line, 13, 1 << 30)))
    return lines.groupBy("diff_id", "file").agg(
        F.max_by(path, F.when(path.isNotNull(), F.col("pos"))).alias("path"), F.max_by(old, F.when(old.isNotNull(), F.col("pos"))).alias("old_path"),
        F.count_if(~head & line.startswith("+") & ~line.startswith("+++")).alias("added"), F.count_if(~head & line.startswith("-") & ~line.startswith("---")).alias("deleted"),
        F.coalesce(F.bool_or(minus & (F.trim(line) == "--- /dev/null")), F.lit(False)).alias("is_new"), F.coalesce(F.bool_or(plus & (F.trim(line) == "+++ /dev/null")), F.lit(False)).alias("is_deleted"),
    ).drop("file")


def diff_hash(text: Column) -> Column:
    return F.substring(F.sha1(text.cast("binary")), 1, 12)


def diff_modules(files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Lines and files of each diff by module; deleted files and files that are no source do not count."""
    rows = files.where(~F.coalesce("is_deleted", F.lit(False)) & is_source(F.col("path"))).withColumn("module", module_of(F.col("path"), settings)).where("module is not null")
    return rows.groupBy("diff_id", "module").agg(F.sum("added").cast("long").alias("added"), F.sum("deleted").cast("long").alias("deleted"), F.count(F.lit(1)).alias("files"))


def successors(phases: DataFrame, reported: DataFrame, edges: DataFrame) -> DataFrame:
    """Where the work of each declining module went: the busiest growing module below its parent directory, else its
    first growing partner, else the busiest growing importer."""
    growing = phases.where((F.col("phase") == GROWTH) & (F.col("level") > 0)).select("module", "level")
    dirs = F.split("module", "/")
    above = F.concat(F.array(F.lit("")), F.when(F.size(dirs) > 1, F.transform(F.sequence(F.lit(1), F.size(dirs) - 1), lambda k: F.array_join(F.slice(dirs, 1, k), "/"))).otherwise(F.array().cast("array<string>")))
    order = Window.partitionBy("parent").orderBy(F.desc("level"), "module")
    below = growing.select("module", "level", F.explode(above).alias("parent")).withColumn("r", F.row_number().over(order)).where("r = 1").select("parent", F.col("module").alias("sibling"))
    out = phases.where(F.col("phase") == DECLINE).select("module", F.regexp_extract("module", "^(.*)/[^/]*$", 1).alias("parent")).join(below, "parent", "left")
    partner = reported.join(phases.where(F.col("phase") == GROWTH).select(F.col("module").alias("partner")), "partner").groupBy("module").agg(F.min_by("partner", "rank").alias("by_partner"))
    importer = edges.select(F.col("dst_module").alias("module"), F.col("src_module").alias("importer")).distinct().join(growing.withColumnsRenamed({"module": "importer"}), "importer")
    importer = importer.withColumn("r", F.row_number().over(Window.partitionBy("module").orderBy(F.desc("level"), "importer"))).where("r = 1").select("module", F.col("importer").alias("by_import"))
    return out.join(partner, "module", "left").join(importer, "module", "left").select("module", F.coalesce("sibling", "by_partner", "by_import").alias("successor"))


def findings(touched: DataFrame, phases: DataFrame, connected: DataFrame, paired: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """What the rules find in each diff, before the deck: diff_id, rule, module, deviation, and evidence.

    `touched` is diff_modules; `phases` has module and phase; `connected` module and status; `paired` weight and lifetime.
    """
    s = settings
    known = phases.select("module", "phase").join(connected.select("module", (F.col("status") == "load-bearing").alias("bearing")), "module", "left")
    rows = touched.join(known, "module", "left").withColumn("bearing", F.coalesce("bearing", F.lit(False))).withColumn("net", F.col("added") - F.col("deleted"))
    adds = (F.col("net") > s.small_addition) | ((F.col("added") > 5) & (F.col("added") > 2 * F.col("deleted")))
    weight = F.least(F.lit(4), 2 + F.col("bearing").cast("int") + (F.col("net") >= s.large_addition).cast("int"))
    rule = F.when(F.col("phase").isNull(), "SL-I02").when(F.col("phase") == NO_DATA, "SL-I01").when((F.col("phase") == STABILIZING) & adds, "SL-W01").when((F.col("phase") == DECLINE) & (F.col("net") > 0), "SL-W02")
    deviation = F.when(F.col("phase").isNull(), 0).when(F.col("phase") == NO_DATA, F.col("bearing").cast("int")).otherwise(weight)
    none = F.lit(None)
    single = rows.withColumn("rule", rule).where("rule is not null").select("diff_id", "rule", "module", deviation.cast("int").alias("deviation"), none.cast("string").alias("other"), none.cast("bigint").alias("lifetime"))

    # Pairs of a sensitive module with any other of the diff, by join: modules that are neither make none.
    sensitive = F.col("phase").isin(STABILIZING, DECLINE) | F.col("bearing")
    each = rows.where("phase is not null").select("diff_id", "module", "phase", "bearing", sensitive.alias("sensitive"))
    one, two = (each.select("diff_id", *(F.col(c).alias(f"{side}_{c}") for c in ("module", "phase", "bearing", "sensitive"))) for side in ("one", "two"))
    met = one.where("one_sensitive").join(two, "diff_id").where((F.col("one_module") < F.col("two_module")) | (F.col("one_module") > F.col("two_module")) & ~F.col("two_sensitive"))
    up = F.col("one_module") < F.col("two_module")
    both = met.select("diff_id", *(F.when(up if side == "a" else ~up, F.col(f"one_{c}")).otherwise(F.col(f"two_{c}")).alias(f"{side}_{c}") for side in "ab" for c in ("module", "phase", "bearing")))
    bearing = F.col("a_bearing") | F.col("b_bearing")
    both = both.join(paired.select(F.col("module_a").alias("a_module"), F.col("module_b").alias("b_module"), "weight", "lifetime"), ["a_module", "b_module"], "left").na.fill(0, ["lifetime"])
    new, faded = F.col("lifetime") == 0, (F.col("lifetime") > 0) & (F.col("weight") < s.min_weight)
    first = F.col("a_phase") == STABILIZING
    target, other = F.when(first, F.col("a_module")).otherwise(F.col("b_module")), F.when(first, F.col("b_module")).otherwise(F.col("a_module"))
    coupling = both.where(new | faded).select("diff_id", F.when(new, "SL-W03").otherwise("SL-W04").alias("rule"), target.alias("module"), F.when(new & bearing, 3).otherwise(2).alias("deviation"), other.alias("other"), "lifetime")
    return single.unionByName(coupling)


def decided(found: DataFrame, deck: RuleDeck, today: date, log: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """Findings with severity, suppression and escalation; those switched off are gone.

    `log` has open earlier warnings of the escalation period: module, rule, open.
    """
    spark = found.sparkSession
    rows = found.join(F.broadcast(deck.rules(spark).select("rule", "name", "severity", "family")), "rule").where("severity <> 'off'")
    quiet = deck.suppressed(spark, today).withColumnsRenamed({"rule": "s_rule", "module": "s_module"})
    rows = rows.withColumn("_id", F.monotonically_increasing_id())
    meets = (F.col("rule") == F.col("s_rule")) & ((F.col("module") == F.col("s_module")) | (F.col("s_module") == "*"))
    order = Window.partitionBy("_id").orderBy("position")
    rows = rows.join(F.broadcast(quiet), meets, "left").withColumn("_r", F.row_number().over(order)).where("_r = 1") if deck.suppressions else rows.withColumns({"reason": F.lit(None).cast("string"), "by": F.lit(None).cast("string"), "until": F.lit(None).cast("date")})
    rows = rows.withColumn("severity", F.when(F.col("reason").isNotNull(), "info").otherwise(F.col("severity")))
    if log is not None:
        rows = rows.join(log.select("module", "rule", "open"), ["module", "rule"], "left")
    else:
        rows = rows.withColumn("open", F.lit(0))
    again = (F.col("severity") == "warn") & (F.col("family") == "W") & (F.coalesce("open", F.lit(0)) >= settings.escalation_count - 1)
    return rows.withColumn("escalated", again).select("diff_id", "rule", "name", "family", "module", "severity", "deviation", "other", "lifetime", F.col("reason").alias("suppressed_because"), "escalated")


def verdicts(diffs: DataFrame, judged: DataFrame) -> DataFrame:
    """One row per diff_id: verdict, deviation, rules_fired."""
    warn = F.col("severity") == "warn"
    one = judged.groupBy("diff_id").agg(F.bool_or(warn).alias("warned"), F.bool_or("escalated").alias("blocked"), F.max("deviation").alias("deviation"), F.array_sort(F.collect_set(F.when(warn, F.col("rule")))).alias("rules_fired"))
    rows = diffs.select("diff_id").distinct().join(one, "diff_id", "left")
    verdict = F.when(F.coalesce("blocked", F.lit(False)), "block").when(F.coalesce("warned", F.lit(False)), "warn").otherwise("ok")
    return rows.select("diff_id", verdict.alias("verdict"), F.coalesce("deviation", F.lit(0)).alias("deviation"), F.coalesce("rules_fired", F.array().cast("array<string>")).alias("rules_fired"))


def authority(touched: DataFrame, phases: DataFrame, judged: DataFrame, reported: DataFrame) -> DataFrame:
    """Modules where each diff may go freely: its growing ones and growing partners of warned ones, less the warned."""
    growing = phases.where(F.col("phase") == GROWTH).select("module")
    warned = judged.where("severity = 'warn'").select("diff_id", "module").distinct()
    fired = judged.where("rule in ('SL-W01', 'SL-W02')").select("diff_id", "module").distinct()
    own = touched.select("diff_id", "module").join(growing, "module", "left_semi").join(fired, ["diff_id", "module"], "left_anti")
    near = warned.join(reported.select("module", "partner"), "module").select("diff_id", F.col("partner").alias("module")).join(growing, "module", "left_semi")
    return own.unionByName(near).distinct().join(warned, ["diff_id", "module"], "left_anti")


def escalations(events: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Warnings in a log (id, ts, module, rule, resolves): how many earlier ones are open, and what each leads to.

    A row with `resolves` (a commit on the module) closes all earlier warnings of its module.
    """
    flow = Window.partitionBy("module").orderBy("ts", "id")
    rows = events.withColumn("epoch", F.sum(F.col("resolves").cast("int")).over(flow.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where(~F.col("resolves")).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    back = Window.partitionBy("module", "rule", "epoch").orderBy("at").rangeBetween(-int(settings.escalation_hours * 3_600_000_000), 0)
    rows = rows.withColumn("open", F.count(F.lit(1)).over(back) - 1)
    return rows.select("id", "ts", "module", "rule", "open", F.when(F.col("open") >= settings.escalation_count - 1, "block").otherwise("warn").alias("verdict"))


def open_warnings(log: DataFrame, facts: DataFrame, now: datetime, settings: Settings = Settings()) -> DataFrame:
    """Warnings (ts, module, rule) of the escalation period that no later commit on their module has answered: open, by
    module and rule, as `decided` takes them."""
    since = F.lit(now.replace(tzinfo=None)).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(settings.escalation_hours * 3600)} SECOND")
    recent = log.where(F.col("ts").cast("timestamp_ntz") >= since)
    answered = facts.groupBy("module").agg(F.max(F.col("ts").cast("timestamp_ntz")).alias("answered"))
    rows = recent.join(answered, "module", "left").where(F.col("answered").isNull() | (F.col("answered") < F.col("ts").cast("timestamp_ntz")))
    return rows.groupBy("module", "rule").agg(F.count(F.lit(1)).alias("open"))


def to_log(judged: DataFrame, now: datetime) -> DataFrame:
    """The warnings that a log keeps: ts, module, rule, verdict, deviation, diff_id."""
    kept = judged.where((F.col("severity") == "warn") & (F.col("family") == "W"))
    blocked = F.max("escalated").over(Window.partitionBy("diff_id"))
    return kept.select(F.lit(now.replace(tzinfo=None)).cast("timestamp_ntz").alias("ts"), "module", "rule", F.when(blocked, "block").otherwise("warn").alias("verdict"), "deviation", "diff_id")


def fail_safe(diffs: DataFrame, fresh: DataFrame | None, allow_stale: bool = False) -> DataFrame:
    """What every diff is told of an index that is missing (no freshness), rewritten or stale; rows as of `findings`."""
    ids = diffs.select("diff_id").distinct()
    if fresh is None:
        rows = ids.withColumn("rule", F.lit("SL-F00"))
    else:
        rule = F.when(F.col("rewritten"), "SL-F02").when(F.col("stale") & F.lit(not allow_stale), "SL-F01")
        rows = ids.join(F.broadcast(fresh.select(rule.alias("rule"))), F.col("rule").isNotNull())  # one row
    none = F.lit(None)
    return rows.select("diff_id", "rule", F.lit("*").alias("module"), F.lit(1).alias("deviation"), none.cast("string").alias("other"), none.cast("bigint").alias("lifetime"))


def log_summary(log: DataFrame, now: datetime, days: int = 30) -> DataFrame:
    """Warnings of the last days by module and rule: how many, and the largest deviation."""
    since = F.lit(now.replace(tzinfo=None)).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAY")
    return log.where(F.col("ts").cast("timestamp_ntz") >= since).groupBy("module", "rule").agg(F.count(F.lit(1)).alias("count"), F.max("deviation").alias("max_deviation"))


def freshness(commits: DataFrame, bookmark: str | None) -> DataFrame:
    """One row: head, bookmark, commits_behind, stale, rewritten. `commits` has hash, ts and parents (array)."""
    head = commits.orderBy(F.desc("ts"), F.desc("hash")).limit(1).select(F.col("hash").alias("head"))
    mark = F.lit(bookmark).cast("string")
    here = commits.agg(F.max(F.when(F.col("hash") == mark, F.struct("ts", "hash"))).alias("at"))
    behind = commits.crossJoin(F.broadcast(here)).agg(F.count_if(F.struct("ts", "hash") > F.col("at")).alias("n"), F.max("at").alias("at"))  # against one row
    return behind.crossJoin(F.broadcast(head)).select(  # one row each
        "head", mark.alias("bookmark"), F.when(F.col("at").isNotNull(), F.col("n")).alias("commits_behind"), (F.col("at").isNull() | (F.col("n") > 0)).alias("stale"), (mark.isNotNull() & F.col("at").isNull()).alias("rewritten")
    )
