"""Queries of the operators that read logs, diffs, trees and sources, and of those that serve from them: the bound tables
are written out in the form that the operator reads, so that the SQL can say directly what must come out."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import renamed
from ..functions.periods import period_index, period_key
from ..operators import content, gate, history, packages
from ..session import new_path
from ..sources.export import tables
from ..sources.files import blob_id, imports_of
from ..sources.gitlog import changes_of
from ..streaming.incremental import IncrementalIndex
from ..streaming.windows import streamed_churn
from . import binding as b

S, NOW = b.SETTINGS, b.NOW
#: A deck that changes a severity, switches a rule off and suppresses one until after NOW and another until before it.
DECK = gate.RuleDeck({"SL-W03": "info", "SL-I02": "off"}, (("SL-W01", "*", "planned", "al", date(2001, 12, 31)), ("SL-W02", "*", "late", "al", date(2001, 8, 14))))


def _text(*parts) -> F.Column:
    return F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))


def rename_paths(spark: SparkSession, d: str) -> DataFrame:
    """Parts as renamed files, in the three notations."""
    key, brand = F.col("p_partkey").cast("string"), F.replace("p_brand", F.lit("#"), F.lit("-"))
    braces, arrow = _text("src/{", brand, " => ", F.col("p_type"), "}/f", key, ".py"), _text(brand, "/f", key, ".py => ", F.col("p_type"), "/f", key, ".py")
    raw = F.when(F.col("p_partkey") % 3 == 0, braces).when(F.col("p_partkey") % 3 == 1, arrow).otherwise(_text("src/f", key, ".py"))
    return b.table(spark, d, "part").select("p_partkey", renamed(raw).alias("r")).select("p_partkey", "r.path", "r.old_path")


def _records(spark: SparkSession, d: str) -> DataFrame:
    """A log record per order: the head, and a line per order line; orders without lines have none."""
    name = _text("src/m", F.col("l_partkey").cast("string"), "/f", F.col("l_linenumber").cast("string"), ".py")
    moved = _text("src/{old => m", F.col("l_partkey").cast("string"), "}/f", F.col("l_linenumber").cast("string"), ".py")
    count = F.when(F.col("l_linenumber") % 5 == 0, "-").otherwise(F.col("l_quantity").cast("int").cast("string"))
    line = _text(count, "\t", F.when(count == "-", "-").otherwise("1"), "\t", F.when(F.col("l_linenumber") % 4 == 0, moved).otherwise(name))
    lines = b.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    key = F.col("o_orderkey").cast("string")
    head = F.concat_ws("\x1f", key, F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("string"), _text("C", F.col("o_custkey").cast("string")), F.lit("c@example.com"), _text("p", key, " q", key), F.col("o_orderpriority"))
    return b.table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(_text(head, "\n\n", F.coalesce("lines", F.lit("")), "\n").alias("record"))


def log_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = changes_of(_records(spark, d), F.col("record"))
    return rows.select("hash", F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"), "author", F.array_join("parents", ",").alias("parents"), "subject", "path", "old_path", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("added", "deleted")), F.coalesce("binary", F.lit(False)).alias("is_binary"))


def empty_commits(spark: SparkSession, d: str) -> DataFrame:
    """Totals of commits of which every third lost its files."""
    key = F.col("hash").cast("long") % 3 == 0
    rows = b.changes(spark, d).withColumns({"path": F.when(~key, F.col("path")), "added": F.when(~key, F.col("added")).otherwise(0), "deleted": F.when(~key, F.col("deleted")).otherwise(0)})
    totals = history.commit_totals(history.touches(rows.dropDuplicates(), S), S).where(F.col("hash").cast("long") % 3 == 0)
    return totals.select("hash", "files", "added", "deleted", "source_files", "modules", "is_noise")


def renames(spark: SparkSession, d: str) -> DataFrame:
    rows = history.renames(changes_of(_records(spark, d), F.col("record")))
    return rows.select("old_path", "path", "hash")


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    """A unified diff per order: a file per line with as many added lines as the line number, and one deleted; the first
    line's file is new, the fourth's is deleted, the fifth's is renamed."""
    n, name = F.col("l_linenumber"), _text("src/m", F.col("l_partkey").cast("string"), "/f", F.col("l_linenumber").cast("string"), ".py")
    old = F.when(n == 5, _text(name, ".old")).otherwise(name)
    head = _text("diff --git a/", old, " b/", name, "\n")
    move = F.when(n == 5, _text("rename from ", old, "\nrename to ", name, "\n")).otherwise("")
    files = _text("--- ", F.when(n == 1, "/dev/null").otherwise(_text("a/", old)), "\n+++ ", F.when(n == 4, "/dev/null").otherwise(_text("b/", name)), "\n@@ -1 +1 @@\n")
    body = _text(F.when(n == 4, "").otherwise(F.repeat(F.lit("+new\n"), n)), F.when(n == 1, "").otherwise("-old\n"), " same\n")
    one = F.struct("l_linenumber", "l_partkey", _text(head, move, files, body).alias("t"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), "")
    return b.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("diff_id")).agg(whole.alias("text"))


def diff_files(spark: SparkSession, d: str) -> DataFrame:
    return gate.parsed_diffs(_diffs(spark, d)).select("diff_id", "path", "old_path", "added", "deleted", "is_new", "is_deleted")


def diff_modules(spark: SparkSession, d: str) -> DataFrame:
    return gate.diff_modules(gate.parsed_diffs(_diffs(spark, d)), S)


def diff_hashes(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "documents").select("doc_id", gate.diff_hash(F.col("text")).alias("diff_hash"), blob_id(F.col("text").cast("binary")).alias("blob"))


def import_targets(spark: SparkSession, d: str) -> DataFrame:
    """Each part's file imports the next part's by dotted name, by directory, by a longer path, and something from outside."""
    # Dealt out by the key of the join, which keeps to it: one-file tables come in one task.
    paths = b.part_paths(spark, d).select("p_partkey", "path").repartition("p_partkey")
    nxt = paths.select((F.col("p_partkey") - 1).alias("p_partkey"), F.regexp_replace("path", r"^src/|\.[a-z]+$", "").alias("name"))
    targets = F.array(F.replace("name", F.lit("/"), F.lit(".")), F.regexp_replace("name", "/[^/]*$", ""), _text("outer/", F.col("name")), F.lit("numpy.linalg"))
    imports = paths.join(nxt.hint("merge"), "p_partkey").select("path", F.explode(targets).alias("target"))
    return packages.resolved_imports(imports, paths, S)


def successor_modules(spark: SparkSession, d: str) -> DataFrame:
    repo = b.repository(spark, d, store=True)
    return gate.successors(repo.phases, repo.partners, repo.edges)


def gate_deck(spark: SparkSession, d: str) -> DataFrame:
    """Findings under a deck with another severity, a rule that is off, and suppressions, one of them expired."""
    rows = b.repository(spark, d, store=True).check(b.proposed(spark, d), DECK)
    return rows.groupBy("rule", "severity", F.coalesce("suppressed_because", F.lit("")).alias("suppressed")).agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("diff_id").alias("diffs"), F.max("deviation").alias("deviation"))


def gate_authority(spark: SparkSession, d: str) -> DataFrame:
    repo, files = b.repository(spark, d, store=True), b.proposed(spark, d)
    return gate.authority(gate.diff_modules(files, S), repo.phases, repo.check(files), repo.partners)


def gate_log(spark: SparkSession, d: str) -> DataFrame:
    """What a check of every order would log, by module and rule."""
    rows = gate.to_log(b.repository(spark, d, store=True).check(b.proposed(spark, d)), NOW)
    return rows.groupBy("module", "rule", "verdict").agg(F.count(F.lit(1)).alias("warnings"), F.max("deviation").alias("deviation"))


def open_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Warnings of the last three days of the event log that no purchase has answered."""
    from dataclasses import replace
    from datetime import datetime

    events = b.gate_events(spark, d)
    return gate.open_warnings(events.where("not resolves"), events.where("resolves"), datetime(2024, 1, 31), replace(S, escalation_hours=72.0))


def _commits(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("hash"), F.col("o_orderdate").alias("ts"))


def index_freshness(spark: SparkSession, d: str) -> DataFrame:
    """With the smallest order as bookmark, and with one that is not there."""
    commits = _commits(spark, d)
    rows = gate.freshness(commits, "1").unionByName(gate.freshness(commits, "none")).unionByName(gate.freshness(commits, None))
    return rows.withColumn("commits_behind", F.coalesce("commits_behind", F.lit(-1)))


def gate_fail_safe(spark: SparkSession, d: str) -> DataFrame:
    """What each diff is told by a stale, a rewritten and a missing index."""
    diffs, commits = b.proposed(spark, d), _commits(spark, d)
    rows = [gate.fail_safe(diffs, gate.freshness(commits, "1")), gate.fail_safe(diffs, gate.freshness(commits, "none")), gate.fail_safe(diffs, None), gate.fail_safe(diffs, gate.freshness(commits, "1"), allow_stale=True)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]).select("diff_id", "rule", "module", "deviation")


def export_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each exported table."""
    found = tables(b.repository(spark, d, store=True))
    counts = [df.select(F.lit(name).alias("exported")).groupBy("exported").agg(F.count(F.lit(1)).alias("rows")) for name, df in found.items()]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


def file_state(spark: SparkSession, d: str) -> DataFrame:
    """The newest content of each path."""
    rows = b.changes(spark, d).select("path", "ts", F.concat(F.lit("b"), F.lpad("hash", 12, "0")).alias("blob"))
    return content.file_state(rows, S).select("path", "module", "blob")


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """Parts as sources in five languages: path, blob, content."""
    kinds = ("py", "ts", "java", "go", "rs")
    key, name = F.col("p_partkey").cast("string"), F.replace("p_name", F.lit(" "), F.lit("_"))
    texts = (
        _text("import os.path\nfrom abc import ABC\nfrom ..core import ", name, "\n\nclass A", key, "(ABC):\n    def f(self, x):\n        if x and self:\n            return 1\n\nclass B:\n    pass\n"),
        _text("import {a} from './", name, "';\nexport {b} from \"lib-", key, "\";\nabstract class K {}\ninterface I {}\nfunction f() { return a ? 1 : 2; }\n"),
        _text("import java.util.", name, ";\nimport static x.y.Z.*;\nclass C {}\nenum E {}\n"),
        _text('import (\n  "fmt"\n  "m/', name, '"\n)\nimport "one/two"\ntype T struct {}\nfunc f() {}\n'),
        _text("use crate::", name, "::deep;\nstruct S {}\ntrait R {}\nfn f() { if true {} }\n"),
    )
    at = F.col("p_partkey") % 5
    pick = lambda values: F.when(at == 0, values[0]).when(at == 1, values[1]).when(at == 2, values[2]).when(at == 3, values[3]).otherwise(values[4])
    path = _text("src/a/b/c/f", key, ".", pick([F.lit(x) for x in kinds]))
    return b.table(spark, d, "part").select("p_partkey", path.alias("path"), pick(texts).alias("content")).withColumn("blob", F.md5("content"))


def source_structure(spark: SparkSession, d: str) -> DataFrame:
    """Classes, imports and sizes of sources in five languages, each distinct content parsed once."""
    rows = _sources(spark, d)
    return rows.select("p_partkey", "blob").join(content.blob_metrics(rows.drop("p_partkey")), "blob").select("p_partkey", "language", "nloc", "functions", "ccn_max", "classes", "abstract_classes", F.array_join("imports", ";").alias("imports"))


def source_imports(spark: SparkSession, d: str) -> DataFrame:
    """(path, target) of the current files, by way of their contents."""
    rows = _sources(spark, d).drop("p_partkey")
    return imports_of(content.blob_metrics(rows), content.file_state(rows, S)).groupBy("target").agg(F.count(F.lit(1)).alias("files"))


def period_steps(spark: SparkSession, d: str) -> DataFrame:
    """The period of each order, the ones beside it, and how many periods lie between it and NOW."""
    i = period_index(F.col("o_orderdate"), "quarterly")
    rows = b.table(spark, d, "orders").select("o_orderkey", i.alias("i"))
    now = period_index(F.lit(NOW).cast("timestamp_ntz"), "quarterly")
    return rows.select("o_orderkey", period_key(F.col("i") + 1, "quarterly").alias("next"), period_key(F.col("i") - 1, "quarterly").alias("previous"), (now - F.col("i")).alias("between"))


def churn_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events by user and day, by the operator of the stream."""
    return streamed_churn(b.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def incremental_commits(spark: SparkSession, d: str) -> DataFrame:
    """Totals from an index that got the orders in two batches, the second one with all of the first again."""
    index = IncrementalIndex(spark, new_path(spark, "index"), S)
    rows = b.changes(spark, d)
    index.apply(rows.where("ts < timestamp_ntz '1998-01-01'"), 1)
    index.apply(rows, 2)
    commits = index.repository(NOW, store=False).commits
    return commits.groupBy("period").agg(F.count(F.lit(1)).alias("commits"), F.sum("files").alias("files"), F.count_if("is_noise").alias("noise"))


QUERIES = {f.__name__: f for f in (
    rename_paths, log_scan, empty_commits, renames, diff_files, diff_modules, diff_hashes, import_targets, successor_modules, gate_deck, gate_authority, gate_log, open_warnings, index_freshness,
    gate_fail_safe, export_tables, file_state, source_structure, source_imports, period_steps, churn_windows, incremental_commits,
)}
