from __future__ import annotations

from datetime import date, datetime, timedelta

from chronolith.config import Settings
from chronolith.operators import gate

DIFF = """diff --git a/src/core/parser/a.py b/src/core/parser/a.py
--- a/src/core/parser/a.py
+++ b/src/core/parser/a.py
@@ -1 +1,3 @@
-old
+new
+more
 same
diff --git a/x/new.py b/x/new.py
new file mode 100644
--- /dev/null
+++ b/x/new.py
+one
diff --git a/o.py b/p.py
similarity index 90%
rename from o.py
rename to p.py
diff --git a/gone.py b/gone.py
--- a/gone.py
+++ /dev/null
-bye
--- a sql comment
"""


def test_diff_parser(spark):
    rows = gate.parsed_diffs(spark.createDataFrame([("d", DIFF), ("e", ""), ("f", None)], "diff_id string, text string")).collect()
    got = {r["path"]: (r["old_path"], r["added"], r["deleted"], r["is_new"], r["is_deleted"]) for r in rows}
    assert got == {"src/core/parser/a.py": (None, 2, 1, False, False), "x/new.py": (None, 1, 0, True, False), "p.py": ("o.py", 0, 0, False, False), "gone.py": (None, 0, 1, False, True)}


PHASES = "module string, phase string, level double"


def world(spark):
    phases = spark.createDataFrame([("core/a", "stabilizing", 0.5), ("core/b", "growth", 3.0), ("old/x", "decline", 0.2), ("old/y", "growth", 5.0), ("n/d", "no_data", 0.0), ("solo", "decline", 0.1)], PHASES)
    connected = spark.createDataFrame([("core/a", "load-bearing"), ("core/b", "isolated"), ("old/x", "isolated"), ("old/y", "isolated"), ("n/d", "load-bearing"), ("solo", "isolated")], "module string, status string")
    pairs = spark.createDataFrame([("core/a", "core/b", 0.2, 4)], "module_a string, module_b string, weight double, lifetime long")
    return phases, connected, pairs


def found(spark, rows):
    touched = spark.createDataFrame(rows, "diff_id string, module string, added long, deleted long, files long")
    return touched, gate.findings(touched, *world(spark))


def test_rules(spark):
    touched, rows = found(spark, [("1", "core/a", 150, 0, 1), ("2", "core/a", 10, 9, 1), ("3", "old/x", 3, 1, 1), ("4", "n/d", 1, 0, 1), ("5", "who", 1, 0, 1), ("6", "core/a", 1, 1, 1), ("6", "core/b", 1, 1, 1), ("7", "core/a", 1, 1, 1), ("7", "old/y", 1, 1, 1)])
    got = {(r["diff_id"], r["rule"], r["module"]): r["deviation"] for r in rows.collect()}
    assert got == {("1", "SL-W01", "core/a"): 4, ("3", "SL-W02", "old/x"): 2, ("4", "SL-I01", "n/d"): 1, ("5", "SL-I02", "who"): 0, ("6", "SL-W04", "core/a"): 2, ("7", "SL-W03", "core/a"): 3}
    judged = gate.decided(rows, gate.RuleDeck(), date(2026, 1, 1))
    assert {r["diff_id"]: r["verdict"] for r in gate.verdicts(touched, judged).collect()} == {"1": "warn", "2": "ok", "3": "warn", "4": "ok", "5": "ok", "6": "warn", "7": "warn"}


def test_deck(spark):
    deck = gate.RuleDeck.from_toml("""
[rules.SL-W01]
severity = "off"
[rules.SL-W02]
severity = "loud"
[rules.XX]
severity = "off"
[[suppress]]
rule = "SL-W02"
module = "*"
reason = "planned"
by = "al"
until = "2026-06-30"
[[suppress]]
rule = "SL-W02"
module = "old/x"
reason = "no author"
until = "2026-06-30"
""")
    assert deck.severities == {"SL-W01": "off"} and len(deck.suppressions) == 1
    _, rows = found(spark, [("1", "core/a", 150, 0, 1), ("3", "old/x", 3, 1, 1)])
    inside = gate.decided(rows, deck, date(2026, 6, 30)).collect()
    assert [(r["rule"], r["severity"], r["suppressed_because"]) for r in inside] == [("SL-W02", "info", "planned")]
    assert [r["severity"] for r in gate.decided(rows, deck, date(2026, 7, 1)).collect()] == ["warn"]
    assert len(deck.expired(date(2026, 7, 1))) == 1


def test_escalation_by_log(spark):
    _, rows = found(spark, [("3", "old/x", 3, 1, 1)])
    log = spark.createDataFrame([("old/x", "SL-W02", 2)], "module string, rule string, open long")
    judged = gate.decided(rows, gate.RuleDeck(), date(2026, 1, 1), log)
    assert gate.verdicts(rows, judged).collect()[0]["verdict"] == "block"


EVENTS = "id long, ts timestamp_ntz, module string, rule string, resolves boolean"


def test_escalation_window(spark):
    t = datetime(2026, 1, 1)
    hours = lambda h: t + timedelta(hours=h)
    rows = [(1, hours(0), "m", "r", False), (2, hours(1), "m", "r", False), (3, hours(2), "m", "r", False), (4, hours(3), "m", "x", False), (5, hours(4), "m", "c", True), (6, hours(5), "m", "r", False), (7, hours(40), "m", "r", False)]
    got = {r["id"]: r["verdict"] for r in gate.escalations(spark.createDataFrame(rows, EVENTS), Settings()).collect()}
    assert got == {1: "warn", 2: "warn", 3: "block", 4: "warn", 6: "warn", 7: "warn"}


def test_successors_and_authority(spark):
    phases, _, _ = world(spark)
    partners = spark.createDataFrame([("solo", "core/b", 1, 2.0)], "module string, partner string, rank int, weight double")
    edges = spark.createDataFrame([("p", "core/b", "solo")], "src_path string, src_module string, dst_module string")
    assert {r["module"]: r["successor"] for r in gate.successors(phases, partners, edges).collect()} == {"old/x": "old/y", "solo": "old/y"}
    touched, rows = found(spark, [("3", "old/x", 3, 1, 1), ("3", "core/b", 3, 1, 1), ("8", "core/b", 1, 0, 1)])
    judged = gate.decided(rows, gate.RuleDeck(), date(2026, 1, 1))
    near = spark.createDataFrame([("old/x", "old/y", 1)], "module string, partner string, rank int")
    got = {(r["diff_id"], r["module"]) for r in gate.authority(touched, phases, judged, near).collect()}
    assert ("8", "core/b") in got and ("3", "old/y") in got


def test_freshness(spark):
    commits = spark.createDataFrame([("a", datetime(2026, 1, 1)), ("b", datetime(2026, 1, 2)), ("c", datetime(2026, 1, 3))], "hash string, ts timestamp_ntz")
    state = lambda mark: tuple(gate.freshness(commits, mark).select("head", "commits_behind", "stale", "rewritten").collect()[0])
    assert state("c") == ("c", 0, False, False) and state("a") == ("c", 2, True, False) and state("zz") == ("c", None, True, True) and state(None) == ("c", None, True, False)
