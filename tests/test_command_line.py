from __future__ import annotations

import subprocess
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from chronolith.__main__ import NO_INDEX, main
from chronolith.operators import gate
from chronolith.sources.files import blob_id, imports_of, read_files
from chronolith.streaming.incremental import IncrementalIndex

from .test_signals import CHANGE, change
from .test_sources_streaming import history

NOW = datetime(2026, 1, 15)


def exported(path) -> str:
    commits: dict[str, list] = {}
    for h, ts, author, email, subject, file, added, deleted in history():
        commits.setdefault(h, [f"\x1e{h}\x1f{int((ts - datetime(1970, 1, 1)).total_seconds())}\x1f{author}\x1f{email}\x1f\x1f{subject}\n"]).append(f"{added}\t{deleted}\t{file}\n")
    path.write_text("".join(x for c in commits.values() for x in c))
    return str(path)


def test_commands(spark, tmp_path, capsys):
    where = ["--index", f"{tmp_path}/index", "--now", NOW.isoformat()]
    assert main(["status", *where]) == NO_INDEX
    log = exported(tmp_path / "log.txt")
    assert main(["init", "--log", log, "--scale", "monthly", *where]) == 0
    assert main(["update", "--log", log, *where]) == 0 and "'commits': 60" in capsys.readouterr().out
    assert main(["context", "a/x", *where]) == 0 and '"module":"a/x"' in capsys.readouterr().out
    assert main(["explain", *where]) == 0 and '"modules":6' in capsys.readouterr().out
    assert main(["rules"]) == 0 and "SL-W04" in capsys.readouterr().out
    assert main(["export", f"{tmp_path}/out", *where]) == 0 and "phases" in capsys.readouterr().out


def test_check_warns_twice_then_blocks(spark, tmp_path):
    rows = [change(f"h{k}", datetime(2024, 1, 3) + timedelta(days=k), "src/core/parser/a.py") for k in range(120)]
    index = IncrementalIndex(spark, f"{tmp_path}/index")
    index.apply(spark.createDataFrame(rows, CHANGE))
    files = spark.createDataFrame([("d", "src/core/parser/a.py", 40, 0, False)], "diff_id string, path string, added long, deleted long, is_deleted boolean")
    seen = []
    for k in range(3):
        judged = index.check(files, NOW + timedelta(hours=k))
        assert [r["rule"] for r in judged.collect()] == ["SL-W01"]
        seen.append(gate.verdicts(files, judged).first()["verdict"])
    assert seen == ["warn", "warn", "block"]
    index.apply(spark.createDataFrame([change("fix", NOW + timedelta(hours=3), "src/core/parser/a.py")], CHANGE))
    assert gate.verdicts(files, index.check(files, NOW + timedelta(hours=4))).first()["verdict"] == "warn"
    assert index.updates().count() == 2 and index.warnings().count() == 4
    index.reset()
    assert index.changes().isEmpty() and index.warnings().count() == 4


def test_fail_safe(spark):
    diffs = spark.createDataFrame([("1",), ("2",)], "diff_id string")
    commits = spark.createDataFrame([("a", datetime(2026, 1, 1)), ("b", datetime(2026, 1, 2))], "hash string, ts timestamp_ntz")
    rules = lambda fresh, **kw: sorted(r["rule"] for r in gate.fail_safe(diffs, fresh, **kw).collect())
    assert rules(None) == ["SL-F00"] * 2 and rules(gate.freshness(commits, "a")) == ["SL-F01"] * 2
    assert rules(gate.freshness(commits, "a"), allow_stale=True) == [] and rules(gate.freshness(commits, "b")) == [] and rules(gate.freshness(commits, "gone"), allow_stale=True) == ["SL-F02"] * 2
    judged = gate.decided(gate.fail_safe(diffs, None), gate.RuleDeck(), NOW.date())
    assert {r["verdict"] for r in gate.verdicts(diffs, judged).collect()} == {"warn"}


def test_files(spark, tmp_path):
    (tmp_path / "src" / "a b").mkdir(parents=True)
    (tmp_path / "src" / "a b" / "m.py").write_text("import os\n")
    row = read_files(spark, str(tmp_path), "*.py").collect()
    assert [(r["path"], bytes(r["content"])) for r in row] == [("src/a b/m.py", b"import os\n")]
    name = subprocess.run(["git", "hash-object", str(tmp_path / "src" / "a b" / "m.py")], capture_output=True, text=True, check=True).stdout.strip()
    assert row[0]["blob"] == name
    assert spark.range(1).select(blob_id(F.lit(b""))).first()[0] == "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"
    blobs = spark.createDataFrame([("x", ["os", "core.a"])], "blob string, imports array<string>")
    state = spark.createDataFrame([("p.py", "x"), ("q.py", "x")], "path string, blob string")
    assert imports_of(blobs, state).count() == 4
