from __future__ import annotations

import random
import subprocess
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronolith.config import Settings
from chronolith.operators import content, gate
from chronolith.operators.serve import Repository
from chronolith.plans.replay import summarised
from chronolith.sources import export, gitlog
from chronolith.streaming.incremental import IncrementalIndex
from chronolith.streaming.windows import streamed_churn, streamed_escalations

from .test_gate import EVENTS
from .test_signals import CHANGE, change

NOW = datetime(2026, 1, 15)


def test_exported_log(spark, tmp_path):
    text = "\x1eh1\x1f1700000000\x1fAl\x1fa@x\x1fp1 p2\x1ffeat: x\n\n3\t1\tsrc/a/b.py\n-\t-\timg.png\n2\t0\tsrc/{a => c}/d.py\n\x1eh2\x1f1700000100\x1fBo\x1fb@x\x1f\x1fempty\n"
    (tmp_path / "log.txt").write_text(text)
    rows = {(r["hash"], r["path"]): r for r in gitlog.read_log(spark, str(tmp_path / "log.txt")).collect()}
    assert set(rows) == {("h1", "src/a/b.py"), ("h1", "img.png"), ("h1", "src/c/d.py"), ("h2", None)}
    one = rows["h1", "src/a/b.py"]
    assert (one["added"], one["deleted"], one["ts"], one["parents"], one["subject"]) == (3, 1, datetime(2023, 11, 14, 22, 13, 20), ["p1", "p2"], "feat: x")
    assert rows["h1", "img.png"]["added"] == 0 and rows["h1", "img.png"]["binary"] and rows["h1", "src/c/d.py"]["old_path"] == "src/a/d.py"


def test_tree(spark, tmp_path):
    (tmp_path / "tree").write_text("100644 blob aaa\tsrc/x y.py\x00160000 commit bbb\tsub\x00")
    assert [tuple(r) for r in gitlog.read_tree(spark, str(tmp_path / "tree")).collect()] == [("src/x y.py", "aaa")]


def test_live_repository(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=Al", "-c", "user.email=a@x", *a], check=True, capture_output=True)
    git("init", "-q")
    for k in range(2):
        (tmp_path / "m.py").write_text("x\n" * (k + 1))
        git("add", "-A")
        git("commit", "-qm", f"c{k}")
    rows = gitlog.live_changes(spark, str(tmp_path)).orderBy("subject").collect()
    assert [(r["path"], r["added"], r["subject"], r["email"]) for r in rows] == [("m.py", 1, "c0", "a@x"), ("m.py", 1, "c1", "a@x")]


def history(n=60, seed=1):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        for m in rnd.sample("abcdef", rnd.randrange(1, 4)):
            rows.append(change(f"h{k}", datetime(2024, 1, 1) + timedelta(days=10 * k, hours=k), f"src/{m}/x/f.py", rnd.choice("pqr"), rnd.randrange(30), rnd.randrange(10)))
    return rows


def snapshot(repo: Repository) -> list:
    return [sorted(map(repr, df.collect())) for df in (repo.periods, repo.pairs.withColumn("weight", F.round("weight", 9)), repo.phases, repo.commits)]


@pytest.mark.parametrize("seed", [1, 2])
def test_incremental_equals_full(spark, tmp_path, seed):
    rows = history(seed=seed)
    index = IncrementalIndex(spark, f"{tmp_path}/index", Settings(window=6))
    index.save_settings()
    cut = random.Random(seed).randrange(10, 50)
    hashes = [f"h{k}" for k in range(60)]
    for some in (hashes[:cut], hashes[cut - 5 :], hashes[:10]):  # batches overlap, and one comes again
        index.apply(spark.createDataFrame([r for r in rows if r[0] in some], CHANGE))
    again = IncrementalIndex.open(spark, f"{tmp_path}/index")
    assert again.settings.window == 6
    assert snapshot(again.repository(NOW)) == snapshot(Repository(spark.createDataFrame(rows, CHANGE), NOW, Settings(window=6)))
    assert again.status()["commits"] == 60 and again.status()["bookmark"] == "h59"


def test_streamed_index(spark, tmp_path):
    rows = history()
    full = sorted({r[0] for r in rows})
    # Whole commits come in one file here: a commit is applied once.
    spark.createDataFrame(rows, CHANGE).repartition(2, "hash").write.parquet(f"{tmp_path}/whole")
    index = IncrementalIndex(spark, f"{tmp_path}/index")
    index.stream(spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/whole"), f"{tmp_path}/checkpoint").awaitTermination()
    assert sorted(r[0] for r in index.changes().select("hash").distinct().collect()) == full
    assert index.changes().count() == len(rows)


def drained(query_df, name, tmp_path):
    q = query_df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination()
    return query_df.sparkSession.table(name)


def test_streamed_escalations_equal_batch(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(k, datetime(2026, 1, 1) + timedelta(minutes=37 * k), f"m{rnd.randrange(3)}", rnd.choice("rs"), rnd.random() < 0.1) for k in range(200)]
    df = spark.createDataFrame(rows, EVENTS)
    df.coalesce(1).orderBy("ts").write.parquet(f"{tmp_path}/events")
    got = drained(streamed_escalations(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/events")), "escalated", tmp_path)
    want = {r["id"]: (r["open"], r["verdict"]) for r in gate.escalations(df).collect()}
    assert {r["id"]: (r["open"], r["verdict"]) for r in got.collect()} == want


def test_streamed_churn(spark, tmp_path):
    df = spark.createDataFrame([(datetime(2026, 1, 1, h), "m") for h in (1, 2, 3)] + [(datetime(2026, 1, 2, 1), "m"), (datetime(2026, 1, 5), "n")], "ts timestamp, module string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = drained(streamed_churn(spark.readStream.schema("ts timestamp, module string").parquet(f"{tmp_path}/in"), "module"), "churned", tmp_path)
    assert {(str(r["window_start"]), r["module"]): r["events"] for r in got.collect()} == {("2026-01-01 00:00:00", "m"): 3, ("2026-01-02 00:00:00", "m"): 1}


PYTHON = '''
import os
from abc import ABC
from .util import helper
from core.tools import x

class Base(ABC):
    def run(self, a):
        if a and a > 1:
            return 1
        return 0

class Plain:
    pass
'''


def test_parse_once_and_metrics(spark):
    files = spark.createDataFrame([("src/core/a/m.py", "b1", PYTHON), ("src/core/z/copy.py", "b1", PYTHON), ("src/web/x/v.ts", "b2", "import {a} from '../y';\nclass K {}\nfunction f() { return a ? 1 : 2; }\n"), ("README.md", "b3", "# hi"), ("src/w/x/e.py", "b4", "")], "path string, blob string, content string")
    blobs = content.blob_metrics(files)
    got = {r["blob"]: r for r in blobs.collect()}
    assert set(got) == {"b1", "b2", "b4"}
    b1, b2 = got["b1"], got["b2"]
    assert (b1["classes"], b1["abstract_classes"], b1["functions"], b1["ccn_total"], b1["nloc"]) == (2, 1, 1, 3, 11)
    assert b1["imports"] == ["abc", "core.tools", "os", "src/core/a/util"]
    assert b2["imports"] == ["../y"] and b2["classes"] == 1 and b2["functions"] == 1
    metrics = {r["module"]: r for r in content.module_metrics(content.file_state(files), blobs).collect()}
    assert metrics["core/a"]["nloc"] == 11 and metrics["core/z"]["ccn_avg"] == 3.0 and metrics["web/x"]["files"] == 1
    assert content.blob_metrics(files, blobs).count() == 0


def test_export(spark, tmp_path):
    repo = Repository(spark.createDataFrame(history(20), CHANGE), NOW)
    for fmt in ("csv", "json"):
        names = export.export(repo, f"{tmp_path}/{fmt}", fmt)
        assert "phases" in names
    assert spark.read.csv(f"{tmp_path}/csv/module_period", header=True).count() == repo.periods.count()
    with pytest.raises(ValueError):
        export.export(repo, str(tmp_path), "xml")


def test_replay_summary(spark):
    steps = spark.createDataFrame([("shared", 2, float(t)) for t in range(1, 22)] + [("shared", 0, 4.0)], "mode string, files int, total_ms double")
    got = {r["size"]: (r["n"], r["median_total_ms"], r["p95_total_ms"]) for r in summarised(steps).collect()}
    assert got == {"1-3": (21, 11.0, 20.0), "0": (1, 4.0, 4.0)}


def test_context_advice(spark):
    rows = Repository(spark.createDataFrame(history(), CHANGE), NOW).context().collect()
    assert rows and all(r["advice"] and len(r["reference_commits"]) <= 3 for r in rows)
