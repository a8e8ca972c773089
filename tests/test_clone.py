"""An index that follows a clone: delta, rebuild, refusal of shallow clones, files at a revision, freshness in checks."""

from __future__ import annotations

import subprocess
from datetime import datetime

import pytest

from chronolith.__main__ import EXIT, SHALLOW, main
from chronolith.sources.gitlog import ShallowHistory, clone_state, live_tree, with_contents
from chronolith.streaming.incremental import IncrementalIndex

NOW = datetime(2026, 1, 15)


def git(repo, *args: str, day: int = 1) -> str:
    moment = f"2025-01-{day:02d}T12:00:00Z"
    env = {"GIT_AUTHOR_DATE": moment, "GIT_COMMITTER_DATE": moment, "PATH": "/usr/bin:/bin:/usr/local/bin", "HOME": str(repo)}
    return subprocess.run(["git", "-C", str(repo), "-c", "user.name=a", "-c", "user.email=a@b.c", *args], env=env, check=True, capture_output=True, text=True).stdout.strip()


def commit(repo, day: int, files: dict[str, str]) -> str:
    for name, text in files.items():
        (repo / name).parent.mkdir(parents=True, exist_ok=True)
        (repo / name).write_text(text)
    git(repo, "add", "-A")
    git(repo, "commit", "-q", "-m", f"day {day}", day=day)
    return git(repo, "rev-parse", "HEAD")


@pytest.fixture
def clone(tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    git(repo, "init", "-q", "-b", "main")
    commit(repo, 1, {"src/core/__init__.py": "class A:\n    pass\n", "src/core/a.py": "def f():\n    return 1\n"})
    commit(repo, 2, {"src/web/b.py": "from src.core import a\nimport src.core.a\n\n\ndef g(x):\n    if x:\n        return 2\n"})
    return repo


def hashes(index) -> set[str]:
    return {r["hash"] for r in index.changes().select("hash").distinct().collect()}


def test_delta_rebuild_and_shallow(spark, clone, tmp_path):
    index = IncrementalIndex(spark, f"{tmp_path}/index")
    assert index.update(str(clone)) == "updated" and len(hashes(index)) == 2
    head = index.bookmark()
    assert head == git(clone, "rev-parse", "HEAD") and index.update(str(clone)) == "current"
    new = commit(clone, 3, {"src/web/b.py": "x = 1\n"})
    state = index.state_of(str(clone))
    assert state.known and state.behind == 1
    row = state.freshness(spark).first()
    assert (row["stale"], row["rewritten"], row["commits_behind"]) == (True, False, 1)
    assert index.update(str(clone)) == "updated"
    last = index.updates().orderBy("at").collect()[-1]
    assert (last["from_hash"], last["to_hash"]) == (head, new)

    git(clone, "reset", "-q", "--hard", "HEAD~2")
    other = commit(clone, 4, {"src/core/a.py": "def f():\n    return 3\n"})
    row = index.state_of(str(clone)).freshness(spark).first()
    assert row["rewritten"] and row["commits_behind"] is None
    assert index.update(str(clone)) == "rebuilt"
    assert new not in hashes(index) and other in hashes(index) and len(hashes(index)) == 2 and index.bookmark() == other

    subprocess.run(["git", "clone", "-q", "--depth", "1", f"file://{clone}", str(tmp_path / "shallow")], check=True, capture_output=True)
    assert clone_state(str(tmp_path / "shallow")).shallow
    with pytest.raises(ShallowHistory):
        IncrementalIndex(spark, f"{tmp_path}/none").update(str(tmp_path / "shallow"))
    assert main(["init", "--repo", str(tmp_path / "shallow"), "--index", f"{tmp_path}/none"]) == SHALLOW


def test_files_of_a_revision(spark, clone):
    (clone / "src/core/a.py").write_text("not committed")
    rows = {r["path"]: bytes(r["content"]) for r in with_contents(live_tree(spark, str(clone)), str(clone)).collect()}
    assert set(rows) == {"src/core/__init__.py", "src/core/a.py", "src/web/b.py"} and rows["src/core/a.py"] == b"def f():\n    return 1\n"
    assert {r["path"] for r in live_tree(spark, str(clone), "HEAD~1").collect()} == {"src/core/__init__.py", "src/core/a.py"}
    gone = spark.createDataFrame([("p", "0" * 40)], "path string, blob string")
    assert with_contents(gone, str(clone)).first()["content"] is None


def test_files_to_edges_and_metrics(spark, clone, tmp_path):
    index = IncrementalIndex(spark, f"{tmp_path}/index")
    index.update(str(clone))
    index.measure_tree(str(clone))
    repo = index.repository(NOW)
    assert {(r["src_module"], r["dst_module"]) for r in repo.edges.collect()} == {("web", "core")}
    m = {r["module"]: r for r in repo.metrics.collect()}
    assert (m["core"]["files"], m["core"]["nloc"], m["core"]["classes"], m["web"]["ccn_max"]) == (2, 4, 1, 2)
    assert {r["module"]: r["fan_in"] for r in repo.connected.collect()} == {"core": 1, "web": 0}
    packet = repo.packets().where("module = 'core'").first()
    assert packet["maintainability"]["nloc"] == 4 and packet["successor"] is None

    parsed = index._table("blobs", "blob string").count()
    commit(clone, 3, {"src/web/b.py": "def g(x):\n    return 2\n"})
    index.update(str(clone))
    index.measure_tree(str(clone))  # the one new content is parsed, and the import is gone
    assert index._table("blobs", "blob string").count() == parsed + 1 and index.repository(NOW).edges.isEmpty()


def test_checks_tell_of_the_index(spark, clone, tmp_path, capsys):
    diff = tmp_path / "d.diff"
    diff.write_text("diff --git a/src/core/a.py b/src/core/a.py\n--- a/src/core/a.py\n+++ b/src/core/a.py\n@@ -1 +1,2 @@\n+x = 1\n")
    where = ["--index", f"{tmp_path}/index", "--repo", str(clone), "--now", NOW.isoformat()]
    assert main(["check", str(diff), *where]) == EXIT["warn"] and "SL-F00" in capsys.readouterr().out
    assert main(["init", *where, "--scale", "monthly"]) == 0
    capsys.readouterr()
    assert main(["check", str(diff), *where]) == EXIT["ok"] and "SL-F" not in capsys.readouterr().out
    commit(clone, 3, {"src/web/b.py": "x = 1\n"})
    assert main(["check", str(diff), *where]) == EXIT["warn"] and "SL-F01" in capsys.readouterr().out
    assert main(["check", str(diff), *where, "--allow-stale"]) == EXIT["ok"]
    assert main(["context", "core", *where]) == 0 and '"commits_behind":1' in capsys.readouterr().out
