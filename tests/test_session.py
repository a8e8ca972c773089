"""Workers that find the package only by what the driver sends, the shared folder, tables that go, an entry module without parts."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])

CLUSTER = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
from chronolith.operators import content
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").getOrCreate()
rows = spark.createDataFrame([("a/b/m.py", "x", "import os\\nclass A: pass\\n")], "path string, blob string, content string")
print("classes", content.blob_metrics(rows).first()["classes"])
"""


def test_workers_get_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", CLUSTER], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "classes 1" in run.stdout, run.stderr[-2000:]


@pytest.mark.parametrize(("master", "refused"), [("local[4]", False), ("local-cluster[1,1,1024]", True), ("spark://host:7077", True), ("yarn", True)])
def test_no_local_folder_on_a_cluster(master, refused):
    from unittest.mock import Mock

    from chronolith.session import shared_dir

    made = []
    context = Mock(master=master, getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=made.append)
    session = Mock(sparkContext=context, conf=Mock(get=lambda name, default=None: default))
    if refused:
        with pytest.raises(RuntimeError):
            shared_dir(session)
        assert not made
    else:
        assert shared_dir(session) == made[0]


def test_scratch_tables_go(spark):
    from chronolith.session import scratch, written

    df = spark.range(5)
    with scratch(spark) as keep:
        gone = written(df, "gone")
        kept = keep(gone, "kept")
        place = {name: t.inputFiles()[0].removeprefix("file://").removeprefix("file:") for name, t in (("gone", gone), ("kept", kept))}
        assert all(map(os.path.exists, place.values()))
    assert kept.count() == 5 and not os.path.exists(place["gone"]) and os.path.exists(place["kept"])


@pytest.mark.parametrize("missing", ["xxhash", "chronolith.llm", "corpus_pipeline"])
def test_entry_without_a_part(missing):
    code = f"import sys; sys.path.insert(0, {ROOT!r}); sys.modules[{missing!r}] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, 'op1_sentencepiece' in q)"
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    n, pipeline, op1 = run.stdout.split()
    assert int(n) > 50 and pipeline == "False" and op1 == str(missing == "corpus_pipeline")
