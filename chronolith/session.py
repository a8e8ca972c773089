"""What operators need of the session: the shared folder, tables written there, workers that find the package."""

from __future__ import annotations

import os
import py_compile
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
#: Applications that have the package, and the paths that each open `scratch` is told of.
_SHIPPED: set[str] = set()
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir` of the session; in local mode else one of our own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="chronolith-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def _at(spark: SparkSession, path: str) -> tuple:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, to be removed at the end of the `scratch` around it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def until_exit(spark: SparkSession, path: str) -> str:
    """What is there at `path` goes when the driver ends."""
    system, jpath = _at(spark, path)
    system.deleteOnExit(jpath)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    until_exit(spark, path)
    return spark.read.schema(spark.read.parquet(path).schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    system, jpath = _at(spark, path)
    system.delete(jpath, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that are written inside go at its end, but for those written by the function that it gives."""
    made: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        _OPEN.append([])
        try:
            return written(df, name)
        finally:
            kept = _OPEN.pop()
            if len(_OPEN) > 1:
                _OPEN[-2].extend(kept)

    _OPEN.append(made)
    try:
        yield keep
    finally:
        _OPEN.remove(made)
        for path in made:
            removed(spark, path)


def ship_package(spark: SparkSession) -> None:
    """Sends the package to the Python workers, once for each application, sources and compiled modules in one archive."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    folder = Path(tempfile.mkdtemp(prefix="chronolith-package-"))
    archive = folder / f"{_PACKAGE.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(_PACKAGE.rglob("*.py")):
            name = source.relative_to(_PACKAGE.parent)
            out.write(source, name)
            out.write(py_compile.compile(str(source), cfile=str(folder / "module.pyc"), dfile=str(name), doraise=True), name.with_suffix(".pyc"))
    sc.addPyFile(str(archive))
    os.unlink(folder / "module.pyc")
    _SHIPPED.add(sc.applicationId)
