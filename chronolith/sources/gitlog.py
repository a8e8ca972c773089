"""Commit logs and trees: text exports as DataFrames, and a live repository as Spark data sources."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.paths import renamed
from ..session import ship_package

#: Of `git log --reverse --no-merges -M --numstat` with this format: one record per commit.
LOG_FORMAT = "%x1e%H%x1f%ct%x1f%an%x1f%ae%x1f%P%x1f%s"
CHANGES = "hash string, ts timestamp_ntz, author string, email string, subject string, parents array<string>, path string, old_path string, added bigint, deleted bigint, binary boolean"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Changes from exported log text; commits without files have one row with a null path."""
    return changes_of(spark.read.option("lineSep", "\x1e").text(path), F.col("value"))


def changes_of(records: DataFrame, record: Column) -> DataFrame:
    lines = F.split(record, "\n")
    head = F.split(F.get(lines, F.lit(0)), "\x1f")
    part = lambda k: F.coalesce(F.get(head, F.lit(k)), F.lit(""))
    parents = F.filter(F.split(part(4), " "), lambda p: p != "")
    moment = F.timestamp_seconds(F.coalesce(F.when(part(1) != "", part(1)), F.lit("0")).cast("bigint"))
    ts = F.to_utc_timestamp(moment, F.current_timezone()).cast("timestamp_ntz")
    files = F.filter(F.slice(lines, 2, F.size(lines)), lambda x: F.size(F.split(x, "\t")) >= 3)
    rows = records.where(F.trim(record) != "").select(part(0).alias("hash"), ts.alias("ts"), part(2).alias("author"), part(3).alias("email"), part(5).alias("subject"), parents.alias("parents"), F.explode_outer(files).alias("line"))
    columns = F.split("line", "\t", 3)
    count = lambda k: F.when(F.col("binary"), 0).otherwise(F.get(columns, F.lit(k)).try_cast("bigint"))
    rows = rows.withColumns({"binary": (F.get(columns, F.lit(0)) == "-") | (F.get(columns, F.lit(1)) == "-"), "name": renamed(F.get(columns, F.lit(2)))})
    return rows.select("hash", "ts", "author", "email", "subject", "parents", "name.path", "name.old_path", count(0).alias("added"), count(1).alias("deleted"), "binary")


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, blob) of an exported `ls-tree -r -z`: `mode type blob<TAB>path`, NUL-separated; blobs only."""
    rows = spark.read.option("lineSep", "\0").text(path).withColumn("p", F.split("value", "\t", 2)).withColumn("m", F.split(F.get("p", F.lit(0)), " "))
    return rows.where(F.get("m", F.lit(1)) == "blob").select(F.get("p", F.lit(1)).alias("path"), F.get("m", F.lit(2)).alias("blob"))


class GitLogSource(DataSource):
    """`spark.read.format("gitlog").option("path", repo)`, with `since` (exclusive), `until` and `first_parent`: raw records."""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _LogReader(dict(self.options))


class _LogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # one history is one stream

    def read(self, partition: InputPartition) -> Iterator[tuple[str]]:
        o = self.options
        span = f"{o['since']}..{o.get('until', 'HEAD')}" if o.get("since") else o.get("until", "HEAD")
        first = ["--first-parent"] if o.get("first_parent", "false").lower() == "true" else []
        command = ["git", "-C", o["path"], "log", *first, "--reverse", "--no-merges", "-M", "--numstat", f"--format={LOG_FORMAT}", span]
        with subprocess.Popen(command, stdout=subprocess.PIPE, text=True, encoding="utf-8", errors="replace") as run:
            record: list[str] = []
            for line in run.stdout:
                if line.startswith("\x1e"):
                    if record:
                        yield ("".join(record),)
                    record = [line[1:]]
                else:
                    record.append(line)
            if record:
                yield ("".join(record),)
        if run.returncode:
            raise RuntimeError(f"git log failed with {run.returncode}")


def live_changes(spark: SparkSession, repo: str, **options: str) -> DataFrame:
    ship_package(spark)
    spark.dataSource.register(GitLogSource)
    return changes_of(spark.read.format("gitlog").options(path=repo, **options).load(), F.col("value"))


class GitTreeSource(DataSource):
    """`spark.read.format("gittree").option("path", repo)`, with `revision`: (path, blob) of its files."""

    @classmethod
    def name(cls) -> str:
        return "gittree"

    def schema(self) -> str:
        return "path string, blob string"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(dict(self.options))


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # names only; contents are read by all tasks

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        command = ["git", "-C", self.options["path"], "ls-tree", "-r", "-z", "--full-tree", self.options.get("revision", "HEAD")]
        for entry in subprocess.run(command, stdout=subprocess.PIPE, check=True).stdout.split(b"\0"):
            about, _, path = entry.partition(b"\t")
            if path and about.split()[1] == b"blob":
                yield path.decode("utf-8", "replace"), about.split()[2].decode()


def live_tree(spark: SparkSession, repo: str, revision: str = "HEAD") -> DataFrame:
    """(path, blob) of the files of a revision, committed ones only."""
    ship_package(spark)
    spark.dataSource.register(GitTreeSource)
    return spark.read.format("gittree").options(path=repo, revision=revision).load()


def with_contents(files: DataFrame, repo: str) -> DataFrame:
    """(path, blob) with the content, read by one long-lived process for each task; a blob that is gone has null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as git:

            def content(blob: str) -> bytes | None:
                git.stdin.write(blob.encode() + b"\n")
                git.stdin.flush()
                head = git.stdout.readline().split()
                if not head:
                    raise RuntimeError(f"git cat-file ended at {blob}")
                return git.stdout.read(int(head[2]) + 1)[:-1] if len(head) == 3 else None

            for batch in batches:
                yield batch.assign(content=[content(b) for b in batch["blob"]])
            git.stdin.close()

    return files.select("path", "blob").mapInPandas(run, "path string, blob string, content binary")


class ShallowHistory(RuntimeError):
    """A truncated history gives wrong phases."""


@dataclass(frozen=True)
class CloneState:
    """The head of a clone against a bookmark: `known` if the bookmark is an ancestor of the head, `behind` commits then."""

    head: str
    bookmark: str | None
    shallow: bool
    known: bool
    behind: int | None

    def freshness(self, spark: SparkSession) -> DataFrame:
        """One row, as of `gate.freshness`, but by ancestry."""
        stale, rewritten = not self.known or self.behind > 0, self.bookmark is not None and not self.known
        return spark.createDataFrame([(self.head, self.bookmark, self.behind, stale, rewritten)], "head string, bookmark string, commits_behind bigint, stale boolean, rewritten boolean")


def clone_state(repo: str, bookmark: str | None = None, until: str = "HEAD") -> CloneState:
    def git(*args: str, check: bool = True) -> subprocess.CompletedProcess:
        return subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, check=check)

    head = git("rev-parse", "--verify", f"{until}^{{commit}}").stdout.strip()
    shallow = git("rev-parse", "--is-shallow-repository").stdout.strip() == "true"
    known = bookmark is not None and git("merge-base", "--is-ancestor", bookmark, head, check=False).returncode == 0
    return CloneState(head, bookmark, shallow, known, int(git("rev-list", "--count", f"{bookmark}..{head}").stdout) if known else None)
