"""An index that grows by batches of commits: facts are appended once per commit, everything else is derived.

A batch that is applied twice, or again after a failure, adds nothing; the index after any sequence of batches equals the
one made of all commits at once. `update` follows a clone: the commits since the bookmark, or all of them after history
was rewritten. `measure` follows its files: contents are parsed once, then files, imports and module metrics are replaced.
"""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..operators.content import METRICS, blob_metrics, file_state, module_metrics
from ..operators.gate import RuleDeck, decided, fail_safe, open_warnings, to_log
from ..operators.packages import resolved_imports
from ..operators.serve import Repository
from ..session import written
from ..sources.files import imports_of
from ..sources.gitlog import CloneState, ShallowHistory, clone_state, live_changes, live_tree, with_contents

_COLUMNS = "hash string, ts timestamp_ntz, author string, email string, subject string, path string, added bigint, deleted bigint, old_path string"
_UPDATES = "at timestamp_ntz, batch_id bigint, years array<int>, from_hash string, to_hash string"
_BLOBS = f"blob string, language string, {METRICS}, mi double"


class IncrementalIndex:
    """Changes under `path`, partitioned by year so that a batch looks up the hashes of its own years only."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings = Settings()):
        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings

    def _exists(self, path: str) -> bool:
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jpath)

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.path}/{name}"
        return self.spark.read.schema(schema).parquet(path) if self._exists(path) else self.spark.createDataFrame([], schema)

    def changes(self) -> DataFrame:
        return self._table("changes", f"{_COLUMNS}, year int")

    def apply(self, batch: DataFrame, batch_id: int | None = None, from_hash: str | None = None, to_hash: str | None = None) -> None:
        """Appends the commits that are not there; usable as a foreachBatch function. `to_hash` becomes the bookmark, after
        the commits are there, so that a batch that fails is applied again."""
        names = [c.split()[0] for c in _COLUMNS.split(", ")]
        batch = batch if "old_path" in batch.columns else batch.withColumn("old_path", F.lit(None).cast("string"))
        new = batch.select(*(F.col(c) for c in names)).withColumn("year", F.year("ts")).where("hash is not null")
        years = [r["year"] for r in new.select("year").distinct().collect()]
        known = self.changes().where(F.col("year").isin(years)).select("hash").distinct()
        # One commit may come twice within a batch: as whole copies of its rows.
        copy = "_copy"
        new = new.join(known, "hash", "left_anti").groupBy(*names, "year").agg(F.count(F.lit(1)).alias(copy))
        new.drop(copy).write.mode("append").partitionBy("year").parquet(f"{self.path}/changes")

        rows = self.spark.range(1).select(F.current_timestamp().cast("timestamp_ntz").alias("at"), F.lit(batch_id).cast("bigint").alias("batch_id"), F.array(*map(F.lit, sorted(y for y in years if y is not None))).cast("array<int>").alias("years"), *(F.lit(h).cast("string").alias(n) for n, h in (("from_hash", from_hash), ("to_hash", to_hash))))
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/updates")

    def updates(self) -> DataFrame:
        """One row per applied batch."""
        return self._table("updates", _UPDATES)

    def bookmark(self) -> str | None:
        """The commit of a clone up to which the index goes."""
        return self.updates().where("to_hash is not null").agg(F.max_by("to_hash", "at")).first()[0]

    def state_of(self, repo: str, until: str = "HEAD") -> CloneState:
        return clone_state(repo, self.bookmark(), until)

    def update(self, repo: str, until: str = "HEAD") -> str:
        """Goes up to a commit of a clone: "current", "updated" (by the commits since the bookmark) or "rebuilt" (the
        bookmark is no ancestor of it any more, so all history is read anew). A shallow clone is an error."""
        state = self.state_of(repo, until)
        if state.shallow:
            raise ShallowHistory(f"{repo} is a shallow clone; fetch its whole history first")
        if state.head == state.bookmark:
            return "current"
        since = state.bookmark if state.known else None
        if state.bookmark and not state.known:
            self.reset()
        self.apply(live_changes(self.spark, repo, until=state.head, **({"since": since} if since else {})), None, since, state.head)
        return "rebuilt" if state.bookmark and not state.known else "updated"

    def measure(self, files: DataFrame, repo: str | None = None) -> None:
        """Replaces files, imports and module metrics by those of the current files: path, blob, and content if they are
        not to be read from a clone. Only contents that were never measured are read and parsed; after a failure, again."""
        state = written(file_state(files.select("path", "blob"), self.settings), "file-state")
        new = files.join(state.select("path"), "path", "left_semi").join(self._table("blobs", _BLOBS).select("blob"), "blob", "left_anti")
        names = [c.split()[0] for c in _BLOBS.split(", ")]
        blob_metrics(with_contents(new, repo) if repo else new).select(names).write.mode("append").parquet(f"{self.path}/blobs")
        blobs = self._table("blobs", _BLOBS).dropDuplicates(["blob"])
        for name, rows in (("edges", resolved_imports(imports_of(blobs, state), state.select("path"), self.settings)), ("metrics", module_metrics(state, blobs)), ("files", state)):
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}")

    def measure_tree(self, repo: str, revision: str = "HEAD") -> None:
        self.measure(live_tree(self.spark, repo, revision), repo)

    def reset(self) -> None:
        """Forgets the history and the bookmark; settings, measured contents and the warning log stay."""
        for name in ("changes", "updates"):
            jpath = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jpath, True)

    def record(self, judged: DataFrame, now: datetime) -> None:
        """Appends the warnings of a check to the index's log."""
        to_log(judged, now).write.mode("append").parquet(f"{self.path}/warnings")

    def warnings(self) -> DataFrame:
        return self._table("warnings", "ts timestamp_ntz, module string, rule string, verdict string, deviation int, diff_id string")

    def check(self, files: DataFrame, now: datetime, deck: RuleDeck = RuleDeck(), record: bool = True, fresh: DataFrame | None = None, allow_stale: bool = False, **more) -> DataFrame:
        """Decided findings of diffs, escalated by the log, which then holds their warnings too. With `fresh`, diffs are also
        told of a stale index or a rewritten history; without any history, of that alone."""
        if self.changes().isEmpty():
            return decided(fail_safe(files, None), deck, now.date(), None, self.settings)
        repo = self.repository(now, **more)
        also = fail_safe(files, fresh, allow_stale) if fresh is not None else None
        judged = repo.check(files, deck, open_warnings(self.warnings(), repo.facts, now, self.settings), also)
        rows = written(judged, "judged")
        if record:
            self.record(rows, now)
        return rows

    def repository(self, now: datetime, **more) -> Repository:
        measured = {name: self.spark.read.parquet(f"{self.path}/{name}") for name in ("edges", "metrics") if self._exists(f"{self.path}/{name}/_SUCCESS")}
        return Repository(self.changes(), now, self.settings, **{"store": True} | measured | more)

    def stream(self, changes: DataFrame, checkpoint: str):
        """Starts a query that applies each micro-batch of streamed changes."""
        return changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def save_settings(self) -> None:
        self.spark.createDataFrame([(self.settings.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/settings")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> IncrementalIndex:
        index = cls(spark, path)
        if index._exists(f"{index.path}/settings"):
            index.settings = Settings.from_json(spark.read.text(f"{index.path}/settings").first()["value"])
        return index

    def status(self) -> dict:
        row = self.changes().agg(F.count_distinct("hash").alias("commits"), F.max(F.struct("ts", "hash")).alias("last")).first()
        return {"commits": row["commits"], "bookmark": self.bookmark() or (row["last"]["hash"] if row["last"] else None), "settings": json.loads(self.settings.to_json())}
