"""Command line: update an index from a clone or an exported log, and print the three answers as JSON lines."""

from __future__ import annotations

import argparse
import sys
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import SCALES, Settings
from .functions.periods import choose_scale
from .operators.gate import RuleDeck, diff_hash, parsed_diffs, verdicts
from .operators.serve import payload
from .sources.export import export
from .sources.gitlog import ShallowHistory, read_log
from .streaming.incremental import IncrementalIndex

EXIT = {"ok": 0, "warn": 1, "block": 2}
NO_INDEX, SHALLOW = 3, 4


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chronolith", description=__doc__)
    p.add_argument("command", choices=["init", "update", "status", "context", "check", "explain", "rules", "export"])
    p.add_argument("target", nargs="?", help="module (context), diff file or - (check), output folder (export)")
    p.add_argument("--index", default=".chronolith", help="folder of the index")
    p.add_argument("--repo", help="clone to read")
    p.add_argument("--log", help="exported log to read")
    p.add_argument("--scale", choices=[*SCALES, "auto"], default="auto")
    p.add_argument("--format", choices=["csv", "json"], default="csv")
    p.add_argument("--rules", help="rule deck in TOML")
    p.add_argument("--allow-stale", action="store_true", help="check: say nothing of an index that is behind")
    p.add_argument("--now", help="ISO time, UTC; default the clock's")
    return p


def _show(rows: DataFrame) -> None:
    for r in payload(rows).toLocalIterator():
        print(r["payload"])


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    now = datetime.fromisoformat(a.now) if a.now else datetime.now(UTC).replace(tzinfo=None)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    deck = RuleDeck.from_toml(Path(a.rules).read_text()) if a.rules else RuleDeck()
    if a.command == "rules":
        _show(deck.rules(spark))
        return 0
    index = IncrementalIndex.open(spark, a.index)
    if a.command in ("init", "update"):
        clone = None if a.log else a.repo or "."
        if a.command == "init":
            index.reset()
        try:
            if clone:
                print(index.update(clone))
            else:
                index.apply(read_log(spark, a.log))
        except ShallowHistory as shallow:
            print(shallow, file=sys.stderr)
            return SHALLOW
        if a.command == "init":
            scale = choose_scale(index.changes(), "ts", now).first()["scale"] if a.scale == "auto" else a.scale
            index.settings = Settings(scale=scale)
            index.save_settings()
        if clone:
            index.measure_tree(clone)
    if index.changes().isEmpty() and a.command != "check":
        print(f"no index in {a.index}", file=sys.stderr)
        return NO_INDEX
    repo = index.repository(now)
    if a.command in ("init", "update", "status"):
        print(index.status())
    elif a.command == "context":
        _show(repo.packets().where(F.col("module") == a.target))
        if a.repo:
            _show(index.state_of(a.repo).freshness(spark))
    elif a.command == "explain":
        for rows in (repo.summary(), repo.phase_table(), repo.hotspots(), repo.couplings()):
            _show(rows)
    elif a.command == "export":
        print("\n".join(export(repo, a.target or "export", a.format)))
    elif a.command == "check":
        text = sys.stdin.read() if a.target in (None, "-") else Path(a.target).read_text()
        diff = spark.createDataFrame([(text,)], "text string").select(diff_hash(F.col("text")).alias("diff_id"), "text")
        files = parsed_diffs(diff)
        # A diff without files is told of the index too.
        told = diff.select("diff_id").join(files, "diff_id", "left")
        fresh = index.state_of(a.repo).freshness(spark) if a.repo else None
        judged = index.check(told, now, deck, fresh=fresh, allow_stale=a.allow_stale)
        _show(judged)
        if not index.changes().isEmpty():
            _show(repo.authority(files, judged))
        verdict = verdicts(diff, judged)
        _show(verdict)
        return EXIT[verdict.first()["verdict"]]
    return 0


if __name__ == "__main__":
    sys.exit(main())
