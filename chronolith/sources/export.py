"""Result tables as CSV or JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.periods import period_key
from ..operators.serve import Repository


def tables(repo: Repository) -> dict[str, DataFrame]:
    """The exported tables by name."""
    from ..operators import cochange, packages

    key = period_key(F.col("idx"), repo.settings.scale).alias("period")
    return {
        "module_period": repo.periods.select("module", key, "commits", "added", "deleted", "files", "authors"),
        "cochange": cochange.cochange_counts(repo.facts, repo.settings).select("module_a", "module_b", key, "count", "last_hash", "last_ts"),
        "module_metrics": repo.metrics,
        "package_metrics": packages.package_metrics(repo.fans, repo.metrics),
        "imports": repo.edges,
        "commits": repo.commits.select("hash", "ts", "author", "period", "files", "added", "deleted", "is_noise", "noise_reason", "modules"),
        "phases": repo.phases.drop("churn_window", "net_window"),
    }


def _flat(df: DataFrame) -> DataFrame:
    """Arrays of texts joined, other nested columns as JSON."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            out.append(F.array_join(f.name, "; ").alias(f.name))
        elif isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType):
            out.append(F.to_json(f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(out)


def export(repo: Repository, out: str, fmt: str = "csv") -> list[str]:
    """Writes each table to a folder below `out`; returns their names."""
    if fmt not in ("csv", "json"):
        raise ValueError(f"unknown format {fmt!r}; expected csv or json")
    found = tables(repo)
    for name, df in found.items():
        if fmt == "csv":
            _flat(df).write.mode("overwrite").csv(f"{out}/{name}", header=True)
        else:
            df.write.mode("overwrite").json(f"{out}/{name}")
    return list(found)
