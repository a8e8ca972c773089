"""The import graph and what hangs on it: resolution, fan-in and fan-out, package metrics, connectedness, hotspots."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import IMPORT_ENDINGS, Settings
from ..functions.paths import is_test_module, module_of
from ..functions.periods import last_closed

#: Files that import the same target are dealt into so many parts, so that a very common target is not one task's work.
PARTS = 64


def _normal(path):
    """Without `.` and resolved `..` parts; leading `..` stay."""
    step = lambda acc, p: F.when((p == "") | (p == "."), acc).when((p == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def _known_names(files: DataFrame, places: list[str]) -> tuple[DataFrame, DataFrame]:
    """What a name may stand for. (name, order): the first of the name's spellings that is a known file, by ending and then
    prefix. (name, below): the smallest file below the name as a directory, bare or below a prefix."""
    at, n = F.col("found"), len(places)
    # A path answers to few names: less a prefix that it has, and less an ending that it has.
    less = F.explode(F.array_compact(F.array(*(F.when(at.startswith(p), F.struct(F.lit(k).alias("k"), F.substring(at, F.lit(len(p) + 1), F.length(at)).alias("rest"))) for k, p in enumerate(places)))))
    rest = F.col("p.rest")
    names = F.array(*(F.when(rest.endswith(end), F.struct(F.substring(rest, F.lit(1), F.length(rest) - len(end)).alias("name"), (F.col("p.k") + e * n).alias("order"))) for e, end in enumerate(IMPORT_ENDINGS)))
    spelled = files.select(F.col("path").alias("found")).select(less.alias("p")).select(F.explode(F.array_compact(names)).alias("s")).select("s.*").groupBy("name").agg(F.min("order").alias("order"))

    # The smallest file of each directory first: of these there are few, whatever the number of files.
    direct = files.where(F.col("path").contains("/")).groupBy(F.regexp_extract("path", r"(?s)^(.*)/[^/]*$", 1).alias("found")).agg(F.min("path").alias("below"))
    steps = F.split(rest, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    return spelled, direct.select("below", less.alias("p")).select("below", F.explode(above).alias("name")).groupBy("name").agg(F.min("below").alias("below"))


def resolved_imports(imports: DataFrame, files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Distinct (src_path, src_module, dst_module) of imports (path, target) against the known files (path).

    Candidates, best first: the target with each ending, bare or below a source prefix; then any file below it, the
    smallest path first; then, for targets with slashes, the same for ever shorter tails. Files give the names that they
    answer to, and each distinct target (of a folder, if relative) is looked up among these, once for each part of the paths
    that import it: no target is spelled in all ways, and no prefix is compared with every path.
    """
    target, relative = F.col("target"), F.col("target").startswith(".")
    places, ask = ["", *(f"{p}/" for p in settings.strip_prefixes)], ["parent", "target", "part"]
    wanted = imports.where("path is not null and target <> ''").select("path", "target", F.when(relative, F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).otherwise("").alias("parent"), F.pmod(F.xxhash64("path"), F.lit(PARTS)).alias("part"))
    parts = F.split(target, "/")
    tails = F.when(target.contains("/") & ~relative, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).otherwise(F.array(target))
    rows = wanted.select(*ask).distinct().select(*ask, F.posexplode(tails).alias("cut", "tail"))
    dotted = F.replace(F.col("tail"), F.lit("."), F.lit("/"))
    rows = rows.select(*ask, "cut", "tail", F.when(relative, _normal(F.concat_ws("/", "parent", "target"))).otherwise(dotted).alias("name"), F.regexp_replace(dotted, r"^[./]+", "").alias("dir"))
    # A name with its place among the target's own (none: not the name of a file), and whether it may be a directory.
    look = lambda name, base, below: F.struct(name.alias("name"), F.lit(base).cast("int").alias("base"), below.alias("as_dir"))
    name, tail, folder = F.col("name"), F.col("tail"), F.col("dir")
    looks = F.array(look(name, 0, (name == folder) & (folder != "")), F.when(~relative & (tail != name), look(tail, 1, F.lit(False))), F.when((folder != name) & (folder != ""), look(folder, None, F.lit(True))))
    rows = rows.select(*ask, "cut", F.explode(F.array_compact(looks)).alias("l")).select(*ask, "cut", "l.*")

    spelled, below = _known_names(files, places)
    # Merged: rows come out of explode, so that sizes are underestimated and a broadcast could be as large as the files.
    rows = rows.hint("merge").join(spelled.hint("merge"), "name", "left").hint("merge").join(below.hint("merge"), "name", "left")
    ways = [(p, end) for end in IMPORT_ENDINGS for p in places]
    prefix, ending = (F.get(F.array(*(F.lit(w[i]) for w in ways)), F.col("order")) for i in (0, 1))
    place = lambda kind, base, order, found: F.struct("cut", F.lit(kind).alias("kind"), base.alias("base"), order.alias("order"), found.alias("found"))
    exact = F.when(F.col("base").isNotNull() & F.col("order").isNotNull(), place(0, F.col("base"), F.col("order"), F.concat(prefix, "name", ending)))
    near = F.when(F.col("as_dir") & F.col("below").isNotNull(), place(1, F.lit(0), F.lit(0), F.col("below")))
    best = rows.select(*ask, F.least(exact, near).alias("m")).where("m is not null").groupBy(*ask).agg(F.min("m").alias("m"))

    best = best.select(*ask, module_of(F.col("m.found"), settings).alias("dst_module")).where("dst_module is not null")
    out = wanted.hint("merge").join(best.hint("merge"), ask).select("path", "dst_module").distinct()
    return out.select(F.col("path").alias("src_path"), module_of(F.col("path"), settings).alias("src_module"), "dst_module").where("src_module is not null and dst_module <> src_module")


def fan_in_out(edges: DataFrame) -> DataFrame:
    """One row per module with an import either way; imports by tests do not count as fan-in."""
    inward = edges.where(~is_test_module(F.col("src_module"))).groupBy(F.col("dst_module").alias("module")).agg(F.count_distinct("src_module").alias("fan_in"))
    outward = edges.groupBy(F.col("src_module").alias("module")).agg(F.count_distinct("dst_module").alias("fan_out"))
    return inward.join(outward, "module", "full").select("module", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def package_metrics(fans: DataFrame, metrics: DataFrame) -> DataFrame:
    """Couplings, instability, abstractness and distance from the main sequence; null where undefined.

    `metrics` has classes and abstract_classes by module.
    """
    both = metrics.select("module", "classes", "abstract_classes").join(fans, "module", "full")
    ca, ce = F.coalesce("fan_in", F.lit(0)), F.coalesce("fan_out", F.lit(0))
    rows = both.select("module", ca.alias("ca"), ce.alias("ce"), F.when(ca + ce > 0, ce / (ca + ce)).alias("instability"), F.when(F.col("classes") > 0, F.coalesce("abstract_classes", F.lit(0)) / F.col("classes")).alias("abstractness"))
    return rows.withColumn("distance", F.abs(F.col("abstractness") + F.col("instability") - 1.0))


def connectedness(modules: DataFrame, fans: DataFrame, all_partners: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Whether anything hangs on a module: enough importers, or enough partners."""
    n = all_partners.groupBy("module").agg(F.count(F.lit(1)).alias("partners"))
    rows = modules.select("module").distinct().join(fans, "module", "left").join(n, "module", "left").na.fill(0, ["fan_in", "fan_out", "partners"])
    bearing = (F.col("fan_in") >= settings.bearing_fan_in) | (F.col("partners") >= settings.bearing_partners)
    return rows.withColumn("status", F.when(bearing, "load-bearing").otherwise("isolated"))


def hotspots(periods: DataFrame, metrics: DataFrame, now: datetime, settings: Settings = Settings(), top: int | None = 10) -> DataFrame:
    """Modules by commits in the window times complexity. `metrics` has ccn_avg and nloc by module; top None: all."""
    closed = last_closed(now, settings.scale)
    recent = periods.where(F.col("idx").between(closed - settings.window + 1, closed)).groupBy("module").agg(F.sum("commits").alias("commits"), F.sum(F.col("added") + F.col("deleted")).alias("lines"))
    rows = recent.join(metrics.select("module", "ccn_avg", "nloc"), "module", "left")
    rows = rows.withColumn("score", F.col("commits") * F.when(F.col("ccn_avg") != 0, F.col("ccn_avg")).otherwise(1.0))
    rows = rows.withColumn("score", F.coalesce("score", F.col("commits").cast("double")))
    return rows.orderBy(F.desc("score"), "module").limit(top) if top else rows
