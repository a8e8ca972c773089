from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chronolith.config import IMPORT_ENDINGS, Settings
from chronolith.functions.paths import module_of
from chronolith.functions.periods import index_of
from chronolith.operators import cochange, packages, phase
from chronolith.operators.serve import Repository

from .test_functions import naive_kendall

NOW, CLOSED = datetime(2026, 1, 15), index_of(datetime(2025, 12, 1), "monthly")
S = Settings()


def axis_of(spark, series: dict[str, list[tuple[int, int, int]]]):
    """(commits, net, authors) per period, the last one just closed."""
    rows = [(m, CLOSED - len(v) + 1 + k, c, max(0, n), max(0, -n), c, a) for m, v in series.items() for k, (c, n, a) in enumerate(v)]
    return spark.createDataFrame(rows, "module string, idx int, commits bigint, added bigint, deleted bigint, files bigint, authors bigint")


def naive_label(v: list[tuple[int, int, int]]) -> tuple[str, str | None]:
    n = len(v)
    if n < 4:
        return "no_data", None
    commits, net, authors = (list(x) for x in zip(*v, strict=True))
    size = [sum(net[: k + 1]) for k in range(n)]
    churn, grown = naive_kendall(commits[-8:], 0.1), naive_kendall(size[-8:], 0.1)
    level, earlier = sum(commits[-4:]) / 4, (sum(commits[:-4]) / (n - 4) if n > 4 else 0.0)
    streak = next((k for k, c in enumerate(reversed(commits)) if c > 1), n)
    prior = max(authors[max(0, n - 28) : n - 4], default=0)
    recent, last = max(authors[-4:]), sum(net[-4:])
    shrank = last < 0 and max(net[-4:]) <= 0 and abs(last) >= 0.05 * max(1, size[-1] - last)
    down = grown[0] == "decreasing" or shrank
    votes = (churn[0] == "decreasing") + down + (recent < prior and recent <= max(1, prior // 2))
    sure = min(churn[1], grown[1]) <= 0.05
    if earlier > 1 and level < earlier and votes >= 2:
        return "decline", "high" if sure and votes == 3 else "medium"
    if streak >= 4 and churn[0] != "increasing" and not down:
        return "stabilizing", "high" if streak >= 6 else "medium"
    up = churn[0] == "increasing" or grown[0] == "increasing"
    if up or level > 1:
        return "growth", "high" if up and sure else "medium" if level > 2 else "low"
    return "growth", "low"


def naive_since(v) -> int:
    final, since, misses = naive_label(v)[0], len(v), 0
    for end in range(len(v) - 1, 3, -1):
        if naive_label(v[:end])[0] != final:
            misses += 1
            if misses > 1:
                break
        else:
            misses, since = 0, end
    return since


def test_phases_equal_a_plain_loop(spark):
    rnd = random.Random(11)
    series = {}
    for k in range(150):
        base, drift = rnd.choice([0, 1, 3, 6]), rnd.choice([-0.4, -0.1, 0, 0.1, 0.5])
        series[f"m{k}"] = [(max(0, round(base + drift * i + rnd.gauss(0, 1))), rnd.randrange(-60, 80), rnd.randrange(0, 5)) for i in range(rnd.randrange(1, 40))]
    labels = phase.phase_labels(phase.phase_features(axis_of(spark, series), S), S)
    got = {(r["module"], r["n"]): (r["phase"], r["confidence"]) for r in labels.collect()}
    assert got == {(m, n): naive_label(v[:n]) for m, v in series.items() for n in range(1, len(v) + 1)}
    last = {r["module"]: r for r in phase.phases(labels, S).collect()}
    for m, v in series.items():
        if last[m]["phase"] != "no_data":
            assert last[m]["since_idx"] - (CLOSED - len(v)) == naive_since(v), m


def test_phase_vectors(spark):
    series = {"short": [(3, 5, 1)] * 3, "rising": [(c, 10, 1) for c in (1, 1, 2, 2, 3, 4, 5, 6, 7, 8)], "calm": [(5, 20, 2)] * 6 + [(0, 0, 0)] * 8}
    rows = {r["module"]: r for r in phase.phases(phase.phase_labels(phase.phase_features(axis_of(spark, series), S), S), S).collect()}
    assert rows["short"]["phase"] == "no_data" and rows["short"]["reasons"] == ["only 3 closed period(s) of history; need 4"] and rows["short"]["since"] is None
    assert (rows["rising"]["phase"], rows["rising"]["churn_trend"], rows["rising"]["confidence"]) == ("growth", "rising", "high")
    assert rows["calm"]["phase"] == "stabilizing" and rows["calm"]["low_streak"] == 8


CHANGE = "hash string, ts timestamp_ntz, author string, email string, subject string, path string, added bigint, deleted bigint"


def change(h, when, path, author="a", added=5, deleted=1, subject="feat"):
    return (h, when, author, f"{author}@x", subject, path, added, deleted)


def test_open_period_and_noise(spark):
    rows = [change("1", datetime(2026, 1, 3), "src/new/mod/a.py"), change("2", datetime(2025, 6, 1), "src/old/mod/b.py"), change("3", datetime(2025, 7, 1), "src/old/mod/b.py", "renovate"), change("4", datetime(2025, 8, 1), "docs/x.md")]
    repo = Repository(spark.createDataFrame(rows, CHANGE), NOW)
    assert {r["module"]: r["phase"] for r in repo.phases.collect()} == {"new/mod": "no_data", "old/mod": "stabilizing"}
    assert {r["hash"]: r["noise_reason"] for r in repo.commits.collect()} == {"1": None, "2": None, "3": "bot_author", "4": "no_source_files"}


def test_decay_partners_and_cap(spark):
    rows = []
    for k in range(8):
        rows += [change(f"old{k}", datetime(2024, 12, 5, k), f"src/{m}/x/f.py") for m in "ab"]
    rows += [change("now", datetime(2026, 1, 10), f"src/{m}/x/f.py") for m in "ac"]
    rows += [change("bulk", datetime(2025, 12, 1), f"src/m{k:02}/x/f.py") for k in range(31)]
    repo = Repository(spark.createDataFrame(rows, CHANGE), NOW)
    weights = {(r["module_a"], r["module_b"]): (r["weight"], r["lifetime"]) for r in repo.pairs.collect()}
    assert weights == {("a/x", "b/x"): (pytest.approx(1.0), 8), ("a/x", "c/x"): (1.0, 1)}
    first = repo.partners.where("module = 'a/x'").orderBy("rank").collect()
    assert [r["partner"] for r in first] == ["b/x", "c/x"] and sum(r["share"] for r in first) == pytest.approx(1)
    assert cochange.strongest_couplings(repo.all_partners).count() == 2


def test_import_resolution(spark):
    files = spark.createDataFrame([("src/core/parser/lexer.py",), ("src/core/util/__init__.py",), ("web/ui/button.tsx",), ("web/app/main.ts",), ("pkg/net/http/client.go",), ("cmd/run/main.go",), ("lib/z/deep/a.py",)], "path string")
    imports = spark.createDataFrame([
        ("src/core/parser/lexer.py", "core.util"), ("web/app/main.ts", "../ui/button"), ("cmd/run/main.go", "example.com/org/net/http"), ("web/app/main.ts", "react"), ("src/core/parser/lexer.py", "z.deep"),
        ("src/core/parser/lexer.py", "core.parser.lexer"), ("web/app/main.ts", None), ("web/app/main.ts", ""),
    ], "path string, target string")
    got = {tuple(r) for r in packages.resolved_imports(imports, files).collect()}
    assert got == {("src/core/parser/lexer.py", "core/parser", "core/util"), ("web/app/main.ts", "web/app", "web/ui"), ("cmd/run/main.go", "cmd/run", "net/http"), ("src/core/parser/lexer.py", "core/parser", "z/deep")}


def naive_target(path: str, target: str, known: list[str], prefixes: tuple[str, ...]) -> str | None:
    """The file that a target stands for, by trying every spelling."""
    relative, places = target.startswith("."), ["", *(f"{p}/" for p in prefixes)]
    parts = target.split("/")
    for tail in [target] if relative or "/" not in target else ["/".join(parts[k:]) for k in range(len(parts))]:
        base = []
        for p in f"{path.rpartition('/')[0]}/{target}".split("/"):
            if p == ".." and base and base[-1] != "..":
                base.pop()
            elif p not in ("", "."):
                base.append(p)
        dotted = tail.replace(".", "/")
        for name in ["/".join(base)] if relative else [dotted, tail]:
            for spelled in (at + name + end for end in IMPORT_ENDINGS for at in places):
                if spelled in known:
                    return spelled
        folder = dotted.lstrip("./")
        below = [f for f in known if folder and any(f.startswith(f"{at}{folder}/") for at in places)]
        if below:
            return min(below)
    return None


@pytest.mark.parametrize("prefixes", [S.strip_prefixes, (), ("src", "src/a", "lib", "src")])
def test_import_resolution_by_every_spelling(spark, prefixes):
    rng = random.Random(len(prefixes))
    words, settings = ["src", "lib", "a", "b", "x.y", "..", "", "index", "__init__", "mod", "a.py"], Settings(strip_prefixes=prefixes, module_depth=3)
    some = lambda most, by="/": by.join(rng.choice(words) for _ in range(rng.randint(1, most)))
    known = [some(5) + rng.choice([*IMPORT_ENDINGS, ".md"]) for _ in range(150)] + ["/", ".py", "src/.py", "src/index.ts"]
    imports = [(rng.choice(known), rng.choice([some(5), some(4, "."), f"./{some(2)}", f"../{some(3)}", f"../../{some(2)}", ".", "src/"])) for _ in range(600)]
    got = {tuple(r) for r in packages.resolved_imports(spark.createDataFrame(imports + imports[:9], "path string, target string"), spark.createDataFrame([(f,) for f in known + known[:9]], "path string"), settings).collect()}
    found = spark.createDataFrame([(p, naive_target(p, t, known, prefixes)) for p, t in imports if t], "path string, found string").where("found is not null")
    rows = found.select("path", module_of(F.col("path"), settings).alias("a"), module_of(F.col("found"), settings).alias("b")).where("a <> b")
    assert got == {tuple(r) for r in rows.collect()} and got


def generated(node) -> int:
    """Rows that explode made in a plan that has run."""
    kind = node.getClass().getSimpleName()
    inner = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(k) for k in range(node.children().size())]
    return sum(map(generated, inner)) + (node.metrics().get("numOutputRows").get().value() if kind == "GenerateExec" else 0)


def test_targets_are_looked_up_not_spelled(spark):
    files = spark.range(300).select(F.format_string("src/m%d/p/f%d.py", F.col("id") % 20, "id").alias("path"))
    nxt = spark.range(300).select(F.format_string("src/m%d/p/f%d.py", F.col("id") % 20, "id").alias("path"), F.format_string("outer/m%d/p/f%d", (F.col("id") + 1) % 300 % 20, (F.col("id") + 1) % 300).alias("target"))
    same = files.select("path", F.lit("numpy.linalg.norm").alias("target"))
    out = packages.resolved_imports(nxt.unionByName(same), files)
    assert out.count() == len(out.collect()) == 300
    assert 0 < generated(out._jdf.queryExecution().executedPlan()) <= 30 * 600


def test_fans_and_packages(spark):
    edges = spark.createDataFrame([("p", "a", "b"), ("q", "tests", "b"), ("r", "b", "c")], "src_path string, src_module string, dst_module string")
    fans = packages.fan_in_out(edges)
    assert {r["module"]: (r["fan_in"], r["fan_out"]) for r in fans.collect()} == {"a": (0, 1), "b": (1, 1), "c": (1, 0), "tests": (0, 1)}
    metrics = spark.createDataFrame([("b", 4, 1), ("z", 0, 0)], "module string, classes long, abstract_classes long")
    got = {r["module"]: r for r in packages.package_metrics(fans, metrics).collect()}
    assert (got["b"]["instability"], got["b"]["abstractness"], got["b"]["distance"]) == (0.5, 0.25, 0.25)
    assert got["z"]["instability"] is None and got["z"]["abstractness"] is None and got["c"]["distance"] is None


def test_hotspots_use_complexity_or_one(spark):
    periods = spark.createDataFrame([("a", CLOSED, 3, 5, 1), ("b", CLOSED, 2, 1, 0), ("c", CLOSED - 8, 9, 9, 9)], "module string, idx int, commits bigint, added bigint, deleted bigint")
    metrics = spark.createDataFrame([("b", 4.0, 10), ("a", 0.0, 5)], "module string, ccn_avg double, nloc long")
    got = [(r["module"], r["score"]) for r in packages.hotspots(periods, metrics, NOW).orderBy(F.desc("score")).collect()]
    assert got == [("b", 8.0), ("a", 3.0)]
