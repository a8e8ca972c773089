from __future__ import annotations

import math
import random
from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronolith.config import SCALES, Settings
from chronolith.functions.commits import author_id, maintainability, noise_reason, step_size
from chronolith.functions.paths import extension, is_ignored, is_source, is_test_module, language_of, module_of, renamed
from chronolith.functions.periods import choose_scale, index_of, last_closed, period_index, period_key, period_start
from chronolith.functions.trend import direction, mann_kendall


def column(spark, values, kind, make):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", make(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def key_of(d: datetime, scale: str) -> str:
    iso = d.isocalendar()
    return {"weekly": f"{iso.year}-W{iso.week:02d}", "monthly": f"{d.year}-{d.month:02d}", "quarterly": f"{d.year}-Q{(d.month - 1) // 3 + 1}", "yearly": str(d.year)}[scale]


@pytest.mark.parametrize("scale", SCALES)
def test_periods(spark, scale):
    rnd = random.Random(3)
    days = [datetime(1999, 12, 25) + timedelta(hours=rnd.randrange(24 * 5000)) for _ in range(300)] + [datetime(2020, 12, 31), datetime(2021, 1, 3, 23), datetime(2021, 1, 4)]
    index = column(spark, days, "timestamp_ntz", lambda c: period_index(c, scale))
    assert index == [index_of(d, scale) for d in days]
    assert column(spark, index, "int", lambda c: period_key(c, scale)) == [key_of(d, scale) for d in days]
    starts = column(spark, index, "int", lambda c: period_start(c, scale))
    assert all(index_of(s, scale) == i and index_of(s - timedelta(days=1), scale) == i - 1 for s, i in zip(starts, index, strict=True))


def test_week_53_and_unknown_scale(spark):
    first, last = index_of(date(2020, 12, 21), "weekly"), index_of(date(2021, 1, 4), "weekly")
    assert column(spark, list(range(first, last + 1)), "int", lambda c: period_key(c, "weekly")) == ["2020-W52", "2020-W53", "2021-W01"]
    with pytest.raises(ValueError):
        period_index(F.col("x"), "daily")
    assert last_closed(datetime(2026, 1, 1, tzinfo=UTC), "monthly") == index_of(date(2025, 12, 1), "monthly")


@pytest.mark.parametrize(("step", "count", "want"), [(7, 60, "weekly"), (30, 30, "monthly"), (90, 12, "quarterly"), (360, 4, "yearly"), (1, 0, "monthly")])
def test_scale_choice(spark, step, count, want):
    now = datetime(2026, 1, 1)
    rows = spark.createDataFrame([(now - timedelta(days=step * k),) for k in range(1, count + 1)], "t timestamp_ntz")
    assert choose_scale(rows, "t", now).collect()[0][0] == want


def naive_kendall(x, alpha):
    n = len(x)
    if n < 3:
        return "no_trend", 1.0, 0.0, 0
    s = sum((x[j] > x[i]) - (x[j] < x[i]) for i in range(n) for j in range(i + 1, n))
    var = (n * (n - 1) * (2 * n + 5) - sum(t * (t - 1) * (2 * t + 5) for t in (x.count(v) for v in set(x)))) / 18
    if var <= 0:
        return "no_trend", 1.0, 0.0, s
    z = (s - (s > 0) + (s < 0)) / math.sqrt(var)
    p = math.erfc(abs(z) / math.sqrt(2))
    return ("no_trend" if p > alpha or not z else "increasing" if z > 0 else "decreasing"), p, z, s


def test_mann_kendall(spark):
    rnd = random.Random(5)
    series = [list(range(1, 9)), [3] * 8, [1, 0, 1, 0, 0, 0, 0, 0], [], [1], [2, 1], *([rnd.randrange(5) for _ in range(rnd.randrange(1, 12))] for _ in range(200))]
    got = column(spark, series, "array<int>", lambda c: mann_kendall(c, 0.1))
    for x, r in zip(series, got, strict=True):
        trend, p, z, s = naive_kendall(x, 0.1)
        assert (r["trend"], r["s"], r["n"]) == (trend, s, len(x))
        assert r["p"] == pytest.approx(p, abs=1e-6) and r["z"] == pytest.approx(z, abs=1e-12)
    assert got[0]["slope"] == 1.0 and got[0]["p"] < 0.01
    assert (got[2]["s"], round(got[2]["z"], 6)) == (-10, -1.5) and got[2]["p"] == pytest.approx(0.1336, abs=1e-4)
    assert column(spark, ["increasing", "decreasing", "no_trend"], "string", direction) == ["rising", "falling", "flat"]


PATHS = {
    "lib/express.js": "lib", "src/setup.py": "src", "src/core/parser/lexer.py": "core/parser", "setup.py": "(root)", "a/b/c/d.py": "a/b", "node_modules/x/y.js": None, "": None, "packages/ui/button.tsx": "ui",
    "a//b.py": "a", "x/package-lock.json": None, "app/app/app/app.py": "app/app",
}


def test_modules(spark):
    assert column(spark, list(PATHS), "string", lambda c: module_of(c, Settings())) == list(PATHS.values())
    assert column(spark, ["a/b/c.py"], "string", lambda c: module_of(c, Settings(module_depth=1))) == ["a"]
    assert column(spark, [None], "string", lambda c: module_of(c, Settings())) == [None]


def test_path_tests(spark):
    paths = ["a/B.PY", "a/.bashrc", "x.tar.gz", "a.b/c", "q_pb2.py", "m/migrations/0001_x.py", "README.md"]
    assert column(spark, paths, "string", extension) == [".py", "", ".gz", "", ".py", ".py", ".md"]
    assert column(spark, paths, "string", is_source) == [True, False, False, False, True, True, False]
    assert column(spark, paths, "string", is_ignored) == [False, False, True, False, True, True, False]
    assert column(spark, ["tests", "core/spec", "a/test_b", "contest/x"], "string", is_test_module) == [True, True, True, False]
    assert column(spark, ["a.kts", "b.H", "c.txt"], "string", language_of) == ["kotlin", "c", None]


def test_renames(spark):
    got = column(spark, ["d/{a => b}/f.py", "x.py => y.py", "p.py", "d/{ => new}/f.py"], "string", renamed)
    assert [(r["path"], r["old_path"]) for r in got] == [("d/b/f.py", "d/a/f.py"), ("y.py", "x.py"), ("p.py", None), ("d/new/f.py", "d/f.py")]


def test_noise(spark):
    rows = [("al", "a@x", "feat", 3, 2, None), ("dependabot", "d@x", "feat", 3, 2, "bot_author"), ("al", "a@x", "Bump lodash", 3, 2, "maintenance_subject"), ("al", "a@x", None, 501, 2, "bulk_changeset"), ("al", "a@x", "docs", 3, 0, "no_source_files"),
            ("ci[bot]", "a@x", "feat", 1, 1, None)]
    df = spark.createDataFrame(rows, "a string, e string, s string, f int, n int, want string")
    assert df.where(~noise_reason(*map(F.col, "aesfn"), Settings()).eqNullSafe(F.col("want"))).count() == 0
    who = spark.createDataFrame([("A", " X@Y "), ("Bob", ""), (None, None)], "a string, e string").select(author_id(F.col("a"), F.col("e"))).collect()
    assert [r[0] for r in who] == ["x@y", "bob", "unknown"]


def test_sizes_and_score(spark):
    assert column(spark, [0, 1, 3, 4, 10, 11, 50, 51], "int", step_size) == ["0", "1-3", "1-3", "4-10", "4-10", "11-50", "11-50", "51+"]
    got = column(spark, [0, 1, 100, 10**9], "bigint", lambda c: maintainability(c, F.lit(5)))
    assert got[0] == got[1] and got[2] == pytest.approx((171 - 1.15 - 16.2 * math.log(100)) / 1.71) and got[3] == 0


def test_settings_json():
    s = Settings(window=6, strip_prefixes=("x",))
    assert Settings.from_json(s.to_json()) == s
    assert Settings.from_json('{"window": 5, "other": 1}').window == 5
