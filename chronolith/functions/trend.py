"""Mann-Kendall trend test with tie correction, and Sen's slope, over an array column."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# A published Chebyshev fit of the complementary error function, good to 1.2e-7 of its value.
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def critical(alpha: float) -> float:
    """|z| from which the two-sided p-value is at most alpha."""
    return NormalDist().inv_cdf(1 - alpha / 2)


def two_sided(z: Column) -> Column:
    """The two-sided tail of the normal distribution beyond |z|."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + x / 2)
    total = F.lit(_ERFC[-1])
    for c in reversed(_ERFC[:-1]):
        total = total * t + c
    return F.least(F.lit(1.0), t * F.exp(-x * x + total))


def _each_pair(x: Column, use) -> Column:
    """`use(earlier, later, distance)` over all pairs."""
    return F.flatten(F.transform(x, lambda a, i: F.transform(F.slice(x, i + 2, F.size(x)), lambda b, k: use(a, b, k + 1))))


def kendall_s(x: Column) -> Column:
    return F.aggregate(_each_pair(x, lambda a, b, _: F.signum(b - a).cast("int")), F.lit(0), lambda s, v: s + v)


def tie_term(x: Column) -> Column:
    """Sum of t(t-1)(2t+5) over groups of equal values."""
    sizes = F.transform(x, lambda a: F.size(F.filter(x, lambda b: b == a)))
    return F.aggregate(sizes, F.lit(0), lambda s, t: s + (t - 1) * (2 * t + 5))


def sen_slope(x: Column) -> Column:
    slopes = F.array_sort(_each_pair(x, lambda a, b, d: (b - a) / d))
    m = F.size(slopes)
    return (F.get(slopes, F.floor((m - 1) / 2).cast("int")) + F.get(slopes, F.floor(m / 2).cast("int"))) / 2


def _bound(value: Column, use) -> Column:
    """`use(value)` with the value evaluated once: inner lambdas then refer to a variable, not to its expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def mann_kendall(x: Column, alpha: float, slope: bool = True) -> Column:
    """Struct (trend, p, z, s, slope, n); fewer than three values or no variance: no_trend, p 1. The slope costs most."""

    def test(v: Column) -> Column:
        n = F.size(v)
        return F.struct(n.alias("n"), kendall_s(v).alias("s"), ((n * (n - 1) * (2 * n + 5) - tie_term(v)) / 18.0).alias("var"), (sen_slope(v) if slope else F.lit(None).cast("double")).alias("slope"))

    def scored(r: Column) -> Column:
        void = (r["n"] < 3) | (r["var"] <= 0)
        z = F.when(void | (r["s"] == 0), 0.0).otherwise((r["s"] - F.signum(r["s"].cast("double"))) / F.sqrt(F.when(void, 1.0).otherwise(r["var"])))
        return F.struct(void.alias("void"), z.alias("z"), r["n"].alias("n"), F.when(r["n"] < 3, 0).otherwise(r["s"]).alias("s"), F.when(void, 0.0).otherwise(r["slope"]).alias("slope"))

    def result(r: Column) -> Column:
        trend = F.when(r["z"] >= critical(alpha), "increasing").when(r["z"] <= -critical(alpha), "decreasing").otherwise("no_trend")
        return F.struct(trend.alias("trend"), F.when(r["void"], 1.0).otherwise(two_sided(r["z"])).alias("p"), r["z"].alias("z"), r["s"].alias("s"), r["slope"].alias("slope"), r["n"].alias("n"))

    return _bound(_bound(_bound(x.cast("array<double>"), test), scored), result)


def direction(trend: Column) -> Column:
    return F.when(trend == "increasing", "rising").when(trend == "decreasing", "falling").otherwise("flat")
