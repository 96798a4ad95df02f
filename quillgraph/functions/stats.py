"""Rates, intervals, percentiles and similarities as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(count: Column, n: Column, z: float = 1.96) -> Column:
    """The 95% score interval of a rate as struct lo, hi, rounded to four digits; null without cases."""
    p, m = F.try_divide(count.cast("double"), n), n.cast("double")
    low = F.lit(z * z)
    denominator = 1 + F.try_divide(low, m)
    center = p + F.try_divide(low, 2 * m)
    margin = F.lit(z) * F.sqrt(F.try_divide(p * (1 - p) + F.try_divide(low, 4 * m), m))
    bounds = F.struct(F.round(F.greatest(F.lit(0.0), (center - margin) / denominator), 4).alias("lo"), F.round(F.least(F.lit(1.0), (center + margin) / denominator), 4).alias("hi"))
    return F.when(n > 0, bounds)


def rate_report(count: Column, n: Column) -> Column:
    """rate, n, count and ci95; null without cases."""
    return F.when(n > 0, F.struct(F.round(F.try_divide(count.cast("double"), n), 4).alias("rate"), n.alias("n"), count.alias("count"), wilson(count, n).alias("ci95")))


def percentile(c: Column, p: float) -> Column:
    """Exact, between neighbours by linear interpolation."""
    return F.percentile(c, F.lit(p))


def rounded(c: Column, digits: int) -> Column:
    """To so many digits, halves away from zero, by the double times a power of ten as DuckDB does: 23 / 40 times 100 lies below 57.5.

    Spark's ``round`` takes the shortest decimal of the double instead (0.575), so a ratio may differ in its last digit.
    """
    return F.round(c * F.lit(10.0**digits), 0) / F.lit(10.0**digits)


def share_floor(n: Column, of: Column) -> Column:
    """Whole percent, rounded down; 0 of nothing."""
    return F.floor(100 * n / F.greatest(of, F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Of arrays of distinct tokens; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.try_divide(both.cast("double"), F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column) -> Column:
    """What part of the smaller of two arrays of distinct tokens the other has; 0 if one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.least(F.size(a), F.size(b))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def draw_key(*parts: Column | str, seed: int | str = 0) -> Column:
    """The order of seeded draws: the same in every engine that has MD5."""
    return F.md5(F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.col(p).cast("string") for p in parts), F.lit(str(seed))).cast("binary"))


def uniform(*parts: Column | str, seed: int | str = 0) -> Column:
    """A number in [0, 1) from the first eight digits of the draw key."""
    return F.conv(F.substring(draw_key(*parts, seed=seed), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
