"""Features of short yearly series: one select of higher-order functions, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.functions.fence import fence

SIGNIFICANT, ANOMALOUS = 0.05, 2.0


def series(columns: list[str]) -> Column:
    """Valid points of ``<name>_<year>`` columns in the order of the years: ``array<struct<year, value>>``."""
    points = F.array(*(F.struct(F.lit(int(c.rsplit("_", 1)[1])).alias("year"), F.col(c).cast("double").alias("value")) for c in columns))
    return F.filter(points, lambda p: p.value.isNotNull() & ~F.isnan(p.value))


def unpivot(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    long = df.unpivot([key], columns, "name", "value")
    return long.select(key, F.split_part("name", F.lit("_"), F.lit(-1)).cast("int").alias("year"), "value")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def _mean(a: Column) -> Column:
    return F.try_divide(_sum(a), F.size(a))


def _slope(points: Column) -> Column:
    """Of the values by the years, by the recurrence of ``regr_slope`` in the order of the years: where the exact slope is 0, the sign is that of its rounding, too."""

    def add(acc: Column, p: Column) -> Column:
        n, dx, dy = acc.n + 1, p.year - acc.x, p.value - acc.y
        x, y = acc.x + dx / n, acc.y + dy / n
        return F.struct(n.alias("n"), x.alias("x"), y.alias("y"), (acc.xx + dx * (p.year - x)).alias("xx"), (acc.xy + dx * (p.value - y)).alias("xy"))

    start = F.struct(*(F.lit(0.0).alias(c) for c in ("n", "x", "y", "xx", "xy")))
    return F.aggregate(points, start, add, lambda acc: F.try_divide(acc.xy, acc.xx))


def two_sided_p(r2: Column, df: Column) -> Column:
    """Of the t-test of a correlation with whole degrees of freedom: the closed form for Student's distribution."""
    theta = F.atan(F.sqrt(F.try_divide(r2, 1 - r2)))
    sin, cos = F.sin(theta), F.cos(theta)
    odd = df % 2 == 1
    # the sum's terms: cos, 2/3 cos^3, ... for odd df; 1, 1/2 cos^2, ... for even
    first = F.struct(F.lit(0.0).alias("sum"), F.when(odd, cos).otherwise(1.0).alias("term"))
    terms = F.when(df >= 2, F.sequence(F.lit(1), F.floor(df / 2).cast("int"))).otherwise(F.array().cast("array<int>"))

    def add(acc: Column, k: Column) -> Column:
        factor = F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
        return F.struct((acc.sum + acc.term).alias("sum"), (acc.term * factor * cos * cos).alias("term"))

    total = F.aggregate(terms, first, add, lambda acc: acc.sum)
    p = F.when(odd, 1 - 2 / F.pi() * (theta + sin * total)).otherwise(1 - sin * total)
    return F.when(r2 >= 1, 0.0).otherwise(F.greatest(F.lit(0.0), p))


def features(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """``keep`` and all features; with fewer than two valid points they are null and ``insufficient_data`` is true."""
    base = fence(df.select(*keep, series(columns).alias("_s")))
    base = base.withColumns({"_v": F.transform("_s", lambda p: p.value), "_y": F.transform("_s", lambda p: p.year), "_n": F.size("_s")})
    base = fence(base).withColumns({"_m": _mean(F.col("_v")), "_my": F.try_divide(F.aggregate("_y", F.lit(0.0), lambda a, y: a + y), F.col("_n"))})
    v, y, n, m, my = (F.col(c) for c in ("_v", "_y", "_n", "_m", "_my"))
    base = fence(base).withColumns({
        "_sxx": _sum(F.transform(y, lambda t: (t - my) * (t - my))),
        "_syy": _sum(F.transform(v, lambda x: (x - m) * (x - m))),
        "_sxy": _sum(F.zip_with(y, v, lambda t, x: (t - my) * (x - m))),
        "_d": F.when(n >= 2, F.zip_with(F.slice(v, 2, F.greatest(n - 1, F.lit(1))), F.slice(v, 1, F.greatest(n - 1, F.lit(1))), lambda b, a: b - a)),
    })
    base = fence(base)
    sxx, syy, sxy, d = (F.col(c) for c in ("_sxx", "_syy", "_sxy", "_d"))
    flat = syy <= 1e-18 * F.greatest(m * m, F.lit(1.0))
    std = F.when(flat, 0.0).otherwise(F.sqrt(F.try_divide(syy, n - 1)))
    r2 = F.when(flat, 0.0).otherwise(F.least(F.lit(1.0), F.try_divide(sxy * sxy, sxx * syy)))
    base = fence(base.withColumns({"_std": std, "_r2": r2}))
    std, r2 = F.col("_std"), F.col("_r2")
    p = F.when(flat, 1.0).when(n == 2, 0.0).otherwise(two_sided_p(r2, F.greatest(n - 2, F.lit(1))))
    anomalies = F.transform(F.filter("_s", lambda q: F.when(std > 0, F.abs(q.value - m) / std > ANOMALOUS).otherwise(False)), lambda q: q.year)
    worst = F.array_max(F.transform(v, lambda x: F.when(std > 0, F.abs(x - m) / std).otherwise(0.0)))
    out = {
        "mean_yield": m, "std_yield": std, "cv_yield": F.when(m != 0, F.try_divide(std, m)).otherwise(0.0),
        "min_yield": F.array_min(v), "max_yield": F.array_max(v), "yield_range": F.array_max(v) - F.array_min(v),
        "best_year": F.try_element_at(y, F.array_position(v, F.array_max(v)).cast("int")), "worst_year": F.try_element_at(y, F.array_position(v, F.array_min(v)).cast("int")),
        "trend_slope": _slope(F.col("_s")), "trend_r2": r2, "trend_p_value": p, "trend_significant": (p < SIGNIFICANT).cast("int"),
        "max_abs_z": worst, "n_anomaly_years": F.size(anomalies), "anomaly_flag": (F.size(anomalies) > 0).cast("int"), "anomaly_years": anomalies,
        "recent_vs_historical": F.when(n >= 3, _mean(F.slice(v, -2, 2)) - _mean(F.slice(v, 1, F.greatest(n - 2, F.lit(1))))).otherwise(0.0),
        "last_year_trend": F.element_at(v, -1) - F.element_at(v, 1),
        "mean_yoy_change": _mean(d), "max_yoy_increase": F.array_max(d), "max_yoy_decrease": F.array_min(d),
    }
    enough = n >= 2
    return base.select(*keep, *(F.when(enough, c).alias(k) for k, c in out.items()), (~enough).alias("insufficient_data"))


def yearly_change(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """``yoy_change_<year>`` of adjacent columns; null if either is."""
    pairs = zip(columns, columns[1:])
    return df.select(*keep, *((F.col(b) - F.col(a)).alias(f"yoy_change_{b.rsplit('_', 1)[1]}") for a, b in pairs))
