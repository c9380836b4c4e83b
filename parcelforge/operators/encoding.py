"""Encoding and scaling of attribute tables: global fits are one aggregate row, joined back by a broadcast of that row."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import stats

#: Efficiency by irrigation type, drainage by soil type; others have the default.
IRRIGATION = {"drip": 1.0, "sprinkler": 0.8, "center_pivot": 0.75, "furrow": 0.5, "flood": 0.3}
DRAINAGE = {"sandy": 0.9, "loamy_sand": 0.75, "sandy_loam": 0.65, "loam": 0.5, "silty_loam": 0.4, "silty_clay": 0.25, "clay_loam": 0.2, "clay": 0.1}
DEFAULT_SCORE = 0.5
#: Upper bounds (inclusive) of the size classes in hectares.
SIZE_CLASSES = {"small": 20.0, "medium": 40.0, "large": 60.0, "xlarge": float("inf")}


def lookup(column: Column, table: dict[str, float], default: float = DEFAULT_SCORE) -> Column:
    entries = F.create_map(*(F.lit(x) for x in itertools.chain.from_iterable(table.items())))
    return F.coalesce(F.try_element_at(entries, column), F.lit(default))


def size_class(area_ha: Column) -> Column:
    """Right-closed bins; null for null, zero and negative areas."""
    out = F.when(area_ha.isNull() | (area_ha <= 0), None)
    for name, top in SIZE_CLASSES.items():
        out = out.when(area_ha <= top, name)
    return out


def size_code(area_ha: Column) -> Column:
    """Position of the class; -1 without one."""
    out = F.when(area_ha.isNull() | (area_ha <= 0), -1)
    for i, top in enumerate(SIZE_CLASSES.values()):
        out = out.when(area_ha <= top, i)
    return out


def row_mean(columns: list[str]) -> Column:
    """Of the values that are there."""
    there = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(there, F.lit(0.0), lambda acc, x: acc + x), F.size(there))


#: Columns that a category may become.
MOST_CATEGORIES = 2000


def categories(df: DataFrame, column: str) -> list[str]:
    """The sorted distinct values: as many as there will be columns. More than ``MOST_CATEGORIES`` are refused."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(MOST_CATEGORIES + 1).collect()]
    if len(found) > MOST_CATEGORIES:
        raise ValueError(f"{column} has more than {MOST_CATEGORIES} different values: too many for a column each")
    return sorted(found)


def label_codes(df: DataFrame, column: str, unknown: str | None = "unknown") -> DataFrame:
    """``label`` and ``code``: lower-cased values by rank, nulls as ``unknown`` (rejected where that is None).

    The different values only are sorted in one task, which spills; none is held in a buffer.
    """
    value = F.lower(column)
    values = df.select((F.coalesce(value, F.lit(unknown)) if unknown else F.coalesce(value, F.raise_error(F.lit("null label")))).alias("label"))
    return values.distinct().select("label", (F.row_number().over(W.orderBy("label")) - 1).cast("long").alias("code"))


def one_hot(df: DataFrame, column: str, prefix: str, values: list[str]) -> DataFrame:
    """``<prefix>__<value>`` for each value, case kept; all 0 for others and nulls."""
    return df.select("*", *(F.coalesce(F.col(column) == v, F.lit(False)).cast("int").alias(f"{prefix}__{v}") for v in values))


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Scaled to 0..1, nulls first filled with 0; a constant column becomes 0."""
    filled = df.na.fill(0, columns)
    fit = filled.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    scaled = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")), F.lit(0.0)) for c in columns}
    return filled.crossJoin(F.broadcast(fit)).withColumns(scaled).select(*df.columns)


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact medians for nulls; a column without values becomes 0."""
    fit = df.agg(*(m.alias(f"_m_{c}") for c, m in stats.medians(df, columns).items()))
    return df.crossJoin(F.broadcast(fit)).withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}"), F.lit(0.0)) for c in columns}).select(*df.columns)


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean 0 and population deviation 1; a column that is constant up to rounding becomes 0."""
    fit = df.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("avg", F.avg), ("std", F.stddev_pop))))

    return df.crossJoin(F.broadcast(fit)).withColumns({c: _scaled(c) for c in columns}).select(*df.columns)


def _scaled(c: str) -> Column:
    mean, std = F.col(f"_avg_{c}"), F.col(f"_std_{c}")
    return F.when(std > 1e-12 * F.greatest(F.abs(mean), F.lit(1.0)), F.try_divide(F.col(c) - mean, std)).otherwise(F.when(F.col(c).isNotNull(), 0.0))


def impute_and_standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """``standardise`` after ``impute_median``, both fitted by one aggregate: the filled values shift its mean and deviation."""
    fit = df.agg(F.count("*").alias("_n"), *(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("k", F.count), ("a", F.avg), ("v", F.var_pop))), *(m.alias(f"_m_{c}") for c, m in stats.medians(df, columns).items()))
    fit = fit.withColumns({f"_m_{c}": F.coalesce(F.col(f"_m_{c}"), F.lit(0.0)) for c in columns})
    fit = fit.withColumns({f"_avg_{c}": F.try_divide(F.col(f"_k_{c}") * F.coalesce(f"_a_{c}", F.lit(0.0)) + (F.col("_n") - F.col(f"_k_{c}")) * F.col(f"_m_{c}"), F.col("_n")) for c in columns})

    def deviation(c: str) -> Column:
        k, mean = F.col(f"_k_{c}"), F.col(f"_avg_{c}")
        there = F.coalesce(k * (F.col(f"_v_{c}") + (F.col(f"_a_{c}") - mean) * (F.col(f"_a_{c}") - mean)), F.lit(0.0))
        filled = (F.col("_n") - k) * (F.col(f"_m_{c}") - mean) * (F.col(f"_m_{c}") - mean)
        return F.sqrt(F.try_divide(there + filled, F.col("_n")))

    fit = fit.select(*(f"{n}_{c}" for c in columns for n in ("_m", "_avg")), *(deviation(c).alias(f"_std_{c}") for c in columns))
    filled = {c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in columns}
    return df.crossJoin(F.broadcast(fit)).withColumns(filled).withColumns({c: _scaled(c) for c in columns}).select(*df.columns)
