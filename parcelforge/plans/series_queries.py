"""Features of the yearly yields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.operators import stats
from parcelforge.operators import timeseries as T

from . import views
from .registry import register

_BASE = f"{views.P}, {views.Y}, {views.S}"
_POINTS = "z AS (SELECT s.field_id, len(lv) AS n, lv, ly FROM s), k AS (SELECT y.field_id, avg(v) AS m, stddev_samp(v) AS sd, regr_slope(v, yr) AS slope, regr_sxx(v, yr) AS sxx, regr_syy(v, yr) AS syy, regr_sxy(v, yr) AS sxy FROM y GROUP BY y.field_id)"
_STATS = f"""{_BASE}, {_POINTS}, a AS (SELECT z.*, m, slope, n - 2 AS df, syy <= 1e-18 * greatest(m * m, 1) AS flat, CASE WHEN syy <= 1e-18 * greatest(m * m, 1) THEN 0 ELSE sd END AS sd2,
 CASE WHEN syy <= 1e-18 * greatest(m * m, 1) THEN 0 ELSE least(1, sxy * sxy / nullif(sxx * syy, 0)) END AS r2 FROM z LEFT JOIN k USING (field_id)),
b AS (SELECT *, CASE WHEN r2 < 1 THEN atan(sqrt(r2 / nullif(1 - r2, 0))) END AS th FROM a),
c AS (SELECT *, CASE WHEN flat THEN 1 WHEN n = 2 OR r2 >= 1 THEN 0 ELSE greatest(0, CASE df WHEN 1 THEN 1 - 2 / pi() * th WHEN 2 THEN 1 - sin(th) WHEN 3 THEN 1 - 2 / pi() * (th + sin(th) * cos(th))
 WHEN 4 THEN 1 - sin(th) * (1 + cos(th) * cos(th) / 2) WHEN 5 THEN 1 - 2 / pi() * (th + sin(th) * (cos(th) + 2.0::DOUBLE / 3 * cos(th) * cos(th) * cos(th))) END) END AS p,
 list_transform(lv, lambda x: CASE WHEN sd2 > 0 THEN abs(x - m) / sd2 ELSE 0 END) AS zs, CASE WHEN n >= 2 THEN list_transform(range(1, n), lambda i: lv[i + 1] - lv[i]) END AS dl FROM b),
ts AS (SELECT field_id, n < 2 AS insufficient_data, CASE WHEN n >= 2 THEN {{}} END AS x FROM c)"""
_FEATURES = {
    "mean_yield": "m", "std_yield": "sd2", "cv_yield": "CASE WHEN m <> 0 THEN sd2 / m ELSE 0 END", "min_yield": "list_min(lv)", "max_yield": "list_max(lv)", "yield_range": "list_max(lv) - list_min(lv)",
    "best_year": "ly[list_position(lv, list_max(lv))]", "worst_year": "ly[list_position(lv, list_min(lv))]", "trend_slope": "slope", "trend_r2": "r2", "trend_p_value": "p", "trend_significant": "(p < 0.05)::INT",
    "max_abs_z": "list_max(zs)", "n_anomaly_years": "len(list_filter(zs, lambda q: q > 2))", "anomaly_flag": "(len(list_filter(zs, lambda q: q > 2)) > 0)::INT",
    "anomaly_years": "'[' || array_to_string(list_filter(list_transform(range(1, n + 1), lambda i: CASE WHEN zs[i] > 2 THEN ly[i] END), lambda q: q IS NOT NULL), ', ') || ']'",
    "recent_vs_historical": "CASE WHEN n >= 3 THEN list_avg(lv[n - 1:n]) - list_avg(lv[1:n - 2]) ELSE 0 END", "last_year_trend": "lv[n] - lv[1]",
    "mean_yoy_change": "list_avg(dl)", "max_yoy_increase": "list_max(dl)", "max_yoy_decrease": "list_min(dl)",
}
KINDS = {"best_year": "i", "worst_year": "i", "trend_significant": "i", "n_anomaly_years": "i", "anomaly_flag": "i", "anomaly_years": "s"}


def ts_sql(names: list[str]) -> str:
    """CTEs up to ``tf``: the features ``names``, null without two points, and ``insufficient_data``."""
    head = _STATS[: _STATS.rindex("ts AS")]
    return head + "tf AS (SELECT field_id, n < 2 AS insufficient_data, " + ", ".join(f"CASE WHEN n >= 2 THEN {_FEATURES[x]} END AS {x}" for x in names) + " FROM c)"


def ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.features(views.fields(spark, sf_dir), views.YIELDS, ["field_id"])
    years = F.concat(F.lit("["), F.array_join("anomaly_years", ", "), F.lit("]"))
    return out.withColumn("anomaly_years", years)


for _name, _some in {
    "ts_features": list(_FEATURES), "ts_basic": ["mean_yield", "std_yield", "min_yield", "max_yield", "yield_range"], "ts_cv": ["cv_yield"], "ts_best_worst": ["best_year", "worst_year"],
    "ts_trend": ["trend_slope", "trend_r2"], "ts_pvalue": ["trend_p_value", "trend_significant"], "ts_anomaly": ["max_abs_z", "n_anomaly_years", "anomaly_flag", "anomaly_years"],
    "ts_recent": ["recent_vs_historical"], "ts_last_first": ["last_year_trend"], "ts_yoy_stats": ["mean_yoy_change", "max_yoy_increase", "max_yoy_decrease"], "ts_insufficient": ["mean_yield"],
}.items():
    register(_name, "field_id:i insufficient_data:i " + " ".join(f"{c}:{KINDS.get(c, 'd')}" for c in _some), f"{ts_sql(_some)} --SELECT * FROM tf")(ts)


@register("unpivot_yields", "field_id:i year:i value:d", f"{_BASE}, yr AS (SELECT unnest(range({views.YEARS[0]}, {views.YEARS[-1] + 1})) AS year) --SELECT p.field_id, yr.year, y.v AS value FROM p CROSS JOIN yr LEFT JOIN y ON y.field_id = p.field_id AND y.yr = yr.year")
def unpivot_yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.unpivot(views.fields(spark, sf_dir), "field_id", views.YIELDS)


_PAIRS = list(zip(views.YEARS, views.YEARS[1:]))


@register("yoy_lag", "field_id:i " + " ".join(f"yoy_change_{b}:d" for _, b in _PAIRS), f"{views.P}, {views.Y}, {views.FIELDS} --SELECT field_id, " + ", ".join(f"yield_{b} - yield_{a} AS yoy_change_{b}" for a, b in _PAIRS) + " FROM f")
def yoy_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.yearly_change(views.fields(spark, sf_dir), views.YIELDS, ["field_id"])


@register("trend_direction_counts", "rising:i falling:i significant:i", f"{ts_sql(['trend_slope', 'trend_significant'])} --SELECT count(*) FILTER (trend_slope > 0) AS rising, count(*) FILTER (trend_slope < 0) AS falling, count(*) FILTER (trend_significant = 1) AS significant FROM tf")
def trend_direction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("trend_slope")
    return ts(spark, sf_dir).agg(F.count_if(s > 0).alias("rising"), F.count_if(s < 0).alias("falling"), F.count_if(F.col("trend_significant") == 1).alias("significant"))


@register("filter_flags", "field_id:i trend_significant:i anomaly_flag:i", f"{ts_sql(['trend_significant', 'anomaly_flag'])} --SELECT * FROM tf WHERE trend_significant = 1 OR anomaly_flag = 1")
def filter_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts(spark, sf_dir).where("trend_significant = 1 OR anomaly_flag = 1")


@register("top_trend", "field_id:i trend_slope:d4", f"{ts_sql(['trend_slope'])} --SELECT field_id, round(trend_slope, 4) AS trend_slope FROM tf ORDER BY 2 DESC NULLS LAST, 1 LIMIT 5")
def top_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top(ts(spark, sf_dir).select("field_id", F.round("trend_slope", 4).alias("trend_slope")), "trend_slope", "field_id", 5)


@register("most_stable", "field_id:i cv_yield:d4", f"{ts_sql(['cv_yield'])} --SELECT field_id, round(cv_yield, 4) AS cv_yield FROM tf ORDER BY 2 NULLS LAST, 1 LIMIT 5")
def most_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top(ts(spark, sf_dir).select("field_id", F.round("cv_yield", 4).alias("cv_yield")), "cv_yield", "field_id", 5, largest=False)
