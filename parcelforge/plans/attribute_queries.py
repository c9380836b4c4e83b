"""Scans, projections, encodings, scaling and summaries of attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.operators import encoding as E
from parcelforge.operators import stats
from parcelforge.operators import timeseries as T

from . import views
from .geometry_queries import FEATURES, geometry_features
from .registry import register

_P = views.P
_F = f"{views.P}, {views.Y}, {views.FIELDS}"
_YIELDS = " ".join(f"{c}:d" for c in views.YIELDS)
_LIST = "[" + ", ".join(views.YIELDS) + "]"


@register("scan_fields", f"field_id:i crop_type:s soil_type:s irrigation_type:s area_ha:d slope_pct:d {_YIELDS}", f"{_F} --SELECT * FROM f")
def scan_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.fields(spark, sf_dir)


@register("scan_attributes", "field_id:i crop_type:s soil_type:s irrigation_type:s area_ha:d slope_pct:d", f"{_P} --SELECT * FROM p")
def scan_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.parcels(spark, sf_dir).drop("polygons")


@register("project_attr", "field_id:i crop_type:s area_ha:d", f"{_P} --SELECT * FROM p")
def project_attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.parcels(spark, sf_dir).select("field_id", "crop_type", "area_ha")


@register("row_mean", "field_id:i mean_yield:d", f"{_F} --SELECT field_id, list_avg({_LIST}) AS mean_yield FROM f")
def row_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.fields(spark, sf_dir).select("field_id", E.row_mean(views.YIELDS).alias("mean_yield"))


def ratios(fields: DataFrame, yields: list[str] = views.YIELDS) -> DataFrame:
    """Derived attributes beside the columns of ``fields``."""
    mean, area = E.row_mean(yields), F.col("area_ha")
    return fields.withColumns({
        "mean_yield": mean, "yield_efficiency": F.try_divide(mean, area), "slope_area_ratio": F.col("slope_pct") / (area + 1),
        "irrigation_efficiency_score": E.lookup(F.col("irrigation_type"), E.IRRIGATION), "soil_drainage_score": E.lookup(F.col("soil_type"), E.DRAINAGE), "area_size_code": E.size_code(area),
    })


def _score(column: str, table: dict[str, float]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {E.DEFAULT_SCORE} END::DOUBLE"


_CODE = "CASE WHEN area_ha IS NULL OR area_ha <= 0 THEN -1 WHEN area_ha <= 20 THEN 0 WHEN area_ha <= 40 THEN 1 WHEN area_ha <= 60 THEN 2 ELSE 3 END"
_CLASS = "CASE WHEN area_ha IS NULL OR area_ha <= 0 THEN NULL WHEN area_ha <= 20 THEN 'small' WHEN area_ha <= 40 THEN 'medium' WHEN area_ha <= 60 THEN 'large' ELSE 'xlarge' END"
_R = f"""{_F}, r AS (SELECT *, list_avg({_LIST}) AS mean_yield, list_avg({_LIST}) / area_ha AS yield_efficiency, slope_pct / (area_ha + 1) AS slope_area_ratio,
 {_score('irrigation_type', E.IRRIGATION)} AS irrigation_efficiency_score, {_score('soil_type', E.DRAINAGE)} AS soil_drainage_score, {_CODE} AS area_size_code FROM f)"""


def _ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratios(views.fields(spark, sf_dir))


register("attr_ratios", "field_id:i mean_yield:d yield_efficiency:d slope_area_ratio:d", f"{_R} --SELECT * FROM r")(_ratios)
register("map_irrigation", "field_id:i irrigation_efficiency_score:d", f"{_R} --SELECT * FROM r")(_ratios)
register("map_soil", "field_id:i soil_drainage_score:d", f"{_R} --SELECT * FROM r")(_ratios)


@register("size_class", "field_id:i size_class:s area_size_code:i", f"{_P} --SELECT field_id, {_CLASS} AS size_class, {_CODE} AS area_size_code FROM p")
def size_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = F.col("area_ha")
    return views.parcels(spark, sf_dir).select("field_id", E.size_class(area).alias("size_class"), E.size_code(area).alias("area_size_code"))


@register("value_counts", "crop_type:s n:i", f"{_P} --SELECT crop_type, count(*) AS n FROM p WHERE crop_type IS NOT NULL GROUP BY crop_type")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_counts(views.parcels(spark, sf_dir), "crop_type")


@register("size_class_counts", "position:i size_class:s n:i", f"{_P}, k(position, size_class) AS (VALUES (0, 'small'), (1, 'medium'), (2, 'large'), (3, 'xlarge')) --SELECT position, size_class, count(field_id) AS n FROM k LEFT JOIN (SELECT field_id, {_CLASS} AS size_class FROM p) USING (size_class) GROUP BY ALL")
def size_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.class_counts(size_class(spark, sf_dir).select("size_class"), "size_class", list(E.SIZE_CLASSES))


_DESCRIBED = [c.split(":")[0] for c in FEATURES.split() if c != "n_vertices:i"] + ["n_vertices"]


@register("describe_features", "name:s n:i mean:d std:d min:d p25:d p50:d p75:d max:d", f"{views.G_SQL} --" + " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}::DOUBLE) AS std, min({c}) AS min, quantile_cont({c}::DOUBLE, 0.25) AS p25, quantile_cont({c}::DOUBLE, 0.5) AS p50, quantile_cont({c}::DOUBLE, 0.75) AS p75, max({c}) AS max FROM g" for c in _DESCRIBED))
def describe_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.describe(geometry_features(views.parcels(spark, sf_dir), ["field_id"]).select(*_DESCRIBED), _DESCRIBED)


_NOTABLE = {"most_compact": ("compactness", True), "most_elongated": ("elongation", True), "largest": ("area_ha", True), "most_vertices": ("n_vertices", True), "least_solid": ("solidity", False)}


@register("notable_fields", "name:s field_id:i", f"{views.G_SQL} --" + " UNION ALL ".join(f"(SELECT '{k}' AS name, field_id FROM g ORDER BY round({c}, 9) {'DESC' if d else ''}, field_id LIMIT 1)" for k, (c, d) in _NOTABLE.items()))
def notable_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = geometry_features(views.parcels(spark, sf_dir), ["field_id"])
    return stats.notable(g.select("field_id", *(F.round(c, 9).alias(c) for c, _ in _NOTABLE.values())), "field_id", _NOTABLE)


@register("label_encode", "field_id:i code:i", f"{_P}, c AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT coalesce(lower(crop_type), 'unknown') AS label FROM p)) --SELECT field_id, code FROM p JOIN c ON c.label = coalesce(lower(crop_type), 'unknown')")
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.parcels(spark, sf_dir)
    return rows.withColumn("label", F.coalesce(F.lower("crop_type"), F.lit("unknown"))).join(E.label_codes(rows, "crop_type"), "label").select("field_id", "code")


@register("category_list", "soil_type:s", f"{_P} --SELECT DISTINCT soil_type FROM p WHERE soil_type IS NOT NULL")
def category_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.parcels(spark, sf_dir).groupBy().agg(F.array_sort(F.collect_set("soil_type")).alias("c")).select(F.explode("c").alias("soil_type"))


_SOILS = sorted(views.SOIL)


@register("one_hot", "field_id:i " + " ".join(f"soil__{s}:i" for s in _SOILS), f"{_P} --SELECT field_id, " + ", ".join(f"(soil_type = '{s}')::INT AS soil__{s}" for s in _SOILS) + " FROM p")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.parcels(spark, sf_dir).select("field_id", "soil_type")
    return E.one_hot(rows, "soil_type", "soil", E.categories(rows, "soil_type"))


_SCALED = ["area_ha", "slope_pct", "mean_yield", "yield_efficiency", "slope_area_ratio", "irrigation_efficiency_score"]


def _min_max(c: str) -> str:
    lo, hi = f"min(coalesce({c}, 0)) OVER ()", f"max(coalesce({c}, 0)) OVER ()"
    return f"CASE WHEN {hi} > {lo} THEN (coalesce({c}, 0) - {lo}) / ({hi} - {lo}) ELSE 0 END AS {c}"


@register("minmax_scale", "field_id:i " + " ".join(f"{c}:d" for c in _SCALED), f"{_R} --SELECT field_id, {', '.join(map(_min_max, _SCALED))} FROM r")
def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.min_max(ratios(views.fields(spark, sf_dir)).select("field_id", *_SCALED), _SCALED)


_CROPS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
_YOY = [f"yoy_change_{y}" for y in views.YEARS[1:]]
_NUMBERS = [*_SCALED, "area_size_code", "crop_type_encoded", *_YOY]
_CODED = f"""{_R}, q AS (SELECT r.*, dense_rank() OVER (ORDER BY coalesce(lower(crop_type), 'unknown')) - 1 AS crop_type_encoded, {', '.join(f'yield_{y} - yield_{x} AS yoy_change_{y}' for x, y in zip(views.YEARS, views.YEARS[1:]))} FROM r)"""


@register("one_hot_crop", "field_id:i " + " ".join(f"crop__{c}:i" for c in _CROPS), f"{_P} --SELECT field_id, " + ", ".join(f"(crop_type = '{c}')::INT AS crop__{c}" for c in _CROPS) + " FROM p")
def one_hot_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.parcels(spark, sf_dir).select("field_id", "crop_type")
    return E.one_hot(rows, "crop_type", "crop", E.categories(rows, "crop_type"))


@register("attribute_matrix", "field_id:i " + " ".join(f"{c}:d" for c in _NUMBERS) + " " + " ".join(f"crop__{c}:i" for c in _CROPS) + " " + " ".join(f"soil__{s}:i" for s in _SOILS), f"{_CODED} --SELECT field_id, {', '.join(map(_min_max, _NUMBERS))}, " + ", ".join([*(f"(crop_type = '{c}')::INT AS crop__{c}" for c in _CROPS), *(f"(soil_type = '{s}')::INT AS soil__{s}" for s in _SOILS)]) + " FROM q")
def attribute_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute_features(views.fields(spark, sf_dir), views.parcels(spark, sf_dir), views.YIELDS)


def attribute_features(fields: DataFrame, categories: DataFrame, yields: list[str]) -> DataFrame:
    """Scaled numbers, the crop's code and the yearly changes among them, then an indicator for each crop and each soil.

    ``categories`` has the crops and soils that there are: ``fields``, or what they were read from.
    """
    changes = [f"yoy_change_{y.rsplit('_', 1)[1]}" for y in yields[1:]]
    numbers = [*_SCALED, "area_size_code", "crop_type_encoded", *changes]
    rows = ratios(fields, yields).withColumn("label", F.coalesce(F.lower("crop_type"), F.lit("unknown")))
    rows = rows.join(E.label_codes(categories, "crop_type").withColumnRenamed("code", "crop_type_encoded"), "label")
    rows = T.yearly_change(rows, yields, ["field_id", "crop_type", "soil_type", *_SCALED, "area_size_code", "crop_type_encoded"])
    scaled = E.min_max(rows.select("field_id", "crop_type", "soil_type", *(F.col(c).cast("double").alias(c) for c in numbers)), numbers)
    crops = E.one_hot(scaled, "crop_type", "crop", E.categories(categories, "crop_type"))
    return E.one_hot(crops, "soil_type", "soil", E.categories(categories, "soil_type")).drop("crop_type", "soil_type")


_IMPUTED = ["yield_1995", "yield_1998", "mean_yield"]


@register("median_impute", "field_id:i " + " ".join(f"{c}:d" for c in _IMPUTED), f"{_R} --SELECT field_id, {', '.join(f'coalesce({c}, median({c}) OVER (), 0) AS {c}' for c in _IMPUTED)} FROM r")
def median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.impute_median(ratios(views.fields(spark, sf_dir)).select("field_id", *_IMPUTED), _IMPUTED)


def standard_sql(c: str) -> str:
    return f"CASE WHEN stddev_pop({c}) OVER () > 1e-12 * greatest(abs(avg({c}) OVER ()), 1) THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () WHEN {c} IS NOT NULL THEN 0 END AS {c}"


@register("standard_scale", "field_id:i area_ha:d slope_pct:d slope_area_ratio:d", f"{_R} --SELECT field_id, {', '.join(map(standard_sql, ['area_ha', 'slope_pct', 'slope_area_ratio']))} FROM r")
def standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = ["area_ha", "slope_pct", "slope_area_ratio"]
    return E.standardise(ratios(views.fields(spark, sf_dir)).select("field_id", *some), some)
