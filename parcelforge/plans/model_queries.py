"""The combined feature table, and training and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.functions.fence import share
from parcelforge.operators import encoding as E
from parcelforge.operators import forest, stats
from parcelforge.operators import timeseries as T

from . import views
from .attribute_queries import _LIST, _score, ratios, standard_sql
from .geometry_queries import geometry_features
from .registry import register
from .series_queries import ts_sql

_GEOM = {"geom_area_ha": "area_ha", "geom_perimeter_km": "perimeter_km", "geom_compactness": "compactness", "geom_elongation": "elongation", "geom_solidity": "solidity", "geom_convexity": "convexity", "geom_n_vertices": "n_vertices", "geom_bbox_fill": "bbox_fill_ratio", "geom_edge_density": "edge_density"}
_ATTR = {"attr_mean_yield": "mean_yield", "attr_slope_pct": "slope_pct", "attr_area_ha": "area_ha", "attr_irrigation": "irrigation_efficiency_score", "attr_drainage": "soil_drainage_score"}
_TS = {"ts_mean": "mean_yield", "ts_cv": "cv_yield", "ts_slope": "trend_slope", "ts_r2": "trend_r2", "ts_min": "min_yield", "ts_max": "max_yield", "ts_range": "yield_range", "ts_n_anomalies": "n_anomaly_years", "ts_last_first": "last_year_trend"}
FEATURES = [*_GEOM, *_ATTR, *_TS]


_OWN = ["field_id", "crop_type", "soil_type", "irrigation_type", "slope_pct"]


def full_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometry, attribute and series features and the crop of each field: row-local but for one join, with the yields."""
    shapes = geometry_features(views.parcels(spark, sf_dir).withColumnRenamed("area_ha", "stated_ha"), [*_OWN, "stated_ha"])
    return combined(shapes.join(views.yields(spark, sf_dir), "field_id", "left"), views.YIELDS)


def combined(fields: DataFrame, yields: list[str]) -> DataFrame:
    """The features of fields that have geometry features, attributes (their area as ``stated_ha``) and yields."""
    rows = fields.select(*_OWN, F.col("stated_ha").alias("area_ha"), *(F.col(c).cast("double").alias(n) for n, c in _GEOM.items()), *yields)
    keep = ["field_id", "crop_type", *_GEOM, *_ATTR]
    both = ratios(rows, yields).select("field_id", "crop_type", *_GEOM, *(F.col(c).alias(n) for n, c in _ATTR.items()), *yields)
    return T.features(both, yields, keep).select(*keep, *(F.col(c).cast("double").alias(n) for n, c in _TS.items()))


_FULL = f"""{ts_sql(list(_TS.values()))}, {views.FIELDS}, {views.G_SQL[len(views.P) + 2:].replace(', e AS (', ', ee AS (').replace('FROM e GROUP', 'FROM ee GROUP').replace('m AS (SELECT shape', 'mm AS (SELECT shape').replace('JOIN m USING', 'JOIN mm USING')},
 r AS (SELECT field_id, crop_type, list_avg({_LIST}) AS mean_yield, slope_pct, area_ha, {_score('irrigation_type', E.IRRIGATION)} AS irrigation_efficiency_score,
 {_score('soil_type', E.DRAINAGE)} AS soil_drainage_score FROM f),
 full_ AS (SELECT g.field_id, r.crop_type, {', '.join(f'g.{c}::DOUBLE AS {n}' for n, c in _GEOM.items())}, {', '.join(f'r.{c} AS {n}' for n, c in _ATTR.items())}, {', '.join(f'tf.{c}::DOUBLE AS {n}' for n, c in _TS.items())}
 FROM g LEFT JOIN r USING (field_id) LEFT JOIN tf USING (field_id))"""

register("merge_features", "field_id:i crop_type:s " + " ".join(f"{c}:d" for c in FEATURES), f"{_FULL} --SELECT * FROM full_")(full_matrix)


@register("preproc_matrix", "field_id:i " + " ".join(f"{c}:d5" for c in FEATURES), f"{_FULL}, im AS (SELECT field_id, {', '.join(f'coalesce({c}, median({c}) OVER (), 0) AS {c}' for c in FEATURES)} FROM full_) --SELECT field_id, {', '.join(map(standard_sql, FEATURES))} FROM im")
def preproc_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.prepare(share(full_matrix(spark, sf_dir).drop("crop_type"), "field_id"), FEATURES)  # fitted, and then applied


@register("class_weights", "crop_type:s n:i weight:d", f"{views.P}, c AS (SELECT crop_type, count(*) AS n FROM p GROUP BY crop_type) --SELECT crop_type, n, (SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n) AS weight FROM c")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.class_weights(views.parcels(spark, sf_dir), "crop_type")


@register("min_class_count", "least:i folds:i", f"{views.P} --SELECT min(n) AS least, least(5, min(n)) AS folds FROM (SELECT count(*) AS n FROM p GROUP BY crop_type)")
def min_class_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    least = F.min("n")
    return stats.value_counts(views.parcels(spark, sf_dir), "crop_type").agg(least.alias("least"), F.least(F.lit(5), least).alias("folds"))


@register("stratified_folds", "field_id:i fold:i", f"{views.P} --SELECT field_id, (row_number() OVER (PARTITION BY crop_type ORDER BY md5('42:' || field_id), field_id) - 1) % (SELECT greatest(1, least(5, min(n))) FROM (SELECT count(*) AS n FROM p GROUP BY crop_type)) AS fold FROM p")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.stratified_folds(views.parcels(spark, sf_dir).select("field_id", "crop_type"), "crop_type", "field_id")


_UNIFORM = "('0x' || substr(md5('42:' || p_partkey), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


@register("train_test_split", "field_id:i test:i", f"SELECT p_partkey AS field_id, {_UNIFORM} < 0.2::DOUBLE AS test FROM part")
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.split(views.parcels(spark, sf_dir).select("field_id"), "field_id", 0.2)


@register("uniform_numbers", "field_id:i u:d12", f"SELECT p_partkey AS field_id, {_UNIFORM} AS u FROM part")
def uniform_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.parcels(spark, sf_dir).select("field_id", stats.uniform(F.col("field_id")).alias("u"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "labels")


@register("accuracy", "accuracy:d support:i", "SELECT avg((quality = toxic)::INT) AS accuracy, count(*) AS support FROM labels")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.accuracy(_labels(spark, sf_dir), "quality", "toxic")


@register("confusion_matrix", "label:i prediction:i n:i", "SELECT quality AS label, toxic AS prediction, count(*) AS n FROM labels GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.confusion(_labels(spark, sf_dir), "quality", "toxic")


@register("classification_report", "class:s precision:d recall:d f1:d support:i", """k AS (SELECT quality AS c FROM labels UNION SELECT toxic FROM labels), b AS (SELECT k.c, count(*) FILTER (quality = k.c) AS support, count(*) FILTER (toxic = k.c) AS predicted, count(*) FILTER (quality = k.c AND toxic = k.c) AS hits FROM k, labels GROUP BY k.c),
 s AS (SELECT c::VARCHAR AS class, coalesce(hits / nullif(predicted, 0), 0)::DOUBLE AS precision, coalesce(hits / nullif(support, 0), 0)::DOUBLE AS recall, coalesce(2 * hits / nullif(predicted + support, 0), 0)::DOUBLE AS f1, support FROM b)
--SELECT * FROM s UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM s UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM s""")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.report(_labels(spark, sf_dir), "quality", "toxic")


@register("normalize_sum", "field_id:i share:d12", f"{views.P} --SELECT field_id, greatest(least(area_ha / sum(area_ha) OVER (), 1), 0) AS share FROM p")
def normalize_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.normalise_sum(views.parcels(spark, sf_dir).select("field_id", "area_ha"), "area_ha")


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of fields with a crop, as a table in the shared folder: a fit reads them many times."""
    return _written(full_matrix(spark, sf_dir).where("crop_type IS NOT NULL"))


def _written(rows: DataFrame) -> DataFrame:
    path = views.scratch(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


_FITS: dict[tuple[str, str], tuple] = {}


def _fitted(spark: SparkSession, sf_dir: str) -> tuple:
    """The forest of a folder's tables, fitted once in an application: the queries that want it read one fit. The last folder's is kept."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FITS:
        _FITS.clear()
        _FITS[key] = _fit(spark, sf_dir)
    return _FITS[key]


def _fit(spark: SparkSession, sf_dir: str) -> tuple:
    return forest.fit(_known(spark, sf_dir), FEATURES, "crop_type", keep=_written)


@register("cv_scores", "fold:i support:i accuracy:d mean:d deviation:d skipped:i")
def cv_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.cross_validate(_known(spark, sf_dir), FEATURES, "crop_type", "field_id", keep=_written)


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In sample, as lower-cased labels."""
    return rf_predict(spark, sf_dir).select(F.lower("crop_type").alias("label"), "predicted")


@register("rf_report", "class:s precision:d recall:d f1:d support:i")
def rf_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.report(_predicted(spark, sf_dir), "label", "predicted")


@register("rf_accuracy", "accuracy:d support:i")
def rf_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.accuracy(_predicted(spark, sf_dir), "label", "predicted")


@register("rf_predict", "field_id:i crop_type:s predicted:s probability:d")
def rf_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.predict(*_fitted(spark, sf_dir), ["field_id", "crop_type"])


@register("importances", "feature:s importance:d bar:s")
def importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = forest.importances(spark, _fitted(spark, sf_dir)[0], FEATURES).orderBy(F.desc("importance"), "feature").limit(15)
    return top.withColumn("bar", F.expr("repeat('#', int(importance * 50))"))
