"""From a file of fields to feature tables as files: GeoJSON in longitude and latitude, projected, measured, and written as CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.functions import crs, rounding
from parcelforge.operators import spatial as S
from parcelforge.operators import timeseries as T
from parcelforge.sources import fields as source

from .attribute_queries import attribute_features
from .geometry_queries import geometry_features
from .model_queries import combined
from .spatial_queries import context

GEOMETRY = (
    "area_ha:4 perimeter_km:4 compactness:6 elongation:4 convex_hull_area_ha:4 solidity:6 convexity:6 n_vertices bbox_area_ha:4 bbox_fill_ratio:6 bbox_width_m:2 bbox_height_m:2 "
    "centroid_lon:6 centroid_lat:6"
)
CONTEXT = "dist_to_nearest_m:2 n_neighbors_500m neighbor_mean_area_ha:4s neighbor_sum_area_ha:4s dominant_neighbor_crop edge_density:6 fragmentation_index:6 local_crop_diversity_H:6"
TOPOLOGY = "n_adjacent_fields total_shared_length_m:2 mean_shared_length_m:2s max_shared_length_m:2 is_isolated adjacency_degree shared_crop_count different_crop_count"
SERIES = (
    "mean_yield:4 std_yield:4 cv_yield:4 trend_slope:6 trend_r2:6 trend_p_value:6 trend_significant min_yield:4 max_yield:4 yield_range:4 best_year worst_year max_abs_z:4 n_anomaly_years anomaly_flag "
    "anomaly_years last_year_trend:4 recent_vs_historical:4 mean_yoy_change:4 max_yoy_increase:4 max_yoy_decrease:4 insufficient_data"
)


def _rounded(df: DataFrame, columns: str, *keep: str) -> DataFrame:
    """The columns in their order, with their number of digits: rounded exactly, or, with an ``s``, scaled."""

    def column(name: str, digits: str) -> Column:
        if not digits:
            return F.col(name)
        rule = rounding.scaled if digits.endswith("s") else rounding.exact
        return rule(F.col(name).cast("double"), int(digits.removesuffix("s"))).alias(name)

    return df.select(*keep, *(column(c, digits) for c, _, digits in (x.partition(":") for x in columns.split())))


def feature_tables(fields: DataFrame, zone: int = 11) -> dict[str, DataFrame]:
    """``fields`` as ``read_geojson`` gives them; a table each of geometry, attributes, context, topology, yearly series, and the combined matrix."""
    fields = source.nan_to_null(fields)
    planar = crs.planar(fields, zone)
    shapes = geometry_features(planar, ["field_id"])
    lon, lat = crs.from_utm(F.col("centroid_x"), F.col("centroid_y"), zone)
    measured = S.measured(planar, "field_id", ["crop_type"])
    yields = source.yield_columns(fields)
    stated = planar.withColumnRenamed("area_ha", "stated_ha")
    named = lambda df: df.withColumnRenamed("id", "field_id")
    return {
        "geometry_features": _rounded(shapes.withColumns({"centroid_lon": lon, "centroid_lat": lat}), GEOMETRY, "field_id"),
        "attribute_features": attribute_features(source.attributes(fields), source.attributes(fields), yields),
        "spatial_context_features": _rounded(named(context(measured)), CONTEXT, "field_id"),
        "topology_features": _rounded(named(S.topology(measured, S.symmetric(S.adjacency(measured)))), TOPOLOGY, "field_id"),
        "full_feature_matrix": combined(geometry_features(stated, ["field_id", "crop_type", "soil_type", "irrigation_type", "slope_pct", "stated_ha", *yields]), yields),
        "time_series_features": _rounded(T.features(source.attributes(fields), yields, ["field_id", "crop_type"]), SERIES, "field_id", "crop_type"),
    }


def export(spark: SparkSession, geojson: str, out: str, zone: int = 11, lines: bool = False, single_file: bool = False) -> None:
    """Each feature table of a GeoJSON file as a folder of CSV below ``out``."""
    for name, table in feature_tables(source.read_geojson(spark, geojson, lines=lines), zone).items():
        source.write_csv(table, f"{out}/{name}", single_file)
