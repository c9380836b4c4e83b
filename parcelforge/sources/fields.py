"""Sources and sinks of field tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collection

_POINTS = "ARRAY<ARRAY<ARRAY<DOUBLE>>>"
#: The schema is declared: inference would read the file twice and sort the names.
PROPERTIES = (
    "field_id STRING, field_name STRING, crop_type STRING, area_ha DOUBLE, soil_type STRING, yield_2021 DOUBLE, yield_2022 DOUBLE, "
    "yield_2023 DOUBLE, yield_2024 DOUBLE, yield_2025 DOUBLE, irrigation_type STRING, slope_pct DOUBLE"
)
SRID = 4326


def read_geojson(spark: SparkSession, path: str, properties: str = PROPERTIES, srid: int = SRID, lines: bool = False) -> DataFrame:
    """One row a feature: the properties in the order of their schema, ``geometry_type`` and ``polygons``.

    Polygon and MultiPolygon are both read as arrays of polygons. The column's metadata holds the coordinate system, ``srid``, which is
    assigned as the files name none. Feature collections are split anywhere (see ``collection``); ``lines`` reads a feature a line.
    """
    feature = f"STRUCT<properties: STRUCT<{_colons(properties)}>, geometry: STRUCT<type: STRING, coordinates: STRING>>"
    if lines:
        rows = spark.read.schema(feature.removeprefix("STRUCT<").removesuffix(">").replace("properties: ", "properties ", 1).replace(", geometry: ", ", geometry ", 1)).json(path)
        rows = rows.select(F.struct("properties", "geometry").alias("f"))
    else:
        typed = feature.replace("STRUCT<properties", "STRUCT<type: STRING, properties", 1)
        rows = collection.features(spark, path).select(F.from_json("feature", typed).alias("f")).where("f.type = 'Feature'")
    text, kind = F.col("f.geometry.coordinates"), F.col("f.geometry.type")
    one, many = F.from_json(text, _POINTS), F.from_json(text, f"ARRAY<{_POINTS}>")
    points = F.when(kind == "MultiPolygon", many).when(kind == "Polygon", F.array(one))
    polygons = F.transform(points, lambda p: F.transform(p, lambda r: F.transform(r, lambda c: F.struct(c[0].alias("x"), c[1].alias("y")))))
    return rows.select("f.properties.*", kind.alias("geometry_type"), polygons.alias("polygons", metadata={"srid": srid}))


def _colons(ddl: str) -> str:
    return re.sub(r"(\w+) (\w+)(,|$)", r"\1: \2\3", ddl)


def attributes(fields: DataFrame) -> DataFrame:
    """Without the geometry, which the scan then does not read from columnar files."""
    return fields.drop("polygons", "geometry_type")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers are null from here on: averages and maxima do not skip NaN."""
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def yield_columns(df: DataFrame) -> list[str]:
    """Columns ``yield_<year>`` in the order of the years."""
    return sorted(c for c in df.columns if re.fullmatch(r"yield_\d{4}", c))


def existing(df: DataFrame, names: list[str]) -> list[str]:
    return [c for c in names if c in df.columns]


def schema_report(df: DataFrame) -> DataFrame:
    """Column names and types, and the number of rows."""
    n = df.count()
    return df.sparkSession.createDataFrame([(c, t, n) for c, t in df.dtypes], "column string, type string, rows long")


def show(df: DataFrame, rows: int = 20) -> None:
    """The first rows, whole, on the console."""
    df.show(rows, truncate=False)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """With a header; nulls are empty, lists are written as ``[a, b]``."""
    flat = df.select(*(F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]")).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes))
    (flat.coalesce(1) if single_file else flat).write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, by: str) -> None:
    """A Parquet table with a folder for each value of ``by``: the values that ``df`` has are replaced, all others stay.

    Spark stages the new folders and moves them into place when all tasks are done: a write that fails leaves the table as it was, and one
    that is repeated changes nothing.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
