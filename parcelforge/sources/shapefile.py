"""Shapefiles: geometries (``.shp``) and attributes (``.dbf``) of any number of files, joined by their record numbers.

The format holds no file over 2 GB, so a file is one task's work; every file of a folder is another one.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from parcelforge.functions.geometry import POLYGONS

#: The format's codes of polygons, without and with heights or measures.
POLYGON_TYPES = (5, 15, 25)
ROWS = 1000


def _signed(ring: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def _holds(ring: list[tuple[float, float]], p: tuple[float, float]) -> bool:
    hits = ((a[1] > p[1]) != (b[1] > p[1]) and p[0] < a[0] + (p[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in zip(ring, ring[1:]))
    return sum(hits) % 2 == 1


def grouped(rings: list[list[tuple[float, float]]]) -> list[list[list[tuple[float, float]]]]:
    """Polygons from rings: clockwise ones are exteriors, the others holes of the smallest exterior that holds them, or, if none does, exteriors, too."""
    outer = sorted((r for r in rings if _signed(r) <= 0), key=lambda r: -_signed(r))
    out = [[r] for r in outer]
    for hole in (r for r in rings if _signed(r) > 0):
        of = next((p for p in out if _holds(p[0], hole[0])), None)
        out.append([hole]) if of is None else of.append(hole)
    return out


def shapes(data: bytes) -> Iterator[tuple[int, list | None]]:
    """Record numbers and polygons; null for records without a shape."""
    at = 100
    while at + 8 <= len(data):
        number, words = struct.unpack(">ii", data[at : at + 8])
        body = data[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        kind = struct.unpack("<i", body[:4])[0]
        if kind == 0:
            yield number, None
            continue
        if kind not in POLYGON_TYPES:
            raise ValueError(f"shapes of type {kind} are no polygons")
        parts, points = struct.unpack("<ii", body[36:44])
        starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
        flat = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
        pairs = list(zip(flat[::2], flat[1::2]))
        yield number, grouped([pairs[a:b] for a, b in zip(starts, starts[1:])])


def _value(kind: str, raw: bytes, encoding: str) -> str | None:
    text = raw.decode(encoding, "replace").strip().strip("\0")
    if kind == "D" and re.fullmatch(r"\d{8}", text):
        return f"{text[:4]}-{text[4:6]}-{text[6:]}"
    if kind == "L":
        return {"T": "true", "Y": "true", "F": "false", "N": "false"}.get(text.upper())
    return None if not text or (kind in "NF" and set(text) == {"*"}) else text


def attributes(data: bytes, encoding: str) -> Iterator[tuple[int, dict[str, str]]]:
    """Record numbers and attributes as texts, without those that are null; deleted records are left out."""
    count, head, size = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode(encoding), chr(data[at + 11]), data[at + 16]))
        at += 32
    for i in range(count):
        row = data[head + i * size : head + (i + 1) * size]
        if row[:1] == b"*":
            continue
        values, begin = {}, 1
        for name, kind, width in fields:
            values[name] = _value(kind, row[begin : begin + width], encoding)
            begin += width
        yield i + 1, {k: v for k, v in values.items() if v is not None}


def _parsed(spark: SparkSession, path: str, ending: str, parse, schema: str) -> DataFrame:
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch["name"].to_pylist(), batch["content"].to_pylist()):
                rows: list[dict] = []
                for number, value in parse(data):
                    rows.append({"name": name, "number": number, "value": value})
                    if len(rows) == ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema=kind)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ending}").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_replace("path", r"\.[^./]*$", "").alias("name"), "content").mapInArrow(run, schema)


def read(spark: SparkSession, path: str, properties: str, srid: int = 4326, encoding: str = "utf-8") -> DataFrame:
    """One row a record that has attributes: ``properties`` (names and types as DDL, by the attributes' names) and ``polygons``, whose metadata holds the system."""

    def points(data: bytes) -> Iterator[tuple[int, list | None]]:
        for number, polygons in shapes(data):
            yield number, polygons and [[[{"x": x, "y": y} for x, y in r] for r in p] for p in polygons]

    drawn = _parsed(spark, path, "shp", points, f"name string, number long, value {POLYGONS}")
    told = _parsed(spark, path, "dbf", lambda data: ((n, list(v.items())) for n, v in attributes(data, encoding)), "name string, number long, value map<string, string>")
    columns = [F.col("told.value").getItem(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(properties)]
    both = told.alias("told").join(drawn.alias("drawn"), ["name", "number"], "left")
    return both.select(*columns, F.col("drawn.value").alias("polygons", metadata={"srid": srid}))
