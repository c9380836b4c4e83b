"""Feature collections read in splits."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from parcelforge.functions import crs
from parcelforge.functions import geometry as G
from parcelforge.sources import collection, fields, shapefile


def feature(i, rng):
    name = rng.choice(["plain", 'a "quoted" {brace}', "back\\slash\\", "}{\"", "é}\n", '\\"{', "", None])
    ring = [[float(rng.randrange(100)), float(j)] for j in range(rng.randrange(3, 30))]
    kind = rng.random() < 0.5
    shape = {"type": "Polygon", "coordinates": [ring + ring[:1]]} if kind else {"type": "MultiPolygon", "coordinates": [[ring + ring[:1]]]}
    members = [("type", "Feature"), ("properties", {"field_id": str(i), "field_name": name, "area_ha": i / 2, "nested": {"a": {"b": "}"}}}), ("geometry", shape)]
    rng.shuffle(members)
    return dict(members)


@pytest.mark.parametrize("split", ["1k", "4k", "64m"])
@pytest.mark.parametrize("indent", [None, 2])
def test_collections_are_split_anywhere(spark, tmp_path, split, indent):
    rng = random.Random(7)
    many = [feature(i, rng) for i in range(300)]
    for name, some in {"one": many[:200], "two": many[200:], "none": []}.items():
        whole = {"type": "FeatureCollection", "name": 'odd "{" name', "crs": {"type": "name", "properties": {"name": "x"}}, "features": some}
        (tmp_path / f"{name}.geojson").write_text(json.dumps(whole, indent=indent, ensure_ascii=False))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        df = fields.read_geojson(spark, str(tmp_path), "field_id STRING, field_name STRING, area_ha DOUBLE")
        rows = {int(r["field_id"]): r for r in df.collect()}
        parts = collection._pieces(spark, str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert set(rows) == set(range(300)) and df.count() == 300 and (parts > 20 or split == "64m")
    for i, f in enumerate(many):
        points = f["geometry"]["coordinates"] if f["geometry"]["type"] == "Polygon" else f["geometry"]["coordinates"][0]
        assert rows[i]["field_name"] == f["properties"]["field_name"] and rows[i]["geometry_type"] == f["geometry"]["type"]
        assert [[[c["x"], c["y"]] for c in r] for r in rows[i]["polygons"][0]] == points


def test_written_collections_are_read(spark, tmp_path):
    rows = [(i, None if i == 3 else f"n{i}", [[[(0.0, 0.0), (float(i), 0.5), (1.0, 2.0), (0.0, 0.0)]]]) for i in range(20)]
    df = spark.createDataFrame(rows, "field_id long, field_name string, polygons array<array<array<struct<x:double,y:double>>>>").repartition(3)
    collection.write(df, f"{tmp_path}/out")
    found = fields.read_geojson(spark, f"{tmp_path}/out", "field_id LONG, field_name STRING").drop("geometry_type")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, df.collect()))
    for f in (tmp_path / "out").glob("part-*"):
        assert json.loads(f.read_text())["type"] == "FeatureCollection"


def shp(records):
    """A file of polygons; each a list of rings, or None."""
    body = b""
    for i, rings in enumerate(records, 1):
        if rings is None:
            content = struct.pack("<i", 0)
        else:
            points = [p for r in rings for p in r]
            starts = [sum(map(len, rings[:k])) for k in range(len(rings))]
            content = struct.pack("<i4d2i", 5, 0, 0, 0, 0, len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        body += struct.pack(">2i", i, len(content) // 2) + content
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8) + body


def dbf(columns, rows):
    size = 1 + sum(w for _, _, w in columns)
    head = struct.pack("<4BIHH20x", 3, 24, 1, 1, len(rows), 33 + 32 * len(columns), size)
    head += b"".join(n.encode().ljust(11, b"\0") + k.encode() + bytes(4) + bytes([w]) + bytes(15) for n, k, w in columns) + b"\r"
    return head + b"".join(flag + b"".join(v.encode().ljust(w)[:w] for v, (_, _, w) in zip(values, columns)) for flag, values in rows) + b"\x1a"


def test_shapefiles(spark, tmp_path):
    box = lambda a, b, c, d: [(float(x), float(y)) for x, y in [(a, b), (a, d), (c, d), (c, b), (a, b)]]  # noqa: E731  clockwise
    one = [[box(0, 0, 10, 10), box(2, 2, 4, 4)[::-1], box(20, 0, 30, 10)], None, [box(3, 3, 5, 5)], [box(0, 0, 1, 1)], [box(7, 7, 8, 8)[::-1]]]
    columns = [("field_id", "C", 6), ("area_ha", "N", 8), ("irrigated", "L", 1), ("planted", "D", 8)]
    live = b" "
    rows = [(live, ("a", "1.5", "T", "20240131")), (live, ("b", "", "?", "")), (live, ("é", "********", "F", "")), (b"*", ("gone", "9", "T", "")), (live, ("e", "-2", "N", ""))]
    for name in ("x/one", "two"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / f"{name}.shp").write_bytes(shp(one))
        (tmp_path / f"{name}.dbf").write_bytes(dbf(columns, rows))
    df = shapefile.read(spark, str(tmp_path), "field_id STRING, area_ha DOUBLE, irrigated BOOLEAN, planted DATE")
    assert df.schema["polygons"].metadata == {"srid": 4326} and df.count() == 8
    found = {r["field_id"]: r for r in df.withColumn("a", G.area(F.col("polygons"))).dropDuplicates(["field_id"]).collect()}
    assert set(found) == {"a", "b", "é", "e"} and (found["a"]["area_ha"], found["a"]["irrigated"], str(found["a"]["planted"])) == (1.5, True, "2024-01-31")
    assert len(found["a"]["polygons"]) == 2 and sorted(len(p) for p in found["a"]["polygons"]) == [1, 2] and found["a"]["a"] == 196
    assert found["b"]["polygons"] is None and found["b"]["area_ha"] is None and found["b"]["irrigated"] is None and found["é"]["area_ha"] is None
    assert found["e"]["a"] == 1 and found["e"]["irrigated"] is False


def test_systems_are_carried_and_checked(spark):
    rows = spark.createDataFrame([(1, [[[(-115.5, 33.0), (-115.4, 33.0), (-115.4, 33.1), (-115.5, 33.0)]]])], f"k int, polygons {G.POLYGONS}")
    zone = crs.planar(rows, 11)  # no system is named: longitude and latitude are assigned
    assert zone.schema["polygons"].metadata == {"srid": 32611} and crs.planar(zone, 11).first() == zone.first()
    there = crs.planar(crs.planar(rows, 12), 11).first()["polygons"][0][0]
    for p, q in zip(there, zone.first()["polygons"][0][0]):
        assert (p["x"], p["y"]) == pytest.approx((q["x"], q["y"]), abs=1e-4)
    with pytest.raises(ValueError, match="3857"):
        crs.planar(rows.select("k", F.col("polygons").alias("polygons", metadata={"srid": 3857})))


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    path = f"{tmp_path}/scores"
    old = spark.createDataFrame([(2023, i, 1.0) for i in range(50)] + [(2024, i, 1.0) for i in range(50)], "year int, id int, score double")
    fields.write_table(old, path, "year")
    new = spark.createDataFrame([(2024, i, 2.0) for i in range(30)] + [(2025, 1, 2.0)], "year int, id int, score double")
    fails = new.repartition(4).withColumn("score", F.when(F.col("id") == 29, F.raise_error(F.lit("half-way")).cast("double")).otherwise(F.col("score")))
    with pytest.raises(Exception, match="half-way"):
        fields.write_table(fails, path, "year")
    sums = lambda: {r["year"]: (r["n"], r["s"]) for r in spark.read.parquet(path).groupBy("year").agg(F.count("*").alias("n"), F.sum("score").alias("s")).collect()}
    assert sums() == {2023: (50, 50.0), 2024: (50, 50.0)}
    for _ in range(2):  # repeatable
        fields.write_table(new, path, "year")
        assert sums() == {2023: (50, 50.0), 2024: (30, 60.0), 2025: (1, 2.0)}
