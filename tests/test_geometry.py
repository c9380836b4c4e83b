import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelforge.functions import crs
from parcelforge.functions import geometry as G
from parcelforge.operators import spatial as S
from parcelforge.plans.geometry_queries import geometry_features

BOX = [(0, 0), (4, 0), (4, 3), (0, 3)]
ELL = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)]
BIG, HOLE = [(0, 0), (10, 0), (10, 10), (0, 10)], [(4, 4), (6, 4), (6, 6), (4, 6)]
FLAT = [(0, 0), (4, 0), (4, 0), (0, 0)]


def close(ring):
    return [*[(float(x), float(y)) for x, y in ring], (float(ring[0][0]), float(ring[0][1]))]


def shift(ring, dx, dy=0.0):
    return [(x + dx, y + dy) for x, y in ring]


def table(spark, shapes):
    return spark.createDataFrame([(k, crop, [[close(r) for r in p] for p in polygons]) for k, crop, polygons in shapes], f"field_id long, crop_type string, polygons {G.POLYGONS}")


@pytest.fixture(scope="module")
def measures(spark):
    shapes = [(1, "a", [[BOX]]), (2, "a", [[ELL]]), (3, "a", [[BIG, HOLE]]), (4, "a", [[BOX], [shift(BOX, 10)]]), (5, "a", [[FLAT]]), (6, "a", [[BOX[::-1]]])]
    return {r["field_id"]: r for r in geometry_features(table(spark, shapes), ["field_id"]).collect()}


def test_shapes(measures):
    box, ell, holed, multi, flat, back = (measures[i] for i in range(1, 7))
    assert (box["area_ha"] * 1e4, box["perimeter_km"] * 1e3, box["bbox_fill_ratio"], box["n_vertices"]) == pytest.approx((12, 14, 1, 4))
    assert (box["elongation"], box["centroid_x"], box["centroid_y"]) == pytest.approx((4 / 3, 2, 1.5))
    assert (ell["area_ha"] * 1e4, ell["perimeter_km"] * 1e3, ell["n_vertices"]) == pytest.approx((7, 16, 6))
    assert (ell["convex_hull_area_ha"] * 1e4, ell["convex_hull_perimeter_km"] * 1e3, ell["solidity"], ell["convexity"]) == pytest.approx((11.5, 14.242641, 0.608696, 0.890165), abs=1e-6)
    assert (holed["area_ha"] * 1e4, holed["perimeter_km"] * 1e3, holed["n_vertices"], holed["centroid_x"]) == pytest.approx((96, 48, 4, 5))
    assert multi["n_vertices"] == 8 and multi["area_ha"] * 1e4 == pytest.approx(24) and multi["centroid_x"] == pytest.approx(7)
    assert flat["elongation"] == math.inf and (flat["bbox_fill_ratio"], flat["compactness"], flat["solidity"], flat["edge_density"]) == (0, 0, 0, 0)
    assert back["area_ha"] == box["area_ha"] and back["centroid_x"] == pytest.approx(2)


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 5), st.booleans(), st.floats(-1e6, 1e6), st.floats(0, 7e6))
def test_area_does_not_depend_on_start_direction_place(spark, start, back, dx, dy):
    ring = ELL[start:] + ELL[:start]
    ring = shift(ring[::-1] if back else ring, dx, dy)
    r = geometry_features(table(spark, [(1, "a", [[ring]])]), ["field_id"]).first()
    assert r["area_ha"] * 1e4 == pytest.approx(7, abs=1e-5) and 0 < r["compactness"] <= 1 and r["convex_hull_area_ha"] >= r["area_ha"]


def test_hull_of_many_corners(spark):
    """Ten thousand corners on a circle, and as many inside; points on lines, and few points."""
    import random

    rng = random.Random(6)
    circle = [(math.cos(2 * math.pi * i / 10_000) * 1000 + 5e5, math.sin(2 * math.pi * i / 10_000) * 1000 + 4e6) for i in range(10_000)]
    inside = [(5e5 + rng.uniform(-600, 600), 4e6 + rng.uniform(-600, 600)) for _ in range(10_000)]
    mixed = circle + inside
    rng.shuffle(mixed)
    line, dot = [(float(i), 2.0 * i) for i in range(50)], [(1.0, 2.0)] * 5
    rows = spark.createDataFrame([(0, mixed), (1, line), (2, dot), (3, [])], "k int, p array<struct<x:double,y:double>>").select("k", G.hull_edges(F.col("p")).alias("h"))
    found = {r["k"]: r for r in rows.select("k", F.size("h").alias("n"), F.when(F.size("h") > 0, G.edges_area(F.col("h"))).alias("a"), G.edges_length(F.col("h")).alias("l")).collect()}
    assert found[0]["n"] == 10_000 and found[0]["a"] == pytest.approx(10_000 / 2 * math.sin(2 * math.pi / 10_000) * 1e6, rel=1e-9)
    assert (found[1]["n"], found[1]["a"]) == (2, pytest.approx(0)) and found[1]["l"] == pytest.approx(2 * 49 * 5**0.5)
    assert found[2]["n"] == found[3]["n"] == 0


def test_utm(spark):
    x, y = crs.to_utm(F.lit(-115.52), F.lit(33.05))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert (r["x"], r["y"]) == pytest.approx((638183.67499, 3657803.42686), abs=1e-4)
    lon, lat = crs.from_utm(F.lit(r["x"]), F.lit(r["y"]))
    assert tuple(spark.range(1).select(lon, lat).first()) == pytest.approx((-115.52, 33.05), abs=1e-10)


def test_neighbourhood(spark):
    """Crops a, a, b within 500 m of the first field, one of them exactly 500 m away; and one far off."""
    unit = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
    m = S.measured(table(spark, [(1, "x", [[unit]]), (2, "a", [[shift(unit, 500)]]), (3, "b", [[shift(unit, 0, 300)]]), (4, "a", [[shift(unit, -100)]]), (5, "z", [[shift(unit, 9000)]])]), "field_id", ["crop_type"])
    rows = {r["id"]: r for r in S.neighbour_stats(m).collect()}
    assert (rows[1]["n_neighbors_500m"], rows[1]["dominant_neighbor_crop"], rows[1]["fragmentation_index"]) == (3, "a", 0.25)
    assert rows[1]["local_crop_diversity_H"] == pytest.approx(0.918296, abs=1e-6)
    assert (rows[5]["n_neighbors_500m"], rows[5]["dominant_neighbor_crop"], rows[5]["local_crop_diversity_H"]) == (0, "isolated", 0.0)
    near = {r["id"]: r["dist_to_nearest_m"] for r in S.nearest(m).collect()}
    assert near[1] == pytest.approx(99) and near[5] == 0.0


def test_nearest_among_large_fields(spark):
    """Fields of several kilometres, beside each other, in each other's reach, and far off."""
    side = [(0, 0), (4000, 0), (4000, 4000), (0, 4000)]
    m = S.measured(table(spark, [(1, "a", [[side]]), (2, "a", [[shift(side, 4000)]]), (3, "a", [[shift(side, 0, 4900)]]), (4, "a", [[shift(BOX, 2100, 2000)]]), (5, "a", [[shift(side, 90000)]])]), "field_id", ["crop_type"])
    assert {r["id"]: r["dist_to_nearest_m"] for r in S.nearest(m).collect()} == {1: pytest.approx(100), 2: pytest.approx(2000), 3: pytest.approx(2900), 4: 0.0, 5: 0.0}


def test_adjacency(spark):
    shapes = [(1, "a", [[BIG]]), (2, "a", [[shift(BIG, 10)]]), (3, "b", [[shift(BIG, 20, 10)]]), (4, "b", [[shift(BIG, -10.4)]]), (5, "b", [[shift(BIG, 0, -10.6)]])]
    m = S.measured(table(spark, shapes), "field_id", ["crop_type"])
    edges = {(r["src"], r["dst"]): r["shared_length_m"] for r in S.adjacency(m).collect()}
    assert edges == {(1, 2): pytest.approx(10), (2, 3): pytest.approx(0), (1, 4): pytest.approx(10)}  # shared edge, corner, gap of 0.4 m; not 0.6 m
    rows = {r["id"]: r for r in S.topology(m, S.symmetric(S.adjacency(m))).collect()}
    assert (rows[1]["n_adjacent_fields"], rows[1]["shared_crop_count"], rows[1]["different_crop_count"], rows[5]["is_isolated"]) == (2, 1, 1, 1)


def test_adjacency_of_fields_inside_each_other(spark):
    inner = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d)]
    big, hole = inner(0, 0, 100, 100), inner(60, 60, 90, 90)
    shapes = [
        (1, "a", [[big, hole]]), (2, "a", [[inner(40, 40, 55, 55)]]), (3, "b", [[inner(70, 70, 80, 80)]]), (4, "b", [[inner(70, 90, 140, 110)]]), (5, "b", [[inner(200, 0, 210, 10)], [inner(10, 10, 20, 20)]]),
        (6, "a", [[inner(60, 60, 65, 65)]]), (7, "c", [[inner(300, 300, 310, 310)]]), (8, "c", [[inner(300, 300, 310, 310)]]), (9, "c", [[inner(310, 300, 320, 310)]]),
    ]
    m = S.measured(table(spark, shapes), "field_id", ["crop_type"])
    found = {(r["src"], r["dst"]): (r["overlaps"], r["shared_length_m"]) for r in S.adjacency(m, overlaps=True).collect()}
    length = pytest.approx
    assert found == {
        (1, 2): (True, 0), (1, 4): (True, length(20)), (1, 5): (True, 0), (1, 6): (False, length(10)),  # inside; overlapping, along the hole; one of two inside; in a corner of the hole
        (7, 8): (True, length(40)), (7, 9): (False, length(10)), (8, 9): (False, length(10)),  # equal; beside
    }


def test_grid_join_is_the_theta_join(spark):
    import random

    rng = random.Random(4)
    shapes = [(i, "a", [[shift([(0, 0), (rng.uniform(1, 90), 0), (5, rng.uniform(1, 90))], rng.uniform(0, 2000), rng.uniform(0, 2000))]]) for i in range(150)]
    m = S.measured(table(spark, shapes), "field_id", ["crop_type"]).cache()
    box = {r["id"]: r["box"] for r in m.collect()}
    reach = 100.0
    want = {(i, j) for i, a in box.items() for j, b in box.items() if i != j and a.minx - reach <= b.maxx and a.maxx + reach >= b.minx and a.miny - reach <= b.maxy and a.maxy + reach >= b.miny}
    for size in (30.0, 100.0, 250.0):  # smaller than most boxes, too
        found = S.pairs(m, m, reach, size)
        got = [(r[0], r[1]) for r in found.select("a.id", "b.id").collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()
