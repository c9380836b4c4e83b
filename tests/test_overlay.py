"""What geometries have in common, buffers, and the grid of several levels, against plain computations."""

import math
import random

import pytest
from pyspark.sql import functions as F
from test_geometry import close, shift

from parcelforge.functions import between as B
from parcelforge.functions import geometry as G
from parcelforge.functions import overlay as O
from parcelforge.operators import spatial as S
from parcelforge.plans import registry


def fields(spark, shapes):
    rows = [(k, "a", [[close(r) for r in p] for p in polygons]) for k, polygons in shapes]
    return S.measured(spark.createDataFrame(rows, f"field_id long, crop_type string, polygons {G.POLYGONS}"), "field_id", ["crop_type"])


def box(a, b, c, d):
    return [(a, b), (c, b), (c, d), (a, d)]


def edges_of(spark, *shapes):
    return {(r["src"], r["dst"]): (r["overlaps"], pytest.approx(r["shared_length_m"], abs=1e-6)) for r in S.adjacency(fields(spark, list(enumerate(shapes))), overlaps=True).collect()}


def test_overlaps_with_sides_in_common(spark):
    assert edges_of(spark, [[box(0, 0, 10, 10)]], [[box(0, 5, 10, 15)]]) == {(0, 1): (True, 10)}  # five metres on either side
    assert edges_of(spark, [[box(0, 0, 10, 10)]], [[box(0, 2, 10, 8)]]) == {(0, 1): (True, 12)}
    assert edges_of(spark, [[box(0, 0, 10, 10)]], [[box(10, 0, 20, 10)]]) == {(0, 1): (False, 10)}
    assert edges_of(spark, [[box(0, 0, 10, 10)]], [[box(0, 0, 10, 10)[::-1]]]) == {(0, 1): (True, 40)}
    assert edges_of(spark, [[box(0, 0, 90, 90), box(30, 30, 60, 60)]], [[box(40, 40, 50, 50)]]) == {}


def test_shared_length_does_not_depend_on_order(spark):
    rise = math.tan(math.radians(0.1))
    long, short = [[[(-500, -500 * rise), (510, 510 * rise), (510, 100), (-500, 100)]]], [[box(0, -10.1, 10, -0.1)]]
    assert edges_of(spark, long, short) == edges_of(spark, short, long) != {}
    (_, length), = edges_of(spark, long, short).values()
    assert length == 10.0 or 9.99 < length.expected < 10.01


def clipped(p, q):
    """A convex polygon cut by the sides of another."""
    for (ax, ay), (bx, by) in zip(q, [*q[1:], q[0]]) if p else ():
        side = lambda c: (bx - ax) * (c[1] - ay) - (by - ay) * (c[0] - ax)  # noqa: B023, E731
        out = []
        for c, d in zip(p, [*p[1:], *p[:1]]):
            if side(c) >= 0:
                out.append(c)
            if side(c) * side(d) < 0:
                t = side(c) / (side(c) - side(d))
                out.append((c[0] + t * (d[0] - c[0]), c[1] + t * (d[1] - c[1])))
        p = out
    return p


def area(p):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, [*p[1:], p[0]])) / 2 if p else 0.0


def around(p):
    return sum(math.dist(a, b) for a, b in zip(p, [*p[1:], p[0]]))


def test_convex_intersections_are_clipped_polygons(spark):
    rng = random.Random(8)

    def convex():
        x, y, r, n = rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(5, 40), rng.randrange(3, 9)
        at = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
        return [(x + r * math.cos(t), y + r * math.sin(t)) for t in at]

    shapes = [convex() for _ in range(40)]
    turned = [s if rng.random() < 0.5 else s[::-1] for s in shapes]
    want = {}
    for i, p in enumerate(shapes):
        for j in range(i + 1, len(shapes)):
            c = clipped(p, shapes[j])
            if area(c) > 1e-3:
                want[i, j] = (pytest.approx(area(c), abs=1e-5), pytest.approx(around(c), abs=1e-5))
    rows = S.intersections(fields(spark, [(i, [[shift(s, 300000, 4e6)]]) for i, s in enumerate(turned)])).where("area_m2 > 1e-3").collect()
    assert {(r["src"], r["dst"]): (r["area_m2"], r["perimeter_m"]) for r in rows} == want and len(want) > 100


def test_intersections_by_type(spark):
    shapes = [
        [[box(0, 0, 10, 10)]], [[box(10, 2, 20, 8)]], [[box(-5, -5, 0, 0)]], [[box(5, 5, 15, 15), box(7, 7, 9, 9)]],
        [[box(100, 0, 110, 10)], [box(112, 0, 120, 10)]], [[[(109, -5), (121, -5), (121, 0), (109, 0)]]],
    ]
    rows = {(r["src"], r["dst"]): r for r in S.intersections(fields(spark, list(enumerate(shapes)))).collect()}
    kinds = {k: (round(r["area_m2"], 6), round(r["line_m"], 6), round(r["length_m"], 6)) for k, r in rows.items()}
    assert kinds[0, 1] == (0, 6, 6) and kinds[0, 2] == (0, 0, 0.01) and kinds[0, 3] == (21, 0, 28)  # a line, a point, an area with a hole
    assert kinds[1, 3] == (15, 0, 16) and kinds[4, 5] == (0, 9, 9)  # two stretches of one side, 1 m and 8 m
    assert (2, 3) not in kinds


def test_buffers(spark):
    r = 2.0
    disc = r * r * 32 * math.sin(math.pi / 32)  # of 64 corners
    ell = [(0, 0), (40, 0), (40, 10), (10, 10), (10, 40), (0, 40)]
    shapes = [box(0, 0, 40, 30), ell, ell[::-1]]
    rows = [(k, [[close(s)]]) for k, s in enumerate(shapes)] + [(3, [[close(box(0, 0, 40, 40)), close(box(10, 10, 30, 30))]]), (4, [[close(box(0, 0, 40, 40)), close(box(10, 10, 13, 30))]]), (5, [[close([(0, 0), (40, 0), (40, 0), (0, 0)])]])]
    found = {x["k"]: x for x in spark.createDataFrame(rows, f"k int, p {G.POLYGONS}").select("k", O.buffer(F.col("p"), r).alias("b")).select("k", "b", G.area(F.col("b")).alias("a"), G.length(F.col("b")).alias("l")).collect()}
    assert found[0]["a"] == pytest.approx(1200 + 140 * r + disc) and len(found[0]["b"][0][0]) == 4 * 17 + 1
    inner = 700 + 160 * r + disc * 5 / 4 - r * r  # five corners turn left, and one cuts a square twice
    assert found[1]["a"] == pytest.approx(inner) and found[2]["a"] == pytest.approx(inner)
    assert found[3]["a"] == pytest.approx(1600 + 160 * r + disc - 16 * 16) and len(found[4]["b"][0]) == 1  # a hole that is left, and one that is too narrow
    assert found[5]["a"] == pytest.approx(40 * 2 * r + disc)  # a line


def test_buffered_adjacency(spark):
    """Along a straight side about twice its length; across a gap of 0.4 m, and not across 0.6 m; a corner."""
    shapes = [(1, [[box(0, 0, 10, 10)]]), (2, [[box(10, 0, 20, 10)]]), (3, [[box(20, 10, 30, 20)]]), (4, [[box(-10.4, 0, -0.4, 10)]]), (5, [[box(0, -10.6, 10, -0.6)]])]
    rows = {(r["src"], r["dst"]): r["shared_length_m"] for r in S.buffered_adjacency(fields(spark, shapes)).collect()}
    assert set(rows) == {(1, 2), (2, 3), (1, 4)} and 20 < rows[1, 2] < 22 and 19.9 < rows[1, 4] < 21 and 0 < rows[2, 3] < 3


def test_buffers_are_not_shuffled(spark):
    """A buffer has many times the corners of its field: the grid join carries the field."""
    shapes = [(1, [[box(0, 0, 10, 10)]]), (2, [[box(10, 0, 20, 10)]])]
    plan = S.buffered_adjacency(fields(spark, shapes))._jdf.queryExecution().optimizedPlan().toString()
    assert "polygons" in plan and "edges" not in plan and "atan2" not in plan.lower()


@pytest.mark.parametrize("name", ["adjacency_buffered", "adjacency_buffered_irregular"])
def test_buffered_queries_make_only_what_they_need(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "polygons" in plan and not any(c in plan for c in ("edges", "rings", "center", "geometry_ha"))


def test_discs_of_a_batch_are_buffers(spark):
    """What a batch of pairs makes of polygons is what the expression makes: corners inwards, holes wide and narrow, lines, repeated corners, spikes, several polygons, none."""
    r, ell, rng = 2.0, [(0, 0), (40, 0), (40, 10), (10, 10), (10, 40), (0, 40)], random.Random(5)
    shapes = [
        [[box(0, 0, 40, 30)]], [[ell]], [[ell[::-1]]], [[box(0, 0, 40, 40), box(10, 10, 30, 30)]], [[box(0, 0, 40, 40)[::-1], box(10, 10, 13, 30), box(20, 10, 30, 30)]], [[[(0, 0), (40, 0), (40, 0), (0, 0)]]],
        [[box(0, 0, 9, 9)], [box(20, 0, 40, 40), box(25, 5, 35, 35)]], [], [[[(0, 0), (20, 0), (40, 0), (40, 30), (39.5, 0.1), (0, 30)]]], [[[(3, 3)]]],
        *([[[(30 * math.cos(t) * rng.uniform(0.2, 1), 30 * math.sin(t)) for t in sorted(rng.uniform(0, 6.28) for _ in range(9))]]] for _ in range(20)),
    ]
    rows = [(k, [[close(c) for c in p] for p in s]) for k, s in enumerate(shapes)]
    table = spark.createDataFrame(rows, f"k int, p {G.POLYGONS}").orderBy("k")
    rings = F.flatten(O.buffer(F.col("p"), r))
    segments = F.filter(F.flatten(F.transform(rings, G.segments)), lambda s: s.a != s.b)
    want = [[(s.a.x, s.a.y, s.b.x, s.b.y) for s in x["e"]] for x in table.select("k", segments.alias("e")).orderBy("k").collect()]
    column = table.toArrow().column("p").combine_chunks()
    many, edges = B._Discs(r, 16).take(column)
    assert many.tolist() == [len(w) for w in want] and len(want[0]) == 4 * 17 and not want[7] and not want[9]
    assert edges.T.ravel().tolist() == pytest.approx([v for w in want for e in w for v in e], abs=1e-9)
    part, _ = B._Discs(r, 16).take(column.slice(3, 4))
    assert part.tolist() == many.tolist()[3:7] and (B._Discs(r, 16).weigh(column) >= many).all()


def test_fields_of_any_size_are_in_few_cells(spark):
    """From 10 m to 100 km: four cells a level at most, and the pairs of a plain comparison."""
    rng = random.Random(2)
    sides = [10, 30, 100, 400, 2000, 9000, 40_000, 100_000]
    shapes = [(i, [[shift(box(0, 0, (w := rng.choice(sides[:4] if i % 50 else sides)), w * rng.uniform(0.2, 1)), rng.uniform(0, 60_000), rng.uniform(0, 60_000))]]) for i in range(1500)]
    m = fields(spark, shapes).select("id", "box").cache()
    at = {r["id"]: r["box"] for r in m.collect()}
    reach, size = 100.0, 200.0
    want = {(i, j) for i, a in at.items() for j, b in at.items() if i != j and a.minx - reach <= b.maxx and a.maxx + reach >= b.minx and a.miny - reach <= b.maxy and a.maxy + reach >= b.miny}
    got = [tuple(r) for r in S.pairs(m, m, reach, size).select("a.id", "b.id").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    levels = m.agg(F.collect_set(S._level(S._extent(), reach, size))).first()[0]
    for name in "ab":
        most = S.celled(m, name, F.array(*map(F.lit, levels)), reach, size).groupBy(f"{name}.id", "level", "left").count().agg(F.max("count")).first()[0]
        assert most <= 4


def test_neighbours_send_no_side_to_the_driver(spark):
    """A side of copies is larger than its estimate: it is never broadcast."""
    found = S.neighbours(fields(spark, [(k, [[box(k * 100, 0, k * 100 + 90, 90)]]) for k in range(9)]))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == sum(1 for a in range(9) for b in range(9) if a != b and abs(a - b) <= 5)


def test_edges_meet_few_others_however_many_there_are(spark):
    """Two discs of many corners: as many pairs of edges as there are edges, and the lens that they have in common."""
    import numpy as np

    from parcelforge.functions import between as B

    n, apart = 2000, 1.0
    disc = lambda x: [(x + math.cos(2 * math.pi * k / n), math.sin(2 * math.pi * k / n)) for k in range(n)]
    lens = 2 * math.acos(apart / 2) - apart / 2 * math.sqrt(4 - apart * apart)
    (row,) = S.intersections(fields(spark, [(0, [[disc(0.0)]]), (1, [[disc(apart)]])])).collect()
    assert row["area_m2"] == pytest.approx(lens, rel=1e-4) and row["perimeter_m"] == pytest.approx(4 * math.acos(apart / 2), rel=1e-4)
    ring = np.array([(*p, *q) for p, q in zip(disc(0.0), [*disc(0.0)[1:], disc(0.0)[0]])]).T
    s, t = B._meeting(np.zeros(n, int), ring, 1e-6)
    assert n <= len(s) <= 8 * n and {(0, 0), (0, 1), (1, 0)} <= set(zip(s.tolist(), t.tolist()))


def test_projection_computes_each_point_once(spark):
    """The size of the expression: what is used many times is named, as nothing else keeps it in a higher-order function."""
    from parcelforge.functions import crs

    one = spark.createDataFrame([([[[(500000.0, 4e6)]]],)], f"p {G.POLYGONS}").select(crs.project(crs.unproject(F.col("p"), 12), 11).alias("p"))
    assert len(one._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert one.select(crs.unproject(F.col("p"), 11)[0][0][0].alias("p")).first()["p"]["x"] == pytest.approx(-111, abs=1e-9)
