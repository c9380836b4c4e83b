"""Planar measures as column expressions.

A geometry is ``polygons: array<array<array<struct<x, y>>>>``: polygons, of rings, of points. The first ring of a polygon is its
exterior, the others are holes; rings are closed (the first point is repeated at the end). All measures stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POLYGONS = "array<array<array<struct<x:double,y:double>>>>"


def ring(points: list[tuple[Column, Column]]) -> Column:
    """A closed ring of the given corners."""
    corners = [F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points]
    return F.array(*corners, corners[0])


def let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it is used: inside a higher-order function nothing else keeps it."""
    return F.transform(F.array(value), use)[0]


def _steps(r: Column) -> Column:
    return F.when(F.size(r) > 1, F.sequence(F.lit(1), F.size(r) - 1)).otherwise(F.array().cast("array<int>"))


def segments(r: Column) -> Column:
    """The ring's edges: ``array<struct<a, b>>``."""
    return F.transform(_steps(r), lambda i: F.named_struct(F.lit("a"), F.element_at(r, i), F.lit("b"), F.element_at(r, i + 1)))


def _sum(a: Column, f) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + f(x))


def _cross(s: Column, o: Column) -> Column:
    """Of an edge's ends, seen from the point ``o``: near zero where coordinates are large."""
    return (s.a.x - o.x) * (s.b.y - o.y) - (s.b.x - o.x) * (s.a.y - o.y)


def signed_area(r: Column) -> Column:
    return _sum(segments(r), lambda s: _cross(s, r[0])) / 2


def ring_length(r: Column) -> Column:
    return _sum(segments(r), lambda s: F.sqrt((s.b.x - s.a.x) * (s.b.x - s.a.x) + (s.b.y - s.a.y) * (s.b.y - s.a.y)))


def area(polygons: Column) -> Column:
    """Holes are subtracted."""
    return _sum(polygons, lambda p: 2 * F.abs(signed_area(p[0])) - _sum(p, lambda r: F.abs(signed_area(r))))


def length(polygons: Column) -> Column:
    """Of all rings, holes too."""
    return _sum(polygons, lambda p: _sum(p, ring_length))


def exterior(polygons: Column) -> Column:
    """The corners of all exteriors, without the closing points."""
    return F.flatten(F.transform(polygons, lambda p: F.slice(p[0], 1, F.greatest(F.size(p[0]) - 1, F.lit(0)))))


def edges(polygons: Column) -> Column:
    """All edges of all rings."""
    return F.flatten(F.transform(F.flatten(polygons), segments))


def vertex_count(polygons: Column) -> Column:
    return F.size(exterior(polygons))


def bbox(polygons: Column) -> Column:
    xs, ys = F.transform(exterior(polygons), lambda p: p.x), F.transform(exterior(polygons), lambda p: p.y)
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def ratio(part: Column, whole: Column, default: float) -> Column:
    """``part / whole``, or ``default`` where ``whole`` is not positive."""
    return F.when(whole > 0, F.try_divide(part, whole)).otherwise(F.lit(default))


def compactness(area_: Column, length_: Column) -> Column:
    return F.when(length_ > 0, F.try_divide(4 * F.pi() * area_, length_ * length_)).otherwise(0.0)


def elongation(width: Column, height: Column, flat: float = float("inf")) -> Column:
    return ratio(F.greatest(width, height), F.least(width, height), flat)


def centroid(polygons: Column) -> Column:
    """Area-weighted, holes subtracted; seen from the first corner."""
    o = polygons[0][0][0]

    def moment(axis: str) -> Column:
        def of_ring(r: Column, sign: Column) -> Column:
            flip = sign * F.signum(signed_area(r))
            return _sum(segments(r), lambda s: (s.a[axis] + s.b[axis] - 2 * o[axis]) * _cross(s, o)) * flip

        return _sum(polygons, lambda p: 2 * of_ring(p[0], F.lit(1.0)) - _sum(p, lambda r: of_ring(r, F.lit(1.0))))

    whole = 6 * area(polygons)
    return F.struct((o.x + F.try_divide(moment("x"), whole)).alias("x"), (o.y + F.try_divide(moment("y"), whole)).alias("y"))


def _turn(p: Column, q: Column, c: Column) -> Column:
    """Positive for a point to the left of p-q, 0 for one that is on its line but for rounding."""
    cross = (q.x - p.x) * (c.y - p.y) - (q.y - p.y) * (c.x - p.x)
    slack = 1e-9 * (F.abs(q.x - p.x) + F.abs(q.y - p.y)) * (F.abs(c.x - p.x) + F.abs(c.y - p.y))
    return F.when(F.abs(cross) > slack, cross).otherwise(0.0)


def _chain(points: Column) -> Column:
    """The hull's lower side, from left to right, of points in that order: a stack that every point is put on once.

    The stack's turns towards a point are to the left first and then not any more, so that what it covers is found by halving.
    """

    def push(stack: Column, p: Column) -> Column:
        def halve(at: Column, _: Column) -> Column:
            mid = F.shiftright(at.low + at.high + 1, 1)
            left = _turn(F.element_at(stack, mid), F.element_at(stack, mid + 1), p) > 0
            return F.when(at.low >= at.high, at).when(left, F.struct(mid.alias("low"), at.high.alias("high"))).otherwise(F.struct(at.low.alias("low"), (mid - 1).alias("high")))

        steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(stack) + 1)).cast("int"))
        kept = F.aggregate(steps, F.struct(F.lit(0).alias("low"), (F.size(stack) - 1).alias("high")), halve, lambda at: at.low + 1)
        return F.when(F.size(stack) == 0, F.array(p)).otherwise(F.concat(F.slice(stack, 1, kept), F.array(p)))

    return F.aggregate(points, F.array().cast("array<struct<x:double,y:double>>"), push)


def hull_edges(points: Column) -> Column:
    """Edges of the convex hull, counterclockwise, by a monotone chain: n log n in the number of corners.

    Points on a line give an edge there and one back; a single point none.
    """
    lower = lambda sorted_: F.concat(_chain(sorted_), _drop_first(_chain(F.reverse(sorted_))))
    return let(let(F.array_sort(F.array_distinct(points)), lower), lambda r: F.zip_with(F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), _drop_first(r), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def _drop_first(a: Column) -> Column:
    return F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))


def edges_area(edges_: Column) -> Column:
    """Of the area within edges that run around it, seen from the first corner."""
    return _sum(edges_, lambda s: _cross(s, edges_[0].a)) / 2


def edges_length(edges_: Column) -> Column:
    return _sum(edges_, lambda s: F.sqrt((s.b.x - s.a.x) * (s.b.x - s.a.x) + (s.b.y - s.a.y) * (s.b.y - s.a.y)))


def point_segment_distance(p: Column, s: Column) -> Column:
    dx, dy = s.b.x - s.a.x, s.b.y - s.a.y
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((p.x - s.a.x) * dx + (p.y - s.a.y) * dy, dx * dx + dy * dy), F.lit(0.0))))
    return F.hypot(p.x - s.a.x - t * dx, p.y - s.a.y - t * dy)


def _inside(e: Column, p: Column) -> Column:
    """Whether a ray from the point meets an odd number of the edges."""
    crossed = F.filter(e, lambda s: ((s.a.y > p.y) != (s.b.y > p.y)) & (p.x < s.a.x + F.try_divide((p.y - s.a.y) * (s.b.x - s.a.x), s.b.y - s.a.y)))
    return F.size(crossed) % 2 == 1


def contains(polygons: Column, p: Column) -> Column:
    """Whether the point is inside (holes are outside); on the boundary, either."""
    return _inside(edges(polygons), p)


def strictly_contains(polygons: Column, p: Column, least: float = 1e-6) -> Column:
    """Whether the point is inside and at least so far from the boundary."""
    return contains(polygons, p) & F.forall(edges(polygons), lambda s: point_segment_distance(p, s) > least)


def point_polygon_distance(p: Column, polygons: Column) -> Column:
    """0 inside (holes are outside), else the distance to the nearest edge."""
    e = edges(polygons)
    return F.when(_inside(e, p), 0.0).otherwise(F.array_min(F.transform(e, lambda s: point_segment_distance(p, s))))


#: The sine of the largest angle between edges that run along each other.
ALONG = 0.1
