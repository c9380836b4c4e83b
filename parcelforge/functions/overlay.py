"""What two geometries have in common, and disc buffers, as column expressions over edges and rings.

Edges run with the interior on their left (``oriented``), so that a point is inside where they wind around it (``winding``); rings that
overlap themselves or each other are one region. All edges of both geometries are split where they meet. Of a piece, two points are looked
at, one on either side of its middle: it bounds the common region if the region is on its left and not on its right. A boundary that both
share, with the region on the same side, counts once. That is done by ``between``, for many pairs at once.

Every function here takes columns and stays in the JVM. What is used many times should be a column of its own (``fence``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G
from .geometry import let

#: Metres: shorter pieces, and gaps between edges, are none.
SMALL = 1e-6
#: Metres from a piece to the points on its sides.
ASIDE = 1e-5


def oriented(polygons: Column) -> Column:
    """All rings, exteriors counterclockwise and holes clockwise."""

    def turned(r: Column, hole: Column) -> Column:
        return F.when((G.signed_area(r) < 0) != hole, F.reverse(r)).otherwise(r)

    return F.flatten(F.transform(polygons, lambda p: F.transform(p, lambda r, i: turned(r, i > 0))))


def oriented_edges(polygons: Column) -> Column:
    """The edges of all rings with the interior on their left; edges without a length are left out."""
    return F.filter(F.flatten(F.transform(oriented(polygons), G.segments)), lambda s: s.a != s.b)


def winding(edges: Column, x: Column, y: Column) -> Column:
    """How often the edges run around the point, counterclockwise."""

    def turn(s: Column) -> Column:
        side = (s.b.x - s.a.x) * (y - s.a.y) - (x - s.a.x) * (s.b.y - s.a.y)
        return F.when((s.a.y <= y) & (s.b.y > y) & (side > 0), 1).when((s.a.y > y) & (s.b.y <= y) & (side < 0), -1).otherwise(0)

    return F.aggregate(edges, F.lit(0), lambda n, s: n + turn(s))


def by_type(m: Column, meet: Column) -> Column:
    """One length for what two geometries have in common: the perimeter of an area, the length of lines, of a collection its lines only, 0.01 for points."""
    area, line = m.area > SMALL, m.line > SMALL
    return F.when(area & ~line, m.perimeter).when(line, m.line).when(meet, 0.01).otherwise(0.0)


def buffer(polygons: Column, radius: float, quadrant: int = 16) -> Column:
    """The geometry grown by a disc: its rings offset by ``radius``, with arcs of ``quadrant`` segments a quarter at corners that turn left.

    At other corners the offset edges are cut where they meet, or led through the corner where they are too short to meet; the region is
    where the rings run around a point (``winding``), so what overlaps is one. Holes that are too narrow vanish. Closed rings, exteriors first.
    """
    step = math.pi / 2 / quadrant

    def around(corners: Column) -> Column:
        """Each corner with the outward normals of the edges before (``n``) and after it (``m``), and its turn."""

        def look(p: Column, before: Column, after: Column) -> Column:
            x1, y1, x2, y2 = p.x - before.x, p.y - before.y, after.x - p.x, after.y - p.y
            size1, size2 = F.hypot(x1, y1), F.hypot(x2, y2)
            return F.struct(
                p.x.alias("x"), p.y.alias("y"), (y1 / size1).alias("nx"), (-x1 / size1).alias("ny"), (y2 / size2).alias("mx"), (-x2 / size2).alias("my"), F.least(size1, size2).alias("short"),
                F.atan2(x1 * y2 - y1 * x2, x1 * x2 + y1 * y2).alias("turn"),
            )

        n = F.size(corners)
        return F.transform(corners, lambda p, i: look(p, F.element_at(corners, F.pmod(i - 1, n) + 1), F.element_at(corners, F.pmod(i + 1, n) + 1)))

    def points(c: Column) -> Column:
        at = lambda x, y: F.struct((c.x + radius * x).alias("x"), (c.y + radius * y).alias("y"))
        start, many = F.atan2(c.ny, c.nx), F.greatest(F.lit(1), F.round(c.turn / step).cast("int"))
        arc = F.transform(F.sequence(F.lit(0), many), lambda k: let(start + c.turn * k / many, lambda angle: at(F.cos(angle), F.sin(angle))))
        down = 1 + c.nx * c.mx + c.ny * c.my
        meet = F.array(at((c.nx + c.mx) / down, (c.ny + c.my) / down))
        through = F.array(at(c.nx, c.ny), at(F.lit(0.0), F.lit(0.0)), at(c.mx, c.my))
        fits = radius * F.tan(-c.turn / 2) <= c.short
        return F.when(c.turn > 1e-9, arc).when(fits & (c.turn > -3), meet).otherwise(through)

    def offset(r: Column) -> Column:
        corners = F.filter(F.slice(r, 1, F.size(r) - 1), lambda p, i: p != F.element_at(r, i + 2))  # no repeated points
        found = F.flatten(F.transform(let(corners, around), points))
        return let(found, lambda f: F.concat(f, F.slice(f, 1, 1)))

    def turned(r: Column, hole: Column) -> Column:
        return F.when((G.signed_area(r) < 0) != hole, F.reverse(r)).otherwise(r)

    rings = lambda p: F.transform(p, lambda r, i: F.struct((i > 0).alias("hole"), let(turned(r, i > 0), offset).alias("r")))
    kept = lambda p: F.filter(rings(p), lambda x: ~x.hole | (G.signed_area(x.r) < 0))
    return F.transform(polygons, lambda p: F.transform(kept(p), lambda x: x.r))
