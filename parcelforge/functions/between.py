"""What pairs of geometries have in common, by their edges: numpy over Arrow batches of pairs.

Each row is a pair; ``a`` and ``b`` are its edges (``array<struct<a, b>>``, with the interior on their left for ``common``) and their boxes. All pairs of a batch
are worked on at once, and edges meet only those whose boxes they touch, found by sorting. Lengths are in metres; a pair without edges has nothing in common.
``discs_common`` takes polygons, and makes the many edges of their disc buffers itself, so that no row has to carry them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .geometry import ALONG
from .overlay import ASIDE, SMALL

#: Edges that are worked on at once; a pair's are never parted.
AT_ONCE = 100_000
#: Metres by which an edge may be outside the other's box and still meet its edges.
FACING = 1e-3


def _within(owner, at, of, low, high):
    """Positions of ranges and numbers of the same owner, for each range (both ends belong to it) and number in it."""
    n, m = len(at), len(low)
    kind = np.repeat([1, 0, 2], [n, m, m])
    order = np.lexsort((kind, np.concatenate([at, low, high]), np.concatenate([owner, of, of])))
    rank = np.empty(n + 2 * m, np.int64)
    rank[order] = np.cumsum(order < n)
    numbers, start = order[order < n], rank[n : n + m]
    count = np.maximum(rank[n + m :] - start, 0)
    return np.repeat(np.arange(m), count), numbers[np.arange(count.sum()) + np.repeat(start - np.cumsum(count) + count, count)]


def _meeting(owner, e, slack):
    """Ordered pairs of edges of the same owner whose boxes, grown by ``slack``, meet."""
    x0, x1, y0, y1 = np.minimum(e[0], e[2]), np.maximum(e[0], e[2]), np.minimum(e[1], e[3]), np.maximum(e[1], e[3])
    s, t = _within(owner, y0, owner, y0 - slack, y1 + slack)  # t begins within s
    u, v = _within(owner, y0 - slack, owner, y0, y1)  # v's grown range begins within u
    more = y0[u] < (y0 - slack)[v]
    s, t = np.concatenate([s, v[more]]), np.concatenate([t, u[more]])
    kept = (x0[t] <= x1[s] + slack) & (x1[t] >= x0[s] - slack)
    return s[kept], t[kept]


def _winding(owner, x, y, of, e):
    """How often the edges of the same owner run around each point."""
    s, p = _within(owner, y, of, np.minimum(e[1], e[3]), np.maximum(e[1], e[3]))
    ax, ay, bx, by = (c[s] for c in e)
    side = (bx - ax) * (y[p] - ay) - (x[p] - ax) * (by - ay)
    up, down = (ay <= y[p]) & (by > y[p]) & (side > 0), (ay > y[p]) & (by <= y[p]) & (side < 0)
    return np.bincount(p, up.astype(float) - down, len(x))


def _common(pair, second, e, facing, n):
    """``area``, ``perimeter`` and ``line`` of each of ``n`` pairs; see ``overlay``."""
    own = pair * 2 + second
    at = np.flatnonzero(facing)
    f = e[:, at]
    dx, dy = f[2] - f[0], f[3] - f[1]
    size = np.sqrt(dx * dx + dy * dy)
    s, t = _meeting(pair[at], f, SMALL)
    px, py, qx, qy = f[0, t] - f[0, s], f[1, t] - f[1, s], f[2, t] - f[0, s], f[3, t] - f[1, s]
    sx, sy, ex, ey, size2 = dx[s], dy[s], dx[t], dy[t], size[s] * size[s]
    cross, near = sx * ey - sy * ex, SMALL * size[s]
    with np.errstate(divide="ignore", invalid="ignore"):
        cuts, on = (px * ey - py * ex) / cross, (px * sy - py * sx) / cross
    cuts = [np.where((cross != 0) & (on >= 0) & (on <= 1), cuts, -1.0), np.where(np.abs(px * sy - py * sx) <= near, (px * sx + py * sy) / size2, -1.0), np.where(np.abs(qx * sy - qy * sx) <= near, (qx * sx + qy * sy) / size2, -1.0)]
    edge, cut = np.tile(s, 3), np.concatenate(cuts)
    real = (cut > 0) & (cut < 1)
    every = np.arange(len(at))
    edge, cut = np.concatenate([every, every, edge[real]]), np.concatenate([np.zeros(len(at)), np.ones(len(at)), cut[real]])
    order = np.lexsort((cut, edge))
    edge, cut = edge[order], cut[order]
    k = np.flatnonzero((edge[:-1] == edge[1:]) & ((cut[1:] - cut[:-1]) * size[edge[:-1]] > SMALL))  # a piece from each of these cuts to the next
    g, t0, t1 = edge[k], cut[k], cut[k + 1]
    of, again, mid = pair[at][g], second[at][g] == 1, (t0 + t1) / 2
    mx, my, ux, uy = f[0, g] + mid * dx[g], f[1, g] + mid * dy[g], dx[g] / size[g], dy[g] / size[g]
    x, y = np.concatenate([mx - ASIDE * uy, mx + ASIDE * uy]), np.concatenate([my + ASIDE * ux, my - ASIDE * ux])
    mine = np.tile(of * 2 + again, 2)
    inside = _winding(np.concatenate([mine, mine ^ 1]), np.tile(x, 2), np.tile(y, 2), own, e) > 0
    ol, or_, tl, tr = inside.reshape(4, -1)
    bounds, touch = ol & tl & ~(or_ & tr) & (tr | ~again), ~again & ol & ~tl & ~or_ & tr
    ax, ay, bx, by, long = f[0, g] + t0 * dx[g], f[1, g] + t0 * dy[g], f[0, g] + t1 * dx[g], f[1, g] + t1 * dy[g], (t1 - t0) * size[g]
    return np.bincount(of, np.where(bounds, ax * by - bx * ay, 0), n) / 2, np.bincount(of, np.where(bounds, long, 0), n), np.bincount(of, np.where(touch, long, 0), n)


def _aside(px, py, e):
    """The square of the distance from each point to its edge."""
    ex, ey, px, py = e[2] - e[0], e[3] - e[1], px - e[0], py - e[1]
    size2 = ex * ex + ey * ey
    at = np.clip((px * ex + py * ey) / np.where(size2 > 0, size2, 1), 0, 1)
    return (px - at * ex) ** 2 + (py - at * ey) ** 2


def _runs(s, t, tolerance):
    """How much of ``t`` lies beside ``s``, between its ends and within the tolerance of its line."""
    dx, dy = s[2] - s[0], s[3] - s[1]
    size = np.sqrt(dx * dx + dy * dy)
    along, aside = ([f(t[i] - s[0], t[i + 1] - s[1]) for i in (0, 2)] for f in (lambda x, y: (x * dx + y * dy) / size, lambda x, y: (y * dx - x * dy) / size))

    def span(first, last, low, high):
        one, two, still = (low - first) / (last - first), (high - first) / (last - first), first == last
        return np.where(still, np.where((first >= low) & (first <= high), 0.0, 2.0), np.minimum(one, two)), np.where(still, 1.0, np.maximum(one, two))

    (from_x, to_x), (from_y, to_y) = span(*along, 0.0, size), span(*aside, -tolerance, tolerance)
    part = np.maximum(0, np.minimum(1, np.minimum(to_x, to_y)) - np.maximum(0, np.maximum(from_x, from_y)))
    return part * np.sqrt((t[2] - t[0]) ** 2 + (t[3] - t[1]) ** 2)


def _beside(pair, second, e, facing, n, tolerance):
    """The least distance between edges of each of ``n`` pairs, infinite beyond the tolerance, and how long edges run along each other."""
    at = np.flatnonzero(facing)
    s, t = _meeting(pair[at], e[:, at], tolerance)
    s, t = at[s], at[t]
    apart = second[s] < second[t]
    s, t = s[apart], t[apart]
    of, s, t = pair[s], e[:, s], e[:, t]
    near = np.sqrt(np.minimum(np.minimum(_aside(s[0], s[1], t), _aside(s[2], s[3], t)), np.minimum(_aside(t[0], t[1], s), _aside(t[2], t[3], s))))
    turn = lambda q, x, y: np.sign((q[2] - q[0]) * (y - q[1]) - (q[3] - q[1]) * (x - q[0]))
    near[(turn(s, t[0], t[1]) * turn(s, t[2], t[3]) < 0) & (turn(t, s[0], s[1]) * turn(t, s[2], s[3]) < 0)] = 0.0
    least = np.full(n, np.inf)
    np.minimum.at(least, of, near)
    cross = (s[2] - s[0]) * (t[3] - t[1]) - (s[3] - s[1]) * (t[2] - t[0])
    square = lambda q: (q[2] - q[0]) ** 2 + (q[3] - q[1]) ** 2
    level = (near <= tolerance) & (cross * cross <= ALONG * ALONG * square(s) * square(t))
    with np.errstate(divide="ignore", invalid="ignore"):
        long = (_runs(s[:, level], t[:, level], tolerance) + _runs(t[:, level], s[:, level], tolerance)) / 2
    return np.where(least <= tolerance, least, np.inf), np.bincount(of[level], long, n)


def _lengths(c):
    return c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


class _Edges:
    """Edges that the rows have."""

    @staticmethod
    def weigh(c):
        """How many edges each row has."""
        return _lengths(c)

    @staticmethod
    def take(c):
        """How many edges each row has, and all of them: ax, ay, bx, by."""
        ends = c.flatten()
        return _lengths(c), np.array([ends.field(p).field(q).to_numpy(zero_copy_only=False) for p in (0, 1) for q in (0, 1)], float).reshape(4, -1)


class _Discs:
    """Edges of the disc buffers of the rows' polygons; see ``overlay.buffer``."""

    def __init__(self, radius, quadrant):
        self.radius, self.quadrant = radius, quadrant

    @staticmethod
    def _corners(c):
        """Row and kind of each ring, its number of points, and their coordinates."""
        polygons = c.flatten()
        rings = polygons.flatten()
        many = _lengths(polygons)
        hole = np.ones(len(rings), bool)
        hole[(np.cumsum(many) - many)[many > 0]] = False
        points = rings.flatten()
        x, y = (np.array(points.field(i).to_numpy(zero_copy_only=False), float) for i in (0, 1))
        return np.repeat(np.repeat(np.arange(len(c)), _lengths(c)), many), hole, _lengths(rings), x, y

    def weigh(self, c):
        """How many edges each row has at most, roughly."""
        row, _, many, _, _ = self._corners(c)
        return np.bincount(row, many, len(c)).astype(np.int64) * (self.quadrant + 1)

    def take(self, c):
        row, hole, many, x, y = self._corners(c)
        ring, ends = np.repeat(np.arange(len(many)), many), np.cumsum(many)
        first, at = (ends - many)[ring], np.arange(len(x))
        step = at + 1 < ends[ring]  # all but the closing points
        turned = (_doubled(ring, x, y, np.where(step, at + 1, at), first, len(many)) < 0) != hole
        at = np.where(turned[ring], first + ends[ring] - 1 - at, at)
        x, y = x[at], y[at]
        kept = np.flatnonzero(step)
        kept = kept[(x[kept] != x[kept + 1]) | (y[kept] != y[kept + 1])]  # no repeated points
        x, y, ring = x[kept], y[kept], ring[kept]
        before, after, _ = _around(ring, len(many))
        x1, y1, x2, y2 = x - x[before], y - y[before], x[after] - x, y[after] - y
        size1, size2 = np.hypot(x1, y1), np.hypot(x2, y2)
        nx, ny, mx, my = y1 / size1, -x1 / size1, y2 / size2, -x2 / size2
        turn = np.arctan2(x1 * y2 - y1 * x2 + 0.0, x1 * x2 + y1 * y2)  # no -0: a spike turns left, as in Spark
        arcs = np.maximum(1, np.floor(turn / (np.pi / 2 / self.quadrant) + 0.5))
        left = turn > 1e-9
        meets = (self.radius * np.tan(-turn / 2) <= np.minimum(size1, size2)) & (turn > -3)
        points = np.where(left, arcs + 1, np.where(meets, 1, 3)).astype(np.int64)
        g = np.repeat(np.arange(len(x)), points)
        k = np.arange(len(g)) - np.repeat(np.cumsum(points) - points, points)
        angle = np.arctan2(ny + 0.0, nx + 0.0)[g] + turn[g] * k / arcs[g]
        with np.errstate(divide="ignore", invalid="ignore"):
            down = 1 + nx * mx + ny * my
            dx, dy = (np.select([left[g], meets[g], k == 0, k == 1], [f(angle), ((n + m) / down)[g], n[g], 0.0], m[g]) for f, n, m in ((np.cos, nx, mx), (np.sin, ny, my)))
        x, y, ring = x[g] + self.radius * dx, y[g] + self.radius * dy, ring[g]
        _, after, first = _around(ring, len(many))
        gone = hole & (_doubled(ring, x, y, after, first, len(many)) >= 0)  # too narrow
        kept = ~gone[ring] & ((x != x[after]) | (y != y[after]))
        return np.bincount(row[ring[kept]], minlength=len(c)), np.array([x, y, x[after], y[after]])[:, kept]


def _around(ring, n):
    """Positions of the points before and after each, in its ring of points without a closing one, and of the ring's first."""
    many = np.bincount(ring, minlength=n)
    ends, at = np.cumsum(many)[ring], np.arange(len(ring))
    first = ends - many[ring]
    return np.where(at == first, ends - 1, at - 1), np.where(at + 1 == ends, first, at + 1), first


def _doubled(ring, x, y, after, first, n):
    """Twice the signed area of each of ``n`` rings."""
    u, v = x - x[first], y - y[first]
    return np.bincount(ring, u * v[after] - u[after] * v, n)


def _batches(a, b, box_a, box_b, slack, measure, edges=_Edges):
    """``measure`` of the pairs, by as many at once as have ``AT_ONCE`` edges; coordinates are seen from the corner of ``a``'s box, and edges face the other's box or not."""
    boxes = [np.array([c.field(i).to_numpy(zero_copy_only=False) for i in range(4)], float) for c in (box_a, box_b)]
    chunk = np.cumsum(edges.weigh(a) + edges.weigh(b)) // AT_ONCE
    limits = np.concatenate([[0], np.flatnonzero(np.diff(chunk)) + 1, [len(a)]])
    out = []
    for i, j in zip(limits, limits[1:]):
        (na, ea), (nb, eb) = (edges.take(c.slice(i, j - i)) for c in (a, b))
        pair = np.concatenate([np.repeat(np.arange(j - i), c) for c in (na, nb)])
        second = np.repeat([0, 1], [na.sum(), nb.sum()])
        x, y = boxes[0][0, i:j][pair], boxes[0][1, i:j][pair]
        other = np.where(second, boxes[0][:, i:j][:, pair], boxes[1][:, i:j][:, pair]) - np.array([x, y, x, y])
        e = np.concatenate([ea, eb], axis=1) - np.array([x, y, x, y])
        facing = (np.minimum(e[0], e[2]) - slack <= other[2]) & (np.maximum(e[0], e[2]) + slack >= other[0]) & (np.minimum(e[1], e[3]) - slack <= other[3]) & (np.maximum(e[1], e[3]) + slack >= other[1])
        out.append(measure(pair, second, e, facing, j - i))
    return [np.concatenate(c) for c in zip(*out)] if out else None


def _struct(found, names):
    return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in (found or [[] for _ in names])], names)


def _doubles(*names: str) -> StructType:
    return StructType([StructField(n, DoubleType()) for n in names])


@F.arrow_udf(_doubles("area", "perimeter", "line"))
def common(a: pa.Array, b: pa.Array, box_a: pa.Array, box_b: pa.Array) -> pa.Array:
    """``area`` and ``perimeter`` of the common region, and the length of the ``line`` along which the two only touch."""
    return _struct(_batches(a, b, box_a, box_b, FACING, _common), ["area", "perimeter", "line"])


def discs_common(radius: float, quadrant: int = 16):
    """As ``common``, of polygons that are grown by discs (``overlay.buffer``) and the boxes of what they grow to."""
    edges = _Discs(radius, quadrant)

    @F.arrow_udf(_doubles("area", "perimeter", "line"))
    def grown(a: pa.Array, b: pa.Array, box_a: pa.Array, box_b: pa.Array) -> pa.Array:
        return _struct(_batches(a, b, box_a, box_b, FACING, _common, edges), ["area", "perimeter", "line"])

    return grown


def beside(tolerance: float):
    """A function of the same arguments: the least distance ``d`` between edges (infinite beyond the tolerance), and ``along``, how long edges run along each other."""

    @F.arrow_udf(_doubles("d", "along"))
    def near(a: pa.Array, b: pa.Array, box_a: pa.Array, box_b: pa.Array) -> pa.Array:
        return _struct(_batches(a, b, box_a, box_b, tolerance, lambda *x: _beside(*x, tolerance)), ["d", "along"])

    return near
