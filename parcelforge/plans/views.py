"""Field tables derived from the supplied tables, as DataFrames and, for the oracles, as SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.functions import geometry as G
from parcelforge.functions.fence import spread

YEARS = list(range(1995, 2002))
YIELDS = [f"yield_{y}" for y in YEARS]
CELL, COLUMNS, EAST = 400, 50, 100000
IRRIGATION = ["drip", "sprinkler", "center_pivot", "furrow", "flood", "hand"]
SOIL = ["sandy", "loamy_sand", "sandy_loam", "loam", "silty_loam", "silty_clay", "clay_loam", "clay", "peat"]
#: Corners by ``field_id % 4``, in metres from the field's origin: a box, an L, a hexagon and a triangle.
SHAPES = [
    [(0, 0), (400, 0), (400, 400), (0, 400)],
    [(0, 0), (400, 0), (400, 100), (100, 100), (100, 400), (0, 400)],
    [(100, 0), (300, 0), (400, 200), (300, 400), (100, 400), (0, 200)],
    [(0, 0), (400, 0), (200, 390)],
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share: below ``spark.checkpoint.dir``, or, in local mode only, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/plans-{uuid.uuid4().hex}" if root else "file://" + tempfile.mkdtemp(prefix="plans-")


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes and polygons of every part, without yields."""
    k = F.col("p_partkey")
    east, north = EAST + (k % COLUMNS) * CELL, F.floor(k / COLUMNS) * CELL
    shape = F.when(F.lit(False), None)
    for i, corners in enumerate(SHAPES):
        shape = shape.when(k % 4 == i, G.ring([(east + x, north + y) for x, y in corners]))
    names = lambda table, at: F.element_at(F.array(*map(F.lit, table)), (at + 1).cast("int"))
    return spread(read(spark, sf_dir, "part"), "p_partkey").select(
        k.alias("field_id"), F.col("p_type").alias("crop_type"), names(SOIL, k % 9).alias("soil_type"), names(IRRIGATION, k % 6).alias("irrigation_type"),
        (F.col("p_size") * 1.5).alias("area_ha"), ((k % 17) / 10).alias("slope_pct"), F.array(F.array(shape)).alias("polygons"),
    )


#: Six fields on each site, in metres from its origin, as polygons of rings: one with a hole, one inside it, one inside the hole, one
#: that overlaps it, one of two polygons that are beside it and 0.3 m off, and one in a corner of the hole.
MIXED = [
    [[[(0, 0), (1000, 0), (1000, 1000), (0, 1000)], [(600, 600), (800, 600), (800, 800), (600, 800)]]],
    [[[(100, 100), (200, 100), (200, 200), (100, 200)]]],
    [[[(680, 680), (720, 680), (720, 720), (680, 720)]]],
    [[[(970, 990), (1100, 990), (1100, 1100), (970, 1100)]]],
    [[[(-100, 0), (0, 0), (0, 100), (-100, 100)]], [[(-100.3, 400), (-0.3, 400), (-0.3, 500), (-100.3, 500)]]],
    [[[(600, 600), (640, 600), (640, 640), (600, 640)]]],
]
SITE = 3000


#: Ten fields on each site: a box, one that overlaps it with two sides in common, a band inside it from side to side, a short field beside a long
#: one that is tilted by a tenth of a degree, the same the other way round, one far from all, one with a corner inwards that crosses the
#: box, and one that touches it in a corner.
IRREGULAR = [
    [[[(0, 0), (100, 0), (100, 100), (0, 100)]]],
    [[[(0, 50), (100, 50), (100, 150), (0, 150)]]],
    [[[(0, 20), (100, 20), (100, 80), (0, 80)]]],
    [[[(300, -1010), (310, -1010), (310, -1000), (300, -1000)]]],
    [[[(-195, -1000.5), (815, -998.737), (815, -900), (-195, -900)]]],
    [[[(-195, 999.5), (815, 1001.263), (815, 1100), (-195, 1100)]]],
    [[[(300, 990), (310, 990), (310, 1000), (300, 1000)]]],
    [[[(1400, 1400), (1410, 1400), (1410, 1410), (1400, 1410)]]],
    [[[(50, -30), (130, 50), (50, 130), (60, 50)]]],
    [[[(0, 0), (-60, -20), (-40, -50)]]],
]
#: Boxes from 10 m to 100 km, in metres from the origin of a site: the largest covers hundreds of sites.
SIZES = [[[[(x, y), (x + w, y), (x + w, y + w), (x, y + w)]]] for x, y, w in [(5, 5, 10), (900, 40, 40), (200, 300, 160), (700, 800, 640), (-500, -900, 2560), (1500, 1500, 12)]]
GIANT = [[[(-20000, -30000), (80000, -30000), (80000, 70000), (-20000, 70000)]]]


def placed(spark: SparkSession, sf_dir: str, shapes: list, site: int = SITE) -> DataFrame:
    """A field of every part: one of ``shapes`` by ``field_id % len(shapes)``, on a site of its own."""
    k = F.col("p_partkey")
    at = F.floor(k / len(shapes))
    east, north = EAST + (at % COLUMNS) * site, F.floor(at / COLUMNS) * site
    shape = F.when(F.lit(False), None)
    for i, polygons in enumerate(shapes):
        shape = shape.when(k % len(shapes) == i, F.array(*(F.array(*(G.ring([(east + x, north + y) for x, y in ring]) for ring in p)) for p in polygons)))
    return spread(read(spark, sf_dir, "part"), "p_partkey").select(k.alias("field_id"), F.col("p_type").alias("crop_type"), shape.alias("polygons"))


def mixed_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir, MIXED)


def sized_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``SIZES``, and in place of each part whose key is divisible by 997 a box of 100 km."""
    rows = placed(spark, sf_dir, SIZES)
    giant = F.array(*(F.array(*(G.ring([(F.lit(EAST + x), F.lit(y)) for x, y in ring]) for ring in p)) for p in GIANT))
    return rows.withColumn("polygons", F.when(F.col("field_id") % 997 == 0, giant).otherwise(F.col("polygons")))


def yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column a year: one pass with partial aggregation, no pivot job."""
    year, items = F.year("l_shipdate"), read(spark, sf_dir, "lineitem")
    return items.groupBy(F.col("l_partkey").alias("field_id")).agg(*(F.avg(F.when(year == y, F.col("l_quantity"))).alias(f"yield_{y}") for y in YEARS))


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parcels(spark, sf_dir).drop("polygons").join(yields(spark, sf_dir), "field_id", "left")


def _case(column: str, names: list[str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


#: Common table expressions: p (parcels), y (yields, long), s (yields as ordered lists), f (parcels with yields), corner, v, seg.
P = f"""p AS (SELECT p_partkey AS field_id, p_type AS crop_type, {_case('p_partkey % 9', SOIL)} AS soil_type, {_case('p_partkey % 6', IRRIGATION)} AS irrigation_type,
 p_size * 1.5::DOUBLE AS area_ha, (p_partkey % 17)::DOUBLE / 10 AS slope_pct, {EAST} + (p_partkey % {COLUMNS}) * {CELL} AS ox, (p_partkey // {COLUMNS}) * {CELL} AS oy, p_partkey % 4 AS shape FROM part)"""
Y = f"y AS (SELECT l_partkey AS field_id, year(l_shipdate) AS yr, avg(l_quantity) AS v FROM lineitem WHERE year(l_shipdate) BETWEEN {YEARS[0]} AND {YEARS[-1]} GROUP BY ALL)"
S = "s AS (SELECT p.field_id, coalesce(list(v ORDER BY yr) FILTER (v IS NOT NULL), []) AS lv, coalesce(list(yr ORDER BY yr) FILTER (v IS NOT NULL), []) AS ly FROM p LEFT JOIN y USING (field_id) GROUP BY p.field_id)"
FIELDS = "f AS (SELECT p.* EXCLUDE (ox, oy, shape), w.* EXCLUDE (field_id) FROM p LEFT JOIN (SELECT field_id, " + ", ".join(f"max(v) FILTER (yr = {y}) AS yield_{y}" for y in YEARS) + " FROM y GROUP BY field_id) w USING (field_id))"
CORNER = "corner(shape, i, dx, dy) AS (VALUES " + ", ".join(f"({s}, {i}, {x}::DOUBLE, {y}::DOUBLE)" for s, c in enumerate(SHAPES) for i, (x, y) in enumerate([*c, c[0]])) + ")"
V = "v AS (SELECT field_id, crop_type, i, ox + dx AS x, oy + dy AS y FROM p JOIN corner USING (shape))"
SEG = "seg AS (SELECT a.field_id, a.crop_type, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM v a JOIN v b ON a.field_id = b.field_id AND b.i = a.i + 1)"
#: Measures of each shape from its corners, then of each field: g.
G_SQL = f"""{P}, {CORNER}, e AS (SELECT a.shape, a.dx AS ax, a.dy AS ay, b.dx AS bx, b.dy AS by_, a.dx * b.dy - b.dx * a.dy AS c FROM corner a JOIN corner b ON a.shape = b.shape AND b.i = a.i + 1),
m AS (SELECT shape, abs(sum(c)) / 2 AS area, sum(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))) AS perimeter, sum((ax + bx) * c) / (3 * sum(c)) AS mx, sum((ay + by_) * c) / (3 * sum(c)) AS my, count(*) AS n FROM e GROUP BY shape),
bb AS (SELECT shape, min(dx) AS x0, max(dx) AS x1, min(dy) AS y0, max(dy) AS y1 FROM corner GROUP BY shape),
pt AS (SELECT DISTINCT shape, dx, dy FROM corner),
he AS (SELECT a.shape, a.dx AS ax, a.dy AS ay, b.dx AS bx, b.dy AS by_ FROM pt a JOIN pt b ON a.shape = b.shape AND (a.dx, a.dy) <> (b.dx, b.dy) WHERE NOT EXISTS (SELECT 1 FROM pt c WHERE c.shape = a.shape
 AND ((b.dx - a.dx) * (c.dy - a.dy) - (b.dy - a.dy) * (c.dx - a.dx) < 0 OR ((b.dx - a.dx) * (c.dy - a.dy) - (b.dy - a.dy) * (c.dx - a.dx) = 0 AND (c.dx - a.dx) * (c.dx - b.dx) + (c.dy - a.dy) * (c.dy - b.dy) > 0)))),
h AS (SELECT shape, sum(ax * by_ - bx * ay) / 2 AS hull_area, sum(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))) AS hull_perimeter FROM he GROUP BY shape),
g AS (SELECT field_id, crop_type, area / 10000 AS area_ha, perimeter / 1000 AS perimeter_km, 4 * pi() * area / (perimeter * perimeter) AS compactness, greatest(x1 - x0, y1 - y0) / least(x1 - x0, y1 - y0) AS elongation,
 hull_area / 10000 AS convex_hull_area_ha, hull_perimeter / 1000 AS convex_hull_perimeter_km, area / hull_area AS solidity, hull_perimeter / perimeter AS convexity, n AS n_vertices, (x1 - x0) * (y1 - y0) / 10000 AS bbox_area_ha,
 area / ((x1 - x0) * (y1 - y0)) AS bbox_fill_ratio, x1 - x0 AS bbox_width_m, y1 - y0 AS bbox_height_m, ox + mx AS centroid_x, oy + my AS centroid_y, perimeter / sqrt(area) AS edge_density,
 ox + x0 AS minx, ox + x1 AS maxx, oy + y0 AS miny, oy + y1 AS maxy FROM p JOIN m USING (shape) JOIN bb USING (shape) JOIN h USING (shape))"""


def _corners(shapes: list, closed: bool = True, oriented: bool = False) -> str:
    """``(shape, part, ring, i, dx, dy)`` of all corners, in metres from the site's origin."""
    rows = []
    for s, polygons in enumerate(shapes):
        for p, rings in enumerate(polygons):
            for r, c in enumerate(rings):
                doubled = sum(x * v - u * y for (x, y), (u, v) in zip(c, [*c[1:], c[0]]))
                c = c[::-1] if oriented and (doubled < 0) != (r > 0) else c
                rows += [f"({s}, {p}, {r}, {i}, {x}::DOUBLE, {y}::DOUBLE)" for i, (x, y) in enumerate([*c, c[0]] if closed else c)]
    return f"corner(shape, part, ring, i, dx, dy) AS (VALUES {', '.join(rows)})"


def placed_sql(shapes: list, site: int = SITE) -> str:
    """The same for ``placed``: corners of all rings (v), edges (seg), boxes (g), and the first corner of each polygon (fc)."""
    n = len(shapes)
    return f"""{_corners(shapes)},
v AS (SELECT p_partkey AS field_id, p_type AS crop_type, part, ring, i, {EAST} + ((p_partkey // {n}) % {COLUMNS}) * {site} + dx AS x, ((p_partkey // {n}) // {COLUMNS}) * {site} + dy AS y FROM part JOIN corner ON p_partkey % {n} = shape),
seg AS (SELECT a.field_id, a.crop_type, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM v a JOIN v b ON a.field_id = b.field_id AND a.part = b.part AND a.ring = b.ring AND b.i = a.i + 1),
g AS (SELECT field_id, crop_type, min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy FROM v GROUP BY ALL),
fc AS (SELECT field_id, part, x, y FROM v WHERE ring = 0 AND i = 0)"""


MIXED_SQL = placed_sql(MIXED)

_TURN = "CASE WHEN e.ay <= {y} AND e.by_ > {y} AND (e.bx - e.ax) * ({y} - e.ay) - ({x} - e.ax) * (e.by_ - e.ay) > 0 THEN 1 WHEN e.ay > {y} AND e.by_ <= {y} AND (e.bx - e.ax) * ({y} - e.ay) - ({x} - e.ax) * (e.by_ - e.ay) < 0 THEN -1 ELSE 0 END"


def rings_sql(shapes: list, radius: float = 0.0, quadrant: int = 16) -> str:
    """Edges of the shapes' rings with the interior on their left, ``rg(shape, part, ring, ax, ay, bx, by_)``; with a ``radius``, of the shapes grown by discs."""
    if radius:
        step = f"(pi() / {2 * quadrant})"
        ends = f"""{_corners(shapes, closed=False, oriented=True)}, nb AS (SELECT *, coalesce(lag(dx) OVER w, last_value(dx) OVER w2) AS px, coalesce(lag(dy) OVER w, last_value(dy) OVER w2) AS py, coalesce(lead(dx) OVER w, first_value(dx) OVER w2) AS qx, coalesce(lead(dy) OVER w, first_value(dy) OVER w2) AS qy
 FROM corner WINDOW w AS (PARTITION BY shape, part, ring ORDER BY i), w2 AS (PARTITION BY shape, part, ring ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 nm AS (SELECT *, (dy - py) / sqrt((dx - px) ** 2 + (dy - py) ** 2) AS nx, -(dx - px) / sqrt((dx - px) ** 2 + (dy - py) ** 2) AS ny, (qy - dy) / sqrt((qx - dx) ** 2 + (qy - dy) ** 2) AS mx, -(qx - dx) / sqrt((qx - dx) ** 2 + (qy - dy) ** 2) AS my,
 atan2((dx - px) * (qy - dy) - (dy - py) * (qx - dx), (dx - px) * (qx - dx) + (dy - py) * (qy - dy)) AS turn FROM nb),
 ar AS (SELECT *, unnest(range(0, CASE WHEN turn > 1e-9 THEN greatest(1, round(turn / {step})::INT) ELSE 0 END + 1)) AS k, CASE WHEN turn > 1e-9 THEN greatest(1, round(turn / {step})) ELSE 1 END AS many FROM nm),
 pt AS (SELECT shape, part, ring, row_number() OVER (PARTITION BY shape, part, ring ORDER BY i, k) AS i, dx + {radius} * CASE WHEN turn > 1e-9 THEN cos(atan2(ny, nx) + turn * k / many) ELSE (nx + mx) / (1 + nx * mx + ny * my) END AS x,
 dy + {radius} * CASE WHEN turn > 1e-9 THEN sin(atan2(ny, nx) + turn * k / many) ELSE (ny + my) / (1 + nx * mx + ny * my) END AS y FROM ar)"""
    else:
        ends = f"{_corners(shapes, closed=False, oriented=True)}, pt AS (SELECT shape, part, ring, i, dx AS x, dy AS y FROM corner)"
    return f"""{ends}, rg AS (SELECT shape, part, ring, x AS ax, y AS ay, coalesce(lead(x) OVER w, first_value(x) OVER w2) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER w2) AS by_
 FROM pt WINDOW w AS (PARTITION BY shape, part, ring ORDER BY i), w2 AS (PARTITION BY shape, part, ring ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


def overlay_sql(shapes: list, radius: float = 0.0) -> str:
    """What each two shapes of a site have in common, by joins: ``ov(src, dst, area, perimeter, line, gap)``, and for fields ``f2``. See ``rings_sql``."""
    return f"""{rings_sql(shapes, radius)},
 prs AS (SELECT a.shape AS src, b.shape AS dst FROM (SELECT DISTINCT shape FROM rg) a JOIN (SELECT DISTINCT shape FROM rg) b ON a.shape < b.shape),
 oe AS (SELECT src, dst, shape = src AS first, row_number() OVER () AS eid, ax, ay, bx, by_, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) AS len FROM prs JOIN rg ON shape IN (src, dst)),
 ct AS (SELECT eid, unnest([0.0::DOUBLE, 1.0]) AS t FROM oe UNION ALL SELECT s.eid, unnest([
 CASE WHEN ((e.ax - s.ax) * (s.by_ - s.ay) - (e.ay - s.ay) * (s.bx - s.ax)) / nullif((s.bx - s.ax) * (e.by_ - e.ay) - (s.by_ - s.ay) * (e.bx - e.ax), 0) BETWEEN 0 AND 1
 THEN ((e.ax - s.ax) * (e.by_ - e.ay) - (e.ay - s.ay) * (e.bx - e.ax)) / nullif((s.bx - s.ax) * (e.by_ - e.ay) - (s.by_ - s.ay) * (e.bx - e.ax), 0) END,
 CASE WHEN abs((e.ax - s.ax) * (s.by_ - s.ay) - (e.ay - s.ay) * (s.bx - s.ax)) <= 1e-6 * s.len THEN ((e.ax - s.ax) * (s.bx - s.ax) + (e.ay - s.ay) * (s.by_ - s.ay)) / (s.len * s.len) END,
 CASE WHEN abs((e.bx - s.ax) * (s.by_ - s.ay) - (e.by_ - s.ay) * (s.bx - s.ax)) <= 1e-6 * s.len THEN ((e.bx - s.ax) * (s.bx - s.ax) + (e.by_ - s.ay) * (s.by_ - s.ay)) / (s.len * s.len) END]) AS t
 FROM oe s JOIN oe e ON s.src = e.src AND s.dst = e.dst),
 sp_ AS (SELECT eid, t AS t0, lead(t) OVER (PARTITION BY eid ORDER BY t) AS t1 FROM ct WHERE t BETWEEN 0 AND 1),
 pc AS (SELECT row_number() OVER () AS pid, o.*, t0, t1, (t1 - t0) * len AS size, ax + (t0 + t1) / 2 * (bx - ax) AS x, ay + (t0 + t1) / 2 * (by_ - ay) AS y, (bx - ax) / len AS ux, (by_ - ay) / len AS uy FROM oe o JOIN sp_ USING (eid) WHERE (t1 - t0) * len > 1e-6),
 wd AS (SELECT pid, coalesce(sum({_TURN.format(x='(p.x - 1e-5 * uy)', y='(p.y + 1e-5 * ux)')}) FILTER (e.first = p.first), 0) > 0 AS ol, coalesce(sum({_TURN.format(x='(p.x - 1e-5 * uy)', y='(p.y + 1e-5 * ux)')}) FILTER (e.first <> p.first), 0) > 0 AS tl,
 coalesce(sum({_TURN.format(x='(p.x + 1e-5 * uy)', y='(p.y - 1e-5 * ux)')}) FILTER (e.first = p.first), 0) > 0 AS orr, coalesce(sum({_TURN.format(x='(p.x + 1e-5 * uy)', y='(p.y - 1e-5 * ux)')}) FILTER (e.first <> p.first), 0) > 0 AS tr
 FROM pc p JOIN oe e ON p.src = e.src AND p.dst = e.dst GROUP BY pid),
 kd AS (SELECT pc.*, ol AND tl AND NOT (orr AND tr) AND (pc.first OR tr) AS bounds, pc.first AND ol AND NOT tl AND NOT orr AND tr AS touch FROM pc JOIN wd USING (pid)),
 gp AS (SELECT s.src, s.dst, min(least({', '.join("sqrt(({p}x - {e}.ax - t{n} * ({e}.bx - {e}.ax)) ** 2 + ({p}y{u} - {e}.ay - t{n} * ({e}.by_ - {e}.ay)) ** 2)".format(p=p, e=e, n=n, u=u) for n, (p, e, u) in enumerate([("s.a", "e", ""), ("s.b", "e", "_"), ("e.a", "s", ""), ("e.b", "s", "_")]))})) AS gap FROM
 (SELECT s, e, s.src AS src, s.dst AS dst, {', '.join("greatest(0, least(1, (({p}x - {e}.ax) * ({e}.bx - {e}.ax) + ({p}y{u} - {e}.ay) * ({e}.by_ - {e}.ay)) / ({e}.len * {e}.len))) AS t{n}".format(p=p, e=e, n=n, u=u) for n, (p, e, u) in enumerate([("s.a", "e", ""), ("s.b", "e", "_"), ("e.a", "s", ""), ("e.b", "s", "_")]))}
 FROM oe s JOIN oe e ON s.src = e.src AND s.dst = e.dst AND s.first AND NOT e.first) s GROUP BY s.src, s.dst),
 ov AS (SELECT src, dst, coalesce(sum((ax + t0 * (bx - ax)) * (ay + t1 * (by_ - ay)) - (ax + t1 * (bx - ax)) * (ay + t0 * (by_ - ay))) FILTER (bounds), 0) / 2 AS area, coalesce(sum(size) FILTER (bounds), 0) AS perimeter, coalesce(sum(size) FILTER (touch), 0) AS line, first(gap) AS gap
 FROM kd JOIN gp USING (src, dst) GROUP BY src, dst),
 f2 AS (SELECT a.p_partkey AS src, b.p_partkey AS dst, a.p_type AS src_crop, b.p_type AS dst_crop, area, perimeter, line, gap FROM ov JOIN part a ON a.p_partkey % {len(shapes)} = ov.src JOIN part b ON b.p_partkey % {len(shapes)} = ov.dst AND b.p_partkey // {len(shapes)} = a.p_partkey // {len(shapes)})"""
