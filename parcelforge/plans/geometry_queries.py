"""Shape descriptors and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.functions import crs, rounding
from parcelforge.functions import geometry as G
from parcelforge.functions.fence import fence, spread
from parcelforge.sources import collection
from parcelforge.sources import fields as source

from . import views
from .registry import register

FEATURES = (
    "area_ha:d perimeter_km:d compactness:d elongation:d convex_hull_area_ha:d convex_hull_perimeter_km:d solidity:d convexity:d n_vertices:i bbox_area_ha:d "
    "bbox_fill_ratio:d bbox_width_m:d bbox_height_m:d centroid_x:d centroid_y:d edge_density:d"
)


def geometry_features(fields: DataFrame, keep: list[str], hull: bool = True) -> DataFrame:
    """All measures of ``polygons``; of the hull, which costs most, only if asked."""
    p = F.col("polygons")
    around = [G.hull_edges(G.exterior(p)).alias("_h")] if hull else []
    base = fence(fields.select(*keep, p, G.area(p).alias("_a"), G.length(p).alias("_l"), G.bbox(p).alias("_b"), G.vertex_count(p).alias("_n"), *around))
    a, l, b, h = (F.col(c) for c in ("_a", "_l", "_b", "_h"))
    width, height = b.maxx - b.minx, b.maxy - b.miny
    center = G.centroid(p)
    of_hull = []
    if hull:
        base = fence(base.withColumns({"_ha": F.coalesce(G.edges_area(h), F.lit(0.0)), "_hl": G.edges_length(h)}).drop("_h"))
        ha, hl = F.col("_ha"), F.col("_hl")
        of_hull = [(ha / 10000).alias("convex_hull_area_ha"), (hl / 1000).alias("convex_hull_perimeter_km"), G.ratio(a, ha, 0.0).alias("solidity"), G.ratio(hl, l, 0.0).alias("convexity")]
    return base.select(
        *keep, (a / 10000).alias("area_ha"), (l / 1000).alias("perimeter_km"), G.compactness(a, l).alias("compactness"), G.elongation(width, height).alias("elongation"), *of_hull,
        F.col("_n").alias("n_vertices"), (width * height / 10000).alias("bbox_area_ha"), G.ratio(a, width * height, 0.0).alias("bbox_fill_ratio"), width.alias("bbox_width_m"), height.alias("bbox_height_m"),
        center.x.alias("centroid_x"), center.y.alias("centroid_y"), F.when(a > 0, F.try_divide(l, F.sqrt(a))).otherwise(0.0).alias("edge_density"),
        b.minx.alias("minx"), b.miny.alias("miny"), b.maxx.alias("maxx"), b.maxy.alias("maxy"),
    )


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry_features(views.parcels(spark, sf_dir), ["field_id"])


def _without_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry_features(views.parcels(spark, sf_dir), ["field_id"], hull=False)


_HULL = {"convex_hull_area_ha", "convex_hull_perimeter_km", "solidity", "convexity"}
for _name, _columns in {
    "geom_features": FEATURES, "geom_area": "area_ha:d", "geom_perimeter": "perimeter_km:d", "geom_compactness": "compactness:d", "geom_elongation": "elongation:d",
    "geom_bbox": "minx:d miny:d maxx:d maxy:d bbox_width_m:d bbox_height_m:d bbox_area_ha:d", "geom_bbox_fill": "bbox_fill_ratio:d", "geom_hull": "convex_hull_area_ha:d convex_hull_perimeter_km:d",
    "geom_solidity": "solidity:d", "geom_convexity": "convexity:d", "geom_vertices": "n_vertices:i", "geom_centroid": "centroid_x:d centroid_y:d", "geom_edge_density": "edge_density:d",
}.items():
    register(_name, f"field_id:i {_columns}", f"{views.G_SQL} --SELECT * FROM g")(_features if _HULL & {c.split(":")[0] for c in _columns.split()} else _without_hull)


def _series(coefficients: tuple[float, ...], xi: str, eta: str, trig: str, hyper: str, sign: str) -> str:
    return "".join(f" {sign} {a!r} * {trig}({2 * j} * {xi}) * {hyper}({2 * j} * {eta})" for j, a in enumerate(coefficients, 1))


_E = repr(crs.ECCENTRICITY)
_LONLAT = "q AS (SELECT p_partkey AS field_id, -115.6::DOUBLE + (p_partkey % 50) * 0.004::DOUBLE AS lon, 33::DOUBLE + (p_partkey // 50) * 0.004::DOUBLE AS lat FROM part)"
_FORWARD = f"""{_LONLAT}, t0 AS (SELECT *, sin(radians(lat)) AS s, radians(lon - {crs.central_meridian(11)}) AS lam FROM q), t1 AS (SELECT *, sinh(atanh(s) - {_E} * atanh({_E} * s)) AS t FROM t0),
t2 AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t1)
--SELECT field_id, {crs.FALSE_EASTING} + {crs.SCALE * crs.RADIUS!r} * (eta{_series(crs.ALPHA, 'xi', 'eta', 'cos', 'sinh', '+')}) AS easting, {crs.SCALE * crs.RADIUS!r} * (xi{_series(crs.ALPHA, 'xi', 'eta', 'sin', 'cosh', '+')}) AS northing FROM t2"""


def _point(k: Column) -> tuple[Column, Column]:
    return F.lit(-115.6) + (k % 50) * 0.004, F.lit(33.0) + F.floor(k / 50) * 0.004


@register("utm_project", "field_id:i easting:d3 northing:d3", _FORWARD)
def utm_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = views.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("field_id"))
    x, y = crs.to_utm(*_point(F.col("field_id")))
    return part.select("field_id", x.alias("easting"), y.alias("northing"))


def _newton(i: int) -> str:
    e2 = repr(crs.ECCENTRICITY**2)
    return (
        f"n{i} AS (SELECT *, tau{i - 1} + (want - have) / sqrt(1 + have * have) * (1 + (1 - {e2}) * tau{i - 1} * tau{i - 1}) / ((1 - {e2}) * root) AS tau{i} FROM "
        f"(SELECT * EXCLUDE (have, root), sqrt(1 + tau{i - 1} * tau{i - 1}) AS root, tau{i - 1} * sqrt(1 + sg * sg) - sg * sqrt(1 + tau{i - 1} * tau{i - 1}) AS have FROM "
        f"(SELECT *, sinh({_E} * atanh({_E} * tau{i - 1} / sqrt(1 + tau{i - 1} * tau{i - 1}))) AS sg FROM (SELECT * EXCLUDE (sg) FROM n{i - 1}))))"
    )


_INVERSE = f"""q AS (SELECT p_partkey AS field_id, (100000 + (p_partkey % 50) * 16000)::DOUBLE AS x, (3000000 + (p_partkey // 50) * 4000)::DOUBLE AS y FROM part),
t0 AS (SELECT field_id, y / {crs.SCALE * crs.RADIUS!r} AS xi, (x - {crs.FALSE_EASTING}) / {crs.SCALE * crs.RADIUS!r} AS eta FROM q),
t1 AS (SELECT field_id, xi{_series(crs.BETA, 'xi', 'eta', 'sin', 'cosh', '-')} AS a, eta{_series(crs.BETA, 'xi', 'eta', 'cos', 'sinh', '-')} AS b FROM t0),
n0 AS (SELECT *, want AS tau0, 0.0::DOUBLE AS sg, 0.0::DOUBLE AS have, 0.0::DOUBLE AS root FROM (SELECT *, sin(a) / sqrt(sinh(b) * sinh(b) + cos(a) * cos(a)) AS want FROM t1)), {', '.join(_newton(i) for i in (1, 2, 3, 4))}
--SELECT field_id, degrees(atan2(sinh(b), cos(a))) + {crs.central_meridian(11)} AS lon, degrees(atan(tau4)) AS lat FROM n4"""


@register("utm_inverse", "field_id:i lon:d8 lat:d8", _INVERSE)
def utm_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    x, y = (100000 + (k % 50) * 16000).cast("double"), (3000000 + F.floor(k / 50) * 4000).cast("double")
    lon, lat = crs.from_utm(x, y)
    return views.read(spark, sf_dir, "part").select(k.alias("field_id"), lon.alias("lon"), lat.alias("lat"))


_NEXT = f"{views.G_SQL}, {views.V}, {views.SEG}, pr AS (SELECT a.field_id, a.centroid_x AS px, a.centroid_y AS py, b.field_id AS other, b.centroid_x AS qx, b.centroid_y AS qy FROM g a JOIN g b ON b.field_id = a.field_id + 1)"
#: Distance from (px, py) to the edges of ``other``, 0 inside.
DISTANCE = """d AS (SELECT pr.field_id, pr.other, CASE WHEN sum(CASE WHEN (ay > py) <> (by_ > py) AND px < ax + (py - ay) * (bx - ax) / nullif(by_ - ay, 0) THEN 1 ELSE 0 END) % 2 = 1 THEN 0.0 ELSE
 min(sqrt((px - ax - t * (bx - ax)) * (px - ax - t * (bx - ax)) + (py - ay - t * (by_ - ay)) * (py - ay - t * (by_ - ay)))) END AS dist FROM (SELECT pr.*, seg.* EXCLUDE (field_id, crop_type),
 greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) AS t FROM pr JOIN seg ON seg.field_id = pr.other) pr GROUP BY ALL)"""


def _with_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.parcels(spark, sf_dir).select("field_id", "polygons", G.centroid(F.col("polygons")).alias("c"))
    return rows.alias("a").join(rows.select((F.col("field_id") - 1).alias("field_id"), F.col("polygons").alias("other"), F.col("c").alias("oc")), "field_id")


@register("dist_point_polygon", "field_id:i dist:d", f"{_NEXT}, {DISTANCE} --SELECT field_id, dist FROM d")
def dist_point_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_next(spark, sf_dir).select("field_id", G.point_polygon_distance(F.col("c"), F.col("other")).alias("dist"))


@register("dist_centroids", "field_id:i dist:d", f"{_NEXT} --SELECT field_id, sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy)) AS dist FROM pr")
def dist_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_next(spark, sf_dir).select("field_id", F.hypot(F.col("c.x") - F.col("oc.x"), F.col("c.y") - F.col("oc.y")).alias("dist"))


_BOXES = f"""{_LONLAT}, c AS (SELECT field_id, i, lon + dx AS lon, lat + dy AS lat FROM q, (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE), (1, 0.004, 0.0), (2, 0.004, 0.003), (3, 0.0, 0.003), (4, 0.0, 0.0)) k(i, dx, dy)),
t0 AS (SELECT *, sin(radians(lat)) AS s, radians(lon - {crs.central_meridian(11)}) AS lam FROM c), t1 AS (SELECT *, sinh(atanh(s) - {_E} * atanh({_E} * s)) AS t FROM t0),
t2 AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t1),
u AS (SELECT field_id, i, {crs.FALSE_EASTING} + {crs.SCALE * crs.RADIUS!r} * (eta{_series(crs.ALPHA, 'xi', 'eta', 'cos', 'sinh', '+')}) AS x, {crs.SCALE * crs.RADIUS!r} * (xi{_series(crs.ALPHA, 'xi', 'eta', 'sin', 'cosh', '+')}) AS y FROM t2)
--SELECT a.field_id, abs(sum((a.x - o.x) * (b.y - o.y) - (b.x - o.x) * (a.y - o.y))) / 20000 AS area_ha, sum(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) / 1000 AS perimeter_km
FROM u a JOIN u b ON a.field_id = b.field_id AND b.i = a.i + 1 JOIN u o ON o.field_id = a.field_id AND o.i = 0 GROUP BY a.field_id"""


@register("utm_polygons", "field_id:i area_ha:d4 perimeter_km:d", _BOXES)
def utm_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in longitude and latitude, projected as geometries and measured in metres."""
    k = F.col("p_partkey")
    lon, lat = _point(k)
    box = G.ring([(lon + dx, lat + dy) for dx, dy in ((0.0, 0.0), (0.004, 0.0), (0.004, 0.003), (0.0, 0.003))])
    planar = fence(spread(views.read(spark, sf_dir, "part"), "p_partkey").select(k.alias("field_id"), crs.project(F.array(F.array(box))).alias("polygons")))
    return geometry_features(planar, ["field_id"], hull=False)


@register("crs_two_systems", "field_id:i area_ha:d4 perimeter_km:d", _BOXES)
def crs_two_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of ``utm_polygons``, of which every other one comes in metres of the zone to the east; both are brought to one zone."""
    k = F.col("p_partkey")
    lon, lat = _point(k)
    corners = [(lon + dx, lat + dy) for dx, dy in ((0.0, 0.0), (0.004, 0.0), (0.004, 0.003), (0.0, 0.003))]
    part = spread(views.read(spark, sf_dir, "part"), "p_partkey")
    degrees = part.where(k % 2 == 0).select(k.alias("field_id"), F.array(F.array(G.ring(corners))).alias("polygons"))  # without a system: assigned
    metres = part.where(k % 2 == 1).select(k.alias("field_id"), crs.project(F.array(F.array(G.ring(corners))), 12).alias("polygons", metadata={"srid": crs.NORTH + 12}))
    both = fence(crs.planar(fence(degrees)).unionByName(crs.planar(metres)))
    return geometry_features(both, ["field_id"], hull=False)


def _exact_sql(x: str, digits: int) -> str:
    """By the digits of the double's whole decimal expansion."""
    return f"""(SELECT (c::BIGINT + CASE WHEN rest > five OR (rest = five AND c::BIGINT % 2 = 1) THEN 1 ELSE 0 END) / 1e{digits} FROM
 (SELECT regexp_replace(s, '^(.*)[.](.{{{digits}}}).*$', '\\1\\2') AS c, regexp_replace(s, '^.*[.].{{{digits}}}', '') AS rest, rpad('5', {40 - digits}, '0') AS five FROM (SELECT printf('%.40f', {x}) AS s)))"""


_NUMBERS = "n AS (SELECT p_partkey AS field_id, (p_partkey % 4000) / 8.0::DOUBLE AS tie, (p_partkey % 100000 * 10 + 5) / 1000.0::DOUBLE AS near FROM part)"


@register(
    "rounded_features", "field_id:i exact_tie:d exact_near:d scaled_tie:d scaled_near:d",
    f"{_NUMBERS} --SELECT field_id, {_exact_sql('tie', 2)} AS exact_tie, {_exact_sql('near', 2)} AS exact_near, round_even(tie * 100, 0) / 100 AS scaled_tie, round_even(near * 100, 0) / 100 AS scaled_near FROM n",
)
def rounded_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in the middle between two of two digits, exactly or nearly so, rounded by either rule."""
    k = F.col("p_partkey")
    tie, near = (k % 4000) / F.lit(8.0), (k % 100000 * 10 + 5) / F.lit(1000.0)
    return views.read(spark, sf_dir, "part").select(
        k.alias("field_id"), rounding.exact(tie, 2).alias("exact_tie"), rounding.exact(near, 2).alias("exact_near"), rounding.scaled(tie, 2).alias("scaled_tie"), rounding.scaled(near, 2).alias("scaled_near"),
    )


@register("geojson_scan", "field_id:i crop_type:s area_ha:d n_vertices:i", f"{views.G_SQL} --SELECT field_id, crop_type, area_ha, n_vertices FROM g")
def geojson_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels written as feature collections, which are then read in splits and measured."""
    folder = f"{views.scratch(spark)}/parcels"
    collection.write(views.parcels(spark, sf_dir).select("field_id", "crop_type", "polygons"), folder)
    found = source.read_geojson(spark, folder, "field_id LONG, crop_type STRING")
    return geometry_features(found, ["field_id", "crop_type"], hull=False)
