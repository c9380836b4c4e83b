"""Neighbourhoods, adjacency and what is computed from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.functions import geometry as G
from parcelforge.functions import overlay as O
from parcelforge.functions.fence import fence, share
from parcelforge.operators import spatial as S
from parcelforge.operators import stats

from . import views
from .geometry_queries import DISTANCE
from .registry import register


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.measured(views.parcels(spark, sf_dir), "field_id", ["crop_type"])


def shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``measured``, for plans that use it many times."""
    return share(measured(spark, sf_dir), "id")


_G = views.G_SQL
_MEET = "a.minx - {r} <= b.maxx AND a.maxx + {r} >= b.minx AND a.miny - {r} <= b.maxy AND a.maxy + {r} >= b.miny"
_CAND = f"{_G}, cand AS (SELECT a.field_id AS src, b.field_id AS dst, a.centroid_x AS px, a.centroid_y AS py FROM g a JOIN g b ON a.field_id <> b.field_id AND {_MEET.format(r=1000)})"
_NEAR = f"{_G}, near AS (SELECT a.field_id AS src, b.field_id AS dst, b.crop_type AS crop, b.area_ha AS ha, sqrt((a.centroid_x - b.centroid_x) ** 2 + (a.centroid_y - b.centroid_y) ** 2) AS distance_m FROM g a JOIN g b ON a.field_id <> b.field_id AND sqrt((a.centroid_x - b.centroid_x) ** 2 + (a.centroid_y - b.centroid_y) ** 2) <= 500)"
_STATS = f"""{_NEAR}, cc AS (SELECT src, crop, count(*) AS n, sum(ha) AS ha FROM near GROUP BY ALL), nb AS (SELECT src, sum(n) AS n, sum(ha) AS ha, first(crop ORDER BY n DESC, crop) AS crop FROM cc GROUP BY src),
 en AS (SELECT cc.src, -sum(cc.n / nb.n * log2(cc.n / nb.n)) AS h FROM cc JOIN nb USING (src) GROUP BY cc.src),
 ns AS (SELECT g.field_id AS id, coalesce(nb.n, 0) AS n_neighbors_500m, coalesce(nb.ha / nb.n, 0) AS neighbor_mean_area_ha, coalesce(nb.ha, 0) AS neighbor_sum_area_ha, coalesce(nb.crop, 'isolated') AS dominant_neighbor_crop,
 1.0::DOUBLE / (1 + coalesce(nb.n, 0)) AS fragmentation_index, coalesce(h, 0) AS "local_crop_diversity_H" FROM g LEFT JOIN nb ON nb.src = g.field_id LEFT JOIN en ON en.src = g.field_id)"""
_DIST = DISTANCE.replace("pr.field_id, pr.other", "pr.src, pr.dst").replace("seg.field_id = pr.other", "seg.field_id = pr.dst").replace("FROM pr JOIN", "FROM cand pr JOIN")
_NEAREST = f"{_CAND}, {views.V}, {views.SEG}, {_DIST}, nn AS (SELECT g.field_id AS id, coalesce(min(dist), 0) AS dist_to_nearest_m FROM g LEFT JOIN d ON d.src = g.field_id GROUP BY g.field_id)"


def _pd(px: str, py: str, s: str) -> str:
    t = f"greatest(0, least(1, (({px} - {s}.ax) * ({s}.bx - {s}.ax) + ({py} - {s}.ay) * ({s}.by_ - {s}.ay)) / (({s}.bx - {s}.ax) ** 2 + ({s}.by_ - {s}.ay) ** 2)))"
    return f"sqrt(({px} - {s}.ax - {t} * ({s}.bx - {s}.ax)) ** 2 + ({py} - {s}.ay - {t} * ({s}.by_ - {s}.ay)) ** 2)"




def _run(s: str, t: str) -> str:
    """How much of the edge ``t`` lies beside ``s``, within half a metre."""
    size = f"sqrt(({s}.bx - {s}.ax) ** 2 + ({s}.by_ - {s}.ay) ** 2)"
    ends = (f"{t}.ax", f"{t}.ay"), (f"{t}.bx", f"{t}.by_")
    along = [f"((({x} - {s}.ax) * ({s}.bx - {s}.ax) + ({y} - {s}.ay) * ({s}.by_ - {s}.ay)) / {size})" for x, y in ends]
    aside = [f"((({y} - {s}.ay) * ({s}.bx - {s}.ax) - ({x} - {s}.ax) * ({s}.by_ - {s}.ay)) / {size})" for x, y in ends]

    def span(first: str, last: str, low: str, high: str) -> tuple[str, str]:
        cuts = [f"({limit} - {first}) / nullif({last} - {first}, 0)" for limit in (low, high)]
        return f"coalesce(least({', '.join(cuts)}), CASE WHEN {first} BETWEEN {low} AND {high} THEN 0 ELSE 2 END)", f"coalesce(greatest({', '.join(cuts)}), 1)"

    (from_a, to_a), (from_b, to_b) = span(*along, "0", size), span(*aside, "-0.5", "0.5")
    return f"greatest(0, least(1, {to_a}, {to_b}) - greatest(0, {from_a}, {from_b})) * sqrt(({t}.bx - {t}.ax) ** 2 + ({t}.by_ - {t}.ay) ** 2)"


_LEVEL = "abs((s.bx - s.ax) * (t.by_ - t.ay) - (s.by_ - s.ay) * (t.bx - t.ax)) <= 0.1 * sqrt((s.bx - s.ax) ** 2 + (s.by_ - s.ay) ** 2) * sqrt((t.bx - t.ax) ** 2 + (t.by_ - t.ay) ** 2)"
_TURN = "sign(({q}.bx - {q}.ax) * ({p} - {q}.ay) - ({q}.by_ - {q}.ay) * ({o} - {q}.ax))"
_CROSS = "({}) * ({}) < 0 AND ({}) * ({}) < 0".format(*(_TURN.format(q=q, o=f"{o}.{e}x", p=f"{o}.{f}") for q, o in (("s", "t"), ("t", "s")) for e, f in (("a", "ay"), ("b", "by_"))))
#: Pairs of fields (g) and what their edges (seg) have in common; ``{near}`` says which of them are adjacent.
_PAIRS = """half AS (SELECT a.field_id AS src, b.field_id AS dst, a.crop_type AS src_crop, b.crop_type AS dst_crop FROM g a JOIN g b ON a.field_id < b.field_id AND """ + _MEET.format(r=0.5) + f"""),
 sp AS (SELECT src, dst, src_crop, dst_crop, {_CROSS} AS crosses, CASE WHEN {_CROSS} THEN 0 ELSE least({_pd('s.ax', 's.ay', 't')}, {_pd('s.bx', 's.by_', 't')}, {_pd('t.ax', 't.ay', 's')}, {_pd('t.bx', 't.by_', 's')}) END AS dist,
 CASE WHEN {_LEVEL} THEN ({_run('s', 't')} + {_run('t', 's')}) / 2 ELSE 0 END AS shared
 FROM half JOIN seg s ON s.field_id = src JOIN seg t ON t.field_id = dst)"""
_ADJ = f"""{_G}, {views.V}, {views.SEG}, {_PAIRS},
 ed AS (SELECT src, dst, src_crop, dst_crop, sum(shared) AS shared_length_m FROM sp GROUP BY ALL HAVING min(dist) <= 0.5),
 sy AS (SELECT * FROM ed UNION ALL SELECT dst, src, dst_crop, src_crop, shared_length_m FROM ed),
 tp AS (SELECT g.field_id AS id, count(src) AS n_adjacent_fields, coalesce(sum(shared_length_m), 0) AS total_shared_length_m, coalesce(avg(shared_length_m), 0) AS mean_shared_length_m, coalesce(max(shared_length_m), 0) AS max_shared_length_m,
 (count(src) = 0)::INT AS is_isolated, count(src) AS adjacency_degree, count(*) FILTER (src_crop = dst_crop) AS shared_crop_count, count(*) FILTER (src_crop <> dst_crop) AS different_crop_count FROM g LEFT JOIN sy ON sy.src = g.field_id GROUP BY g.field_id)"""


def _points_in(points: str, own: str, other: str) -> str:
    """Pairs, with each point of ``other``: whether it is inside ``own``, and how far from its edges."""
    parity = "sum(((s.ay > c.y) <> (s.by_ > c.y) AND c.x < s.ax + (c.y - s.ay) * (s.bx - s.ax) / nullif(s.by_ - s.ay, 0))::INT) % 2 = 1"
    return f"SELECT src, dst, {parity} AS inside, min({_pd('c.x', 'c.y', 's')}) AS off FROM half JOIN {points} c ON c.field_id = {other} JOIN seg s ON s.field_id = {own} GROUP BY src, dst, c.x, c.y"


_MIXED = f"""{views.MIXED_SQL}, {_PAIRS}, pin AS ({_points_in('fc', 'src', 'dst')} UNION ALL {_points_in('fc', 'dst', 'src')}),
 cin AS ({_points_in('(SELECT DISTINCT field_id, x, y FROM v)', 'src', 'dst')} UNION ALL {_points_in('(SELECT DISTINCT field_id, x, y FROM v)', 'dst', 'src')}),
 ed AS (SELECT src, dst, src_crop, dst_crop, sum(shared) AS shared_length_m, bool_or(crosses) OR (src, dst) IN (SELECT (src, dst) FROM cin WHERE inside AND off > 1e-6) AS overlap FROM sp GROUP BY src, dst, src_crop, dst_crop
 HAVING min(dist) <= 0.5 OR (src, dst) IN (SELECT (src, dst) FROM pin WHERE inside))"""


@register("candidate_pairs", "src:i dst:i", f"{_CAND} --SELECT src, dst FROM cand")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measured(spark, sf_dir).select("id", "box")
    return S.pairs(m, m, 1000.0, 1000.0).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"))


@register("neighbors_500m", "src:i dst:i distance_m:d", f"{_NEAR} --SELECT * FROM near")
def neighbors_500m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.neighbours(measured(spark, sf_dir)).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"), "distance_m")


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.neighbour_stats(measured(spark, sf_dir))


for _name, _columns in {"neighbor_stats": "n_neighbors_500m:i neighbor_mean_area_ha:d neighbor_sum_area_ha:d", "dominant_crop": "dominant_neighbor_crop:s", "crop_entropy": "local_crop_diversity_H:d", "fragmentation": "fragmentation_index:d"}.items():
    register(_name, f"id:i {_columns}", f"{_STATS} --SELECT * FROM ns")(_stats)


@register("filter_isolated", "id:i", f"{_STATS} --SELECT id FROM ns WHERE n_neighbors_500m = 0")
def filter_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir).where("n_neighbors_500m = 0")


@register("nearest_neighbor", "id:i dist_to_nearest_m:d", f"{_NEAREST} --SELECT * FROM nn")
def nearest_neighbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.nearest(measured(spark, sf_dir))


_CONTEXT = "id:i dist_to_nearest_m:d n_neighbors_500m:i neighbor_mean_area_ha:d neighbor_sum_area_ha:d dominant_neighbor_crop:s edge_density:d fragmentation_index:d local_crop_diversity_H:d"


@register("context_features", _CONTEXT, f"{_NEAREST}, {_STATS[len(_G) + 2:]} --SELECT ns.*, dist_to_nearest_m, edge_density FROM ns JOIN nn USING (id) JOIN g ON g.field_id = id")
def context_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context(shared(spark, sf_dir))


def context(m: DataFrame) -> DataFrame:
    """Distance to the nearest field, neighbours within the radius, and edge density, of measured fields."""
    p = F.col("polygons")
    density = m.select("id", F.when(G.area(p) > 0, F.try_divide(G.length(p), F.sqrt(G.area(p)))).otherwise(0.0).alias("edge_density"))
    return S.nearest(m).join(S.neighbour_stats(m), "id").join(density, "id")


@register("adjacency_candidates", "src:i dst:i", f"{_ADJ} --SELECT src, dst FROM half")
def adjacency_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measured(spark, sf_dir).select("id", "box")
    return S.pairs(m, m, S.TOLERANCE, 1000.0, half=True).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.adjacency(shared(spark, sf_dir))


register("adjacency_edges", "src:i dst:i src_crop:s dst_crop:s", f"{_ADJ} --SELECT * FROM ed")(_edges)
register("shared_boundary", "src:i dst:i shared_length_m:d", f"{_ADJ} --SELECT * FROM ed WHERE shared_length_m > 0")(lambda spark, sf_dir: _edges(spark, sf_dir).where("shared_length_m > 0"))
register("adjacency_symmetric", "src:i dst:i shared_length_m:d", f"{_ADJ} --SELECT * FROM sy")(lambda spark, sf_dir: S.symmetric(_edges(spark, sf_dir)))


def _topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = shared(spark, sf_dir)
    return S.topology(m, S.symmetric(S.adjacency(m)))


for _name, _columns in {
    "topology_features": "n_adjacent_fields:i total_shared_length_m:d mean_shared_length_m:d max_shared_length_m:d is_isolated:i adjacency_degree:i shared_crop_count:i different_crop_count:i",
    "adjacency_degree": "n_adjacent_fields:i adjacency_degree:i", "shared_length_stats": "total_shared_length_m:d mean_shared_length_m:d max_shared_length_m:d",
    "crop_match_counts": "shared_crop_count:i different_crop_count:i", "is_isolated": "is_isolated:i",
}.items():
    register(_name, f"id:i {_columns}", f"{_ADJ} --SELECT * FROM tp")(_topology)


@register("network_stats", "n_fields:i n_connected:i n_isolated:i connected_pct:d n_pairs:i max_degree:i", f"{_ADJ} --SELECT count(*) AS n_fields, count(*) FILTER (n_adjacent_fields > 0) AS n_connected, count(*) FILTER (n_adjacent_fields = 0) AS n_isolated, 100.0::DOUBLE * count(*) FILTER (n_adjacent_fields > 0) / count(*) AS connected_pct, sum(n_adjacent_fields) / 2 AS n_pairs, max(n_adjacent_fields) AS max_degree FROM tp")
def network_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.network(_topology(spark, sf_dir))


@register("adjacency_matrix", "src:i dst:i shared_length_m:d row_sum_m:d", f"{_ADJ}, rs AS (SELECT src, sum(shared_length_m) AS row_sum_m FROM sy GROUP BY src HAVING sum(shared_length_m) > 0) --SELECT sy.src, sy.dst, shared_length_m, row_sum_m FROM sy JOIN rs ON rs.src = sy.src WHERE sy.dst IN (SELECT src FROM rs) AND shared_length_m > 0")
def adjacency_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.matrix(S.symmetric(_edges(spark, sf_dir)))


@register("most_connected", "name:s field_id:i", f"{_ADJ} --SELECT 'most_connected' AS name, id AS field_id FROM tp ORDER BY n_adjacent_fields DESC, id LIMIT 1")
def most_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _topology(spark, sf_dir).select(F.col("id").alias("field_id"), "n_adjacent_fields")
    return stats.notable(found, "field_id", {"most_connected": ("n_adjacent_fields", True)})


@register("adjacency_mixed", "src:i dst:i shared_length_m:d overlap:i src_crop:s dst_crop:s", f"{_MIXED} --SELECT * FROM ed")
def adjacency_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields with holes, of several polygons, inside each other and overlapping."""
    return S.adjacency(S.measured(views.mixed_parcels(spark, sf_dir), "field_id", ["crop_type"]), overlaps=True).withColumnRenamed("overlaps", "overlap")


def _irregular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.measured(views.placed(spark, sf_dir, views.IRREGULAR), "field_id", ["crop_type"])


_ODD = f"""{views.placed_sql(views.IRREGULAR)}, {_PAIRS}, ed AS (SELECT src, dst, src_crop, dst_crop, sum(shared) AS shared_length_m, min(dist) AS dist FROM sp GROUP BY src, dst, src_crop, dst_crop), ov_ AS (WITH """ + views.overlay_sql(views.IRREGULAR) + """ SELECT * FROM f2)"""


@register("adjacency_irregular", "src:i dst:i shared_length_m:d overlap:i src_crop:s dst_crop:s", f"{_ODD} --SELECT ed.*, coalesce(area, 0) > 1e-6 AS overlap FROM ed LEFT JOIN ov_ USING (src, dst) WHERE dist <= 0.5 OR area > 1e-6")
def adjacency_irregular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tilted, crossing and touching fields, and such as have sides in common with what they overlap."""
    return S.adjacency(_irregular(spark, sf_dir), overlaps=True).withColumnRenamed("overlaps", "overlap")


@register("filter_isolated_irregular", "id:i", f"""{views.placed_sql(views.IRREGULAR)}, mo AS (SELECT field_id, sum((ax - o.x) * (by_ - o.y) - (bx - o.x) * (ay - o.y)) AS a2, sum((ax + bx - 2 * o.x) * ((ax - o.x) * (by_ - o.y) - (bx - o.x) * (ay - o.y))) AS mx,
 sum((ay + by_ - 2 * o.y) * ((ax - o.x) * (by_ - o.y) - (bx - o.x) * (ay - o.y))) AS my, any_value(o.x) AS x, any_value(o.y) AS y FROM seg JOIN fc o USING (field_id) GROUP BY field_id), ce AS (SELECT field_id, x + mx / (3 * a2) AS cx, y + my / (3 * a2) AS cy FROM mo)
--SELECT field_id AS id FROM ce a WHERE NOT EXISTS (SELECT 1 FROM ce b WHERE a.field_id <> b.field_id AND sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) <= 500)""")
def filter_isolated_irregular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields without a neighbour; one on each site has none."""
    return S.neighbour_stats(_irregular(spark, sf_dir)).where("n_neighbors_500m = 0")


_LENGTH = "CASE WHEN line > 1e-6 THEN line WHEN area > 1e-6 THEN perimeter ELSE 0.01 END"
for _name, _shapes in {"intersection_measures": views.MIXED, "intersection_irregular": views.IRREGULAR}.items():
    register(
        _name, "src:i dst:i area_m2:d4 perimeter_m:d line_m:d length_m:d",
        f"{views.overlay_sql(_shapes)} --SELECT src, dst, area AS area_m2, perimeter AS perimeter_m, line AS line_m, {_LENGTH} AS length_m FROM f2 WHERE area > 1e-6 OR line > 1e-6 OR gap <= 1e-6",
    )(lambda spark, sf_dir, shapes=_shapes: S.intersections(S.measured(views.placed(spark, sf_dir, shapes), "field_id", ["crop_type"])))

for _name, _shapes in {"adjacency_buffered": views.MIXED, "adjacency_buffered_irregular": views.IRREGULAR}.items():
    register(
        _name, "src:i dst:i shared_length_m:d overlap_m2:d4 src_crop:s dst_crop:s",
        f"{views.overlay_sql(_shapes, 0.25)} --SELECT src, dst, perimeter AS shared_length_m, area AS overlap_m2, src_crop, dst_crop FROM f2 WHERE area > 1e-6",
    )(lambda spark, sf_dir, shapes=_shapes: S.buffered_adjacency(S.boxed(views.placed(spark, sf_dir, shapes), "field_id", ["crop_type"])))


_PLAIN = [[[c]] for c in views.SHAPES]
_WIDE = 25.0


@register("buffer_polygons", "field_id:i area_m2:d4 perimeter_m:d n_points:i", f"{views.rings_sql(_PLAIN, _WIDE)}, bf AS (SELECT shape, sum(ax * by_ - bx * ay) / 2 AS area_m2, sum(sqrt((bx - ax) ** 2 + (by_ - ay) ** 2)) AS perimeter_m, count(*) AS n_points FROM rg GROUP BY shape) --SELECT p_partkey AS field_id, area_m2, perimeter_m, n_points FROM part JOIN bf ON shape = p_partkey % 4")
def buffer_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels grown by a disc, as geometries, measured."""
    grown = fence(views.parcels(spark, sf_dir).select("field_id", O.buffer(F.col("polygons"), _WIDE).alias("polygons")))
    p = F.col("polygons")
    return grown.select("field_id", G.area(p).alias("area_m2"), G.length(p).alias("perimeter_m"), G.vertex_count(p).alias("n_points"))


_SIZED = f"""{views.placed_sql(views.SIZES)}, gb AS (SELECT field_id, CASE WHEN field_id % 997 = 0 THEN {views.EAST + views.GIANT[0][0][0][0]} ELSE minx END AS minx, CASE WHEN field_id % 997 = 0 THEN {views.EAST + views.GIANT[0][0][2][0]} ELSE maxx END AS maxx,
 CASE WHEN field_id % 997 = 0 THEN {views.GIANT[0][0][0][1]} ELSE miny END AS miny, CASE WHEN field_id % 997 = 0 THEN {views.GIANT[0][0][2][1]} ELSE maxy END AS maxy FROM g)"""


@register("candidate_pairs_sizes", "src:i dst:i", f"{_SIZED} --SELECT a.field_id AS src, b.field_id AS dst FROM gb a JOIN gb b ON a.field_id < b.field_id AND {_MEET.format(r=100)}")
def candidate_pairs_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from 10 m to 100 km, at most 100 m apart: by a grid of several levels."""
    m = views.sized_parcels(spark, sf_dir).select(F.col("field_id").alias("id"), G.bbox(F.col("polygons")).alias("box"))
    return S.pairs(m, m, 100.0, 100.0, half=True).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"))


_CHOSEN = [1, 2, 3, 4, 5]
_DM = f"{_G}, ch AS (SELECT * FROM g WHERE field_id BETWEEN 1 AND 5), pw AS (SELECT a.field_id AS src, b.field_id AS dst, sqrt((a.centroid_x - b.centroid_x) ** 2 + (a.centroid_y - b.centroid_y) ** 2) AS d FROM ch a CROSS JOIN ch b)"


def _chosen_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances among a fixed handful of fields."""
    few = measured(spark, sf_dir).where(F.col("id").isin(_CHOSEN)).select("id", "center")
    a, b = few.select(F.col("id").alias("src"), F.col("center").alias("p")), few.select(F.col("id").alias("dst"), F.col("center").alias("q"))
    return a.join(F.broadcast(b)).select("src", "dst", F.hypot(F.col("p.x") - F.col("q.x"), F.col("p.y") - F.col("q.y")).alias("d"))


@register("distance_matrix", "src:i " + " ".join(f"f{i}:d" for i in _CHOSEN), f"{_DM} --SELECT src, " + ", ".join(f"max(d) FILTER (dst = {i}) AS f{i}" for i in _CHOSEN) + " FROM pw GROUP BY src")
def distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chosen_pairs(spark, sf_dir).groupBy("src").pivot("dst", _CHOSEN).agg(F.first("d")).withColumnsRenamed({str(i): f"f{i}" for i in _CHOSEN})


@register("nearest_in_matrix", "src:i nearest:i d:d", f"{_DM} --SELECT src, first(dst ORDER BY round(d, 9), dst) AS nearest, min(d) AS d FROM pw WHERE src <> dst GROUP BY src")
def nearest_in_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chosen_pairs(spark, sf_dir).where("src <> dst")
    return rows.groupBy("src").agg(F.min_by("dst", F.struct(F.round("d", 9), "dst")).alias("nearest"), F.min("d").alias("d"))


@register("focus_neighbor_count", "radius:i n:i", f"{_G} --SELECT r.radius, count(*) FILTER (sqrt((g.centroid_x - c.centroid_x) ** 2 + (g.centroid_y - c.centroid_y) ** 2) <= r.radius) AS n FROM g, (SELECT * FROM g WHERE field_id = 53) c, (VALUES (500), (1000), (2000)) r(radius) WHERE g.field_id <> 53 GROUP BY r.radius")
def focus_neighbor_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measured(spark, sf_dir).select("id", "center")
    focus = m.where("id = 53").select(F.col("center").alias("c"))
    d = F.hypot(F.col("center.x") - F.col("c.x"), F.col("center.y") - F.col("c.y"))
    radii = (500, 1000, 2000)
    one = m.where("id <> 53").join(F.broadcast(focus)).agg(*(F.count_if(d <= r).alias(str(r)) for r in radii))
    return one.select(F.explode(F.array(*(F.struct(F.lit(r).alias("radius"), F.col(str(r)).alias("n")) for r in radii))).alias("x")).select("x.*")
