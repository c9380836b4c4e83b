"""Neighbourhood and adjacency by grid joins: an equi-join on cells, then the exact predicate. No theta join, no driver loop.

Rows are copied to the cells that they cover or can reach, and every pair is taken in one cell only. Dense cells are skewed
join keys, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.functions import between as B
from parcelforge.functions import geometry as G
from parcelforge.functions import overlay as O
from parcelforge.functions.fence import fence

RADIUS, TOLERANCE = 500.0, 0.5


def measured(fields: DataFrame, key: str, carry: list[str]) -> DataFrame:
    """Measures that both sides of a join need, computed once a row and not once a pair."""
    p = F.col("polygons")
    return fence(fields.select(F.col(key).alias("id"), *carry, p, G.centroid(p).alias("center"), G.bbox(p).alias("box"), (G.area(p) / 10000).alias("geometry_ha")))


def boxed(fields: DataFrame, key: str, carry: list[str]) -> DataFrame:
    """What of ``measured`` a join of polygons needs."""
    return fence(fields.select(F.col(key).alias("id"), *carry, "polygons", G.bbox(F.col("polygons")).alias("box")))


def _extent() -> Column:
    """The power of two that no side of the row's box is longer than."""
    return F.ceil(F.log2(F.greatest(F.col("box.maxx") - F.col("box.minx"), F.col("box.maxy") - F.col("box.miny"), F.lit(1.0)))).cast("int")


def extents(rows: DataFrame) -> Column:
    """The different powers of two by which the boxes are classed: a few numbers, found once in a plan however often it asks for them."""
    return rows.select(_extent().alias("extent")).agg(F.collect_set("extent")).scalar()


def _level(extent: Column, reach: float, size: float) -> Column:
    """Of the cells that are as large as such a box, grown by half of ``reach``."""
    return F.greatest(F.lit(0), F.ceil(F.log2((F.pow(F.lit(2.0), extent) + reach) / size))).cast("int")


def celled(rows: DataFrame, name: str, sizes: Column, reach: float, size: float) -> DataFrame:
    """The rows as structs ``name`` in each cell ``(level, cx, cy)``, once for either role of the left side, ``left``: that the pair's level is its own, or a smaller row's that is copied up."""
    levels = F.array_distinct(F.transform("sizes", lambda e: _level(e, reach, size)))
    lower = F.exists(levels, lambda x: x < F.col("own"))
    role = lambda level, left: F.struct(level.alias("level"), F.lit(left).alias("left"))
    above = F.transform(F.filter(levels, lambda x: x > F.col("own")), lambda x: role(x, name == "b"))
    own = F.array(role(F.col("own"), True)) if name == "a" else F.when(lower, F.array(role(F.col("own"), True), role(F.col("own"), False))).otherwise(F.array(role(F.col("own"), True)))
    rows = rows.select(F.struct("*").alias(name), "box", _level(_extent(), reach, size).alias("own"), sizes.alias("sizes")).select(name, "box", F.inline(F.concat(own, above)))
    side, grow = size * F.pow(F.lit(2.0), F.col("level")), reach / 2
    cells = lambda low, high: F.sequence(F.floor((F.col(f"box.{low}") - grow) / side), F.floor((F.col(f"box.{high}") + grow) / side))
    wide = rows.select("level", "left", F.explode(cells("minx", "maxx")).alias("cx"), cells("miny", "maxy").alias("rows"), name)
    return wide.select("level", "left", "cx", F.explode("rows").alias("cy"), name)


def pairs(left: DataFrame, right: DataFrame, reach: float, size: float, half: bool = False, sizes: Column | None = None) -> DataFrame:
    """Pairs whose boxes are at most ``reach`` apart in either axis: structs ``a`` and ``b`` of the columns of ``left`` and ``right``.

    A grid of several levels: a row's own level has cells as large as its box (up to a power of two), grown by half of ``reach`` (cells of the
    lowest level have side ``size``), so that it is in four cells at most, at its own level and at each larger one that there is. A pair meets at
    the larger of its rows' levels, in the cell that holds the lower corner of what both boxes cover: once, and small rows never meet each
    other in a large cell. ``half`` keeps pairs with ``a.id < b.id`` only; ``sizes`` are the ``extents`` of both sides, if they are known.
    """
    size = max(size, 2 * reach)  # else what is small would be on several levels
    if sizes is None:
        sizes = extents(left if left is right else left.select("box").unionAll(right.select("box")))
    meets = (
        (F.col("a.box.minx") - reach <= F.col("b.box.maxx")) & (F.col("a.box.maxx") + reach >= F.col("b.box.minx"))
        & (F.col("a.box.miny") - reach <= F.col("b.box.maxy")) & (F.col("a.box.maxy") + reach >= F.col("b.box.miny"))
    )
    side = size * F.pow(F.lit(2.0), F.col("level"))
    lower = lambda axis: F.floor((F.greatest(F.col(f"a.box.{axis}"), F.col(f"b.box.{axis}")) - reach / 2) / side)
    here = (F.col("cx") == lower("minx")) & (F.col("cy") == lower("miny"))
    order = F.col("a.id") < F.col("b.id") if half else F.col("a.id") != F.col("b.id")
    # Spark's estimate knows neither the edges that were made of a row nor its copies: by it, a large side would be broadcast
    both = celled(left, "a", sizes, reach, size).hint("merge").join(celled(right, "b", sizes, reach, size), ["level", "left", "cx", "cy"])
    return both.where(here & meets & order).select("a", "b")


def neighbours(m: DataFrame, radius: float = RADIUS) -> DataFrame:
    """Ordered pairs whose centroids are at most ``radius`` apart: a grid join on the centroids' cells, three by three."""
    cx, cy = F.floor(F.col("center.x") / radius), F.floor(F.col("center.y") / radius)
    near = F.array(*(F.lit(i).cast("long") for i in (-1, 0, 1)))
    a = m.select(cx.alias("cx"), cy.alias("cy"), F.struct(*[c for c in m.columns if c != "polygons"]).alias("a"))
    b = m.select(F.struct(*[c for c in m.columns if c != "polygons"]).alias("b"), F.explode(F.transform(near, lambda i: cx + i)).alias("cx"), cy.alias("y0"))
    b = b.select("b", "cx", F.explode(F.transform(near, lambda i: F.col("y0") + i)).alias("cy"))
    apart = F.hypot(F.col("a.center.x") - F.col("b.center.x"), F.col("a.center.y") - F.col("b.center.y"))
    # by Spark's estimate, which knows no copies, a side of any size would be broadcast
    return a.hint("merge").join(b, ["cx", "cy"]).where((apart <= radius) & (F.col("a.id") != F.col("b.id"))).select("a", "b", apart.alias("distance_m"))


#: Where a field nearer than this is found, no field farther off need be looked at.
CLOSE = 400.0


def nearest(m: DataFrame, radius: float = RADIUS, size: float = 1000.0) -> DataFrame:
    """``id`` and the least distance from the centroid to another field in the box of reach; 0.0 where there is none.

    First among the fields whose boxes are close to the centroid; what has no field that near meets all within reach.
    """

    def least(of: DataFrame, reach: float) -> DataFrame:
        met = pairs(of, m.select("id", "box", "polygons"), reach, size, sizes=known)
        found = met.select(F.col("a.id").alias("id"), G.point_polygon_distance(F.col("a.center"), F.col("b.polygons")).alias("d"))
        return found.groupBy("id").agg(F.min("d").alias("d"))

    at, known = F.col("center"), F.array_append(extents(m), F.lit(0))  # points have no extent
    point = m.select("id", "center", F.struct(at.x.alias("minx"), at.y.alias("miny"), at.x.alias("maxx"), at.y.alias("maxy")).alias("box"))
    near = least(point, CLOSE).where(F.col("d") <= CLOSE)
    rest = m.select("id", "center", "box").join(near.select("id"), "id", "left_anti")
    found = near.unionAll(least(rest, 2 * radius))
    return m.select("id").join(found, "id", "left").select("id", F.coalesce("d", F.lit(0.0)).alias("dist_to_nearest_m"))


def neighbour_stats(m: DataFrame, radius: float = RADIUS) -> DataFrame:
    """Counts, areas, dominant crop (ties: first by name) and crop entropy of the neighbours; defaults without any."""
    by_crop = neighbours(m, radius).groupBy(F.col("a.id").alias("id"), F.col("b.crop_type").alias("crop")).agg(F.count("*").alias("n"), F.sum("b.geometry_ha").alias("ha"))
    crops = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "crop")))
    grouped = by_crop.groupBy("id").agg(F.sum("n").alias("n"), F.sum("ha").alias("ha"), crops.alias("crops"))
    entropy = F.aggregate("crops", F.lit(0.0), lambda acc, c: acc - (-c.minus / F.col("n")) * F.log2(-c.minus / F.col("n"))) + 0.0
    stats = grouped.select("id", "n", "ha", F.col("crops")[0].crop.alias("dominant"), entropy.alias("h"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return m.select("id").join(stats, "id", "left").select(
        "id", n.alias("n_neighbors_500m"), F.coalesce(F.try_divide("ha", "n"), F.lit(0.0)).alias("neighbor_mean_area_ha"), F.coalesce("ha", F.lit(0.0)).alias("neighbor_sum_area_ha"),
        F.coalesce("dominant", F.lit("isolated")).alias("dominant_neighbor_crop"), (1 / (1 + n)).alias("fragmentation_index"), F.coalesce("h", F.lit(0.0)).alias("local_crop_diversity_H"),
    )


def _between(measure, needed: Column | None = None, of: str = "edges") -> Column:
    """A measure of ``functions.between`` of the pair's edges; where ``needed`` is false, it gets none."""
    edges = [F.col(f"{c}.{of}") if needed is None else F.when(needed, F.col(f"{c}.{of}")) for c in "ab"]
    return measure(*edges, F.col("a.box"), F.col("b.box"))


def with_edges(m: DataFrame) -> DataFrame:
    """``measured`` rows with their oriented edges, and a corner of each polygon (``starts``), in place of the polygons."""
    starts = F.transform("polygons", lambda p: p[0][0])
    return fence(m.select(*[c for c in m.columns if c != "polygons"], O.oriented_edges(F.col("polygons")).alias("edges"), starts.alias("starts")))


def adjacency(m: DataFrame, tolerance: float = TOLERANCE, size: float = 1000.0, overlaps: bool = False) -> DataFrame:
    """Each adjacent pair once (``src < dst``): at most ``tolerance`` apart, as one that lies inside the other is, too.

    ``shared_length_m`` is the overlap of edges that run along each other (0 for a corner contact, or none), whichever of the two comes
    first; with ``overlaps`` a column of that name says whether the fields have area in common.
    """
    rows = with_edges(m.select("id", "box", "crop_type", "polygons"))
    found = pairs(rows, rows, tolerance, size, half=True)

    def common(low: str, high: str) -> Column:
        return F.least(F.col("a.box")[high], F.col("b.box")[high]) - F.greatest(F.col("a.box")[low], F.col("b.box")[low]) > 0

    def holds(own: str, other: str) -> Column:
        """Of a polygon whose edges are all farther off, any corner tells whether it lies inside."""
        return F.exists(F.col(f"{other}.starts"), lambda c: O.winding(F.col(f"{own}.edges"), c.x, c.y) > 0)

    both = common("minx", "maxx") & common("miny", "maxy")  # else neither can be inside the other
    inside = F.when(both, holds("a", "b") | holds("b", "a")).otherwise(False)
    ends = [F.col("a.id").alias("src"), F.col("b.id").alias("dst"), F.col("a.crop_type").alias("src_crop"), F.col("b.crop_type").alias("dst_crop"), inside.alias("inside")]
    over = [_between(B.common, both).alias("common")] if overlaps else []
    edges = fence(found.select(*ends, _between(B.beside(tolerance)).alias("near"), *over))
    near = F.col("near.d") <= tolerance
    return edges.where(near | F.col("inside")).select("src", "dst", F.col("near.along").alias("shared_length_m"), *([(F.col("common.area") > O.SMALL).alias("overlaps")] if overlaps else []), "src_crop", "dst_crop")


def intersections(m: DataFrame, size: float = 1000.0) -> DataFrame:
    """``src``, ``dst`` (``src < dst``), ``area_m2`` and ``perimeter_m`` of what two fields have in common, ``line_m`` along which they only touch, whether they ``meet`` at all, and one ``length_m`` by type."""
    rows = with_edges(m.select("id", "box", "polygons"))
    found = pairs(rows, rows, 0.0, size, half=True)
    over = fence(found.select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"), _between(B.common).alias("common"), _between(B.beside(O.SMALL)).alias("near")))
    c = F.col("common")
    met = over.withColumn("meet", (c.area > O.SMALL) | (c.line > O.SMALL) | (F.col("near.d") <= O.SMALL))
    return met.where("meet").select("src", "dst", c.area.alias("area_m2"), c.perimeter.alias("perimeter_m"), c.line.alias("line_m"), "meet", O.by_type(c, F.col("meet")).alias("length_m"))


def _grown(radius: float) -> Column:
    return F.struct(*((F.col(f"box.{c}") + (radius if c[:3] == "max" else -radius)).alias(c) for c in ("minx", "miny", "maxx", "maxy")))


def buffered_adjacency(m: DataFrame, radius: float = TOLERANCE / 2, size: float = 1000.0) -> DataFrame:
    """Adjacency by discs: pairs (``src < dst``) whose fields, grown by ``radius``, have area in common, with its perimeter as ``shared_length_m``.

    For two fields along a straight edge the perimeter is about twice the edge. The grid join carries the polygons; a pair's batch grows
    them, as a buffer has many times the corners of its field.
    """
    rows = fence(m.select("id", "crop_type", _grown(radius).alias("box"), "polygons"))
    found = pairs(rows, rows, 0.0, size, half=True)
    common = _between(B.discs_common(radius), of="polygons").alias("common")
    over = fence(found.select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"), F.col("a.crop_type").alias("src_crop"), F.col("b.crop_type").alias("dst_crop"), common))
    return over.where(F.col("common.area") > O.SMALL).select("src", "dst", F.col("common.perimeter").alias("shared_length_m"), F.col("common.area").alias("overlap_m2"), "src_crop", "dst_crop")


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of each pair, in one pass."""
    turned = {"src": "dst", "dst": "src", "src_crop": "dst_crop", "dst_crop": "src_crop"}
    back = F.struct(*(F.col(turned.get(c, c)).alias(c) for c in edges.columns))
    return edges.select(F.inline(F.array(F.struct(*edges.columns), back)))


def topology(m: DataFrame, both: DataFrame) -> DataFrame:
    """Degree, shared lengths, and counts of equal and different crops by field; zeros where isolated."""
    stats = both.groupBy(F.col("src").alias("id")).agg(
        F.count("*").alias("n"), F.sum("shared_length_m").alias("total"), F.max("shared_length_m").alias("most"),
        F.count_if(F.col("src_crop") == F.col("dst_crop")).alias("same"), F.count_if(F.col("src_crop") != F.col("dst_crop")).alias("other"),
    )
    n = F.coalesce("n", F.lit(0)).cast("long")
    return m.select("id").join(stats, "id", "left").select(
        "id", n.alias("n_adjacent_fields"), F.coalesce("total", F.lit(0.0)).alias("total_shared_length_m"), F.coalesce(F.try_divide("total", "n"), F.lit(0.0)).alias("mean_shared_length_m"),
        F.coalesce("most", F.lit(0.0)).alias("max_shared_length_m"), (n == 0).cast("long").alias("is_isolated"), n.alias("adjacency_degree"),
        F.coalesce("same", F.lit(0)).cast("long").alias("shared_crop_count"), F.coalesce("other", F.lit(0)).cast("long").alias("different_crop_count"),
    )


def network(topology_: DataFrame) -> DataFrame:
    """Totals of the adjacency graph in one row."""
    linked = F.count_if(F.col("n_adjacent_fields") > 0)
    return topology_.agg(
        F.count("*").alias("n_fields"), linked.alias("n_connected"), F.count_if(F.col("n_adjacent_fields") == 0).alias("n_isolated"),
        F.try_divide(100.0 * linked, F.count("*")).alias("connected_pct"), (F.coalesce(F.sum("n_adjacent_fields"), F.lit(0)) / 2).cast("long").alias("n_pairs"),
        F.max("n_adjacent_fields").alias("max_degree"),
    )


def matrix(both: DataFrame) -> DataFrame:
    """The adjacency matrix in sparse form: its cells over zero, of all fields, with the sum of their row.

    Rows and columns without a shared boundary have no cell: as an edge has both its directions, both axes are masked alike.
    """
    cells = both.where("shared_length_m > 0")
    return cells.join(cells.groupBy("src").agg(F.sum("shared_length_m").alias("row_sum_m")), "src").select("src", "dst", "shared_length_m", "row_sum_m")
