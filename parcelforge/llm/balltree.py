"""Operator 13: hard-negative mining by inner product, with ball trees.

An anchor's positives are the rows of its label that score highest with it; its hard negatives, for each positive, are the highest rows
of other labels whose score lies in a window below the positive's. Both are found exactly, by branch and bound: in a ball of center ``c``
and radius ``r`` every score is within ``|q| r`` of ``q c``, so a ball whose bounds lie outside of the window, or whose upper bound is
strictly beneath the least of the best found so far, is left out.

Rows are dealt to buckets of about ``BUCKET_ROWS``, near each other in space: planes for that come from a bounded sample (``SAMPLE_ROWS``),
the balls of the buckets from all rows; a bucket of more rows is several. The bounds are used twice: an anchor is sent only to buckets
whose ball may hold what it looks for, and in each bucket, one group of a shuffle, there is a tree for every label. An anchor looks for
positives in its own bucket first, and elsewhere only where more than the least of these may be. A bucket that many anchors visit has
several copies. The driver holds a ball for each bucket, ``MAX_BUCKETS`` of them at most: larger tables have larger buckets.

Without structure in the vectors no ball is ever left out, and the work is that of comparing every anchor with every row, in blocks.

Defined results: numbers are whole, ``floor(scale * x)``, held to +-2**25, so that scores are exact for up to 4,096 numbers. Rows take no part
whose id, label or vector is null or whose vector holds null or non-finite numbers; an empty vector scores 0, and a shorter one is as
one that ends in zeros. Of rows with equal ids the least stays, by label and vector. Higher scores come first, then smaller ids. An
anchor without positives, or a positive without rows in its window, has no rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import exchange as X

SAMPLE_ROWS = 20_000
BUCKET_ROWS, MAX_BUCKETS = 8192, 16_384
BUCKET_QUERIES = 20_000
#: Rows in a leaf of a tree, and anchors that go down a tree together.
LEAF, TOGETHER = 128, 1024
LARGEST = 1 << 25
NONE, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def halves(x: np.ndarray) -> tuple[np.ndarray, float] | None:
    """A plane that has half of the points on its lower side: across the line between two points far apart. None if all are equal."""
    far = x[((x - x.mean(0)) ** 2).sum(1).argmax()]
    line = far - x[((x - far) ** 2).sum(1).argmax()]
    along = x @ line
    cut = np.median(along)
    if not (along < cut).any():
        above = along[along > cut]
        if not len(above):
            return None
        cut = above.min()
    return line, float(cut)


class Planes:
    """Splits space into leaves that hold about as many points of the sample; ``centers`` are their means."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.planes: list[tuple[np.ndarray, float, int, int] | None] = []
        self.centers: list[np.ndarray] = []
        self.leaf: dict[int, int] = {}
        least = max(4, len(sample) // max(1, leaves))
        todo = [(sample.astype(float), -1, False)]
        while todo:
            x, parent, upper = todo.pop()
            at = len(self.planes)
            if parent >= 0:
                line, cut, low, high = self.planes[parent]
                self.planes[parent] = (line, cut, *((low, at) if upper else (at, high)))
            found = halves(x) if len(x) > least and leaves > 1 else None
            if found is None:
                self.planes.append(None)
                self.leaf[at] = len(self.centers)
                self.centers.append(x.mean(0))
                continue
            line, cut = found
            self.planes.append((line, cut, -1, -1))
            above = x @ line >= cut
            todo += [(x[above], at, True), (x[~above], at, False)]

    def of(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if self.planes[node] is None:
                out[rows] = self.leaf[node]
                continue
            line, cut, low, high = self.planes[node]
            above = x[rows] @ line >= cut
            todo += [(high, rows[above]), (low, rows[~above])]
        return out


class Tree:
    """Balls over rows of one label, each half of the one above it, down to ``LEAF`` rows or equal ones."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.nodes: list[tuple[np.ndarray, float, float, int, int, np.ndarray | None]] = []
        self.x, self.ids, self.whole = x, ids, x.astype(np.int64)
        self.most = float(np.abs(x).max(initial=0))
        self._grow(np.arange(len(x)))

    def _grow(self, rows: np.ndarray) -> int:
        x, at = self.x[rows], len(self.nodes)
        center = x.mean(0)
        radius = float(np.sqrt(((x - center) ** 2).sum(1).max()))
        found = halves(x) if len(rows) > LEAF else None
        size = float(np.sqrt((center**2).sum()))
        self.nodes.append((center, radius, size, -1, -1, rows))
        if found is not None:
            above = x @ found[0] >= found[1]
            low, high = self._grow(rows[~above]), self._grow(rows[above])
            self.nodes[at] = (center, radius, size, low, high, None)
        return at

    def scores(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact: in double precision where every sum is a whole number below 2**53, else in 64-bit integers."""
        if q.shape[1] * self.most * float(np.abs(q).max(initial=0)) < 1 << 53:
            return (q @ self.x[rows].T).astype(np.int64)
        return q.astype(np.int64) @ self.whole[rows].T

    def search(self, q: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Brings ``score`` and ``ids`` (anchor, window, place) up to date with what is in the windows ``low`` to ``high`` (anchor, window)."""
        norm = np.sqrt((q**2).sum(1))
        todo = [(0, np.arange(len(q)))]
        while todo:
            node, some = todo.pop()
            center, radius, size, left, right, rows = self.nodes[node]
            middle, slack = q[some] @ center, norm[some] * (radius + 1e-9 * (size + radius)) + 1
            above, below = (middle + slack)[:, None], (middle - slack)[:, None]
            some = some[((above >= low[some]) & (below <= high[some]) & (above >= score[some, :, -1])).any(1)]
            if not len(some):
                continue
            if rows is None:
                nearer = sorted((left, right), key=lambda n: float((q[some] @ self.nodes[n][0]).sum()))
                todo += [(n, some) for n in nearer]  # the higher one is met first
                continue
            got = self.scores(q[some], rows)
            got[own[some][:, None] == self.ids[rows]] = NONE
            for w in range(low.shape[1]):
                fits = np.where((got >= low[some, w][:, None]) & (got <= high[some, w][:, None]), got, NONE)
                better = np.flatnonzero((fits.max(1) >= score[some, w, -1]) & (fits.max(1) > NONE))
                if not len(better):
                    continue
                at, k = some[better], score.shape[2]
                both = np.concatenate([score[at, w], fits[better]], 1)
                names = np.concatenate([ids[at, w], np.broadcast_to(self.ids[rows], (len(at), len(rows)))], 1)
                names = np.where(both == NONE, LAST, names)
                best = np.lexsort((names, -both.astype(float) if both.max() < 1 << 53 else _falling(both)), axis=1)[:, :k]
                score[at, w], ids[at, w] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)


def _falling(x: np.ndarray) -> np.ndarray:
    """Numbers in the reverse order; the least of all has no negative."""
    return -np.maximum(x, NONE + 1)


def _doubles(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """Packed numbers as rows of ``size``, with zeros at the end of shorter ones."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(v.ljust(4 * size, b"\0") for v in raw), "<i4").reshape(len(raw), size).astype(float)


def _prepared(vectors: DataFrame, id_col: str, embedding: str, label: str, scale: int) -> DataFrame:
    """``id``, ``label`` as a string, and the numbers as an array, of usable rows; one row an id."""
    rows = X.pick(vectors, id=id_col, label=label, v=embedding).select(F.col("id").cast("long"), F.col("label").cast("string"), F.col("v").cast("array<double>"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = F.transform("v", lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x * scale))).cast("int"))
    usable = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & fine).select("id", "label", held.alias("v"))
    return usable.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = [np.array(x, "<i4").tobytes() for x in batch["v"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], pa.array(v, pa.binary()), pa.array([len(x) // 4 for x in v], pa.int32())], ["id", "label", "v", "size"])


class Buckets:
    """Where rows lie, and which buckets may hold what an anchor looks for."""

    def __init__(self, planes: Planes, count: np.ndarray, radius: np.ndarray, rows: int):
        self.parts = np.maximum(1, -(-count // rows))
        self.first = X.offsets(self.parts)[:-1]
        self.planes, self.center, self.radius = planes, np.array(planes.centers), radius
        self.size = np.sqrt((self.center**2).sum(1))

    def home(self, leaf: np.ndarray, ids: np.ndarray) -> np.ndarray:
        draw = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
        return self.first[leaf] + draw % self.parts[leaf]

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the scores of each anchor in each leaf."""
        norm, middle = np.sqrt((q**2).sum(1)), q @ self.center.T
        slack = norm[:, None] * (self.radius + 1e-9 * (self.size + self.radius)) + 1
        return middle - slack, middle + slack

    def within(self, leaf: np.ndarray) -> np.ndarray:
        return X.places(self.first[leaf], self.parts[leaf])


_ROW = "id long, label string, v binary"
_FOUND = "id long, window long, window_score long, other long, score long"


def _look(asked: DataFrame, members: DataFrame, size: int, k: int, same: bool) -> DataFrame:
    """``_FOUND`` of each anchor in ``asked`` in the bucket it is sent to: the best ``k`` of its windows (``low``, ``high``) that are of its label, or not."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[int]] = [[], [], [], [], []]
        if left.num_rows and right.num_rows:
            label = np.array(right["label"].to_pylist(), object)
            x, names = _doubles(right["v"], size), right["id"].to_numpy()
            trees = {one: Tree(x[label == one], names[label == one]) for one in dict.fromkeys(label.tolist())}
            for a in range(0, left.num_rows, TOGETHER):
                some = left.slice(a, TOGETHER)
                q, own, of = _doubles(some["v"], size), some["id"].to_numpy(), np.array(some["label"].to_pylist(), object)
                windows = some["windows"].to_pylist()
                most = max(map(len, windows))
                low, high = np.full((len(q), most), LAST), np.full((len(q), most), NONE)
                for i, each in enumerate(windows):
                    low[i, : len(each)], high[i, : len(each)] = [w["low"] for w in each], [w["high"] for w in each]
                score, ids = np.full((len(q), most, k), NONE), np.full((len(q), most, k), LAST)
                for one, tree in trees.items():
                    at = np.flatnonzero((of == one) == same)
                    if len(at):
                        s, i = score[at], ids[at]
                        tree.search(q[at], own[at], low[at], high[at], s, i)
                        score[at], ids[at] = s, i
                for i, w, p in zip(*(axis.tolist() for axis in np.nonzero(score > NONE))):
                    window = windows[i][w]
                    for column, value in zip(out, (int(own[i]), window["id"], window["score"], int(ids[i, w, p]), int(score[i, w, p]))):
                        column.append(value)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["id", "window", "window_score", "other", "score"])

    copies = X.materialize(asked.groupBy("bucket").agg(F.ceil(F.count("*") / BUCKET_QUERIES).alias("copies")))
    copied = members.join(copies, "bucket").select("id", "label", "v", "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    visits = asked.join(copies, "bucket").select("id", "label", "v", "windows", "bucket", F.pmod(F.xxhash64("id"), "copies").alias("copy"))
    return visits.groupBy("bucket", "copy").cogroup(copied.groupBy("bucket", "copy")).applyInArrow(run, _FOUND)


_WINDOWS = "windows array<struct<id: long, score: long, low: long, high: long>>"


def _windows(*each: tuple[Column, Column, Column, Column]) -> Column:
    names = ("id", "score", "low", "high")
    return F.array(*(F.struct(*(v.cast("long").alias(n) for n, v in zip(names, one))) for one in each)).alias("windows")


def _sent(anchors: DataFrame, buckets: Buckets, size: int) -> DataFrame:
    """A row for each bucket that may hold what one of the anchor's windows allows, but for the bucket ``met``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            below, above = buckets.bounds(_doubles(batch["v"], size))
            at, to = [], []
            for i, (each, met) in enumerate(zip(batch["windows"].to_pylist(), batch["met"].to_pylist())):
                may = np.zeros(below.shape[1], bool)
                for w in each:
                    may |= (above[i] >= w["low"]) & (below[i] <= w["high"])
                some = buckets.within(np.flatnonzero(may))
                some = some[some != met]
                at += [i] * len(some)
                to += some.tolist()
            for a in range(0, len(at), 8192):
                some = batch.take(pa.array(at[a : a + 8192], pa.int64()))
                yield pa.RecordBatch.from_arrays([*(some[c] for c in ("id", "label", "v", "windows")), pa.array(to[a : a + 8192], pa.int64())], ["id", "label", "v", "windows", "bucket"])

    return anchors.select("id", "label", "v", "windows", "met").mapInArrow(run, f"{_ROW}, {_WINDOWS}, bucket long")


def mine(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
         id_col: str = "vec_id", embedding: str = "embedding", label: str = "label", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``.

    Anchors are the rows whose id is divisible by ``every``; a negative's score is ``low`` to ``high`` hundredths of the positive's.
    """
    spark = vectors.sparkSession
    rows = X.materialize(_prepared(vectors, id_col, embedding, label, scale).mapInArrow(_pack, f"{_ROW}, size int"))
    total, size = rows.agg(F.count("*"), F.max("size")).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not total or not size:  # without a number every score is 0, but there may be rows
        size = 1
    if not total:
        return spark.createDataFrame([], out)
    few = W.partitionBy("label", "v").orderBy("id")  # of equal rows of a label none but the first can be among the best; an anchor is not its own
    apart = rows.withColumn("copy", F.row_number().over(few)).where(F.col("copy") <= max(positives + 1, negatives)).select("id", "label", "v")
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, SAMPLE_ROWS / total) * (1 << 30))).select("id", "v").collect() or rows.limit(1).select("id", "v").collect()
    bucket_rows = max(bucket_rows, -(-total // MAX_BUCKETS))
    planes = Planes(_doubles(pa.array([r["v"] for r in sorted(drawn, key=lambda r: r["id"])], pa.binary()), size), -(-total // bucket_rows))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _doubles(batch["v"], size)
            at = planes.of(x)
            far = np.sqrt(((x - np.array(planes.centers)[at]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(far)], ["id", "label", "v", "leaf", "far"])

    placed = X.materialize(apart.mapInArrow(leaves, f"{_ROW}, leaf long, far double"))
    count, radius = np.zeros(len(planes.centers), np.int64), np.zeros(len(planes.centers))
    for r in placed.groupBy("leaf").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # a row for each leaf
        count[r["leaf"]], radius[r["leaf"]] = r["n"], r["far"]
    buckets = Buckets(planes, count, radius, bucket_rows)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = buckets.home(planes.of(_doubles(batch["v"], size)), batch["id"].to_numpy())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], batch["v"], pa.array(at, pa.int64())], ["id", "label", "v", "bucket"])

    members = placed.select("id", "label", "v").mapInArrow(homes, f"{_ROW}, bucket long")
    anchors = X.materialize(rows.where(F.col("id") % every == 0).select("id", "label", "v").mapInArrow(homes, f"{_ROW}, bucket long"))
    zero, least, most = F.lit(0), F.lit(int(NONE) + 1), F.lit(int(LAST))
    at_home = X.materialize(_look(anchors.withColumn("windows", _windows((zero, zero, least, most))), members, size, positives, same=True))
    least_of = at_home.groupBy("id").agg(F.count("*").alias("n"), F.min("score").alias("worst")).where(F.col("n") >= positives).select("id", "worst")
    farther = anchors.join(least_of, "id", "left").withColumn("windows", _windows((zero, zero, F.coalesce("worst", least), most))).withColumnRenamed("bucket", "met")
    elsewhere = _look(X.materialize(_sent(farther, buckets, size)), members, size, positives, same=True)
    best = W.partitionBy("id").orderBy(F.desc("score"), "other")
    first = at_home.unionAll(elsewhere).withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    window = F.struct(F.col("other").alias("id"), "score", F.ceil(F.col("score").cast("decimal(30,0)") * low / 100).cast("long").alias("low"), F.floor(F.col("score").cast("decimal(30,0)") * high / 100).cast("long").alias("high"))
    wanted = X.materialize(first.select("id", window.alias("w")).where("w.low <= w.high").groupBy("id").agg(F.sort_array(F.collect_list("w")).alias("windows")))  # as many as there are positives
    asked = X.materialize(_sent(anchors.drop("bucket").join(wanted, "id").withColumn("met", F.lit(-1).cast("long")), buckets, size))
    found = _look(asked, members, size, negatives, same=False)
    order = W.partitionBy("id", "window").orderBy(F.desc("score"), "other")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select(F.col("id").alias("anchor_id"), F.col("window").alias("positive_id"), "rank", F.col("other").alias("negative_id"), F.col("window_score").alias("positive_score"), F.col("score").alias("negative_score"))


def oracle(vectors: str) -> str:
    """The same by comparing every anchor with every row."""
    return f"""WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM {vectors}
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.id % 50 = 0 AND a.id <> b.id),
 p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
 SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b))::INT AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
 FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
 QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) <= 3"""
