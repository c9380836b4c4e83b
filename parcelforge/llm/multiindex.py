"""Operator 4: approximate nearest neighbours by largest inner product, with an inverted multi-index.

Either half of the vectors is quantised by its own k-means; a pair of centroids is a cell. A query walks the pairs by falling
sum of its halves' products with the two centroids, from a heap, until the cells it met hold a set share of the rows; their
rows are reranked by the exact product in double precision. Centroids and that share come from a bounded sample
(``SAMPLE_ROWS``): the share is what 97 in 100 of the true neighbours within the sample need. Every row is indexed.

Cells are packed into buckets of about ``BUCKET_ROWS`` rows, large cells split; a bucket that many queries visit gets several
copies. A bucket answers each query with its best only. There are as many centroids as give cells of ``CELL_ROWS`` rows, up to
``MAX_CENTROIDS`` a half: the driver holds the number of rows of each cell, a million numbers at most.

The work is what the calibrated share asks for. Where neighbours lie close together the share is small; for vectors without any
structure no index has a small one.

Defined results: vectors that are null, zero, or hold null or non-finite numbers take no part. A shorter vector is as one that
ends in zeros, so vectors of different sizes have the product of the numbers that both have. Of
equal vectors the ``k + 1`` smallest ids are kept: no other can be among the ``k`` nearest. A row is never its own
neighbour, nor are rows of the same id. Queries with no candidate have no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import exchange as X

SAMPLE_ROWS = 20_000
TARGET = 0.97
CELL_ROWS, MAX_CENTROIDS = 64, 1024
BUCKET_ROWS = 8192
BUCKET_QUERIES = 20_000


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(4)
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = nearest(x, centers)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, weights=x[:, j], minlength=k) for j in range(x.shape[1])], 1)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (x @ centers.T - (centers**2).sum(1) / 2).argmax(1)


class Codebook:
    def __init__(self, sample: np.ndarray, rows: int, k: int):
        self.half = sample.shape[1] // 2
        n = int(np.clip(np.sqrt(rows / CELL_ROWS), 2, MAX_CENTROIDS))
        self.size = min(n, len(np.unique(sample, axis=0)))
        self.left, self.right = kmeans(sample[:, : self.half], self.size), kmeans(sample[:, self.half :], self.size)
        cells = self.cells(sample)
        counts = np.bincount(cells, minlength=self.size**2)
        asked = sample[:200]
        need = []
        for q, x in enumerate(asked):
            score = sample @ x
            score[q] = -np.inf
            true = np.argsort(-score)[:k]
            by_cell = (self.left @ x[: self.half])[:, None] + self.right @ x[self.half :]
            order = np.argsort(-by_cell, axis=None)
            walked = np.empty(len(order))
            walked[order] = np.cumsum(counts[order])
            need.append(walked[cells[true]])
        self.share = float(np.quantile(np.concatenate(need), TARGET) / len(sample))

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.half], self.left) * self.size + nearest(x[:, self.half :], self.right)

    def walk(self, query: np.ndarray, counts: np.ndarray, rows: int) -> list[int]:
        """Cells that hold rows, by falling sum, until they hold ``rows`` or all are met."""
        left, right = self.left @ query[: self.half], self.right @ query[self.half :]
        by_left, by_right = np.argsort(-left), np.argsort(-right)
        left, right = left[by_left].tolist(), right[by_right].tolist()
        heap, out, have, n = [(-(left[0] + right[0]), 0, 0)], [], 0, self.size
        while heap and have < rows:
            _, i, j = heapq.heappop(heap)
            cell = int(by_left[i]) * n + int(by_right[j])
            if counts[cell]:
                out.append(cell)
                have += int(counts[cell])
            if j + 1 < n:
                heapq.heappush(heap, (-(left[i] + right[j + 1]), i, j + 1))
            if j == 0 and i + 1 < n:  # each pair is pushed once: rows from their first column, columns along a row
                heapq.heappush(heap, (-(left[i + 1] + right[0]), i + 1, 0))
        return out


def _vectors(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)


def _packed(embedding: str):
    """Usable vectors as the bytes of little-endian doubles, by an Arrow pass; others are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw, size = [], [], []
            for i, v in zip(batch["id"].to_pylist(), batch["v"].to_pylist()):
                if i is None or not v or None in v:
                    continue
                x = np.asarray(v, "<f8")
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    raw.append((x + 0.0).tobytes())  # -0.0 becomes 0.0
                    size.append(len(v))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary()), pa.array(size, pa.int32())], ["id", "v", "size"])

    return run


def neighbours(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` nearest found for rows whose id is divisible by ``every``."""
    spark, out = vectors.sparkSession, "query_id long, vec_id long, score double"
    rows = X.materialize(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(embedding).alias("v")).mapInArrow(_packed(embedding), "id long, v binary, size int"))
    total, size = rows.agg(F.count("*"), F.max("size")).first()
    if not total:
        return spark.createDataFrame([], out).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    size = max(size, 2)  # either half has a number
    rows = rows.select("id", F.when(F.col("size") == size, F.col("v")).otherwise(F.concat("v", F.unhex(F.repeat(F.lit("0" * 16), F.lit(size) - F.col("size"))))).alias("v"))
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, SAMPLE_ROWS / total) * (1 << 30))).collect() or rows.limit(100).collect()
    sample = np.frombuffer(b"".join(r["v"] for r in sorted(drawn, key=lambda r: (r["id"], r["v"]))), "<f8").reshape(len(drawn), -1)
    book = Codebook(sample, total, k)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch["id"], batch["v"], pa.array(book.cells(_vectors(batch["v"])), pa.int64())], ["id", "v", "cell"])

    few = W.partitionBy("v").orderBy("id")
    members = X.materialize(rows.distinct().withColumn("copy", F.row_number().over(few)).where(F.col("copy") <= k + 1).drop("copy").mapInArrow(cells, "id long, v binary, cell long"))
    counts = np.zeros(book.size**2, np.int64)
    for r in members.groupBy("cell").count().collect():  # as many rows as there are pairs of centroids, at most
        counts[r["cell"]] = r["count"]
    first, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    bucket, filled = 0, 0
    for c in np.flatnonzero(counts):
        parts[c] = -(-counts[c] // BUCKET_ROWS)
        if filled and filled + counts[c] > BUCKET_ROWS:
            bucket, filled = bucket + 1, 0
        first[c] = bucket
        bucket, filled = (bucket + int(parts[c]), 0) if parts[c] > 1 else (bucket, filled + int(counts[c]))
    want = int(np.ceil(book.share * counts.sum()))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, raw, buckets, met = [], [], [], []
            for i, v, x in zip(batch["id"].to_pylist(), batch["v"].to_pylist(), _vectors(batch["v"])):
                by_bucket: dict[int, list[int]] = {}
                for c in book.walk(x, counts, want):
                    for b in range(int(first[c]), int(first[c] + parts[c])):
                        by_bucket.setdefault(b, []).append(c)
                for b, some in by_bucket.items():
                    ids.append(i)
                    raw.append(v)
                    buckets.append(b)
                    met.append(np.array(some, "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary()), pa.array(buckets, pa.int64()), pa.array(met, pa.binary())], ["id", "v", "bucket", "met"])

    asked = X.materialize(rows.where(F.col("id") % every == 0).distinct().mapInArrow(visits, "id long, v binary, bucket long, met binary"))
    copies = X.materialize(asked.groupBy("bucket").agg(F.ceil(F.count("*") / BUCKET_QUERIES).alias("copies")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, ids = batch["cell"].to_numpy(), batch["id"].to_numpy()
            at = first[cell] + (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts[cell]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], ["id", "v", "cell", "bucket"])

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        queries, ranks, scores = [], [], []
        if left.num_rows and right.num_rows:
            right = right.sort_by("id")
            x, ids, cell = _vectors(right["v"]), right["id"].to_numpy(), right["cell"].to_numpy()
            slot = {c: i for i, c in enumerate(np.unique(cell).tolist())}
            column = np.array([slot[c] for c in cell.tolist()])
            for a in range(0, left.num_rows, 512):
                some = left.slice(a, 512)
                q, own = _vectors(some["v"]), some["id"].to_numpy()
                met = np.zeros((len(q), len(slot)), bool)
                for i, m in enumerate(some["met"].to_pylist()):
                    met[i, [slot[c] for c in np.frombuffer(m, "<i4").tolist() if c in slot]] = True
                near = q @ x.T
                near[~met[:, column] | (own[:, None] == ids)] = -np.inf
                for i, line in enumerate(near):
                    cut = np.partition(line, -k)[-k] if len(line) > k else -np.inf
                    at = np.flatnonzero((line >= cut - 1e-9 * abs(cut) - 1e-12 if np.isfinite(cut) else True) & np.isfinite(line))
                    exact = (x[at] * q[i]).sum(1)  # the same order of sums for equal vectors
                    best = np.lexsort((ids[at], -exact))[:k]
                    queries += [int(own[i])] * len(best)
                    ranks += ids[at][best].tolist()
                    scores += exact[best].tolist()
        return pa.table([pa.array(queries, pa.int64()), pa.array(ranks, pa.int64()), pa.array(scores, pa.float64())], names=["query_id", "vec_id", "score"])

    placed = members.mapInArrow(place, "id long, v binary, cell long, bucket long").join(copies, "bucket")
    placed = placed.select("id", "v", "cell", "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    asked = asked.join(copies, "bucket").select("id", "v", "bucket", "met", F.pmod(F.xxhash64("id"), "copies").alias("copy"))
    found = asked.groupBy("bucket", "copy").cogroup(placed.groupBy("bucket", "copy")).applyInArrow(rerank, out)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
