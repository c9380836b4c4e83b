"""GeoJSON feature collections as splits of any size: one file is read by many tasks.

Spark reads the file as text whose lines end at closing braces, so that it splits it anywhere and the pieces of a split are whole. Whether a
split begins inside a string and how deep in braces is known once the quotes and braces of all splits before it are counted; that is a
first pass, with a row for each split. In a second pass every split gives the features that are whole within it, and the ends of those that are not;
these few are put together by a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_ESCAPED = re.compile(r"\\.", re.S)
_MARKS = re.compile(r'\\.|["{]', re.S)
WHOLE, HEAD, TAIL, MIDDLE = range(4)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The file's text up to each closing brace, without it, in the order of each split."""
    return spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    for batch in batches:
        yield from zip(batch["file"].to_pylist(), batch["start"].to_pylist(), batch["value"].to_pylist())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split its quotes, and the braces it opens more than it closes, if it begins outside of a string and inside of one."""
    found: dict[tuple[str, int], list[int]] = {}
    for file, start, value in _by_split(batches):
        n = found.setdefault((file, start), [0, 0, 0])
        parts = (_ESCAPED.sub("", value) + "}").split('"')
        for i, part in enumerate(parts):
            n[1 + (n[0] + i) % 2] += part.count("{") - part.count("}")
        n[0] += len(parts) - 1
    rows = [(f, s, *n) for (f, s), n in found.items()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.string(), *[pa.int64()] * 4))], ["file", "start", "quotes", "outside", "inside"])


def _features(states: dict[tuple[str, int], tuple[bool, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, int, int, str]] = []
        size, at, held, kind, quoted, depth = 0, None, [], WHOLE, False, 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.string(), pa.int64(), pa.int32(), pa.string()))], ["file", "start", "kind", "text"])

        for file, start, value in _by_split(batches):
            if (file, start) != at:
                if held:
                    out.append((*at, MIDDLE if kind == HEAD else TAIL, "".join(held)))
                at, held = (file, start), []
                quoted, depth = states[at]
                kind = HEAD if depth > 1 else WHOLE
            begin = 0
            for mark in _MARKS.finditer(value):
                if mark[0] == '"':
                    quoted = not quoted
                elif mark[0] == "{" and not quoted:
                    depth += 1
                    if depth == 2:
                        begin = mark.start()
            if depth > 1:
                held.append(value[begin:] + "}")
            if not quoted:
                depth -= 1
                if depth == 1 and held:
                    out.append((*at, kind, "".join(held)))
                    size += len(out[-1][3])
                    held, kind = [], WHOLE
            if size > 4 << 20:
                yield rows()
                out, size = [], 0
        if held:
            out.append((*at, MIDDLE if kind == HEAD else TAIL, "".join(held)))
        yield rows()

    return run


def features(spark: SparkSession, path: str) -> DataFrame:
    """Every object of the collections' second level as a column ``feature`` of text; other members of a collection, such as its ``crs``, too."""
    pieces = _pieces(spark, path)
    in_order = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    quoted = F.coalesce(F.sum("quotes").over(in_order), F.lit(0)) % 2 == 1
    counts = pieces.mapInArrow(_count, "file string, start long, quotes long, outside long, inside long").groupBy("file", "start").agg(*(F.sum(c).alias(c) for c in ("quotes", "outside", "inside")))
    known = counts.withColumn("quoted", quoted).withColumn("opened", F.when(F.col("quoted"), F.col("inside")).otherwise(F.col("outside")))
    depth = F.coalesce(F.sum("opened").over(in_order), F.lit(0))
    states = {(r["file"], r["start"]): (r["quoted"], r["depth"]) for r in known.select("file", "start", "quoted", depth.alias("depth")).collect()}  # as many as there are splits
    found = pieces.mapInArrow(_features(states), "file string, start long, kind int, text string")
    # a feature that no split holds whole: a tail, any number of middles, and a head
    rest = found.where(F.col("kind") != WHOLE).withColumn("place", F.when(F.col("kind") == TAIL, 1).otherwise(0))
    until = W.partitionBy("file").orderBy("start", "place").rowsBetween(W.unboundedPreceding, 0)
    joined = rest.withColumn("nth", F.sum("place").over(until)).groupBy("file", "nth").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "place", "text"))), lambda x: x.text), "").alias("feature"))
    return found.where(F.col("kind") == WHOLE).select(F.col("text").alias("feature")).unionAll(joined.select("feature"))


def write(rows: DataFrame, path: str, geometry: str = "polygons") -> None:
    """A folder of feature collections, one a partition: ``geometry`` as MultiPolygons, all other columns as properties."""
    points = F.transform(geometry, lambda p: F.transform(p, lambda r: F.transform(r, lambda c: F.array(c.x, c.y))))
    shape = F.struct(F.lit("MultiPolygon").alias("type"), points.alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*[c for c in rows.columns if c != geometry]).alias("properties"), shape.alias("geometry")), {"ignoreNullFields": "false"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = '{"type": "FeatureCollection", "features": ['
        for batch in batches:
            lines = batch["value"].to_pylist()
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([head + lines[0], *("," + x for x in lines[1:])])], ["value"])
                head = ","
        yield pa.RecordBatch.from_arrays([pa.array(["]}"] if head == "," else [head + "]}"])], ["value"])

    rows.select(feature.alias("value")).mapInArrow(run, "value string").write.mode("overwrite").text(path)
