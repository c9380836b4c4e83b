"""Bounded samples of labelled rows, drawn by a hash of the id: about as many rows of each class, the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X


def sample_by_class(rows: DataFrame, label: str, id_col: str, total: int) -> tuple[DataFrame, DataFrame]:
    """The sampled rows, and a table ``(class, n)`` of how many rows each class has in all.

    ``total`` is divided evenly among the classes, but each has one row at least, however many there are. A row is taken if the hash
    of its id is below its class's share, so no class is ever gathered in one task.
    """
    counts = X.materialize(rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n")))
    each = max(1, total // max(1, counts.count()))
    shares = counts.select(F.col("class").alias("_class"), (F.lit(float(each)) / F.col("n")).alias("_share"))
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    return rows.join(shares, F.col(label) == F.col("_class")).where(draw < F.col("_share")).drop("_class", "_share"), counts
