"""A boundary that keeps computed columns from being copied into every place that uses them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fence(df: DataFrame) -> DataFrame:
    """The same rows; expressions above refer to these columns instead of repeating them.

    Catalyst merges adjacent projections, which multiplies nested higher-order functions. A generator of one row stays in the
    stage's generated code and ends that.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def share(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key``, for a plan that uses it in several places: all of them read the one exchange.

    The fence keeps each place from asking for columns of its own, which would make as many exchanges; so what is costly to compute
    is computed once, for one shuffle. Its partitions are not coalesced: few rows may be much work to what reads them.
    """
    return fence(df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key))


def estimate(df: DataFrame, unknown: int = 0) -> int:
    """Spark's own estimate of the size in bytes, which runs no job; ``unknown`` where it has none (rows that came from an RDD count as exabytes)."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else unknown


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, dealt by ``key``.

    Only inputs that are read in fewer splits than there are cores are shuffled: a small file whose rows take long to compute would
    keep one core busy.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(cores, key) if estimate(df) < cores * split else df
