"""Summaries, rankings and the evaluation of classifiers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelforge.functions.fence import estimate


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def class_counts(df: DataFrame, column: str, classes: list[str]) -> DataFrame:
    """Counts of an ordered set of classes, empty ones too."""
    table = df.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, classes))).alias("position", column))
    counts = value_counts(df, column)
    return table.join(counts, column, "left").select(F.col("position").cast("long").alias("position"), column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


#: Bytes of a table whose exact percentiles may keep each distinct value in one buffer; and the values of a column that may.
IN_ONE_BUFFER, VALUES = 1 << 30, 1_000_000
#: Accuracy of the sketch that brackets a percentile: ranks are right to one part in so many.
ACCURACY = 10_000


def percentiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, Column]:
    """By column an expression, for an aggregate over ``df``, of the array of its exact percentiles (interpolated; null for no values).

    Small tables are summed up by Spark's exact aggregate, in the same pass as whatever else is asked. Of large ones, that would keep
    each distinct value in one task: there the percentiles are worked out beforehand, and the expressions are literals. Each is
    bracketed by a mergeable sketch, and the values in its bracket are bracketed again, until they are few enough for the exact one.
    """
    if estimate(df, unknown=IN_ONE_BUFFER + 1) <= IN_ONE_BUFFER:
        return {c: F.percentile(c, F.array(*map(F.lit, shares))) for c in columns}
    counts = df.agg(*(F.count(c).alias(c) for c in columns)).first()
    wanted = [(c, q) for c in columns if counts[c] for q in shares]
    rank = {k: k[1] * (counts[k[0]] - 1) for k in wanted}
    bracket = {k: (-math.inf, math.inf) for k in wanted}
    below, inside = dict.fromkeys(wanted, 0), {k: counts[k[0]] for k in wanted}

    def values(k: tuple[str, float]) -> Column:
        low, high = bracket[k]
        return F.when(F.col(k[0]).cast("double").between(low, high), F.col(k[0]).cast("double"))

    def each(keys: list, make) -> dict:
        row = df.agg(*(make(k).alias(str(i)) for i, k in enumerate(keys))).first()
        return {k: row[str(i)] for i, k in enumerate(keys)}

    fixed: set[tuple[str, float]] = set()  # brackets that do not shrink: nearly all their values are those at the ends
    while many := [k for k in wanted if inside[k] > VALUES and bracket[k][0] < bracket[k][1] and k not in fixed]:
        def sketch(k: tuple[str, float]) -> Column:
            at = (rank[k] - below[k]) / (inside[k] - 1)
            room = 2 / ACCURACY + 2 / inside[k]
            return F.percentile_approx(values(k), [max(0.0, at - room), min(1.0, at + room)], ACCURACY)

        sketched = {k: tuple(v) for k, v in each(many, sketch).items()}
        fixed |= {k for k, v in sketched.items() if v == bracket[k]}
        bracket |= sketched
        found = each(many, lambda k: F.struct(F.count_if(F.col(k[0]).cast("double") < bracket[k][0]), F.count(values(k))))
        below |= {k: v[0] for k, v in found.items()}
        inside |= {k: v[1] for k, v in found.items()}
    exact = each(wanted, lambda k: F.percentile(values(k), min(1.0, max(0.0, (rank[k] - below[k]) / max(1, inside[k] - 1))))) if wanted else {}
    return {c: F.array(*(F.lit(exact.get((c, q))).cast("double") for q in shares)) if counts[c] else F.lit(None).cast("array<double>") for c in columns}


def medians(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    return {c: x[0] for c, x in percentiles(df, columns, [0.5]).items()}


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: count, mean, sample deviation, minimum, exact quartiles, maximum."""
    quartiles = percentiles(df, columns, [0.25, 0.5, 0.75])
    one = df.agg(*(F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), quartiles[c].alias("q"), F.max(c).cast("double").alias("max")).alias(c) for c in columns))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("s")) for c in columns))).alias("r"))
    return rows.select("r.name", "r.s.n", "r.s.mean", "r.s.std", "r.s.min", F.col("r.s.q")[0].alias("p25"), F.col("r.s.q")[1].alias("p50"), F.col("r.s.q")[2].alias("p75"), "r.s.max")


def notable(df: DataFrame, key: str, wanted: dict[str, tuple[str, bool]]) -> DataFrame:
    """For each name the key of the row with the largest (or smallest) value of a column; the smallest key wins ties."""
    def pick(c: str, largest: bool) -> Column:
        return F.max_by(key, F.struct(F.col(c), -F.col(key))) if largest else F.min_by(key, F.struct(c, key))

    one = df.agg(*(pick(c, largest).alias(name) for name, (c, largest) in wanted.items()))
    return one.unpivot([], list(wanted), "name", key)


def top(df: DataFrame, column: str, key: str, n: int, largest: bool = True) -> DataFrame:
    order = F.desc_nulls_last(column) if largest else F.asc_nulls_last(column)
    return df.orderBy(order, key).limit(n)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced: rows over classes times rows of the class."""
    counts = value_counts(df, label)
    total = counts.agg(F.sum("n").alias("_rows"), F.count("*").alias("_classes"))
    return counts.crossJoin(F.broadcast(total)).select(label, "n", (F.col("_rows") / (F.col("_classes") * F.col("n"))).alias("weight"))


def fold_count(df: DataFrame, label: str, most: int = 5) -> int:
    """As many folds as the smallest class allows; fewer than two mean that there is nothing to validate."""
    least = value_counts(df, label).agg(F.min("n")).first()[0]
    return min(most, least or 0)


def stratified_folds(df: DataFrame, label: str, key: str, most: int = 5, seed: int = 42) -> DataFrame:
    """Rows of each class dealt in turn to as many folds as ``fold_count``, in the order of a seeded hash of their key.

    A row's place is the number of rows in smaller ranges of the hash, from counts, plus its place in its own range: no class is
    ranked in one task.
    """
    own = [c for c in df.columns if c != "fold"]
    rows = df.select(*own, F.md5(F.concat_ws(":", F.lit(seed), F.col(key))).alias("_hash")).withColumn("_range", F.substring("_hash", 1, 3))
    counts = rows.groupBy(F.col(label).alias("_class"), F.col("_range").alias("_of")).agg(F.count("*").alias("_n"))
    before = W.partitionBy("_class").orderBy("_of").rowsBetween(W.unboundedPreceding, -1)  # 4096 ranges of a class, at most
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_class", "_of", "_before")
    folds = value_counts(df, label).agg(F.greatest(F.lit(1), F.least(F.lit(most), F.min("n"))).alias("_folds"))
    placed = rows.hint("merge").join(starts, F.col(label).eqNullSafe(F.col("_class")) & (F.col("_range") == F.col("_of"))).crossJoin(F.broadcast(folds))
    place = F.col("_before") + F.row_number().over(W.partitionBy(label, "_range").orderBy("_hash", key)) - 1
    return placed.withColumn("fold", (place % F.col("_folds")).cast("long")).select(*own, "fold")


def split(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """``df`` with ``test``, true for about this share of the rows: by a seeded hash of their key, so the same on every run."""
    return df.withColumn("test", uniform(F.col(key), seed) < share)


def uniform(key: Column, seed: int = 42) -> Column:
    """A number from 0 to 1 (not reached) that depends on the key and the seed only: 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"), F.count("*").alias("support"))


def report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support by class, and their plain and weighted means; 0 for divisions by zero."""
    cells = df.groupBy(F.col(label).alias("l"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0)
    as_label = cells.select(F.col("l").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), hit.alias("hits"))
    as_prediction = cells.select(F.col("p").alias("class"), F.lit(0).cast("long"), "n", F.lit(0).cast("long"))
    by_class = as_label.unionAll(as_prediction).groupBy("class").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    zero = F.lit(0.0)
    scored = by_class.select(F.col("class").cast("string").alias("class"), F.coalesce(F.try_divide("hits", "predicted"), zero).alias("precision"), F.coalesce(F.try_divide("hits", "support"), zero).alias("recall"), F.coalesce(F.try_divide(2.0 * F.col("hits"), F.col("predicted") + F.col("support")), zero).alias("f1"), "support")
    names = ("precision", "recall", "f1")
    plain = scored.agg(F.lit("macro avg").alias("class"), *(F.avg(c).alias(c) for c in names), F.sum("support").alias("support"))
    weighted = scored.agg(F.lit("weighted avg").alias("class"), *(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in names), F.sum("support").alias("support"))
    return scored.unionAll(plain).unionAll(weighted)


def normalise_sum(df: DataFrame, column: str) -> DataFrame:
    """Shares of the column's total, the parts clipped to 0..1."""
    total = df.agg(F.sum(column).alias("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn("share", F.greatest(F.least(F.try_divide(column, "_total"), F.lit(1.0)), F.lit(0.0))).drop("_total")
