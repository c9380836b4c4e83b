"""The random-forest classifier over a feature table."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import encoding, stats


def prepare(df: DataFrame, features: list[str]) -> DataFrame:
    """Nulls imputed by medians, then standardised."""
    return encoding.impute_and_standardise(df, features)


def labelled(df: DataFrame, features: list[str], label: str) -> tuple[DataFrame, list[str]]:
    """The rows with their label's ``code``, the class's ``weight`` and the prepared features as a ``vector``; and the label of each code."""
    codes = encoding.label_codes(df, label, None)
    # the classes are few; without the hint Spark may take the rows, by too small an estimate, for what is broadcast
    rows = df.withColumn("_label", F.lower(label)).join(F.broadcast(codes.withColumnRenamed("label", "_label")), "_label")
    rows = rows.join(F.broadcast(stats.class_weights(rows, "code").select("code", "weight")), "code").withColumn("code", F.col("code").cast("double"))
    names = [r["label"] for r in codes.orderBy("code").collect()]
    return VectorAssembler(inputCols=features, outputCol="vector").transform(prepare(rows, features)), names


def _classifier(trees: int, depth: int, seed: int) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="vector", labelCol="code", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=1, featureSubsetStrategy="sqrt", seed=seed)


def fit(df: DataFrame, features: list[str], label: str, trees: int = 100, depth: int = 5, seed: int = 42, keep=lambda rows: rows):
    """The model, the rows it was fitted on, and the label of each code. A fit reads its rows several times: ``keep`` may write them and give the table."""
    rows, names = labelled(df, features, label)
    rows = keep(rows.drop(*features))
    return _classifier(trees, depth, seed).fit(rows), rows, names


def cross_validate(df: DataFrame, features: list[str], label: str, key: str, most: int = 5, trees: int = 100, depth: int = 5, seed: int = 42, keep=lambda rows: rows) -> DataFrame:
    """``fold``, ``support`` and ``accuracy`` of a forest fitted on the other folds, and over all folds their ``mean`` and population ``deviation``.

    Features are prepared once, on all rows, and so are the classes' weights. With fewer than two folds (see ``stats.fold_count``) there is nothing to
    validate: one row without a fold, with accuracy 0.
    """
    schema = "fold long, support long, accuracy double, mean double, deviation double, skipped boolean"
    folds = stats.fold_count(df.withColumn("_label", F.lower(label)), "_label", most)
    if folds < 2:
        return df.sparkSession.createDataFrame([(None, 0, 0.0, 0.0, 0.0, True)], schema)
    rows = stats.stratified_folds(keep(labelled(df, features, label)[0].select(key, "code", "weight", "vector")), "code", key, most, seed).persist()
    try:
        scores = []
        for fold in range(folds):
            model = _classifier(trees, depth, seed).fit(rows.where(F.col("fold") != fold))
            scores.append(stats.accuracy(model.transform(rows.where(F.col("fold") == fold)), "code", "prediction").first())
    finally:
        rows.unpersist()
    each = [r["accuracy"] for r in scores]
    mean = sum(each) / folds
    deviation = (sum((x - mean) ** 2 for x in each) / folds) ** 0.5
    return df.sparkSession.createDataFrame([(i, r["support"], r["accuracy"], mean, deviation, False) for i, r in enumerate(scores)], schema)


def predict(model, rows: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    table = F.array(*map(F.lit, names))
    done = model.transform(rows)
    return done.select(*keep, F.element_at(table, F.col("prediction").cast("int") + 1).alias("predicted"), F.array_max(vector_to_array("probability")).alias("probability"))


def importances(spark, model, features: list[str]) -> DataFrame:
    return spark.createDataFrame([(f, float(x)) for f, x in zip(features, model.featureImportances.toArray())], "feature string, importance double")
