"""A training-data pipeline over the table ``documents``: five stages, each written as Parquet and read by the next.

Every stage works on whole texts and on all rows that its predecessor kept, and carries all columns along, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, quality, simhash, suffix
from . import exchange as X
from .queries import table


def _aside(docs: DataFrame, *needed: str) -> DataFrame:
    """``docs`` with its columns, but for the needed ones, under names that no operator makes; ``toDF`` undoes it."""
    return docs.toDF(*(c if c in needed else f"own_{i}" for i, c in enumerate(docs.columns)))


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's limits."""
    own = _aside(docs, "doc_id", "text", "lang")
    found = quality.classify(own, table(spark, sf_dir, "labels"), own.columns)
    return found.where("keep").select(*own.columns).toDF(*docs.columns)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest id stays.

    Rows with equal ids and equal texts stay once; equal ids with different texts are different documents, the smaller text first.
    Rows without an id stay, as nothing tells them apart.
    """
    own = _aside(docs, "doc_id", "text")
    rows, key = own.where("doc_id IS NOT NULL"), "doc_id"
    if rows.groupBy("doc_id").count().where("count > 1").limit(1).count():
        key = "row"
        whole = F.struct(*rows.columns)
        one = rows.groupBy("doc_id", "text").agg(F.min_by(whole, F.to_json(whole)).alias("x")).select("x.*")  # the least of the others' values
        rows = X.materialize(one.orderBy("doc_id", "text").withColumn(key, F.monotonically_increasing_id()))
    found = simhash.similar_documents(rows, similarity=0.8, shingle=5, id_col=key)
    gone = found.where("id <> component").select(F.col("id").alias(key))
    kept = rows.join(gone, key, "left_anti").select(*own.columns)
    return kept.unionAll(own.where("doc_id IS NULL")).toDF(*docs.columns)


def _repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a document with a smaller id has are cut out; a document that nothing is left of goes."""
    own = _aside(docs, "doc_id", "text", "n_chars")
    found = suffix.remove_repeats(own, whole_characters=True).withColumn("text", F.col("kept").cast("string"))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.where("n_removed = 0 OR text RLIKE '\\\\S'").select(*own.columns).toDF(*docs.columns)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def _bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns, with the text as decoded from ``ids`` (little-endian unsigned 32-bit), and ``n_tokens``.

    Columns of these two names, and one named ``decoded``, are replaced.
    """
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own, names = X.aside(docs, ("n_tokens", "ids", "decoded"), text="text")
    both = bpe.encode(own, path, public_tokenizers.PATTERN, decoded=True)
    at = {c: f"own_{i}" for i, c in enumerate(names)} | {"text": "decoded"}
    kept = [c for c in docs.columns if c in at]
    found = both.withColumn("decoded", F.col("decoded").cast("string"))
    return found.select(*(F.col(at[c]) for c in kept), (F.length("ids") / 4).cast("long"), "ids").toDF(*kept, "n_tokens", "ids")


def _stage(make):
    """The result is not written here but by the caller, whose session keeps the options for long texts; ``run`` puts them back."""

    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        X.use_small_batches(spark)
        return make(spark, docs, sf_dir)

    stage.__doc__ = make.__doc__
    return stage


STAGES = [
    ("quality classifier", _stage(_quality)),
    ("SimHash near-dedup", _stage(_near_duplicates)),
    ("suffix-array dedup", _stage(_repeated_passages)),
    ("benchmark decontamination", _stage(_decontamination)),
    ("byte-level BPE", _stage(_bpe)),
]

#: The stages (language model, fingerprints, suffix arrays, tokenizer) aren't expressible in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    with X.scratch(spark), X.small_batches(spark):
        docs = table(spark, sf_dir, "documents")
        for _, stage in STAGES:
            with X.scratch(spark):
                docs = X.materialize(stage(spark, docs, sf_dir))
    return docs
