"""The registered queries of this package: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, balltree, bpe, decontaminate, exchange, language, mixing, multiindex, quality, sharding, simhash, suffix, tokencount, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id", "lang"])


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan of built-in operators only; it needs no table of its own."""
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.neighbours(table(spark, sf_dir, "embeddings"))


def _without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def _near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.fit(docs))
    return found.select("doc_id", exchange.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def _contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", exchange.held_out("doc_id").alias("held_out"), "score", "predicted")


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, empty at first: every distinct text is a miss."""
    cache = f"{exchange.shared_dir(spark)}/cache"
    return tokencount.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), cache)


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = audit.failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit.audit(failed, list(audit.FILTERS))


def _hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return balltree.mine(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label")))


_EAGER = {
    "op1_quality": _classified, "op2_bpe": _encoded, "op4_multi_index": _neighbours, "op5_suffix_dedup": _without_repeats, "op6_simhash": _near_duplicates,
    "op7_language": _languages, "op8_decontamination": _contaminated, "op9_toxicity": _toxicity, "op10_token_counts": _counted,
    "op11_cube_mix": _mixed, "op12_filter_audit": _audited, "op13_hard_negatives": _hard_negatives,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Those that read texts or vectors are computed when called, with options that hold for that long, and return a table."""
    found = {k: lambda spark, sf_dir, f=f: exchange.eagerly(spark, lambda: f(spark, sf_dir)) for k, f in _EAGER.items()} | {"op3_sharding": op3_sharding}
    return {k: found[k] for k in sorted(found, key=lambda k: int(k[2:].split("_")[0]))}


def oracle_sql() -> dict[str, str]:
    return {"op3_sharding": sharding.oracle("documents", "doc_id", SHARDS), "op12_filter_audit": audit.oracle("documents", "labels"), "op13_hard_negatives": balltree.oracle("embeddings")}
