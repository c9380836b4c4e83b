"""Operator 10: token counts through a digest cache.

The cache is a Parquet table ``(digest, tokenizer, n_tokens)``. A text's digest is the SHA-256 of its normalised content:
null becomes the empty text, and nothing else changes, as the tokenizer counts every byte. The tokenizer's version is the
SHA-256 of its file. Digests join the cache; of the distinct digests that miss, one block of documents each is chosen to
encode the text; the new counts are appended to the cache and all rows are counted from it. Both joins have a row for each distinct
digest of a block, and not for each document: a text that a third of the documents share is there once a block.

Defined results: null and empty texts have the count of the empty text; repeated rows each give a row; an empty table gives
none and appends none. A digest that two writers append at once is counted once. Columns of the input named ``n_bytes``, ``n_tokens``
or ``over_limit`` are replaced; all others are carried along, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from tokenizers import Tokenizer

from . import exchange as X

CACHE = "digest binary, tokenizer string, n_tokens long"


@functools.lru_cache(4)
def _counter(path: str):
    if path.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _cached(spark: SparkSession, cache: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CACHE)


_ASKED = "digest binary, block long"


def _distinct(digests: list[bytes]) -> tuple[list[int], list[int]]:
    """Of each different digest its first place, and of each place the number of its digest."""
    number: dict[bytes, int] = {}
    of = [number.setdefault(d, len(number)) for d in digests]
    first = dict(zip(reversed(of), reversed(range(len(of)))))
    return [first[i] for i in range(len(number))], of


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in X.each_block(batches):
        each = [row["digests"][i : i + 32] for i in range(0, len(row["digests"]), 32)]
        yield pa.RecordBatch.from_arrays([pa.array(each, pa.binary()), pa.array([row["block"]] * len(each), pa.int64())], ["digest", "block"])
        X.let_go()


def count_tokens(docs: DataFrame, path: str, cache: str, text: str = "text", limit: int = 4096, block_bytes: int = X.BLOCK_BYTES) -> DataFrame:
    """``docs`` without ``text``, plus ``n_bytes``, ``n_tokens`` and ``over_limit``; misses are appended to ``cache``."""
    spark, version = docs.sparkSession, tokenizer_version(path)
    made = ("n_bytes", "n_tokens", "over_limit")
    own, names = X.aside(docs, made, text=text)
    content = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(content.cast("binary"), 256))

    def pack_texts(table: pa.Table) -> dict:
        table = table.take(_distinct(table["digest"].to_pylist())[0])
        return {"digests": b"".join(table["digest"].to_pylist()), "texts": X.freeze(table)}

    def encode(row: dict, wanted: pa.Table) -> pa.Table:
        counted = pa.schema([("digest", pa.binary()), ("tokenizer", pa.string()), ("n_tokens", pa.int64())])
        if not wanted.num_rows:
            return counted.empty_table()
        table, some = X.thaw(row["texts"]), set(wanted["digest"].to_pylist())
        table = table.filter(pa.array([d in some for d in table["digest"].to_pylist()]))
        n = [x for chunk in table["content"].chunks for x in _counter(path)(chunk.to_pylist())]
        return pa.table([table["digest"].to_pylist(), [version] * len(n), n], schema=counted)

    blocks = X.to_blocks(own.select(content.alias("content"), digest.alias("digest")), "content", pack_texts, block_bytes)
    hits = _cached(spark, cache).where(F.col("tokenizer") == version)
    misses = blocks.mapInArrow(_asked, _ASKED).join(hits, "digest", "left_anti").groupBy("digest").agg(F.min("block").alias("block"))
    X.meet(blocks, misses, encode, CACHE).write.mode("append").parquet(cache)

    rest = own.columns[1:]
    rows = own.select(F.struct(*rest).alias("rest") if rest else F.lit(None).cast("string").alias("rest"), F.octet_length(content).cast("long").alias("n_bytes"), digest.alias("digest"))

    def pack_rows(table: pa.Table) -> dict:
        digests = table["digest"].to_pylist()
        first, of = _distinct(digests)
        return {"digests": b"".join(digests[i] for i in first), "of": X.squeeze(np.array(of, np.uint32)), "rows": X.freeze(table.drop_columns(["digest"]))}

    def fill(row: dict, known: pa.Table) -> pa.Table:
        n = dict(zip(known["digest"].to_pylist(), known["n_tokens"].to_pylist()))
        each = np.array([n[row["digests"][i : i + 32]] for i in range(0, len(row["digests"]), 32)], np.int64)
        return X.thaw(row["rows"]).append_column("n_tokens", pa.array(each[X.expand(row["of"])]))

    counts = _cached(spark, cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    light = X.to_blocks(rows, "digest", pack_rows, block_bytes)
    known = light.mapInArrow(_asked, _ASKED).join(counts, "digest")
    done = X.meet(light, known, fill, f"rest {rows.schema['rest'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return done.select(*(F.col("rest").getField(c).alias(c) for c in rest), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")).toDF(*names, *made)
