"""Columns with odd names, or with names that differ from an operator's own in case only."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from parcelforge.llm import bpe, decontaminate, pipeline, suffix, tokencount

ODD = ["a.b", "x`y", "IDS", "Kept", "N_Bytes", "own_0", "raw_1", "block", "Decoded", "über"]


@pytest.fixture(scope="module")
def odd(spark):
    text = "the same passage of more than fifty bytes that is in two documents, word for word"
    rows = [(1, "first " + text, "en", "s", 9), (2, "second " + text, "en", None, 9), (3, None, None, "s", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *(F.lit(c).alias(c) for c in ODD))


def values(df, made):
    """That columns which the operator does not make are what they were."""
    kept = [c for c in ODD if c.lower() not in made]
    assert [c for c in df.columns if c in ODD and c not in made] == kept
    rows = df.toDF(*(str(i) for i in range(len(df.columns)))).collect()
    assert len(rows) == 3
    for r in rows:
        for c in kept:
            assert r[df.columns.index(c)] == c
    return {r[df.columns.index("doc_id")]: dict(zip(df.columns, r)) for r in rows}


def test_operators(spark, odd, tmp_path):
    ranks = P.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(odd, ranks, P.PATTERN)
    values(encoded, {"ids", "decoded"})
    rows = values(bpe.decode(encoded, ranks), {"ids", "decoded"})
    assert rows[1]["decoded"].decode().startswith("first the same") and rows[3]["decoded"] == b""
    rows = values(suffix.remove_repeats(odd), {"kept", "n_bytes", "n_removed", "spans"})
    assert rows[1]["n_removed"] == 0 and rows[2]["n_removed"] > 50
    rows = values(tokencount.count_tokens(odd, P.path("piece_bpe_32k.model"), f"file://{tmp_path}/cache"), {"n_bytes", "n_tokens", "over_limit"})
    assert rows[3]["n_tokens"] == 0 and rows[1]["n_tokens"] > 10
    benchmark = spark.createDataFrame([(1, "Q: where is it? A: nowhere at all")], "item_id long, text string")
    values(decontaminate.clean(odd, benchmark), set())


def test_pipeline(spark, odd, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "Q: where is it? A: nowhere at all")], "item_id long, text string")
    named = odd.toDF(*("n_tokenS" if c == "IDS" else c for c in odd.columns))
    for name, df in {"documents": named, "labels": labels, "benchmark": benchmark}.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    found = pipeline.run(spark, str(tmp_path))
    assert found.count() <= 3 and [c for c in found.columns if c in ODD] == [c for c in ODD if c not in ("IDS", "Decoded")] and found.columns[-2:] == ["n_tokens", "ids"]
