"""The pipeline's stages, each on its own input, against brute force."""

import itertools

import numpy as np
import public_tokenizers as P

import corpus_pipeline
from parcelforge.llm import bpe, decontaminate, exchange, suffix

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "suffix-array dedup", "benchmark decontamination", "byte-level BPE"]
    for name, stage in corpus_pipeline.STAGES:
        docs = exchange.materialize(stage(spark, docs, SF))
        rows = docs.collect()
        after = {r["doc_id"]: r["text"] for r in rows}
        assert docs.columns[: len(columns)] == columns and len(after) == len(rows) and set(after) <= set(before)
        gone = set(before) - set(after)
        if name == "quality classifier":
            assert np.mean([i in after for i, q in quality.items() if q == 1]) >= 0.97
            assert np.mean([i in gone for i, q in quality.items() if q == 0]) >= 0.9
        elif name == "SimHash near-dedup":
            sets = {i: shingles(t) for i, t in before.items()}
            alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b]}
            assert not [p for p, j in alike.items() if j >= 0.9 and p[0] in after and p[1] in after]
            copied = {x for p, j in alike.items() if j >= 0.6 for x in p} | {i for i, t in before.items() if list(before.values()).count(t) > 1}
            assert gone <= copied
        elif name == "suffix-array dedup":
            seen: set = set()
            for i in sorted(before):
                b = before[i].encode()
                starts = [b[p : p + suffix.LENGTH] for p in range(len(b) - suffix.LENGTH + 1)]
                cover = np.zeros(len(b), bool)
                for p, s in enumerate(starts):
                    if s in seen:
                        cover[p : p + suffix.LENGTH] = True
                seen |= set(starts)
                at, kept = 0, []
                for c in before[i]:
                    n = len(c.encode())
                    kept += [] if cover[at : at + n].all() else [c]
                    at += n
                assert after.get(i, "").strip() == "".join(kept).strip()
        elif name == "benchmark decontamination":
            flat = lambda t: " " + " ".join(decontaminate.words(t)) + " "
            dirty = {i for i, t in before.items() if any(flat(x) in flat(t) for x in items)}
            assert dirty <= gone and len(gone - dirty) <= 1
        else:
            assert after == before
            encode = bpe.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).encode_ordinary
            assert all(np.frombuffer(r["ids"], "<u4").tolist() == encode(r["text"]) and r["n_tokens"] == len(r["ids"]) // 4 for r in rows)
        before = after


def test_awkward_rows_pass_through(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long, keep int, perplexity string, kept string, id int, ids string, decoded string, n_tokens int"
    rows = [(1, "plain words of a text here", "en", "s", 26), (1, "plain words of a text here", "en", "s", 26), (2, None, None, None, None), (None, "plain words of a text here", None, "s", None), (3, "", "en", "s", 0)]
    for name, some in (("awkward", rows), ("empty", [])):
        sf = str(tmp_path / name)
        spark.createDataFrame([(*x, 1, None, "k", 2, "y", "z", 3) for x in some], columns).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)] if some else [], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([(1, "an item. its answer")] if some else [], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        out = corpus_pipeline.run(spark, sf)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "keep", "perplexity", "kept", "id", "n_tokens", "ids"]
        assert {(r["keep"], r["perplexity"], r["kept"], r["id"]) for r in out.collect()} <= {(1, None, "k", 2)}
        assert sorted(str(r["doc_id"]) for r in out.collect()) == (["1", "None"] if some else [])


def test_equal_ids_with_different_texts_are_different_documents(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(5, text(1)), (5, text(2)), (5, text(1)), (7, text(2)), (9, text(3)), (2, text(3)), (None, text(1)), (None, text(1)), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, docs, SF).collect()
    assert sorted(map(str, left)) == sorted(map(str, spark.createDataFrame([(5, text(1)), (5, text(2)), (2, text(3)), (None, text(1)), (None, text(1)), (8, None)], "doc_id long, text string").collect()))
