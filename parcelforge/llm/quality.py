"""Operator 1: quality classifier by an interpolated modified Kneser-Ney n-gram model.

The model's words are bytes and its order is five; a word that is the same as the word before it is one symbol, ``AGAIN``, and not
spelled out, so that saying a word over and over is something that the model can learn, and finds cheap. It is trained on all trusted
text: blocks send their distinct 5-grams with counts to shards by the two symbols before the last, so that a shard holds every longer
count and history it needs; the counts by the last two symbols and the last one (65,536 and 256 numbers, whatever the data) are known
everywhere. Scoring is a sharded count join: blocks send their distinct 5-grams, shards join them with the counts and answer with log
probabilities, and blocks sum them by document. Where the input is so large that the blocks' questions about one frequent pair of
symbols are more than a task should hold, blocks are dealt to groups, and each group has the counts (which the alphabet bounds).

The perplexity is by byte of the text. A document is rejected if it is outside its language's limits: two quantiles of the
perplexities of the trusted documents of that language, with a margin. Junk of odd characters is above them, junk of repeated words
far below. Short texts are given the benefit of the doubt: the limits are widened by a standard error, which falls with the root of
the text's length.

Defined results: null and empty texts have no perplexity and are rejected. A null language, and one without
trusted documents, has the limits of all trusted documents; with no trusted text at all nothing but empty texts is rejected.
Repeated rows each give a row; a document that is labelled twice is trusted if any label says so. Columns of the input that are named
like one that is made (``MADE``) are replaced.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X

ORDER = 5
BLOCK_BYTES = 4 << 20
QUANTILES = (0.01, 0.99)
MARGIN = 1.15
#: Natural logarithms that the limits are widened by, over the root of the number of bytes.
DOUBT = 2.0
AGAIN = b"\1"
MADE = ("perplexity", "n_bytes", "perplexity_least", "perplexity_most", "keep")
#: Bytes of input whose blocks are answered together.
GROUP_BYTES = 4 << 30
#: Ids of trusted documents that are broadcast (16 bytes each); more are joined by a shuffle.
MAX_BROADCAST_IDS = 4_000_000
_PAD = b"\0" * (ORDER - 1)
_CHUNK = 1 << 20
_SAME = re.compile(rb"(?<!\S)(\S+)(?:\s+\1(?!\S))+")
#: Steps of a natural logarithm in the answers.
_STEP = 2048.0


def _codes(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The 5-grams of the texts as 40-bit numbers, and the number of the text each is of; up to ``_CHUNK`` at once."""
    padded = np.frombuffer(_PAD + _PAD.join(texts) + bytes(8), np.uint8)
    words = np.ndarray(len(padded) - 7, ">u8", padded, strides=(1,))
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths + len(_PAD))
    begins = ends - lengths
    for a in range(0, int(lengths.sum() + len(_PAD) * len(texts)), _CHUNK):
        b = min(a + _CHUNK, int(ends[-1]))
        at = np.arange(a, b)
        doc = np.searchsorted(ends, at, side="right")
        at, doc = at[own := at >= begins[doc]], doc[own]
        yield words[at - len(_PAD)].astype(np.uint64) >> np.uint64(64 - 8 * ORDER), doc


def _distinct(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.unique(c, return_counts=True) for c, _ in _codes(texts)]
    if len(parts) == 1:
        return parts[0]
    each, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return each, np.bincount(inverse, weights=np.concatenate([p[1] for p in parts]), minlength=len(each)).astype(np.int64)


def _by_shard(codes: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Positions of the codes of a shard: by the two symbols before the last."""
    shard = (((codes >> np.uint64(8)) & np.uint64(0xFFFF)) * np.uint64(2654435761) >> np.uint64(12)).astype(np.int64) % shards
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cut)):
        yield int(s), order[cut[s] : cut[s + 1]]


def symbols(text: bytes) -> bytes:
    """The text as the model reads it: of a run of equal words (by white space) the first, and ``AGAIN`` for each other."""
    words = text.split()
    if not any(map(operator.eq, words, words[1:])):
        return text
    return _SAME.sub(lambda run: run[1] + AGAIN * (len(run[0].split()) - 1), text)


def _texts(table: pa.Table, column: str) -> tuple[list[bytes], np.ndarray]:
    """The texts as the model reads them, and how many bytes they have."""
    texts = [t or b"" for chunk in table[column].chunks for t in chunk.to_pylist()]
    return list(map(symbols, texts)), np.array([len(t) for t in texts], np.int64)


def _suffixes(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct last ``n`` bytes, and of how many of the (distinct) codes each is the end."""
    return np.unique(codes & np.uint64((1 << 8 * n) - 1), return_counts=True)


def train(trusted: DataFrame, text: str = "text") -> dict:
    """The model: a table of counts by shard in the shared folder, and what is known everywhere."""
    shards, groups = X.shards(trusted, BLOCK_BYTES), X.groups(trusted, GROUP_BYTES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId()
        for i, table in enumerate(X.whole_blocks(batches, "text", BLOCK_BYTES)):
            codes, counts = _distinct(_texts(table, "text")[0])
            yield from X.payload_rows([(s + shards * ((first + i) % groups), i, X.squeeze((np.diff(codes[at], prepend=np.uint64(0)), counts[at].astype(np.uint32)))) for s, at in _by_shard(codes, shards)]).to_batches()
            X.let_go()

    def merge(got: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        parts = [X.expand(p) for _, p in got]
        codes, inverse = np.unique(np.concatenate([np.cumsum(d, dtype=np.uint64) for d, _ in parts]), return_inverse=True)
        counts = np.bincount(inverse, weights=np.concatenate([c for _, c in parts]))
        yield -1, X.squeeze((np.diff(codes, prepend=np.uint64(0)), counts.astype(np.int64)))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(order, key, n): how many n-grams have count 1 to 4 (order 5 to 3), and of each bigram its different histories (2)."""
        for batch in batches:
            for payload in batch["payload"].to_pylist():
                codes, counts = _model(payload)
                rows = []
                for order in (5, 4, 3):
                    rows += [(order, k, int((counts == k).sum())) for k in (1, 2, 3, 4)]
                    codes, counts = _suffixes(codes, order - 1)
                rows += [(2, int(c), int(n)) for c, n in zip(codes, counts)]
                order, key, n = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(order, pa.int32()), pa.array(key, pa.int64()), pa.array(n, pa.int64())], ["order", "key", "n"])

    rows = trusted.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")).where("length(text) > 0")
    merged = X.answer(rows.mapInArrow(count, X.PAYLOAD), merge, shards * groups)
    if groups > 1:
        merged = X.answer(merged.withColumn("shard", (F.col("shard") % shards).cast("int")), merge, shards)
    table = X.materialize(merged)
    found = table.mapInArrow(known, "order int, key long, n long").groupBy("order", "key").agg(F.sum("n").alias("n")).collect()
    of = {o: {r["key"]: r["n"] for r in found if r["order"] == o} for o in (5, 4, 3, 2)}
    two = np.zeros(1 << 16)
    two[list(of[2])] = list(of[2].values())
    discounts = {o: _discounts([of[o].get(k, 0) for k in (1, 2, 3, 4)]) for o in (5, 4, 3)}
    discounts[2] = _discounts([int((two == k).sum()) for k in (1, 2, 3, 4)])
    one = (two.reshape(256, 256) > 0).sum(0).astype(float)
    discounts[1] = _discounts([int((one == k).sum()) for k in (1, 2, 3, 4)])
    p1 = _mix(one, np.zeros(256, np.int64), one, discounts[1], np.full(256, 1 / 256), 1)
    p2 = _mix(two, np.arange(1 << 16) >> 8, two, discounts[2], np.tile(p1, 256), 256)
    return {"table": table, "shards": shards, "p2": p2, "discounts": discounts, "trained": bool(found)}


def _discounts(n: list[int]) -> np.ndarray:
    """The three discounts of modified Kneser-Ney, for counts of 1, 2, and 3 or more."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k / 2 for k in (1, 2, 3)]
    return np.clip(d, 0.05, [0.95, 1.9, 2.85])


def _mix(c: np.ndarray, history: np.ndarray, counts: np.ndarray, d: np.ndarray, lower: np.ndarray, histories: int, of: np.ndarray | None = None) -> np.ndarray:
    """Interpolated probabilities: of ``c`` (counts of what is asked) after ``of``, where ``counts`` follow ``history``."""
    total, left = np.bincount(history, weights=counts, minlength=histories), np.zeros(histories)
    for k in (1, 2, 3):
        left += d[k - 1] * np.bincount(history, weights=(counts == k) if k < 3 else (counts >= 3), minlength=histories)
    of = history if of is None else of
    total, left = total[of], left[of]
    cut = np.where(c > 0, d[np.clip(c, 1, 3).astype(np.int64) - 1], 0)
    return np.where(total > 0, (np.maximum(c - cut, 0) + left * lower) / np.maximum(total, 1e-300), lower)


def _model(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    d, counts = X.expand(payload)
    return np.cumsum(d, dtype=np.uint64), counts


def _lookup(table: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, asked), max(0, len(table) - 1))
    return at, (table[at] == asked) if len(table) else np.zeros(len(asked), bool)


def probabilities(asked: np.ndarray, model: tuple[np.ndarray, np.ndarray] | None, p2: np.ndarray, discounts: dict[int, np.ndarray]) -> np.ndarray:
    """The probability of each asked 5-gram's last byte after the four before it."""
    p = p2[(asked & np.uint64(0xFFFF)).astype(np.int64)]
    if model is None:
        return p
    tables = {5: model}
    for n in (4, 3):
        tables[n] = _suffixes(tables[n + 1][0], n)
    for n in (3, 4, 5):
        codes, counts = tables[n]
        want = asked & np.uint64((1 << 8 * n) - 1)
        at, hit = _lookup(codes, want)
        histories, history = np.unique(codes >> np.uint64(8), return_inverse=True)
        of, seen = _lookup(histories, want >> np.uint64(8))
        p = np.where(seen, _mix(np.where(hit, counts[at], 0).astype(float), history, counts, discounts[n], p, len(histories), of), p)
    return p


def perplexities(docs: DataFrame, model: dict, carry: list[str], text: str = "text") -> DataFrame:
    """The columns ``carry`` of every row, its ``perplexity`` by byte (null without text) and ``n_bytes``."""
    p2, discounts, shards = model["p2"], model["discounts"], model["shards"]
    carry = [c for c in carry if c not in ("perplexity", "n_bytes")]
    if not model["trained"]:
        return docs.select(*carry, F.when(F.length(text) > 0, F.lit(256.0)).alias("perplexity"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"))
    names = {c: f"c{i}" for i, c in enumerate(carry) if c != text}
    rows = docs.select(F.col(text).cast("binary").alias("t"), *(F.col(c).alias(n) for c, n in names.items()))
    kept = [*names.values(), *(["t"] if text in carry else [])]
    groups = X.groups(docs, GROUP_BYTES)

    def pack(table: pa.Table) -> dict:
        if "t" in kept:
            return {"rows": X.freeze(table)}
        texts, n = _texts(table, "t")  # the text itself goes no farther
        return {"rows": X.freeze(table.drop_columns(["t"]).append_column("t", pa.array(texts, pa.binary()))), "n": X.squeeze(n)}

    def unpack(row: dict) -> tuple[pa.Table, list[bytes], np.ndarray]:
        table = X.thaw(row["rows"])
        if "n" not in row:
            return table, *_texts(table, "t")
        return table, [t for chunk in table["t"].chunks for t in chunk.to_pylist()], X.expand(row["n"])

    def questions(row: dict) -> Iterator[tuple[int, bytes]]:
        codes, _ = _distinct(unpack(row)[1])
        for s, at in _by_shard(codes, shards):
            yield s + shards * (row["block"] % groups), X.squeeze(np.diff(codes[at], prepend=np.uint64(0)))

    def reply(got: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        counts = _model(got[0][1]) if got[0][0] == -1 else None
        asked = [(block, np.cumsum(X.expand(p), dtype=np.uint64)) for block, p in got if block != -1]
        if asked:
            every = np.unique(np.concatenate([a for _, a in asked]))
            nats = np.minimum(np.rint(-np.log(probabilities(every, counts, p2, discounts)) * _STEP), 65535).astype(np.uint16)
            for block, a in asked:
                yield block, X.squeeze(nats[np.searchsorted(every, a)])

    def finish(row: dict, answers: dict[int, bytes]) -> pa.Table:
        table, texts, n = unpack(row)
        codes, _ = _distinct(texts)
        nats = np.zeros(len(codes))
        for s, at in _by_shard(codes, shards):
            nats[at] = X.expand(answers[s + shards * (row["block"] % groups)])
        total = np.zeros(len(texts))
        for some, doc in _codes(texts):
            each, inverse = np.unique(some, return_inverse=True)
            total += np.bincount(doc, weights=nats[np.searchsorted(codes, each)][inverse], minlength=len(texts))
        value = np.exp(total / _STEP / np.maximum(n, 1))
        made = {"perplexity": pa.array(value, mask=n == 0), "n_bytes": pa.array(n, pa.int64())}
        return pa.table([*table.select(kept).columns, *made.values()], names=[*kept, *made])

    blocks = X.to_blocks(rows, "t", pack, BLOCK_BYTES)
    schema = ", ".join([*(f"{n} {rows.schema[n].dataType.simpleString()}" for n in kept), "perplexity double", "n_bytes long"])
    counts = model["table"]
    if groups > 1:
        counts = counts.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select((F.col("shard") + shards * F.col("group")).cast("int").alias("shard"), "block", "payload")
    answers = X.answer(X.ask(blocks, questions).unionAll(counts), reply, shards * groups)
    done = X.settle(blocks, answers, finish, schema)
    return done.select(*(F.col("t").cast("string").alias(c) if c == text else F.col(names[c]).alias(c) for c in carry), "perplexity", "n_bytes")


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", label: str = "quality") -> DataFrame:
    return labels.where(F.col(label) == 1).select(F.col(id_col).alias("trusted")).where("trusted is not null").distinct()


def classify(docs: DataFrame, labels: DataFrame, carry: list[str], id_col: str = "doc_id", text: str = "text", lang: str = "lang", quantiles: tuple[float, float] = QUANTILES, margin: float = MARGIN) -> DataFrame:
    """The columns ``carry``, and of each row ``perplexity``, ``n_bytes``, ``perplexity_least``, ``perplexity_most`` and ``keep``."""
    carry = [c for c in carry if c not in MADE]
    name = {c: f"own{i}" for i, c in enumerate(dict.fromkeys([*carry, id_col, lang, text]))}
    rows, key, own_lang = docs.select(*(F.col(c).alias(n) for c, n in name.items())), name[id_col], name[lang]
    ids = X.materialize(trusted_ids(labels, id_col))
    few = F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids
    trusted = rows.join(few, F.col(key) == F.col("trusted"), "left_semi")
    model = train(trusted, name[text])
    scored = X.materialize(perplexities(rows, model, [n for c, n in name.items() if c != text or c in carry], name[text]))
    known = scored.join(few, F.col(key) == F.col("trusted"), "left_semi").where("perplexity is not null")
    low, high = (F.percentile_approx("perplexity", q, 10_000) for q in quantiles)
    limits = [(low / margin).alias("low"), (high * margin).alias("high")]
    by_lang = X.materialize(known.where(F.col(own_lang).isNotNull()).groupBy(F.col(own_lang).alias("of")).agg(*limits))  # as many rows as languages
    rest = known.agg(*limits).first()
    doubt = F.exp(DOUBT / F.sqrt(F.greatest("n_bytes", F.lit(1))))
    limited = scored.join(by_lang, F.col(own_lang) == F.col("of"), "left").withColumns({
        "perplexity_least": F.coalesce("low", F.lit(0.0 if rest["low"] is None else rest["low"])) / doubt,
        "perplexity_most": F.coalesce("high", F.lit(float("inf") if rest["high"] is None else rest["high"])) * doubt,
    })
    keep = F.coalesce(F.col("perplexity").between(F.col("perplexity_least"), F.col("perplexity_most")), F.lit(False))
    return limited.select(*(F.col(name[c]).alias(c) for c in carry), "perplexity", "n_bytes", "perplexity_least", "perplexity_most", keep.alias("keep"))
