"""Operator 2: byte-level BPE encoding and decoding by a global shuffle of distinct words.

Every text is cut into pre-tokens. A block of documents keeps, for each position, the number of its word among the block's
distinct words; the distinct words alone are shuffled by hash, each is encoded once in its shard however many blocks hold
it, and the ids go back to the blocks, where they are put together by position. Decoding joins ids with the token-byte
table, which is as large as the vocabulary and no larger.

Defined results: a null or empty text has no ids (``ids`` is empty, never null). Repeated rows each give a row. The other
columns of the input are carried along; a column named ``ids`` or ``decoded`` of the input is replaced.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

from . import exchange as X


#: Bytes of text in a block: its words, positions and ids are all in one worker's memory.
BLOCK_BYTES = 4 << 20


@functools.lru_cache(4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(4)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all bytes, and the start and length of each id's bytes."""
    with open(path, "rb") as f:
        table = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    parts = [table.get(i, b"") for i in range(max(table) + 1)]
    lengths = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), X.offsets(lengths)[:-1], lengths


class _Coder(dict):
    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _pack_words(words: list[bytes]) -> tuple[np.ndarray, bytes]:
    return np.array([len(w) for w in words], np.uint32), b"".join(words)


def _unpack_words(packed: tuple[np.ndarray, bytes]) -> list[bytes]:
    ends = X.offsets(packed[0]).tolist()
    return [packed[1][a:b] for a, b in zip(ends, ends[1:])]


def _planes(a: np.ndarray) -> bytes:
    """Little-endian bytes of 32-bit numbers, all lowest bytes first: compresses better."""
    return np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplane(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _by_shard(words: list[bytes], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The words' numbers ordered by shard, and where each shard's begin."""
    shard = np.fromiter((zlib.crc32(w) % shards for w in words), np.int32, len(words))
    return np.argsort(shard, kind="stable"), np.searchsorted(np.sort(shard), np.arange(shards + 1))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", block_bytes: int = BLOCK_BYTES, decoded: bool = False) -> DataFrame:
    """``docs`` without ``text``, plus ``ids``: the token ids as little-endian unsigned 32-bit integers.

    With ``decoded`` the ids are decoded where they were put together, as ``decode`` does it, without a second worker. Columns that are
    named as the made ones are, in any case, are replaced.
    """
    own, names = X.aside(docs, ("ids", "decoded"), ids=text)
    kept = own.columns[1:]
    rows = own.select(*kept, F.coalesce("ids", F.lit("")).alias("ids"))
    shards = X.shards(docs, block_bytes)

    def pack(table: pa.Table) -> dict:
        find, coder = regex.compile(pattern).findall, _Coder()
        codes, counts = [], []
        for chunk in table["ids"].chunks:
            for t in chunk.to_pylist():
                words = find(t)
                counts.append(len(words))
                codes.append(np.fromiter(map(coder.__getitem__, words), np.uint32, len(words)))
        codes = np.concatenate(codes)
        order = np.argsort(-np.bincount(codes, minlength=len(coder)), kind="stable")  # frequent words get low numbers
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        words = list(coder)
        return {"rest": X.freeze(table.drop_columns(["ids"])), "seq": X.squeeze((np.array(counts, np.int64), _planes(rank[codes])), 5), "words": X.squeeze(_pack_words([words[i].encode() for i in order]))}

    def questions(row: dict) -> Iterator[tuple[int, bytes]]:
        words = _unpack_words(X.expand(row["words"]))
        order, first = _by_shard(words, shards)
        for s in range(shards):
            if first[s] < first[s + 1]:
                yield s, X.squeeze(_pack_words([words[i] for i in order[first[s] : first[s + 1]]]))

    def reply(got: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        one, coder, ids = encoding(path, pattern).encode_ordinary, _Coder(), []
        asked = []
        for block, payload in got:
            words = _unpack_words(X.expand(payload))
            known = len(coder)
            asked.append((block, np.fromiter(map(coder.__getitem__, words), np.int64, len(words))))
            if len(coder) > known:
                ids += [one(words[i].decode()) for i in np.flatnonzero(asked[-1][1] >= known)]  # new words, in the order of their numbers
        lengths = np.array([len(x) for x in ids], np.int64)
        flat, starts = np.array([y for x in ids for y in x], np.uint32), X.offsets(lengths)[:-1]
        for block, codes in asked:
            yield block, X.squeeze((lengths[codes].astype(np.uint32), X.ragged(flat, starts[codes], lengths[codes])))

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), "ids binary", *(["decoded binary"] if decoded else [])])

    def finish(row: dict, answers: dict[int, bytes]) -> pa.Table:
        encoding.cache_clear()  # the worker may have been a shard's before
        words = _unpack_words(X.expand(row["words"]))
        order, first = _by_shard(words, shards)
        lengths, flat = np.zeros(len(words), np.int64), [np.zeros(0, np.uint32)]
        starts, done = np.zeros(len(words), np.int64), 0
        for s, payload in answers.items():
            n, ids = X.expand(payload)
            here = order[first[s] : first[s + 1]]
            lengths[here] = n
            starts[here] = done + X.offsets(n)[:-1]
            done += len(ids)
            flat.append(ids)
        counts, planes = X.expand(row["seq"])
        codes = _unplane(planes)
        ids = X.ragged(np.concatenate(flat), starts[codes], lengths[codes]).astype("<u4")
        ends = X.offsets(lengths[codes])[X.offsets(counts)] * 4
        raw = memoryview(ids.tobytes())
        each = [raw[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
        table = X.thaw(row["rest"]).append_column("ids", pa.array(each, pa.binary()))
        return table.append_column("decoded", _decoded(each, path)) if decoded else table

    blocks = X.to_blocks(rows, "ids", pack, block_bytes)
    done = X.settle(blocks, X.answer(X.ask(blocks, questions), reply, shards), finish, schema)
    return done.toDF(*names, *done.columns[len(names) :])


def _decoded(ids: list, path: str) -> pa.Array:
    flat, starts, lengths = token_bytes(path)
    out = []
    for raw in ids:
        i = np.frombuffer(raw or b"", "<u4")
        out.append(None if raw is None else X.ragged(flat, starts[i], lengths[i]).tobytes())
    return pa.array(out, pa.binary())


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``df`` plus ``decoded``: the bytes of ``ids``, by the token-byte table. Null ids give null."""
    rows, names = X.aside(df, ("decoded",), ids=ids)
    schema = to_arrow_schema(rows.schema).append(pa.field("decoded", pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                some = batch.slice(first, 256)
                yield pa.RecordBatch.from_arrays([*some.columns, _decoded(some.column("ids").to_pylist(), path)], schema=schema)
            X.let_go()

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("decoded", BinaryType())])).toDF(ids, *names, "decoded")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, decode, and digest both: one row a document."""
    both = encode(docs.select("doc_id", "text"), path, pattern, decoded=True)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
