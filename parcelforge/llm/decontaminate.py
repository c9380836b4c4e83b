"""Operator 8: benchmark decontamination with a BM25 index of test items and block-max WAND.

Test items (split into parts of at most ``PART_WORDS`` words) are indexed by word; a posting's weight is its BM25 weight divided
by the score that the part has with itself, so a passage with all of a part's words scores one. Every document is cut into
passages of ``PASSAGE_WORDS`` words that overlap by half, so each part lies whole within one; each passage is a query, and all
parts scoring at least ``THRESHOLD`` are retrieved. Of each part the lightest words, which make up at most ``COMMON`` of it
together, cannot decide alone: they have no postings. Block-max WAND runs over the posting blocks of the other words with the
threshold less that share, and what it finds is scored with all words. A retrieved item is verified: of its question (all sentences but the last) and of its answer (the last one), each, at least ``OVERLAP`` of the
shingles of five words (fewer where there are fewer) must stand in the text around the passage.

The index is as large as the benchmark, which does not grow with the corpus; more than ``MAX_INDEX_BYTES`` of items are split by
hash into several indexes. They are built and run one after the other over the corpus, so that the driver holds one at a time, and all
weigh words by the counts of the whole benchmark: how it is split does not change what is found.

Defined results: one row for each document row and item found; null and empty texts and items match nothing; items with equal
texts are each found; a row whose id is null is found with a null id.
"""

from __future__ import annotations

import functools
import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as X

K1, B = 1.2, 0.75
PART_WORDS = 64
PASSAGE_WORDS = 2 * PART_WORDS
THRESHOLD = 0.6
SHINGLE, OVERLAP = 5, 0.8
#: What words without postings may add up to in any part, at most.
COMMON = 0.4
POSTING_BLOCK = 16
MAX_INDEX_BYTES = 32 << 20
_WORDS = re.compile(r"\w+")
_SENTENCES = re.compile(r"[^.!?\n]*[.!?\n]*")


def words(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of all sentences but the last, and of the last; one sentence is halved."""
    sentences = [w for s in _SENTENCES.findall(text) if (w := words(s))]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    all_words = words(text)
    return all_words[: (len(all_words) + 1) // 2], all_words[(len(all_words) + 1) // 2 :]


def overlap(part: list[str], around: list[str]) -> float:
    """The share of the part's shingles that the words around the passage have; 1 for no words."""
    n = min(SHINGLE, len(part))
    if not n:
        return 1.0
    mine = {tuple(part[i : i + n]) for i in range(len(part) - n + 1)}
    theirs = set(zip(*(around[i:] for i in range(n))))
    return len(mine & theirs) / len(mine)


def _parts(text: str) -> list[Counter]:
    w = words(text)
    return [Counter(w[a : a + PART_WORDS]) for a in range(0, len(w), PART_WORDS)]


class Index:
    """Of some items; ``whole`` has the counts of all: in how many parts each word is, the number of parts, and of their words."""

    def __init__(self, items: list[tuple[int, str]], whole: tuple[dict[str, int], int, int] | None = None):
        self.ids = [i for i, _ in items]
        self.split = [question_answer(t) for _, t in items]
        self.length = [len(q) + len(a) for q, a in self.split]
        parts = [(k, c) for k, (_, t) in enumerate(items) for c in _parts(t)]
        self.item = [k for k, _ in parts]
        df, n_parts, n_words = whole or (Counter(t for _, c in parts for t in c), len(parts), sum(c.total() for _, c in parts))
        mean = n_words / max(1, n_parts)
        self.own: list[dict[str, float]] = []
        for _, c in parts:
            weight = {t: math.log(1 + (n_parts - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * c.total() / mean)) for t, n in c.items()}
            total = sum(weight.values())
            self.own.append({t: x / total for t, x in weight.items()})
        postings, self.common = defaultdict(list), 0.0
        for p, weight in enumerate(self.own):
            share = 0.0
            for t, x in sorted(weight.items(), key=lambda y: (y[1], y[0])):
                if share + x <= COMMON:
                    share += x
                else:
                    postings[t].append((p, x))
            self.common = max(self.common, share)
        self.number = {t: i for i, t in enumerate(postings)}
        self.parts = [[p for p, _ in x] for x in postings.values()]
        self.weights = [[w for _, w in x] for x in postings.values()]
        self.most = [max(x) for x in self.weights]
        self.blocks = [[(x[min(i + POSTING_BLOCK, len(x)) - 1], max(w[i : i + POSTING_BLOCK])) for i in range(0, len(x), POSTING_BLOCK)] for x, w in zip(self.parts, self.weights)]

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All parts whose weights over ``terms`` sum to the threshold or more, by block-max WAND."""
        found, end = [], len(self.item)
        cursors = [[self.parts[t][0], 0, t] for t in terms]  # next part, place in the posting list, term
        while True:
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, (part, _, t) in enumerate(cursors):
                if part == end:
                    break
                bound += self.most[t]
                if bound >= threshold:
                    pivot = i
                    break
            if pivot < 0:
                return found
            part = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == part:
                pivot += 1
            bound, skip = 0.0, end  # by the blocks in which the pivot would stand
            for c in cursors[: pivot + 1]:
                blocks, b = self.blocks[c[2]], c[1] // POSTING_BLOCK
                while b < len(blocks) and blocks[b][0] < part:
                    b += 1
                if b < len(blocks):
                    bound += blocks[b][1]
                    skip = min(skip, blocks[b][0] + 1)
            if bound >= threshold:
                if cursors[0][0] == part:
                    score = sum(self.weights[c[2]][c[1]] for c in cursors[: pivot + 1])
                    if score >= threshold:
                        found.append((part, score))
                    target = part + 1
                else:
                    target = part
            else:
                target = max(part + 1, min(skip, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end))
            for c in cursors[: pivot + 1]:
                if c[0] < target:
                    parts, at = self.parts[c[2]], c[1]
                    while at < len(parts) and parts[at] < target:
                        at += POSTING_BLOCK if at % POSTING_BLOCK == 0 and at + POSTING_BLOCK <= len(parts) and parts[at + POSTING_BLOCK - 1] < target else 1
                    c[0], c[1] = (parts[at] if at < len(parts) else end), at

    def matches(self, text: str, threshold: float = THRESHOLD) -> list[tuple[int, float, float, float]]:
        """(item, best score, question overlap, answer overlap) of the items verified in the text."""
        doc = words(text)
        numbers = list(map(self.number.get, doc))
        best: dict[int, tuple[float, float, float]] = {}
        least = threshold - self.common - 1e-9
        for a in range(0, max(1, len(doc) - PART_WORDS), PART_WORDS):
            terms = set(numbers[a : a + PASSAGE_WORDS])
            terms.discard(None)
            if sum(map(self.most.__getitem__, terms)) < least:
                continue
            passage = None
            for part, _ in self.search(list(terms), least):
                passage = passage or set(doc[a : a + PASSAGE_WORDS])
                score = sum(x for t, x in self.own[part].items() if t in passage)
                if score < threshold:
                    continue
                k = self.item[part]
                around = doc[max(0, a - self.length[k]) : a + PASSAGE_WORDS + self.length[k]]
                question, answer = (overlap(x, around) for x in self.split[k])
                if question >= OVERLAP and answer >= OVERLAP and score > best.get(k, (0,))[0]:
                    best[k] = (score, question, answer)
        return [(self.ids[k], *x) for k, x in sorted(best.items())]


_BUILT: dict[str, Index] = {}


def _index(shared: Broadcast) -> Index:
    """The index of a broadcast part, built once a Python worker."""
    name, items, whole = shared.value
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Index(items, whole)
    return _BUILT[name]


def _indexes(spark: SparkSession, benchmark: DataFrame, item_col: str, item_text: str) -> Iterator[tuple[Broadcast, bool]]:
    """The distinct items with a text, at most about ``MAX_INDEX_BYTES`` in each part, and whether it is the only one."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text")).where("length(text) > 0").distinct()
    n = 1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // MAX_INDEX_BYTES
    if n > 1:
        items = X.materialize(items.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(n))))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(p, w, 1, 0) for p, t in zip(batch["part"].to_pylist(), batch["text"].to_pylist()) for c in _parts(t) for w in c]
                rows += [(p, "", 1, c.total()) for p, t in zip(batch["part"].to_pylist(), batch["text"].to_pylist()) for c in _parts(t)]  # no word is empty
                yield pa.RecordBatch.from_pylist([dict(zip(("part", "word", "parts", "words"), r)) for r in rows], schema=pa.schema([("part", pa.int64()), ("word", pa.string()), ("parts", pa.int64()), ("words", pa.int64())]))

        sums = [F.sum(c).alias(c) for c in ("parts", "words")]
        by_part = X.materialize(items.mapInArrow(count, "part long, word string, parts long, words long").groupBy("part", "word").agg(*sums))
        all_parts, all_words = by_part.where("word = ''").agg(*sums).first()
    for i in range(n):
        mine, whole = items, None
        if n > 1:
            mine = items.where(F.col("part") == i)
            df = by_part.join(by_part.where((F.col("part") == i) & (F.col("word") != "")).select("word"), "word").groupBy("word").agg(F.sum("parts").alias("n"))
            whole = ({r["word"]: r["n"] for r in df.collect()}, all_parts, all_words)
        found = sorted(((r["item"], r["text"]) for r in mine.select("item", "text").collect()), key=lambda x: (x[0] is None, x))
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, found, whole))
        yield shared, n == 1
        if n > 1:
            shared.destroy()


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``id_col``, ``item_id``, ``score``, ``question_overlap`` and ``answer_overlap`` of every item found in a document."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where("length(text) > 0")
    kind = rows.schema["id"].dataType.simpleString()

    def find(items: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(items)
            for batch in batches:
                found = [(i, m) for i, t in enumerate(batch["text"]) for m in index.matches(t.as_py())]
                ids = batch["id"].take(pa.array([i for i, _ in found], pa.int64()))
                item, score, question, answer = zip(*(m for _, m in found)) if found else ((),) * 4
                yield pa.RecordBatch.from_arrays([ids, pa.array(item, pa.int64()), *(pa.array(x, pa.float64()) for x in (score, question, answer))], ["id", "item_id", "score", "question_overlap", "answer_overlap"])

        return rows.mapInArrow(run, f"id {kind}, item_id long, score double, question_overlap double, answer_overlap double")

    parts = [find(items) if only else X.materialize(find(items)) for items, only in _indexes(docs.sparkSession, benchmark, item_col, item_text)]
    return functools.reduce(DataFrame.unionAll, parts).withColumnRenamed("id", id_col)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in whose text no item is found."""
    columns = docs.columns
    names = [f"c{i}" for i in range(len(columns))]
    at = names[columns.index(text)]

    def without(rows: DataFrame, items: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(items)
            for batch in batches:
                yield batch.filter(pa.array([not t.is_valid or not index.matches(t.as_py()) for t in batch[at]], pa.bool_()))

        return rows.mapInArrow(run, rows.schema)

    rows = docs.toDF(*names)
    for items, only in _indexes(docs.sparkSession, benchmark, item_col, item_text):
        rows = without(rows, items) if only else X.materialize(without(rows, items))
    return rows.toDF(*columns)
