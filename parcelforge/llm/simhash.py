"""Operator 6: SimHash near-duplicates, found with pivot distance tables.

A fingerprint has a bit set where over half of its shingles' hashes have it. The pivot table holds, for each of six
segments of the fingerprint, the Hamming distances from the segment to many reference fingerprints. Two fingerprints that
differ in at most three bits agree on three whole segments, so there their distances to all references are equal: each
fingerprint goes to one bucket for every three segments, named by its rows of the table. In a bucket, pairs whose full
distances to some reference differ by more than the limit are discarded (triangle inequality), and survivors are verified
by their exact distance. A bucket with more than ``HOT`` fingerprints is dealt again by the same rule over the bits outside
its three segments; as then 48 bits are equal, at most 2^16 different fingerprints can meet.

Buckets give a spanning forest of their links, not the pairs; components come from alternating star contraction.

For documents that are less alike, ``similar_documents`` takes longer fingerprints of the same kind, whose segments are narrow
enough that two documents of the wanted similarity agree on some segment with high probability; its buckets are named by the
same table. Links by the first ``CHECKED`` bits are candidates only: they are verified by the Jaccard similarity of the shingle sets.

Defined results: a text without words (null, empty, blank) has fingerprint zero and is linked like any other. Repeated rows
each give a row. A null id takes its component from equal fingerprints and never names one (null if nothing else is there).
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X

#: Bits that linked fingerprints may differ in, at most: with six segments three must agree.
MAX_DISTANCE = 3
REFERENCES = 64
HOT = 1024
_THREES = list(itertools.combinations(range(6), 3))


def fingerprint(text: str, shingle: int = 3) -> int:
    words = text.encode().lower().split()  # bytes: only A-Z, and white space \x20 \x09-\x0D
    if not words:
        return 0
    joined = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.frombuffer(b"".join([xxhash.xxh64_digest(s, 42) for s in joined]), np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col`` and ``fp``, the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(t.as_py() or "", shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, fp long").withColumnRenamed("id", id_col)


def _segments(bits: list[int]) -> list[list[int]]:
    cuts = [round(i * len(bits) / 6) for i in range(7)]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:])]


@functools.lru_cache(256)
def _table(bits: tuple[int, ...]) -> tuple[list[int], np.ndarray]:
    """For a segment: its bits, and a row for each value it can have: the distances to the references' segments."""
    refs = np.random.default_rng(6).integers(0, 1 << 64, REFERENCES, dtype=np.uint64)
    part = sum(((refs >> np.uint64(b)) & np.uint64(1)) << np.uint64(i) for i, b in enumerate(bits)).astype(np.uint64)
    return list(bits), np.bitwise_count(np.arange(1 << len(bits), dtype=np.uint64)[:, None] ^ part).astype(np.uint8)


def _values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    return sum(((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(i) for i, b in enumerate(bits)).astype(np.int64)


def _distances(fp: np.ndarray, segments: list[list[int]]) -> np.ndarray:
    """The pivot distances (rows by references) of the fingerprints: the sum of their segments' distances."""
    out = np.zeros((len(fp), REFERENCES), np.uint8)
    for seg in segments:
        bits, table = _table(tuple(seg))
        out += table[_values(fp, bits)]
    return out


@functools.lru_cache(256)
def _mixed(bits: tuple[int, ...], place: int) -> np.ndarray:
    """For a segment, a mix of the row of the pivot table for each value; equal rows have equal mixes."""
    return (_table(bits)[1].astype(np.uint64) * np.random.default_rng(64 + place).integers(1, 1 << 63, REFERENCES, dtype=np.uint64)).sum(1, dtype=np.uint64)


def _names(fp: np.ndarray, segments: list[list[int]]) -> list[np.ndarray]:
    """For every three segments, the bucket's name: a mix of the distances there."""
    mixed = [_mixed(tuple(seg), i)[_values(fp, seg)] for i, seg in enumerate(segments)]
    odd = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    names = []
    for k, three in enumerate(_THREES):
        h = np.full(len(fp), k + 1, np.uint64) * odd[0]
        for s in three:
            h = (h ^ mixed[s]) * odd[1]
            h ^= h >> np.uint64(29)
        names.append((h * odd[2]).view(np.int64))
    return names


_ALL = _segments(list(range(64)))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, id) to (bucket, three, fp, id): twenty rows each."""
    for batch in batches:
        fp = batch["fp"].to_numpy(zero_copy_only=False).astype(np.int64)
        for k, name in enumerate(_names(fp.view(np.uint64), _ALL)):
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(np.full(len(fp), k, np.int32)), batch["fp"], batch["id"]], ["bucket", "three", "fp", "id"])


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of hot buckets, dealt by their bits outside the three segments."""
    for batch in batches:
        fp, bucket = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("fp", "bucket"))
        three = batch["three"].to_numpy(zero_copy_only=False)
        for k in np.unique(three):
            at = np.flatnonzero(three == k)
            rest = _segments([b for s in range(6) if s not in _THREES[k] for b in _ALL[s]])
            for name in _names(fp[at].view(np.uint64), rest):
                rows = batch.take(pa.array(at))
                mixed = (name.view(np.uint64) ^ (bucket[at].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(mixed), rows["three"], rows["fp"], rows["id"]], ["bucket", "three", "fp", "id"])


def _links(bucket: np.ndarray, fp: np.ndarray, limit: int) -> np.ndarray:
    """For rows ordered by bucket: the first row that each is linked with, by links within buckets."""
    n = len(fp)
    label = np.arange(n)
    fp = fp.view(np.uint64)
    table = _distances(fp, _ALL).astype(np.int16)
    longest = int(np.diff(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))).max(initial=0))
    left = np.arange(n)
    for lag in range(1, longest):
        left = left[left + lag < n]
        left = left[bucket[left] == bucket[left + lag]]
        a, b = left, left + lag
        for r in range(0, REFERENCES, 8):  # most pairs go at the first references
            near = (np.abs(table[a, r : r + 8] - table[b, r : r + 8]) <= limit).all(1)
            a, b = a[near], b[near]
        true = np.bitwise_count(fp[a] ^ fp[b]) <= limit
        a, b = a[true], b[true]
        label = _join_up(label, a, b)
    return label


_OUT = ["kind", "bucket", "three", "fp", "id", "other"]


def _match(hot: int | None, limit: int):
    """Rows ordered by bucket to links (kind 0: id, other), and to the rows of buckets over ``hot`` (kind 1)."""

    def edges(bucket: np.ndarray, fp: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        label = _links(bucket, fp, limit)
        at = np.flatnonzero(ids[label] != ids)
        if len(at):
            zero = np.zeros(len(at), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(zero.astype(np.int32)), pa.array(zero), pa.array(zero.astype(np.int32)), pa.array(zero), pa.array(ids[at]), pa.array(ids[label[at]])], _OUT)

    def passed(rows: list[np.ndarray]) -> pa.RecordBatch:
        n = len(rows[0])
        return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), *map(pa.array, rows), pa.nulls(n, pa.int64())], _OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot_now = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch[c].to_numpy(zero_copy_only=False) for c in ("bucket", "three", "fp", "id")]
            rows = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            for part, ended in (([x[:last] for x in rows], True), ([x[last:] for x in rows], False)):
                if not len(part[0]):
                    held = None
                elif hot is None:
                    if ended:
                        yield from edges(part[0], part[2], part[3])
                    else:
                        held = part
                else:
                    if ended or len(part[0]) > hot or part[0][0] == hot_now:
                        sizes = np.bincount(inverse := np.cumsum(np.concatenate(([0], part[0][1:] != part[0][:-1]))))
                        big = (sizes[inverse] > hot) | (part[0] == (part[0][0] if hot_now is None else hot_now)) & (hot_now is not None)
                        if big.any():
                            yield passed([x[big] for x in part])
                        if not big.all():
                            yield from edges(*([x[~big] for x in part][i] for i in (0, 2, 3)))
                        held, hot_now = None, hot_now if ended else part[0][0]
                    else:
                        held = part
        if held is not None:
            yield from edges(held[0], held[2], held[3])

    return run


#: Links that one task brings down to a forest.
LINKS = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every ``LINKS`` links of a partition to as few that hang together alike: from each id to the smallest that they lead to."""

    def reduced(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        ids, place = np.unique(np.concatenate((u, v)), return_inverse=True)
        label = _join_up(np.arange(len(ids)), place[: len(u)], place[len(u) :])
        at = np.flatnonzero(label != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[label[at]])], ["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append((batch["u"].to_numpy(), batch["v"].to_numpy()))
        n += batch.num_rows
        if n > LINKS:
            yield reduced(*(np.concatenate(x) for x in zip(*held)))
            held, n = [], 0
    if held:
        yield reduced(*(np.concatenate(x) for x in zip(*held)))


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for the ids in ``links(id, other)`` that lead to a smaller one: the smallest of them.

    Tasks of ``LINKS`` links each reduce them to forests, as a large group is linked many times over. What more than one task has
    left goes through alternating star contraction (large star, small star) until nothing changes; each round is written to the
    shared folder.
    """
    edges = X.materialize(links.select(F.greatest("id", "other").alias("u"), F.least("id", "other").alias("v")).where("u <> v").distinct())
    tasks = -(-edges.count() // LINKS)
    edges = X.materialize(edges.coalesce(max(1, tasks)).mapInArrow(_forest, "u long, v long"))
    state = None
    while tasks > 1:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        edges = X.materialize(small)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.countDistinct("u")).first()
        if now == state:
            break
        state = now
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))


def link(classes: DataFrame) -> DataFrame:
    """``(id, component)`` for the ids of distinct fingerprints ``(fp, id)`` whose links lead to a smaller id."""
    n = X.partitions(classes.sparkSession)
    schema = "kind int, bucket long, three int, fp long, id long, other long"
    rows = classes.where("id is not null").mapInArrow(_buckets, "bucket long, three int, fp long, id long")
    first = X.materialize(rows.repartition(n, "bucket").sortWithinPartitions("bucket", "id").mapInArrow(_match(HOT, MAX_DISTANCE), schema))
    finer = first.where("kind = 1").select("bucket", "three", "fp", "id").mapInArrow(_finer, "bucket long, three int, fp long, id long")
    second = finer.repartition(n, "bucket").sortWithinPartitions("bucket", "id").mapInArrow(_match(None, MAX_DISTANCE), schema)
    return components(first.where("kind = 0").unionAll(second).select("id", "other"))


def near_duplicates(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col``, ``fp`` and ``component_id`` for every row of ``docs``."""
    prints = X.materialize(fingerprints(docs, shingle, id_col, text))
    classes = X.materialize(prints.groupBy("fp").agg(F.min(id_col).alias("id")))
    named = classes.join(link(classes), "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return prints.join(named, "fp").select(id_col, "fp", "component_id")


def hex_fingerprint(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


#: Longer fingerprints: number of segments, bits of each, and the leading bits by which rows of a bucket are compared.
BANDS, BAND_BITS, CHECKED = 40, 16, 256
#: How often the bits are dealt into segments (the first time as they stand), and the standard deviations by which pairs of the
#: wanted similarity may exceed the expected distance.
DEALS, MARGIN = 3, 5
#: Rows of whole buckets that are compared at once; all pairs of a bucket over ``WIDE`` are met row by row, but for those linked already.
AT_ONCE, WIDE = 4096, 256
#: Documents in a cell, within which links are verified by the shingles; larger groups of candidates are cut into several.
CELL = 192
_ORDERS = [np.arange(BANDS * BAND_BITS), *(np.random.default_rng(7 + i).permutation(BANDS * BAND_BITS) for i in range(DEALS - 1))]
_WORDS = BANDS * BAND_BITS // 64
_MIX = np.random.default_rng(5).integers(0, 1 << 63, _WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str, shingle: int) -> np.ndarray | None:
    """The hashes of the distinct shingles, in order; a text of fewer words is one shingle; None for a text with no words."""
    words = text.encode().lower().split()
    if not words:
        return None
    joined = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.array([xxhash.xxh64_intdigest(s, 42) for s in joined], np.uint64))


def long_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``BANDS * BAND_BITS`` bits as 64-bit numbers, of a set of shingles: a repeated line counts once."""
    counts = np.zeros(_WORDS * 64, np.int64)
    for i in range(0, len(hashes), 1 << 13):
        h = hashes[i : i + (1 << 13), None] * _MIX
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        counts += np.unpackbits(h.view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes)).view(np.uint64)


def bits_apart(similarity: float, bits: int = CHECKED) -> int:
    """How many of ``bits`` differ at most, but for ``MARGIN`` deviations, between documents whose shingle sets have this Jaccard similarity."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * share + MARGIN * math.sqrt(bits * share * (1 - share)))


def _wide_rows(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, key, fp): the key is equal for equal sets of shingles only."""
    for batch in batches:
        ids, keys, prints = [], [], []
        for i, t in zip(batch["id"].to_pylist(), batch["text"]):
            if (hashes := shingle_set(t.as_py() or "", shingle)) is not None:
                ids.append(i)
                keys.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                prints.append(long_fingerprint(hashes).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(prints, pa.binary())], ["id", "key", "fp"])
    X.let_go()


_CHECK = [f"w{i}" for i in range(CHECKED // 64)]


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, fp) to (bucket, id, the words that are verified): a row for each segment, named by its pivot distances."""
    name = _mixed(tuple(range(BAND_BITS)), 0)
    for batch in batches:
        if not batch.num_rows:
            continue
        fp = np.frombuffer(b"".join(batch["fp"].to_pylist()), np.uint64).reshape(batch.num_rows, _WORDS)
        bits = np.unpackbits(fp.view(np.uint8), axis=1)
        words = [pa.array(fp[:, i].view(np.int64)) for i in range(len(_CHECK))]
        for deal, order in enumerate(_ORDERS):
            parts = np.ascontiguousarray(np.packbits(bits[:, order], axis=1)).view(np.uint16)
            for band in range(BANDS):
                h = (name[parts[:, band]] ^ np.uint64(deal * BANDS + band + 1)) * np.uint64(0x9E3779B97F4A7C15)
                yield pa.RecordBatch.from_arrays([pa.array((h ^ (h >> np.uint64(31))).view(np.int64)), batch["id"], *words], ["bucket", "id", *_CHECK])
    X.let_go()


def _join_up(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` after the links a-b: each row's label is the first row of its group."""
    while len(a):
        la, lb = label[a], label[b]
        if (la == lb).all():
            break
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        label[a] = np.minimum(label[a], low)
        label[b] = np.minimum(label[b], low)
        while not np.array_equal(label, up := label[label]):
            label = up
    return label


def _one_by_one(label: np.ndarray, near) -> np.ndarray:
    """``label`` after all links of one bucket: ``near(row, others)`` says which others a row is linked with.

    Every pair is met but those with equal labels by then, so a group whose rows are all near its first costs one round.
    """
    for row in range(len(label) - 1):
        others = np.flatnonzero(label[row + 1 :] != label[row]) + row + 1
        others = others[near(row, others)] if len(others) else others
        if len(others):
            met = np.zeros(len(label), bool)
            met[label[others]] = met[label[row]] = True
            label[met[label]] = np.flatnonzero(met)[0]
        if not row or len(others):
            if (label == label[0]).all():
                break
    return label


def _near_in_buckets(limit: int):
    """Rows ordered by bucket to links (id, other) that make up each bucket's groups."""

    def in_step(bucket: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
        label, left, lag = np.arange(len(bucket)), np.arange(len(bucket)), 0
        while len(left):
            lag += 1
            left = left[left + lag < len(bucket)]
            left = left[bucket[left] == bucket[left + lag]]
            a = left
            apart = np.zeros(len(a), np.int64)
            for w in words:  # what has differed so far is a lower bound
                apart = apart + np.bitwise_count(w[a] ^ w[a + lag])
                a, apart = a[apart <= limit], apart[apart <= limit]
            label = _join_up(label, a, a + lag)
        return label

    def links(rows: list[np.ndarray]) -> pa.RecordBatch:
        """Of whole buckets."""
        bucket, ids, words = rows[0], rows[1], [w.view(np.uint64) for w in rows[2:]]
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        sizes = np.diff(cuts)
        label, small = np.arange(len(bucket)), np.flatnonzero(np.repeat(sizes <= WIDE, sizes))
        label[small] = small[in_step(bucket[small], [w[small] for w in words])]
        for at, size in zip(cuts[:-1][sizes > WIDE], sizes[sizes > WIDE]):
            own = [w[at : at + size] for w in words]
            label[at : at + size] = at + _one_by_one(np.arange(size), lambda row, others, own=own: sum(np.bitwise_count(w[others] ^ w[row]).astype(np.int64) for w in own) <= limit)
        at = np.flatnonzero(ids[label] != ids)
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[label[at]])], ["id", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # the rows so far of the running bucket
        for batch in batches:
            new = [batch[c].to_numpy(zero_copy_only=False) for c in ("bucket", "id", *_CHECK)]
            for i in range(0, batch.num_rows, AT_ONCE):
                rows = [x[i : i + AT_ONCE] for x in new]
                if held and held[0][0][0] == rows[0][-1]:
                    held.append(rows)
                    continue
                rows = [np.concatenate(x) for x in zip(*held, rows)]
                last = int(np.searchsorted(rows[0], rows[0][-1]))
                if last:
                    yield links([x[:last] for x in rows])
                held = [[x[last:] for x in rows]]
        if held:
            yield links([np.concatenate(x) for x in zip(*held)])
        X.let_go()

    return run


def _alike_in_cells(similarity: float, shingle: int):
    """Rows (cell, id, label, text) ordered by cell to links (id, other): rows of a label are linked already, others by their Jaccard similarity."""

    def links(ids: list[int], labels: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in sets])

        def near(row: int, others: np.ndarray) -> np.ndarray:
            fit = np.minimum(sizes[others], sizes[row]) / np.maximum(sizes[others], sizes[row]) >= similarity
            some = others[fit]
            if len(some):
                flat, own = np.concatenate([sets[i] for i in some]), sets[row]
                hits = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                both = np.add.reduceat(hits.astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
                fit[fit] = both / (sizes[row] + sizes[some] - both) >= similarity
            return fit

        own, (_, first, place) = np.array(ids), np.unique(np.array(labels), return_index=True, return_inverse=True)
        label = _one_by_one(first[place], near)
        at = np.flatnonzero(own[label] != own)
        return pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(own[label[at]])], ["id", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [])
        for batch in batches:
            for cell, i, label, text in zip(batch["cell"].to_pylist(), batch["id"].to_pylist(), batch["label"].to_pylist(), batch["text"]):
                if cell != now and held[0]:
                    yield links(*held)
                    held = ([], [], [])
                now = cell
                if (hashes := shingle_set(text.as_py() or "", shingle)) is not None:
                    for x, y in zip(held, (i, label, hashes)):
                        x.append(y)
        if held[0]:
            yield links(*held)
        X.let_go()

    return run


#: Ids that are broadcast to pick the texts of candidates, and groups of documents; more are joined by a shuffle.
_BROADCAST = 4_000_000


def _side(table: DataFrame) -> DataFrame:
    """A table of ids or groups as a side of a join: broadcast if it has few rows."""
    return F.broadcast(table) if table.count() <= _BROADCAST else table


#: Blocks that a document may meet in a component's second round; where it were more, its buckets take the component's place.
MEETINGS = 128


def _meetings(named: DataFrame) -> DataFrame:
    """``(id, label, cell)`` in which each two documents of a ``group`` and of different labels meet, of groups that have several labels.

    The group's largest label is cut into k blocks of ``CELL`` documents, the others together into m. A cell is two blocks, the second one of others.
    """
    labels = named.groupBy("group", "label").agg(F.count("*").alias("n")).groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"))
    several = X.materialize(labels.where("n > most").select("group", "main", F.ceil(F.col("most") / CELL).alias("k"), F.ceil((F.col("n") - F.col("most")) / CELL).alias("m")))
    meet = named.join(_side(several), "group").withColumn("h", F.xxhash64("id"))
    cells = F.expr("""CASE WHEN label = main THEN transform(sequence(0L, m - 1), y -> struct(pmod(h, k) AS x, y AS y))
        ELSE concat(transform(sequence(0L, k + pmod(h, m)), x -> struct(x AS x, pmod(h, m) AS y)), transform(sequence(0L, m - 1), y -> struct(k + pmod(h, m) AS x, y AS y))) END""")
    again = meet.select("id", "label", "group", F.explode(F.array_distinct(cells)).alias("c")).select("id", "label", "group", "c.*")
    return again.select("id", "label", F.xxhash64("group", "x", "y").alias("cell"))


def _verified(rows: DataFrame, loose: DataFrame, buckets: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """``(id, other)``: links of the wanted similarity that make up the groups within each component of ``loose``.

    A component of over ``CELL`` documents is cut into cells that all get its first document. If that leaves several groups, each
    document outside the largest one meets all others in cells of a second round. Candidates' links reach down to a similarity of about 0.5, so
    that pages of one template may hang together in one component without being alike. Where a component is so large that its documents
    would have over ``MEETINGS`` blocks to meet, they meet in their ``buckets`` instead, in which all candidates are found: a document has as many
    of these as its fingerprint has segments, however large the component.
    """
    n = X.partitions(rows.sparkSession)

    def check(dealt: DataFrame) -> DataFrame:
        dealt = X.materialize(dealt)
        picked = rows.join(_side(dealt), "id").select("cell", "id", "label", "text")
        ordered = picked.repartition(n, "cell").sortWithinPartitions("cell", "id")
        return X.materialize(ordered.mapInArrow(_alike_in_cells(similarity, shingle), "id long, other long").distinct())

    members = X.materialize(loose.unionAll(loose.select(F.col("component").alias("id"), "component").distinct()))
    large = X.materialize(members.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > CELL))
    part = members.join(_side(large), "component", "left").withColumn("cells", F.ceil(F.coalesce("n", F.lit(1)) / CELL))
    own = F.array(F.pmod(F.xxhash64("id"), "cells"))
    first = check(part.select("id", F.col("id").alias("label"), "component", F.explode(F.when(F.col("id") == F.col("component"), F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).otherwise(own)).alias("x")).select("id", "label", F.xxhash64("component", "x").alias("cell")))
    if not large.limit(1).count():
        return first
    found = components(first).withColumnRenamed("component", "label")
    named = X.materialize(members.join(_side(large), "component").join(found, "id", "left").select("id", F.col("component").alias("group"), F.coalesce("label", "id").alias("label")))
    apart = named.groupBy("group", "label").agg(F.count("*").alias("n")).groupBy("group").agg((F.sum("n") - F.max("n")).alias("others"), F.sum("n").alias("n")).where("others > 0")
    apart = X.materialize(apart.select("group", (F.col("n") > MEETINGS * CELL).alias("wide")))
    if not apart.limit(1).count():
        return first
    left = X.materialize(named.join(_side(apart), "group"))
    links = first.unionAll(check(_meetings(left.where("NOT wide").drop("wide"))))
    wide = left.where("wide").select("id", "label")
    if not wide.limit(1).count():
        return links
    return links.unionAll(check(_meetings(X.materialize(buckets.select("id", F.col("bucket").alias("group")).join(_side(wide), "id")))))


def similar_documents(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, component)`` of documents whose links lead to a smaller id: ``component`` is the smallest of these.

    Two documents are linked if their shingle sets have this Jaccard similarity. Candidates are found by long fingerprints, which may
    miss a few pairs that are hardly similar enough, and verified by their shingles. Documents without words, and null ids, are linked with nothing.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
    prints = X.materialize(rows.mapInArrow(lambda b: _wide_rows(b, shingle), "id long, key binary, fp binary"))
    classes = X.materialize(prints.groupBy("key", "fp").agg(F.min("id").alias("first")))
    copies = prints.join(classes, ["key", "fp"]).where("id <> first").select("id", F.col("first").alias("other"))
    schema = "bucket long, id long, " + ", ".join(f"{w} long" for w in _CHECK)
    dealt = classes.select(F.col("first").alias("id"), "fp").mapInArrow(_bands, schema)
    # candidates by bucket; by id, too: a group's links lead to its smallest id, which in all buckets of a large group is one of few
    ordered = dealt.repartition(X.partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "id")
    loose = components(ordered.mapInArrow(_near_in_buckets(bits_apart(similarity)), "id long, other long").distinct())
    named = X.materialize(components(_verified(rows, loose, dealt.select("bucket", "id"), similarity, shingle)))  # of first copies only: others follow theirs
    follow = copies.join(named.withColumnRenamed("id", "first"), copies["other"] == F.col("first"), "left")
    return named.unionAll(follow.select("id", F.coalesce("component", "other").alias("component")))
