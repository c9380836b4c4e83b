"""Operator 5: removal of repeated byte strings with suffix arrays.

A byte goes if it is covered by a string of ``length`` bytes that also starts in a document with a smaller id. Three
exchanges of blocks (see ``exchange``) find these strings without ever sorting the whole corpus at one place:

1. Each window of ``length`` bytes is named by the smallest hash of the short strings in it, so equal windows have equal names
   wherever they are. Blocks send the names they hold (32 bits each); shards say which are in more than one block.
2. Stretches of windows with one shared name are sent to the name's shard, each different stretch once a block, with the
   smallest id it occurs in. The shard builds suffix arrays over them (Larsson-Sadakane refinement: start from eight bytes,
   double the depth, sort unsorted groups only), common prefixes (Kasai) and so classes of equal windows. A shard with more
   than ``PIECE_BYTES`` has several arrays, whose classes are merged by binary search. Where the stretches of one name are
   more than ``SHARD_BYTES``, its blocks are dealt to a triangle of shards so that any two blocks still meet in one.
3. The smallest id of every window goes back to its blocks, which remove what has a smaller one than their own.

The first step only leaves out windows that are in one document alone; it decides nothing else. As equal windows have equal names,
arrays of different names have nothing to merge. Arrays of one name do, wherever it has several: within a shard by binary search of
each array's sorted classes in the others, and between the cells of a triangle by the smallest id that any of them found.

Defined results: null texts are empty; a null id counts as larger than all others; rows with equal ids never remove each
other's bytes; repeated rows each give a row. Texts shorter than ``length`` are kept whole. Columns of the input named ``kept``,
``n_bytes``, ``n_removed`` or ``spans`` are replaced; all others are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X

LENGTH = 50
BLOCK_BYTES = 8 << 20
#: Bytes of different stretches in one suffix array, and in one shard.
PIECE_BYTES = 8 << 20
SHARD_BYTES = 64 << 20
#: Length of the strings that are hashed for a window's name.
GRAM = 24
_CHUNK = 1 << 20
_LAST = np.iinfo(np.int64).max


def _names(data: np.ndarray, length: int) -> np.ndarray:
    """The name of each window that starts in ``data`` (``uint8``) and ends in it."""
    gram = min(GRAM, length)
    n = len(data) - gram + 1
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.ndarray(len(data), "<u8", padded, strides=(1,)).copy()
    h = np.zeros(n, np.uint64)
    for i, at in enumerate(range(0, gram - 7, 8)) if gram >= 8 else ():
        h = (h ^ (words[at : at + n] * np.uint64(0x9E3779B97F4A7C15 + 2 * i))) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(31)
    if gram < 8:
        h = (words[:n] & np.uint64((1 << 8 * gram) - 1)) * np.uint64(0x9E3779B97F4A7C15)
    h *= np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    width, have = length - gram + 1, 1
    while have < width:  # least of `have` hashes to least of `width`
        step = min(have, width - have)
        h = np.minimum(h[: len(h) - step], h[step:])
        have += step
    return h


def _runs(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows with one name in one document: where they start, how many windows they have, their names."""
    starts, counts, names = [], [], []
    for a in range(0, len(data) - length + 1, _CHUNK):
        b = min(a + _CHUNK, len(data) - length + 1)
        name = _names(data[a : b + length - 1], length)
        cut = np.ones(b - a, bool)
        cut[1:] = name[1:] != name[:-1]
        cut[ends[np.searchsorted(ends, a) : np.searchsorted(ends, b)] - a] = True
        first = np.flatnonzero(cut)
        at = first + a
        doc = np.searchsorted(ends, at, side="right")
        size = np.minimum(np.diff(np.append(at, b)), ends[doc] - length + 1 - at)  # windows do not leave their document
        some = size > 0
        starts.append(at[some])
        counts.append(size[some])
        names.append(name[first[some]])
    empty = np.zeros(0, np.int64)
    return (np.concatenate(starts or [empty]), np.concatenate(counts or [empty]), np.concatenate(names or [empty.astype(np.uint64)]))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``text`` in the order of their first ``depth`` bytes or more."""
    n = len(text)
    key = np.ndarray(n, ">u8", np.concatenate((text, np.zeros(8, np.uint8))), strides=(1,)).astype(np.uint64)
    order = np.argsort(key)
    sorted_key = key[order]
    head = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    del key, sorted_key
    at = np.flatnonzero(head)
    group = np.repeat(at, np.diff(np.append(at, n)))
    rank = np.empty(n + 1, np.int64)
    rank[order] = group
    rank[n] = -1
    open_ = np.flatnonzero(~(head & np.append(head[1:], True)))  # slots of groups with more than one suffix
    h = 8
    while h < depth and len(open_):
        p = order[open_]
        pair = rank[p] * (n + 2) + rank[np.minimum(p + h, n)] + 1
        by = np.argsort(pair)
        p, pair = p[by], pair[by]
        order[open_] = p
        head = np.concatenate(([True], pair[1:] != pair[:-1]))
        rank[p] = open_[np.maximum.accumulate(np.where(head, np.arange(len(p)), 0))]
        open_ = open_[~(head & np.append(head[1:], True))]
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, cap: int, lane: int = 256) -> np.ndarray:
    """By text position, the length (up to ``cap``) of the prefix shared with the suffix before it in ``order``.

    Kasai's walk: the next position shares at least one byte less. Many stretches of the text are walked side by side, eight
    bytes at a time. Suffixes that are equal as deep as they were sorted have no order to rely on: after these the walk
    starts anew.
    """
    n = len(text)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = n  # nothing
    words = np.ndarray(n + cap + 1, "<u8", np.concatenate((text, np.zeros(cap + 9, np.uint8))), strides=(1,))
    out = np.zeros(n, np.int32)
    starts = np.arange(0, n, lane)
    shared = np.zeros(len(starts), np.int64)
    for step in range(lane):
        p = starts + step
        if p[-1] >= n:
            p, starts, shared = p[:-1], starts[:-1], shared[:-1]
            if not len(p):
                break
        q = before[p]
        shared = np.where(shared >= cap, 0, np.maximum(shared - 1, 0))
        live = np.arange(len(p))
        while len(live):
            differ = words[p[live] + shared[live]] ^ words[np.minimum(q[live] + shared[live], n + cap)]
            shared[live] += np.where(differ == 0, 8, np.bitwise_count((differ & -differ) - np.uint64(1)) // 8)
            live = live[(differ == 0) & (shared[live] < cap)]
        shared = np.minimum(np.minimum(shared, cap), n - np.maximum(p, q))
        out[p] = shared
    return out


def _least_ids(strings: list[bytes], ids: np.ndarray, length: int) -> np.ndarray:
    """For every window of the strings, one string after the other, the smallest id of a string that holds an equal window."""
    windows = np.array([len(s) - length + 1 for s in strings], np.int64)
    least = np.empty(int(windows.sum()), np.int64)
    pieces, first, size = [], 0, 0
    for i, s in enumerate(strings):
        size += len(s)
        if size >= PIECE_BYTES or i + 1 == len(strings):
            pieces.append((first, i + 1))
            first, size = i + 1, 0
    begin = X.offsets(windows)
    found = []
    for a, b in pieces:
        text = np.frombuffer(b"".join(strings[a:b]), np.uint8)
        lengths = windows[a:b] + length - 1
        order = suffix_array(text, length)
        new = common_prefixes(text, order, length)[order] < length
        place = np.full(len(text), -1, np.int64)  # of the window among all windows
        place[X.places(X.offsets(lengths)[:-1], windows[a:b])] = np.arange(begin[a], begin[b])
        own = np.repeat(ids[a:b], windows[a:b])
        classes = np.cumsum(new)
        at = place[order]
        order, classes, at = order[at >= 0], classes[at >= 0], at[at >= 0]
        heads = np.flatnonzero(np.concatenate(([True], classes[1:] != classes[:-1])))
        low = np.minimum.reduceat(own[at - begin[a]], heads)
        keys = np.ndarray(len(text) - length + 1, f"S{length}", text, strides=(1,))[order[heads]] if len(pieces) > 1 else None
        found.append([at, np.diff(np.append(heads, len(at))), low, keys])
    for j in range(len(found)):  # merge the arrays' classes
        for i in range(j):
            mine, theirs = found[j][3], found[i][3]
            slot = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
            same = np.flatnonzero(theirs[slot] == mine)
            both = np.minimum(found[j][2][same], found[i][2][slot[same]])
            found[j][2][same] = both
            found[i][2][slot[same]] = both
    for at, sizes, low, _ in found:
        least[at] = np.repeat(low, sizes)
    return least


class _Block:
    """A block's documents, and the stretches of windows in it."""

    def __init__(self, row: dict, length: int):
        self.table, self.length = X.thaw(row["rows"]), length
        texts = [t for chunk in self.table["text"].chunks for t in chunk.to_pylist()]
        self.raw = b"".join(texts)
        self.data = np.frombuffer(self.raw, np.uint8)
        self.ends = X.offsets(np.array([len(t) for t in texts], np.int64))[1:]
        self.ids = np.array([_LAST if i is None else i for i in self.table["id"].to_pylist()], np.int64)
        full = np.append(True, np.diff(self.ends) > 0) if len(self.ends) else np.zeros(0, bool)
        self.starts, self.counts, self.names = _runs(self.data, self.ends[full], length) if len(self.data) >= length else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
        self.doc = np.searchsorted(self.ends, self.starts, side="right")
        self.each, self.inverse = np.unique(self.names, return_inverse=True)

    def by_shard(self, shards: int) -> Iterator[tuple[int, np.ndarray]]:
        """The positions in ``each`` of a shard's names."""
        shard = (self.each >> np.uint64(32)).astype(np.int64) % shards
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(cut)):
            yield int(s), order[cut[s] : cut[s + 1]]

    def stretches(self, answers: dict[int, bytes], shards: int) -> dict[int, tuple[int, list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
        """By shard: its parts, the different stretches to send, the smallest id of each, and the runs and their stretch."""
        shared, parts = np.zeros(len(self.each), bool), {}
        shard_of = np.zeros(len(self.each), np.int64)
        for s, at in self.by_shard(shards):
            shard_of[at] = s
            parts[s], bits = X.expand(answers[s])
            shared[at] = np.unpackbits(bits, count=len(at)).astype(bool)
        low, high = np.full(len(self.each), _LAST), np.full(len(self.each), -_LAST)
        ids = self.ids[self.doc]
        np.minimum.at(low, self.inverse, ids)
        np.maximum.at(high, self.inverse, ids)
        runs = np.flatnonzero((shared | (low < high))[self.inverse])
        runs = runs[np.argsort(shard_of[self.inverse[runs]], kind="stable")]
        shard = shard_of[self.inverse[runs]]
        cut = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True]))) if len(runs) else []
        out = {}
        for a, b in zip(cut, cut[1:]):
            mine, known = runs[a:b], {}
            of = np.empty(b - a, np.int64)
            begin = self.starts[mine].tolist()
            for i, (p, n) in enumerate(zip(begin, self.counts[mine].tolist())):
                of[i] = known.setdefault(self.raw[p : p + n + self.length - 1], len(known))
            least = np.full(len(known), _LAST)
            np.minimum.at(least, of, ids[mine])
            out[int(shard[a])] = (parts[int(shard[a])], list(known), least, mine, of)
        return out


def _cells(block: int, parts: int) -> list[int]:
    """The cells of the triangle of a shard's parts that a block goes to: any two blocks share one."""
    a = (block * 2654435761 >> 7) % parts
    return [max(a, j) * (max(a, j) + 1) // 2 + min(a, j) for j in range(parts)]


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, whole_characters: bool = False) -> DataFrame:
    """``docs`` without ``text``, plus ``kept`` (the bytes left), ``n_bytes``, ``n_removed`` and ``spans``.

    ``spans`` holds the removed runs as offsets, start and end in turn. Columns that are named as the made ones are, in any case, are replaced. With
    ``whole_characters`` a character that is covered in part only is kept, so that ``kept`` is UTF-8 as the text was.
    """
    made = ("kept", "n_bytes", "n_removed", "spans")
    own, names = X.aside(docs, made, id=id_col, text=text)
    rest = own.columns[2:]
    rows = own.select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.struct(*rest).alias("rest") if rest else F.lit(None).cast("string").alias("rest"))
    shards = X.shards(docs, block_bytes)

    def questions(row: dict) -> Iterator[tuple[int, bytes]]:
        block = _Block(row, length)
        runs = np.bincount(block.inverse, weights=block.counts + length - 1, minlength=len(block.each))
        for s, at in block.by_shard(shards):
            yield s, X.squeeze((block.each[at].astype(np.uint32), runs[at].astype(np.uint32)))

    def shared(got: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        names, sizes = zip(*(X.expand(p) for _, p in got))
        flat = np.concatenate(names)
        order = np.argsort(flat, kind="stable")
        same = flat[order][1:] == flat[order][:-1]
        many = np.zeros(len(flat), bool)
        many[order[1:][same]] = many[order[:-1][same]] = True
        parts = 1 + int(np.concatenate(sizes)[many].sum(dtype=np.int64)) // SHARD_BYTES
        begin = 0
        for (block, _), own in zip(got, names):
            yield block, X.squeeze((parts, np.packbits(many[begin : begin + len(own)])))
            begin += len(own)

    def stretches(row: dict, answers: dict[int, bytes]) -> pa.Table:
        sent = []
        for s, (parts, strings, least, _, _) in _Block(row, length).stretches(answers, shards).items():
            payload = X.squeeze((np.array([len(x) for x in strings], np.uint32), b"".join(strings), least))
            sent += [(s + shards * (1 + c), row["block"], payload) for c in _cells(row["block"], parts)]
        return X.payload_rows(sent)

    def classes(got: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        known: dict[bytes, int] = {}
        ids, asked = [], []
        for block, payload in got:
            lengths, joined, least = X.expand(payload)
            ends = X.offsets(lengths).tolist()
            of = np.array([known.setdefault(joined[a:b], len(known)) for a, b in zip(ends, ends[1:])], np.int64)
            asked.append((block, of))
            ids.append(least)
        low = np.full(len(known), _LAST)
        for (_, of), least in zip(asked, ids):
            np.minimum.at(low, of, least)
        strings = list(known)
        least = _least_ids(strings, low, length)
        windows = np.array([len(s) - length + 1 for s in strings], np.int64)
        begin = X.offsets(windows)[:-1]
        for block, of in asked:
            yield block, X.squeeze(X.ragged(least, begin[of], windows[of]), 1)

    def finish(row: dict, answers: dict[int, bytes]) -> pa.Table:
        block = _Block(row, length)
        own = block.ids[block.doc]
        gone = np.zeros(len(block.data) + 1, np.int32)
        for s, (parts, strings, _, runs, of) in block.stretches({k: v for k, v in answers.items() if k < shards}, shards).items():
            windows = np.array([len(x) - length + 1 for x in strings], np.int64)
            least = np.full(int(windows.sum()), _LAST)
            for c in _cells(row["block"], parts):
                least = np.minimum(least, X.expand(answers[s + shards * (1 + c)]))
            n = block.counts[runs]
            smaller = X.ragged(least, X.offsets(windows)[:-1][of], n) < np.repeat(own[runs], n)
            at = X.places(block.starts[runs], n)[smaller]
            np.add.at(gone, at, 1)
            np.add.at(gone, at + length, -1)
        cover = np.cumsum(gone[:-1]) > 0
        kept, removed, spans = [], [], []
        for a, b in zip(np.append(0, block.ends[:-1]).tolist(), block.ends.tolist()):
            hit = cover[a:b]
            if whole_characters and hit.any():
                lead = np.flatnonzero((block.data[a:b] & 0xC0) != 0x80)
                hit = np.repeat(np.logical_and.reduceat(hit, lead), np.diff(np.append(lead, b - a)))
            edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
            kept.append(block.data[a:b][~hit].tobytes() if len(edge) else block.raw[a:b])
            removed.append(int((edge[1::2] - edge[::2]).sum()))
            spans.append(edge)
        sizes = np.diff(np.append(0, block.ends))
        return pa.table([block.table["id"], block.table["rest"], pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.int64()))], names=["id", "rest", *made])

    blocks = X.to_blocks(rows, "text", lambda t: {"rows": X.freeze(t)}, block_bytes)
    masks = X.answer(X.ask(blocks, questions), shared, shards)
    least = X.answer(X.settle(blocks, masks, stretches, X.PAYLOAD), classes, shards)
    schema = f"id long, rest {rows.schema['rest'].dataType.simpleString()}, kept binary, n_bytes long, n_removed long, spans array<bigint>"
    done = X.settle(blocks, masks.unionAll(least), finish, schema)
    return done.select("id", *(F.col("rest").getField(c).alias(c) for c in rest), *made).toDF(id_col, *names, *made)
