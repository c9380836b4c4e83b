"""Block exchange: whole documents travel in compressed blocks, and what a block needs to know about the rest of the
corpus travels as one packed row per (block, shard).

A *block* is a few MB of whole rows, packed inside one input partition and shuffled once by its id. Both the question
(``block -> shards``) and the answer (``shards -> block``) are binary payloads, so that the volume shuffled follows the
distinct keys of a block and not its tokens. A key that is in every block (a frequent word, a passage of all documents)
costs its shard one entry a block, however often the blocks hold it.

The blocked frame is the same exchange in every branch of a plan, so Spark's reuse of exchanges computes it once. A block's id
is a digest of its rows: a lost executor's blocks are rebuilt from the input, and if that gives other rows, or the same in another
order, their answers find no block and the job fails (see ``settle``) instead of joining what does not belong together.

A shard is one task's work. There are as many as the input's size calls for (``shards``), not as many as a setting says.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.functions.fence import estimate

#: Bytes of text in a block; a longer document is a block of its own.
BLOCK_BYTES = 8 << 20
#: What a row counts besides its text, so that a block of empty texts is bounded too.
ROW_BYTES = 64


#: Bytes that an Arrow batch between the JVM and a Python worker may hold; the default is sized for short rows.
BATCH_BYTES = 2 << 20


_OPTIONS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES), "spark.sql.parquet.columnarReaderBatchSize": "512"}
#: Folders made within each running ``scratch``.
_MADE: list[list[str]] = []


def use_small_batches(spark: SparkSession) -> None:
    """Bound this session's Arrow batches by bytes and the scan's batches by rows, so that long texts do not pile up in the JVM."""
    for k, v in _OPTIONS.items():
        spark.conf.set(k, v)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """``use_small_batches`` for what is executed meanwhile; then the options are what they were."""
    before = {k: spark.conf.get(k, None) for k in _OPTIONS}
    use_small_batches(spark)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """At the end, the folders made meanwhile are removed but for the last one, which has the result."""
    _MADE.append([])
    try:
        yield
    finally:
        made = _MADE.pop()
    for path in made[:-1]:
        _remove(spark, path)
    if _MADE:
        _MADE[-1] += made[-1:]


def eagerly(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``make`` as a table in the shared folder, computed with ``small_batches``, and nothing else left there."""
    with scratch(spark), small_batches(spark):
        return materialize(make())


def pick(df: DataFrame, **names: str) -> DataFrame:
    """The columns ``names`` under the names they are given by; others are dropped.

    Found by their exact names, or else in another case; other columns may have dots or backticks in their names, or differ in case only.
    """
    return aside(df, (), **names)[0].select(*names)


def aside(df: DataFrame, made: Iterable[str], **needed: str) -> tuple[DataFrame, list[str]]:
    """The columns ``needed`` under the names they are given by, then all others as ``own_0``, ``own_1`` and so on; and the names of the others.

    Needed columns are found as by ``pick``. Others that are named as one of ``made`` is, in any case, are left out: the made ones replace them.
    """
    folded, made = [c.lower() for c in df.columns], {c.lower() for c in made}
    at = {new: df.columns.index(c) if c in df.columns else folded.index(c.lower()) for new, c in needed.items()}
    rest = [i for i, c in enumerate(folded) if i not in at.values() and c not in made]
    raw = df.toDF(*(f"raw_{i}" for i in range(len(folded))))
    own = raw.select(*(F.col(f"raw_{i}").alias(new) for new, i in at.items()), *(F.col(f"raw_{i}").alias(f"own_{k}") for k, i in enumerate(rest)))
    return own, [df.columns[i] for i in rest]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of the input, as Spark estimates them, in a shard; and the least that a block is to send to a shard on average.
SHARD_BYTES, PAYLOAD_BYTES = 64 << 20, 128


def shards(df: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """How many shards the rows of ``df`` call for: by their estimated size, two a shuffle partition at least.

    There are at most so many that a block has some ``PAYLOAD_BYTES`` for each; larger inputs want larger blocks.
    """
    return max(2 * partitions(df.sparkSession), min(estimate(df) // SHARD_BYTES, block_bytes // PAYLOAD_BYTES))


def groups(df: DataFrame, bytes_each: int) -> int:
    """How many groups of ``bytes_each`` the rows of ``df`` make up, by their estimated size."""
    return max(1, min(estimate(df) // bytes_each, 1 << 16))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors and the driver see; removed when Python ends at the latest.

    Only in local mode, where there is but one machine, a temporary folder takes the place of a missing setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{(root or _own_root()).rstrip('/')}/llm-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    if _MADE:
        _MADE[-1].append(path)
    return path


@functools.lru_cache(1)
def _own_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="llm-shared-")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone; the folder's owner cleans it
        pass


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts the lineage, and outlives executors."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def squeeze(obj: object, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(pickle.dumps(obj, 5))


def expand(data: bytes) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def freeze(table: pa.Table, level: int = 5) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table.combine_chunks())
    return zstandard.ZstdCompressor(level=level).compress(sink.getvalue())


def thaw(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all()


def let_go() -> None:
    """Hand freed memory back to the system: Python workers outlive their blocks, and an executor has several."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def whole_blocks(batches: Iterator[pa.RecordBatch], text: str, block_bytes: int) -> Iterator[pa.Table]:
    """Tables of whole rows with about ``block_bytes`` of text each, in the order of the input."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths.astype(np.int64) + ROW_BYTES)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = min(int(np.searchsorted(ends, base + block_bytes - size)) + 1, batch.num_rows)
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1] - base)
            start = stop
            if size >= block_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


#: A block travels in pieces: large rows would each be a large object to the JVM.
PIECE_BYTES = 256 << 10
BLOCK = "block long, part int, parts int, data binary"
_BLOCK = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("data", pa.binary())])


def to_blocks(df: DataFrame, text: str, pack: Callable[[pa.Table], dict], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The dicts of ``bytes`` that ``pack`` makes, one a block, in pieces and hash-partitioned by block.

    Hand the result on whole to keep the exchange reusable.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for i, table in enumerate(whole_blocks(batches, text, block_bytes)):
            block = _digest(table, text, first + i)
            data = pickle.dumps(pack(table), 5)
            pieces = [data[a : a + PIECE_BYTES] for a in range(0, len(data), PIECE_BYTES)]
            n = len(pieces)
            del table, data
            yield pa.RecordBatch.from_arrays([pa.array([block] * n), pa.array(range(n), pa.int32()), pa.array([n] * n, pa.int32()), pa.array(pieces, pa.binary())], schema=_BLOCK)
            del pieces
            let_go()

    return df.mapInArrow(run, BLOCK).repartition(partitions(df.sparkSession), "block")


def _digest(table: pa.Table, text: str, place: int) -> int:
    """Of the texts in their order, of the numbers in a column ``id`` if there is one, and of the place; never negative."""
    h = xxhash.xxh64(seed=place)
    for chunk in table[text].chunks:
        for t in chunk:
            h.update(t.as_buffer() if t.is_valid else b"")
        h.update(pc.fill_null(pc.binary_length(chunk), -1).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
    if "id" in table.column_names and pa.types.is_int64(table.schema.field("id").type):
        h.update(pc.fill_null(table["id"], -1).to_numpy().tobytes())
    return h.intdigest() >> 1


def whole(pieces: list[tuple[int, bytes]], block: int) -> dict:
    return pickle.loads(b"".join(data for _, data in sorted(pieces))) | {"block": block}


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The dicts of the blocks in a partition, as their last pieces arrive."""
    pending: dict[int, list[tuple[int, bytes]]] = {}
    for batch in batches:
        for block, part, parts, data in zip(*(batch[c].to_pylist() for c in ("block", "part", "parts", "data"))):
            pending.setdefault(block, []).append((part, data))
            if len(pending[block]) == parts:
                yield whole(pending.pop(block), block)


def of_group(table: pa.Table) -> dict | None:
    """The dict of the one block whose pieces are the table's rows."""
    if not table.num_rows:
        return None
    return whole(list(zip(table["part"].to_pylist(), table["data"].to_pylist())), table["block"][0].as_py())


PAYLOAD = "shard int, block long, payload binary"
_PAYLOAD = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("payload", pa.binary())])


def payload_rows(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    shard, block, payload = zip(*rows) if rows else ((), (), ())
    return pa.table([pa.array(shard, pa.int32()), pa.array(block, pa.int64()), pa.array(payload, pa.binary())], schema=_PAYLOAD)


def ask(blocks: DataFrame, questions: Callable[[dict], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Payload rows ``(shard, block, payload)`` that ``questions`` makes from each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_block(batches):
            yield from payload_rows([(s, row["block"], p) for s, p in questions(row)]).to_batches()
            let_go()

    return blocks.mapInArrow(run, PAYLOAD)


def answer(asked: DataFrame, reply: Callable[[list[tuple[int, bytes]]], Iterator[tuple[int, bytes]]], shards: int) -> DataFrame:
    """``reply`` gets all of a shard's ``(block, payload)``, ordered by block, and gives ``(block, payload)`` back.

    There is a task for each of the ``shards``, on average. It holds their packed payloads, unsorted: the JVM need not keep and sort
    them as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for shard, block, payload in zip(*(batch[c].to_pylist() for c in ("shard", "block", "payload"))):
                held.setdefault(shard, []).append((block, payload))
        for shard in sorted(held):
            yield from payload_rows([(shard, b, p) for b, p in reply(sorted(held.pop(shard), key=lambda x: x[0]))]).to_batches()
            let_go()

    return asked.repartition(shards, "shard").mapInArrow(run, PAYLOAD)


def meet(blocks: DataFrame, answers: DataFrame, finish: Callable[[dict, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``finish`` gets each block with the rows of ``answers`` (which have a column ``block``) for it, and gives the rows that come of it.

    Answers without their block mean that the block was built anew from rows in another order: that fails.
    """
    empty = _empty(blocks.sparkSession, schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = of_group(left)
        if row is None:
            if right.num_rows:
                raise RuntimeError("a block was rebuilt from other rows than before: give the operator a table, or write its input as one")
            return empty
        out = finish(row, right).cast(empty.schema)  # columns that are never null are declared as others are
        let_go()
        return out

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def settle(blocks: DataFrame, answers: DataFrame, finish: Callable[[dict, dict[int, bytes]], pa.Table], schema: str) -> DataFrame:
    """``meet``, where ``finish`` gets each block with its answers by shard."""
    return meet(blocks, answers, lambda row, right: finish(row, dict(zip(right["shard"].to_pylist(), right["payload"].to_pylist()))), schema)


def _empty(spark: SparkSession, schema: str) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema)).empty_table()


def places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers ``starts[i]`` to ``starts[i] + lengths[i] - 1``, run after run."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``values[starts[i]:starts[i] + lengths[i]]``, one after the other."""
    return values[places(starts, lengths)]


def offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))


def held_out(id_col: str) -> F.Column:
    """True for the quarter of the ids that no label may be learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
