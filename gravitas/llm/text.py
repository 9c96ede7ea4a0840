"""Shared helpers: documents with unique ids, and batches of texts seen as one byte buffer.

The array helpers work on a few MB of text at a time, so a task's memory does not depend on how many rows an Arrow
batch holds. One document is never cut.
"""

from __future__ import annotations

import ctypes
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gravitas.session import fresh_path

PIECE_BYTES = (1 << 19) - 1

#: ASCII white space: space and \x09-\x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def unique_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``doc_id, text`` with one row per id.

    Rows that share an id are one document; its text is the smallest that is not null. The ids alone are counted first,
    so that texts are shuffled only if some id does repeat. A null id is an id like any other.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    repeated = plain.groupBy("doc_id").count().where("count > 1")
    return plain if repeated.isEmpty() else plain.groupBy("doc_id").agg(F.min("text").alias("text"))


@cache
def _allocator() -> ctypes.CDLL | None:
    """The C library, where it can hand freed memory back."""
    library = ctypes.CDLL(None)
    return library if hasattr(library, "malloc_trim") else None


def release() -> None:
    """Hand memory that is free back to the machine, and drop tables that only a very long text needed.

    Python workers outlive their tasks; without this each of them keeps the most that any of its tasks has used.
    """
    if _powers and len(_powers[0]) > PIECE_BYTES + 1:
        _powers.clear()
    pa.default_memory_pool().release_unused()
    if library := _allocator():
        library.malloc_trim(0)


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, at least one row; frees memory after the last."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to
    release()


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of bytes, and where each begins (one entry more than rows). Null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or len(offsets) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (a run of bytes other than ASCII white space), and the first word of each text."""
    solid = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], solid[:-1])) if len(data) else solid
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.concatenate((solid[1:], [False])) if len(data) else solid
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(19, int(n - 1).bit_length())
        _powers[:] = []
        for base in (_BASE, _BASE_INVERSE):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for every span: a difference of polynomial prefix sums, scrambled."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for every run of k neighbouring hashes."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + n]
    return mix(out)


def owners(first: np.ndarray) -> np.ndarray:
    """For each item the row that holds it, from the first item of each row."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def slide(values: np.ndarray, w: int, best: np.ufunc) -> np.ndarray:
    """Smallest or largest of each w neighbouring values, in about log2(w) passes."""
    n, have, out = len(values) - w + 1, 1, values
    if n <= 0:
        return values[:0]
    while have * 2 <= w:
        out = best(out[: len(out) - have], out[have:])
        have *= 2
    return best(out[:n], out[w - have : w - have + n])


def list_array(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def join_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans' bytes one after the other, and where each begins."""
    sizes = ends - starts
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])], offsets


def binary_array(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return whole.cast(kind or pa.binary())


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _cleaning = threading.Lock(), {}
_scratch = threading.local()


@contextmanager
def _cleanup(spark: SparkSession) -> Iterator[None]:
    """Remove shuffle files after each query; the setting is as before when the last of several writers is done."""
    with _lock:
        users, before = _cleaning.get(spark, (0, spark.conf.get(CLEANUP, None)))
        _cleaning[spark] = (users + 1, before)
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            users, before = _cleaning.pop(spark)
            if users > 1:
                _cleaning[spark] = (users - 1, before)
            elif before is None:
                spark.conf.unset(CLEANUP)
            else:
                spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: a step that lost executors need not repeat.

    The shuffle files that the step has used are removed when it is done. The innermost open ``scratch`` of this thread,
    if there is one, owns the table.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    with _cleanup(spark):
        df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    if owners := getattr(_scratch, "open", None):
        owners[-1][id(made)] = (made, path)
    return made


def _taken(df: DataFrame) -> str | None:
    """The path of a table that an open ``scratch`` owned until now."""
    return next((owned.pop(id(df))[1] for owned in getattr(_scratch, "open", []) if id(df) in owned), None)


def remove(*tables: DataFrame) -> None:
    """Delete tables written in an open ``scratch``; nothing may read them afterwards."""
    for df in tables:
        if path := _taken(df):
            jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def kept(df: DataFrame) -> DataFrame:
    """A written table that is a result and so outlives its ``scratch``."""
    _taken(df)
    return df


@contextmanager
def scratch() -> Iterator[None]:
    """Delete at the end all tables that this thread has written inside, but for those ``kept``."""
    if not hasattr(_scratch, "open"):
        _scratch.open = []
    own: dict[int, tuple[DataFrame, str]] = {}
    _scratch.open.append(own)
    try:
        yield
    finally:
        remove(*(df for df, _ in list(own.values())))
        _scratch.open.pop()


def packed_texts(docs: DataFrame, chosen: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``doc_id, size, packed``: texts as compressed bytes, a third smaller in a shuffle than Spark's own compression.

    With ``chosen`` only rows for which it is true of the id's hash (``xxhash64``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            if chosen:
                batch = batch.filter(pa.array(chosen(batch.column("key").to_numpy().view(np.uint64))))
            for part in pieces(batch, "text"):
                raw = pc.fill_null(part.column("text").cast(pa.large_binary()), b"").to_pylist()
                packed = [codec.compress(x, asbytes=True) if x else b"" for x in raw]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "size", "packed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    key = [F.xxhash64("doc_id").alias("key")] if chosen else []
    return docs.select("doc_id", "text", *key).mapInArrow(run, f"doc_id {kind}, size long, packed binary")


def unpacked(batch: pa.RecordBatch, limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of packed texts with their bytes and offsets, about ``limit`` bytes each."""
    codec = pa.Codec("zstd")
    size = batch.column("size").to_numpy()
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        part = batch.slice(at, to - at)
        raw = b"".join(codec.decompress(x, decompressed_size=n, asbytes=True) for x, n in zip(part.column("packed").to_pylist(), size[at:to].tolist()) if n)
        yield part, np.frombuffer(raw, np.uint8), np.concatenate(([0], ends[at:to] - before))
        at = to
    release()
