"""Helpers shared by the operators: Arrow batches, hashing of words, shared folders.

Python stages get Arrow batches and hand numpy views of the UTF-8 bytes to vectorised
code. A batch is cut into slices of a few MB of text, so memory follows the slice size
(or the longest single document), not the partition.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20
U = np.uint64

_rng = np.random.default_rng(20240229)
#: Random 64-bit value of each byte, for polynomial hashes.
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
GOLDEN = U(0x9E3779B97F4A7C15)

#: ASCII white space [\x20\x09-\x0D].
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Lower-cases A-Z only.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings one after another, and n + 1 offsets into them. Null counts as empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each has about most bytes in the column, and one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(batch.schema.get_field_index(column)))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, side="right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, so that long texts don't make large ones."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8388608")


def release() -> None:
    """Gives freed memory back to the system; a Python worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def releasing(work):
    """work over batches, and release() after the last."""

    @functools.wraps(work)
    def until_end(batches):
        yield from work(batches)
        release()

    return until_end


@contextlib.contextmanager
def no_gc():
    """Python's cycle search is off inside: it takes longer than code that makes many small objects and no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Words:
    """ASCII-space words of a slice of documents, as arrays.

    begin, end: byte range of each word; hash: 64 bits; doc: row of the slice;
    first: n + 1 offsets of each document's words.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool):
        n = len(data)
        self.data, self.at = data, at
        if not n:
            empty = np.zeros(0, np.int64)
            self.begin, self.end, self.hash, self.doc = empty, empty, empty.astype(np.uint64), empty
            self.first = np.zeros(len(at), np.int64)
            return
        if lower:
            data = np.frombuffer(data.tobytes().translate(LOWER), dtype=np.uint8)
        word = ~IS_SPACE[data]
        cut = np.zeros(n + 1, dtype=bool)
        cut[at[:-1]] = True
        cut = cut[:n]
        start = word.copy()
        start[1:] &= ~word[:-1] | cut[1:]
        stop = word.copy()
        stop[:-1] &= ~word[1:] | cut[1:]
        self.begin = np.flatnonzero(start)
        self.end = np.flatnonzero(stop) + 1
        # a word's hash is the sum of a random value for each pair of a byte and its place in the word
        if len(self.begin):
            code = (np.arange(n) - self.begin[np.cumsum(start) - 1]).astype(np.uint64)
            code <<= U(8)
            code |= data
            code *= GOLDEN
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(mix(code), out=sums[1:])
            self.hash = mix(sums[self.end] - sums[self.begin] + (self.end - self.begin).astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)
        self.first = np.searchsorted(self.begin, at)
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(self.first))

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and whether all lie in one document."""
        m = len(self.hash)
        if m < n:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        k = powers(0xD6E8FEB86659FD93, n)
        total = np.zeros(m - n + 1, dtype=np.uint64)
        for i in range(n):
            total += self.hash[i : m - n + 1 + i] * k[i]
        return mix(total), self.doc[: m - n + 1] == self.doc[n - 1 :]


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """Sorted distinct n-word shingle hashes of each document; with fewer words the whole sequence counts as one."""
    hashes, whole = words.shingles(n)
    out, k = [], powers(0xA24BAED4963EE407, n)
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= n:
            x = np.sort(hashes[a : b - n + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif b > a:
            out.append(mix((words.hash[a:b] * k[: b - a]).sum(keepdims=True, dtype=np.uint64) + U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shared_folder(spark: SparkSession) -> str:
    """A fresh path in the folder that all machines share; sets one only where spark.checkpoint.dir is unset, as in tests."""
    at = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.conf.get("spark.sql.warehouse.dir", "/tmp").rstrip("/") + "/_shared"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return f"{at.rstrip('/')}/{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def dropping_shuffles(spark: SparkSession):
    """Shuffle files of a query that runs inside go when it ends, not when the driver happens to collect its garbage."""
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, was)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes what cut_lineage wrote for df. Nothing may read it any more."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: A key is hot if more than one in HOT_SHARE rows, and more than HOT_ROWS, hold it; so at most HOT_SHARE keys are.
HOT_SHARE, HOT_ROWS = 1000, 1000


def join_hot(left: DataFrame, right: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """Joins left, of total rows, with right, which has one row of bounded size for each key. Hot keys of left don't meet in one task: their rows of right, HOT_SHARE at most, are broadcast."""
    hot = []
    if total > HOT_ROWS:
        most = max(HOT_ROWS, total // HOT_SHARE)
        hot = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(key).collect()
    if not hot:
        return left.join(right, key, how)
    keys = F.broadcast(left.sparkSession.createDataFrame(hot, left.select(key).schema))
    few = F.broadcast(right.join(keys, key, "left_semi"))
    return left.join(keys, key, "left_anti").join(right, key, how).unionByName(left.join(keys, key, "left_semi").join(few, key, how))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


COUNTS = "key string, block int, task int, counts binary"
BLOCK = 2048


def count_rows(counts: dict[str, np.ndarray], task: int) -> pa.RecordBatch:
    """What one task has counted: for each key a vector of 64-bit counts, in blocks."""
    rows = [(key, i // BLOCK, task, v[i : i + BLOCK].astype("<i8").tobytes()) for key, v in counts.items() for i in range(0, len(v), BLOCK)]
    key, block, at, data = zip(*rows) if rows else ((), (), (), ())
    return pa.record_batch([pa.array(key, pa.string()), pa.array(block, pa.int32()), pa.array(at, pa.int32()), pa.array(data, pa.binary())], names=["key", "block", "task", "counts"])


def summed_counts(parts: DataFrame, size: int) -> dict[str, np.ndarray]:
    """Sums such rows in two levels, so no task gets more than a share of them, and brings the totals, of fixed size, to the driver."""

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), "<i8") for x in rows.column("counts"))
        first = rows.slice(0, 1)
        return pa.table([first.column("key"), first.column("block"), pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["key", "block", "task", "counts"])

    once = parts.withColumn("task", F.col("task") % 64).groupBy("key", "block", "task").applyInArrow(add, COUNTS)
    out: dict[str, np.ndarray] = {}
    for key, block, _, data in once.groupBy("key", "block").applyInArrow(add, COUNTS).collect():
        out.setdefault(key, np.zeros(size, np.int64))[block * BLOCK : block * BLOCK + len(data) // 8] = np.frombuffer(data, "<i8")
    return out


def byte_grams(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of the n bytes (4 at most) from each position on."""
    if len(data) < n:
        return np.zeros(0, np.uint32)
    x = np.zeros(len(data) - n + 1, np.uint32)
    for i in range(n):
        x |= data[i : len(data) - n + 1 + i].astype(np.uint32) << np.uint32(8 * i)
    return (x * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)


def span_sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of values from begin to end, for each pair of positions; 0 if end is not after begin."""
    sums = np.concatenate((np.zeros(1, values.dtype if values.dtype.kind != "b" else np.int64), np.cumsum(values)))
    return sums[np.maximum(begin, end)] - sums[begin]
