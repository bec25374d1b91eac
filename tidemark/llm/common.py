"""Shared helpers of the training-data operators: table reading, shared-folder tables, Arrow text access."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts name it: space and 0x09 to 0x0D.
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Tables of ids, with a few numbers each, are broadcast up to this many rows (some 50 MB at most); beyond it Spark joins by shuffle.
BROADCAST_IDS = 200_000
#: Rows of an Arrow batch in the jobs that operators run themselves: some 3 MB of ordinary texts.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session that names none gets one, a cluster an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='spark-tidemark-')}"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> Iterator[None]:
    """Jobs begun inside send whole texts to Python in batches of at most rows rows; the session's setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(name)
    if not 0 < int(held) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, held)


#: Tables of the scopes that are open: (path, whether it outlives its scope).
_SCOPES: ContextVar[tuple[list[tuple[str, bool]], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end, but for those written with keep, which the scope around gets.

    What is returned from inside must not read a removed table."""
    mine: list[tuple[str, bool]] = []
    outer = _SCOPES.get()
    token = _SCOPES.set((*outer, mine))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for path, keep in mine:
            if not keep:
                _remove(spark, path)
            elif outer:
                outer[-1].append((path, False))


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(table_: DataFrame) -> None:
    """Remove the table that written gave, before its scope ends; nothing may read it later."""
    if files := table_.inputFiles():
        _remove(table_.sparkSession, files[0].rpartition("/")[0])


def written(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors.

    In a scope (see scratch) the table goes with it, unless keep is set."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{tag}-{uuid.uuid4().hex}"
    if scopes := _SCOPES.get():
        scopes[-1].append((path, keep))
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def small_side(ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """ids with a broadcast hint if it has at most limit rows (counted), else as it is."""
    return F.broadcast(ids) if ids.limit(limit + 1).count() <= limit else ids


def with_seq(df: DataFrame, name: str) -> DataFrame:
    """Add a row number. It is drawn anew whenever df is computed: use the result in one job, or see numbered."""
    return df.withColumn(name, F.monotonically_increasing_id())


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a row number, written once: each later read sees the same numbers, whatever shuffles made df."""
    return written(with_seq(df, name), "rows", keep=True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """Return the memory that freed arrays have left to the system: Python workers live on between tasks."""
    _POW.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with memory given back at the end of the task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def byte_values(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """The values of a binary or string Arrow column as bytes; null as empty."""
    for v in column.cast(pa.binary()) if pa.types.is_string(column.type) else column:
        yield v.as_py() or b""


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes (Stafford's variant 13 of the MurmurHash3 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.empty(n, np.uint64)
    if n:
        out[0], k, step = 1, 1, base
        while k < n:
            m = min(k, n - k)
            out[k : k + m] = out[:m] * np.uint64(step)
            step = step * step % (1 << 64)
            k += m
    return out


_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_POW: dict[str, np.ndarray] = {}


def _powers(kind: str, n: int) -> np.ndarray:
    held = _POW.get(kind)
    if held is None or len(held) < n:
        held = _POW[kind] = powers(_BASE if kind == "up" else _INV, max(n, 1 << 20))
    return held[:n]


class Words:
    """Word boundaries and hashes of a block of texts.

    Texts are lower-cased (A-Z), split at ASCII white space and joined by single spaces. A span's hash
    is a polynomial over its bytes modulo 2^64, mixed; equal spans of text have equal hashes.
    """

    def __init__(self, texts: list[bytes]):
        joined = [b" ".join(t.lower().split()) for t in texts]
        self.data = np.frombuffer(b"\n".join(joined) + b"\n", np.uint8)
        ends = np.flatnonzero((self.data == 32) | (self.data == 10))
        starts = np.concatenate(([0], ends[:-1] + 1))
        real = ends > starts
        self.start, self.end = starts[real], ends[real]
        close = np.cumsum([len(j) + 1 for j in joined])
        self.first = np.searchsorted(self.end, np.concatenate(([0], close[:-1])), "left")
        self.count = np.diff(np.append(self.first, len(self.end)))
        up = _powers("up", len(self.data))
        sums = np.cumsum(_BYTE[self.data] * up, dtype=np.uint64)
        self.sums = np.concatenate((np.zeros(1, np.uint64), sums))

    def spans(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the spans from word first[i] to word last[i], both included."""
        a, b = self.start[first], self.end[last]
        return mix64((self.sums[b] - self.sums[a]) * _powers("down", len(self.data))[a])

    def words(self) -> np.ndarray:
        every = np.arange(len(self.start))
        return self.spans(every, every)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word shingles and the text each belongs to; a text with 1 to k-1 words has one."""
        n = np.where(self.count >= k, self.count - k + 1, np.minimum(self.count, 1))
        of = np.repeat(np.arange(len(n)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.first[of]
        return self.spans(at, at + np.minimum(self.count[of], k) - 1), of


def blocks(texts: Iterator[bytes], most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in blocks of about most bytes, each with the index of its first text."""
    block: list[bytes] = []
    size = at = 0
    for t in texts:
        block.append(t)
        size += len(t) + 1
        if size >= most:
            yield at, block
            at, block, size = at + len(block), [], 0
    if block:
        yield at, block
