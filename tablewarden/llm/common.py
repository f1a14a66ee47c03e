"""Shared pieces of the text operators: scratch tables, size estimates, text keys and packed chunks.

Several operators move one small fact per word (a hash, a count) through Spark.  A row per word would
cost more in row overhead than in content, so mappers gather documents into bounded *chunks* and send
one binary row per chunk and hash bucket.  Chunks and buckets are both bounded: a chunk closes after
``CHUNK_WORDS`` words (a single longer document forms a chunk of its own) and the number of buckets
grows with the input (``bucket_count``).
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that a mapper gathers before it sends a chunk on.
CHUNK_WORDS = 1_000_000
#: Bytes of table that one hash bucket answers for; one bucket is what a reduce task holds at once.
BUCKET_BYTES = 16 << 20

#: Spark's setting to remove the shuffle files of a query at its end.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared checkpoint folder that the session names.

    Only a local session, whose tasks all run in this process, may go without one and gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tablewarden-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


_WRITES = threading.Lock()
_writing = 0
_found: str | None = None


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries remove their shuffle files at their end; the session's own setting returns with the last of our writes."""
    global _writing, _found
    with _WRITES:
        if not _writing:
            _found = spark.conf.get(_CLEAN_UP, None)
            spark.conf.set(_CLEAN_UP, "true")
        _writing += 1
    try:
        yield
    finally:
        with _WRITES:
            _writing -= 1
            if not _writing:
                spark.conf.set(_CLEAN_UP, _found) if _found else spark.conf.unset(_CLEAN_UP)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: cuts lineage and survives lost executors.

    The shuffle files behind the write go as soon as it has ended, as nothing reads them again.  The table goes
    when ``release`` is told to, or else when the driver ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with _shuffles_removed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``written`` gave, of which no plan that is still to run reads anything."""
    for df in tables:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        files.delete(place, True)
        files.cancelDeleteOnExit(place)


def table_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of ``df`` (file sizes for a scan), for which no job runs.

    A plan without statistics says a size near the largest number; then the texts are measured.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 56 else int(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def bucket_count(df: DataFrame) -> int:
    """Hash buckets for the words of ``df``: in proportion to its size, and at least one for each shuffle partition."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return int(max(parts, table_bytes(df) // BUCKET_BYTES, 16))


#: Rows that one task adds up where every task of a stage sends a row.
FAN = 64


def folded(rows: DataFrame, docs: DataFrame, keys: list[str], add: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Rows (part, *keys, ...) that each task of a pass over ``docs`` sends, added up in a tree to few a key.

    ``part`` is the task's number; ``add`` makes one row of the rows of equal part and keys.  However many
    tasks there are, a group has about ``FAN`` rows, and as many at most are left of a key if file sizes are as estimated.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, table_bytes(docs) // BUCKET_BYTES)
    while parts > FAN:
        rows = rows.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("part", *keys).applyInArrow(add, schema)
        parts = -(-parts // FAN)
    return rows


def ascii_lower(data: bytes) -> bytes:
    """Lower-case A-Z only."""
    return data.translate(_ASCII_LOWER)


def word_hashes(words: Iterable[bytes], cache: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of words.  ``cache`` is a plain memo and is emptied when it grows past a fixed size."""
    digest = xxhash.xxh3_64_intdigest
    out = []
    add = out.append
    for w in words:
        h = cache.get(w)
        if h is None:
            if len(cache) > 100_000:
                cache.clear()
            h = cache[w] = digest(w)
        add(h)
    return np.array(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads the bits of a 64-bit hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: An odd base and, modulo 2**64, its inverse.
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, _BASE, np.uint64)]))
            down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, inverse, np.uint64)]))
        _POWERS[size] = (up, down)
    return _POWERS[size]


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every window of ``width`` word hashes, modulo 2**64.

    Prefix sums of ``h[k] * base**-k`` give each window in constant time; as the word hashes are spread
    over 64 bits and the width is fixed, the power-of-two modulus loses nothing.
    """
    n = len(hashes)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = _powers(n)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * down[:n], dtype=np.uint64)])
        return mix((sums[width:] - sums[:-width]) * up[: n - width + 1])


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than ``width`` form one shingle, no words none."""
    if len(hashes) == 0:
        return np.empty(0, np.uint64)
    if len(hashes) < width:
        return rolling(hashes, len(hashes)) ^ np.uint64(len(hashes))
    return np.unique(rolling(hashes, width))


def permutations(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and increments of ``count`` universal hash functions over 64-bit values."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, dtype=np.uint64)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least value of each universal hash (upper 32 bits) over the shingles; all ones for an empty set."""
    best = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 256):
        part = shingles[at : at + 256]
        with np.errstate(over="ignore"):
            np.minimum(best, ((a[:, None] * part[None, :] + b[:, None]) >> np.uint64(32)).min(axis=1), out=best)
    return best.astype(np.uint32)


def text_rows(batches: Iterator[pa.RecordBatch], key: str = "doc_id", text: str = "text") -> Iterator[tuple[int | None, str]]:
    """(key, text) of Arrow batches; a null text comes as the empty text."""
    for batch in batches:
        for k, t in zip(batch.column(key).to_pylist(), batch.column(text), strict=True):
            yield k, t.as_py() or ""


def source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the input folder, by Spark's reader alone."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _trim() -> None:
    """Give memory that the worker no longer uses back to the system; workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, and at its end no more memory held than its caches need."""

    def drained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _trim()

    return drained


#: Seconds between two groups after which unused memory is given back.
TRIM_S = 2.0


def lean_groups(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``run`` for groups; now and then no more memory held than needed, as a task has very many groups."""
    last = [time.monotonic()]

    def trimmed(table: pa.Table) -> pa.Table:
        out = run(table)
        if time.monotonic() - last[0] > TRIM_S:
            _trim()
            last[0] = time.monotonic()
        return out

    return trimmed


#: Bytes of an Arrow batch for Python workers, and the setting's name.
BATCH_BYTES, _BATCH_BYTES = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Send Python workers Arrow batches of a few MB, as texts may be long, unless the session has a bound of its own.

    The bound is read when a plan runs, after the operator has returned, so it stays set.
    """
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text only, so that columns of other names never reach Python or a shuffle."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def set_aside(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but ``keep`` in one, ``rest``, so that no name can clash; and what undoes it."""
    others = [c for c in docs.columns if c not in keep]
    rest = F.struct(*[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(others)]) if others else F.lit(None)

    def restore(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c) if c in keep else F.col(f"rest.f{others.index(c)}").alias(c) for c in docs.columns])

    return docs.select(*keep, rest.alias("rest")), restore


def pack(values: list[np.ndarray]) -> bytes:
    """Arrays one after another, each with its dtype and length in front."""
    out = []
    for v in values:
        code = v.dtype.str.encode().ljust(4)
        out += [code, len(v).to_bytes(8, "little"), np.ascontiguousarray(v).tobytes()]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    """The arrays that ``pack`` put together."""
    out, at = [], 0
    while at < len(data):
        dtype, n = np.dtype(data[at : at + 4].decode().strip()), int.from_bytes(data[at + 4 : at + 12], "little")
        out.append(np.frombuffer(data, dtype, n, at + 12))
        at += 12 + n * dtype.itemsize
    return out


def least_uint(x: np.ndarray) -> np.ndarray:
    """``x`` in the smallest unsigned type that holds it."""
    return x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8)
