"""Shared pieces: table access, the shared scratch folder, word splitting and hashing.

A word is a maximal run of characters outside ``[\\x20\\x09-\\x0D]``.  Those six
characters are exactly what ``bytes.split()`` splits on, so ``text.encode().split()``
gives a text's words as UTF-8 bytes.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text handled at once by the vectorised helpers.
CHUNK_BYTES = 1 << 21

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE)] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset (tests on
    one machine) a local folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = jvm_dir.get() if jvm_dir.isDefined() else None
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, sort_by: list[str] | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: later steps start
    from replicated files, not from executors' memory, and their plans have true sizes."""
    spark = df.sparkSession
    path = scratch(spark)
    (df.sortWithinPartitions(*sort_by) if sort_by else df).write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()  # shuffle files of finished plans go when the driver collects its garbage
    return spark.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession, seconds: float = 3.0) -> None:
    """Waits for the shuffle files of finished plans to go: Spark's cleaner removes them some
    time after the driver has collected its garbage."""
    gc.collect()  # plans that only Python still refers to
    spark.sparkContext._jvm.System.gc()
    time.sleep(seconds)


def drop_stored(df: DataFrame) -> None:
    """Deletes the files behind a frame from ``stored``; nothing may still need them."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts may be long, so batches to Python stay short."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 * CHUNK_BYTES))


def bounded(batches, limit: int = 4 * CHUNK_BYTES):
    """Arrow batches cut so that none but those of one row has more than ``limit`` bytes."""
    for b in batches:
        at, rows = 0, max(1, b.num_rows * limit // max(b.nbytes, 1))
        while at < b.num_rows:
            piece = b.slice(at, rows)
            while piece.num_rows > 1 and piece.nbytes > limit:  # long texts close together
                piece = piece.slice(0, piece.num_rows // 2)
            yield piece
            at += piece.num_rows


def tidy() -> None:
    """Gives memory that a Python worker no longer needs back to the machine: workers live on
    after a task, and executors count them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def text_of(name: str = "text"):
    """A null text counts as empty."""
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 1024)
        _POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, _BASE, np.uint64))])
    return _POWERS


def chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, number of rows) of consecutive pieces of about ``limit`` bytes each."""
    n = len(column)
    if not n:
        return
    sizes = np.cumsum(np.array([len(x) for x in (v.as_buffer() if v.is_valid else b"" for v in column)], dtype=np.int64))
    first = 0
    while first < n:
        base = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, base + limit, side="right")))
        yield first, last - first
        first = last


class Words:
    """The words of several texts, with a 64-bit content hash for each word.

    ``doc`` is each word's text index, ``start``/``end`` are byte offsets into ``data``
    and ``bounds[i]:bounds[i+1]`` are the words of text ``i``.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.data = b" ".join(texts) + b" "
        raw = np.frombuffer(self.data, dtype=np.uint8)
        space = _IS_SPACE[raw]
        word = ~space
        before = np.empty_like(word)
        before[0] = False
        before[1:] = word[:-1]
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(space & before)
        n = len(self.start)
        lengths = np.array([len(t) for t in texts], dtype=np.int64) + 1
        text_start = np.concatenate([[0], np.cumsum(lengths)])
        self.bounds = np.searchsorted(self.start, text_start)
        self.bounds[-1] = n
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        if n:
            size = self.end - self.start
            at = np.flatnonzero(word)
            inside = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
            value = (_LOWER if lower else _SAME)[raw[at]].astype(np.uint64) + np.uint64(1)
            value *= _powers(int(size.max()) + 1)[inside]
            self.hash = mix64(np.add.reduceat(value, np.cumsum(size) - size) + size.astype(np.uint64))
        else:
            self.hash = np.empty(0, np.uint64)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the k words from i on, whether they lie in one text) for each i."""
        n = len(self.hash)
        if n < k:
            return np.empty(0, np.uint64), np.empty(0, bool)
        m = n - k + 1
        total = np.zeros(m, np.uint64)
        for j in range(k):
            total = (total ^ self.hash[j : j + m]) * _BASE
            total ^= total >> np.uint64(29)
        return mix64(total), self.doc[:m] == self.doc[k - 1 :]


def hash_bytes(parts_: list[bytes]) -> np.ndarray:
    """Stable 64-bit hashes of byte strings."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in parts_), dtype=np.uint64, count=len(parts_))
