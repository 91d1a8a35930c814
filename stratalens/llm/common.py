"""What several operators share: the shared folder, Arrow text buffers, hashing."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Most bytes of text that a vectorised step lays out at once (one longer text is one step).
CHUNK_BYTES = 512 << 10


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names the folder. Only where it is unset (local tests) is a
    folder of our own made and set for checkpoint().
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            base = jvm_dir.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="stratalens-")
            spark.sparkContext.setCheckpointDir(base)
            base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}"


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows over all cores, if the input's splits would leave half of them idle.

    Tables of a cluster's size have more splits than cores and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() * 2 <= cores else df


def write_table(df: DataFrame, path: str | None = None) -> DataFrame:
    """Cuts the lineage: writes Parquet to the shared folder and reads it back."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Deletes a written table, by Hadoop's file system so that any store will do."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def text_column(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (length n + 1) of an Arrow string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Row ranges of at most ``most`` bytes; a longer text is a range of its own."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


@contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """Jobs whose plans are made within take at most so many rows into an Arrow batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def sliced(batches, rows: int = 200):
    """The batches in parts of few rows, so that few of their texts are Python's at once."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def class_table(keep) -> np.ndarray:
    """Byte to lower-cased byte for A-Z and word bytes, 0 for all others."""
    table = np.zeros(256, np.uint8)
    for b in range(256):
        low = b + 32 if 65 <= b <= 90 else b
        if keep(low):
            table[b] = low
    return table


# Word characters [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z became a-z; every byte of a
# character beyond ASCII is 0x80 or more, so bytes and characters agree.
ALNUM = class_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)


def word_bounds(clean: np.ndarray, doc_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of non-zero bytes; a text's start always ends a run."""
    n = len(clean)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = clean != 0
    first = word.copy()
    first[1:] &= ~word[:-1]
    at = doc_start[doc_start < n]
    first[at] = word[at]
    last = word.copy()
    last[:-1] &= ~word[1:]
    before = at[at > 0] - 1
    last[before] = word[before]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out) if n else out


_cache: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, kept per worker."""
    if "up" not in _cache or len(_cache["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        up, down = _powers(_BASE, size), _powers(_INVERSE, size)
        if size > 4 * CHUNK_BYTES:  # one huge text: do not keep its tables
            return up[:n], down[:n]
        _cache.update(up=up, down=down)
    return _cache["up"][:n], _cache["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads low bits to high ones."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    return h * np.uint64(0xD6E8FEB86659FD93)


def word_hashes(clean: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word, the same wherever the word stands."""
    up, down = powers(len(clean) + 1)
    total = np.zeros(len(clean) + 1, np.uint64)
    np.cumsum((clean.astype(np.uint64) + np.uint64(1)) * up[: len(clean)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def hadoop_filesystem(uri: str):
    """(pyarrow file system, path) of a URI that all executors can reach."""
    from pyarrow import fs

    if "://" not in uri:
        uri = uri[5:] if uri.startswith("file:") else uri
        return fs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), uri.split("://", 1)[1]
    return fs.FileSystem.from_uri(uri)


_ROLL = np.uint64(0xC2B2AE3D27D4EB4F)


def roll(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes."""
    m = len(hashes) - n + 1
    out = np.zeros(max(m, 0), np.uint64)
    for j in range(n if m > 0 else 0):
        out = out * _ROLL + hashes[j : j + m]
    return mix(out + np.uint64(n))


def equal_runs(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether a[a_start : a_start + length] equals b[b_start : b_start + length], pair by pair."""
    total = int(length.sum())
    if not total:
        return np.ones(len(length), bool)
    first = np.cumsum(length) - length
    step = np.arange(total) - np.repeat(first, length)
    wrong = a[np.repeat(a_start, length) + step] != b[np.repeat(b_start, length) + step]
    seen = np.append(0, np.cumsum(wrong))
    return seen[first + length] == seen[first]
