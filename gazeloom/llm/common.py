"""Helpers shared by the corpus operators: table access, durable cuts, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the query contracts: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: A broadcast hint is given only to tables of at most so many rows (checked by counting).
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Only where it names
    none, as in tests, a local one is made."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return _LOCAL[0]


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: later steps no longer depend on
    the executors that made it."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{what}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows in an Arrow batch of whole texts; Spark's default holds 10,000 of them at once, twice.
BATCH_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Let Spark send whole texts to Python workers in batches of BATCH_ROWS rows; a session that sets
    another number than Spark's own keeps it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, BATCH_ROWS)


def give_back() -> None:
    """Return freed memory of this Python worker to the system; idle workers keep what they held else."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL(None).malloc_trim(0)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, else as it is. df should
    be cheap to count (a written table)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words (multiply and shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow string column as one byte array, and the n + 1 offsets into
    it; null texts are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


#: Longer strings are hashed one by one.
LONG_SPAN = 64
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hashes of the byte strings data[start:end], equal for equal strings. Eight bytes at
    a time enter a chain of bijective steps, so that two strings of one length and up to eight
    bytes never share a hash; strings of more than LONG_SPAN bytes go through blake2b. Another
    lane gives hashes that are independent of these."""
    size = (ends - starts).astype(np.int64)
    out = mix64(size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(lane + 1))
    factor = np.uint64((0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)[lane])
    eights = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    live, at = np.flatnonzero(size <= LONG_SPAN), 0
    while len(live):
        block = eights[starts[live] + at] & _BYTES[np.minimum(size[live] - at, 8)]
        out[live] = mix64(out[live] ^ (block * factor))
        at += 8
        live = live[size[live] > at]
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=bytes([lane])).digest()
        out[i] = int.from_bytes(digest, "little")
    return out
