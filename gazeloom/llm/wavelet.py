"""Token-ID output as wavelet matrices, one compressed file image per shard.

A shard holds the ids of consecutive documents. Its ids are stored as bit planes, highest bit
first; below each plane the ids are stably parted by that plane's bit. Planes are cut into
blocks that are compressed one by one, with the number of ones before each block kept beside
them, so that reading one id, counting an id or finding its k-th place opens one block a plane
(or a few) instead of the shard.

File image, little-endian: magic ``WMX1``; u64 ids, u32 documents, u8 planes, u32 block bytes;
compressed documents table (i64 doc ids, u8 null marks, u64 lengths); for each plane u64 zeros,
u32 blocks, u64 ones before each block, u64 end of each block, blocks.

File images are kept as rows of a Parquet table (``payload``), so that Spark's commit protocol
decides which attempt of a task counts and any store that Spark writes to will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small
from .tokens import default_vocabulary, encoder, text_slices, with_end

#: Ids per shard at least (the last shard of a partition has fewer; a document is never split).
SHARD_IDS = 2_000_000
#: Bytes of a plane's block before compression.
BLOCK = 16_384
_BYTE_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
SHARD_SCHEMA = "part int, seq int, n_docs int, n_ids long, payload binary"
DOC_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def build(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """The file image of a shard."""
    pack = zstandard.ZstdCompressor(level=1).compress
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    table = pack(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes() + lengths.astype("<u8").tobytes())
    out = [b"WMX1", struct.pack("<QIBI", len(ids), len(doc_ids), planes, BLOCK), struct.pack("<I", len(table)), table]
    left = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    for plane in range(planes - 1, -1, -1):
        bit = (left >> plane) & 1 == 1
        packed = np.packbits(bit, bitorder="little")
        blocks = [packed[i : i + BLOCK] for i in range(0, len(packed), BLOCK)]
        ones = np.array([int(_BYTE_ONES[b].sum(dtype=np.int64)) for b in blocks], "<u8")
        stored = [pack(b.tobytes()) for b in blocks]
        zeros = len(left) - int(ones.sum())
        out += [struct.pack("<QI", zeros, len(blocks)), (np.cumsum(ones) - ones).astype("<u8").tobytes(), np.cumsum([len(s) for s in stored]).astype("<u8").tobytes(), *stored]
        left = np.concatenate([left[~bit], left[bit]])
    return b"".join(out)


class WaveletMatrix:
    """Reads a file image; blocks are opened when they are needed."""

    def __init__(self, image: bytes):
        if image[:4] != b"WMX1":
            raise ValueError("not a wavelet matrix file")
        self.image, self._open = memoryview(image), {}
        self.n, n_docs, self.planes, self.block = struct.unpack_from("<QIBI", image, 4)
        at = 4 + struct.calcsize("<QIBI")
        (size,) = struct.unpack_from("<I", image, at)
        table = zstandard.ZstdDecompressor().decompress(image[at + 4 : at + 4 + size])
        nulls = np.frombuffer(table, np.uint8, n_docs, 8 * n_docs)
        self.doc_ids = [None if gone else int(d) for d, gone in zip(np.frombuffer(table, "<i8", n_docs), nulls)]
        self.lengths = np.frombuffer(table, "<u8", n_docs, 9 * n_docs).astype(np.int64)
        at += 4 + size
        self.levels = []
        for _ in range(self.planes):
            zeros, n = struct.unpack_from("<QI", image, at)
            at += struct.calcsize("<QI")
            before, ends = np.frombuffer(image, "<u8", n, at), np.frombuffer(image, "<u8", n, at + 8 * n)
            at += 16 * n
            self.levels.append((zeros, before, ends, at))
            at += int(ends[-1]) if n else 0

    def _bytes(self, level: int, block: int) -> np.ndarray:
        key = (level, block)
        if key not in self._open:
            _, _, ends, at = self.levels[level]
            start = int(ends[block - 1]) if block else 0
            if len(self._open) > 256:
                self._open.clear()
            self._open[key] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.image[at + start : at + int(ends[block])]), np.uint8)
        return self._open[key]

    def _bit(self, level: int, i: int) -> int:
        return int(self._bytes(level, i // 8 // self.block)[i // 8 % self.block] >> (i % 8)) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        _, before, _, _ = self.levels[level]
        block, rest = divmod(i, 8 * self.block)
        if block == len(before):
            return self.n - self.levels[level][0]
        data = self._bytes(level, block)
        return int(before[block]) + int(_BYTE_ONES[data[: rest // 8]].sum(dtype=np.int64)) + (bin(int(data[rest // 8]) & ((1 << rest % 8) - 1)).count("1") if rest % 8 else 0)

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, (zeros, *_) in enumerate(self.levels):
            bit, ones = self._bit(level, i), self._ones(level, i)
            i = zeros + ones if bit else i - ones
            value = value * 2 + bit
        return value

    def rank(self, token: int, i: int) -> int:
        """How often token stands before place i."""
        if token >> self.planes:
            return 0
        start, end = 0, i
        for level, (zeros, *_) in enumerate(self.levels):
            a, b = self._ones(level, start), self._ones(level, end)
            start, end = (zeros + a, zeros + b) if token >> (self.planes - 1 - level) & 1 else (start - a, end - b)
        return end - start

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of token."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        low, high = 0, self.n  # rank(token, low) <= k < rank(token, high)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self.rank(token, mid) <= k else (low, mid)
        return low

    def ids(self) -> np.ndarray:
        """All ids, by undoing the partings from the lowest plane up."""
        value = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        reader = zstandard.ZstdDecompressor()
        for level in range(self.planes - 1, -1, -1):
            zeros, _, ends, at = self.levels[level]
            edges = [0, *ends.tolist()]
            packed = b"".join(reader.decompress(self.image[at + a : at + b]) for a, b in zip(edges, edges[1:]))
            bit = np.unpackbits(np.frombuffer(packed, np.uint8), count=self.n, bitorder="little").view(bool)
            above = np.empty_like(value)
            above[~bit] = value[:zeros]
            above[bit] = value[zeros:] | value.dtype.type(1 << (self.planes - 1 - level))
            value = above
        return value


def _shards(vocabulary: str, end_id: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        docs: list[int | None] = []
        sizes: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            ids, lengths = np.concatenate(held), np.concatenate(sizes)
            image = build(ids, docs, lengths)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(docs)], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([image], pa.binary())], names=["part", "seq", "n_docs", "n_ids", "payload"])

        for batch in batches:
            for rows in text_slices(batch, 1):
                ids, offs = with_end(*encoder(vocabulary).encode(rows.column(1)), end_id)
                held.append(ids)
                sizes.append(np.diff(offs))
                docs += rows.column(0).to_pylist()
                n += len(ids)
                if n >= shard_ids:
                    yield flush()
                    held, docs, sizes, n, seq = [], [], [], 0, seq + 1
        if docs:
            yield flush()

    return run


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            shard = WaveletMatrix(batch.column(1)[row].as_py())
            ids, lengths = shard.ids(), shard.lengths
            ends = np.cumsum(lengths)
            wide = ids.astype("<u4")
            crc = [zlib.crc32(wide[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(batch.column(0)[row].as_py() + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def write_shards(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, shard_ids: int = SHARD_IDS, partitions: int | None = None) -> DataFrame:
    """Encode every text of docs (doc_id, text; other columns are ignored) in ascending doc_id
    order (null ids first, ties by text) and write the shards; the table of file images, in
    order of (part, seq), as read back. Null texts are empty and have end_id alone; an empty
    table gives no shard. Long texts make a longer shard."""
    spark = docs.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    shards = ordered.mapInArrow(_shards(vocabulary or default_vocabulary(), end_id, shard_ids), SHARD_SCHEMA)
    return cut(shards, "wavelet")


def read_documents(shards: DataFrame) -> DataFrame:
    """Per document, from the file images alone: doc_id, start (ids of all documents before
    it), n_tokens and the crc32 of its ids."""
    sizes = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row a partition, not a document
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    starts = shards.select("part", "seq", inside.alias("inside")).join(before, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("start"))
    placed = shards.join(small(cut(starts, "wavelet-starts")), ["part", "seq"])
    return placed.select("start", "payload").mapInArrow(_documents, DOC_SCHEMA)
