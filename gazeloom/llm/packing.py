"""Harmonic packing of token sequences, each worker on its own.

A class k of pieces has the length floor(capacity / k), and its bins take exactly k pieces. A
document is cut greedily into the longest class lengths that fit (full sequences first), which
ends after a few cuts: what is left after a piece of class k is shorter than capacity / k(k+1),
and lengths up to the root of the capacity are class lengths themselves. Bins that stay open
at a worker's end are emptied, their pieces laid end to end and cut into full sequences; the
last one is cut into powers of two, which need no padding. Nothing is shuffled, and a worker
holds less than one sequence a class.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back
from .tokens import default_vocabulary, encoder, text_slices, with_end

CAPACITY = 1024
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def class_lengths(capacity: int) -> list[int]:
    """For each length 0..capacity the longest class length within it."""
    out = [0] * (capacity + 1)
    for k in range(1, capacity + 1):
        out[capacity // k] = capacity // k
    for n in range(1, capacity + 1):
        out[n] = out[n] or out[n - 1]
    return out


def pieces_of(length: int, fitting: list[int]) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    capacity, at, out = len(fitting) - 1, 0, []
    while at < length:
        take = fitting[min(capacity, length - at)]
        out.append((at, take))
        at += take
    return out


class Packer:
    """Fills the bins of one worker; rows() gives and forgets the pieces placed so far."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY):
        self.capacity, self.fitting, self.sequence = capacity, class_lengths(capacity), first_sequence
        self.open: dict[int, list[tuple]] = {}
        self.placed: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.placed.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4")), total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        for at, n in pieces_of(len(ids), self.fitting):
            piece = (doc, at, ids[at : at + n], len(ids))
            if n == self.capacity:
                self._close([piece])
                continue
            held = self.open.setdefault(n, [])
            held.append((doc, at, ids[at : at + n].copy(), len(ids)))
            if len(held) == self.capacity // n:
                self._close(self.open.pop(n))

    def finish(self) -> None:
        """Empty the open bins into full sequences, and the rest into powers of two."""
        rest = [p for n in sorted(self.open, reverse=True) for p in self.open[n]]
        self.open = {}
        left = sum(len(p[2]) for p in rest)
        room, now = self._room(left), []
        while rest:
            doc, start, ids, total = rest.pop(0)
            now.append((doc, start, ids[:room], total))
            taken = len(now[-1][2])
            room, left = room - taken, left - taken
            if taken < len(ids):
                rest.insert(0, (doc, start + taken, ids[taken:], total))
            if room == 0:
                self._close(now)
                room, now = self._room(left), []

    def _room(self, left: int) -> int:
        return self.capacity if left >= self.capacity else 1 << max(0, left.bit_length() - 1)

    def rows(self) -> list[tuple]:
        out, self.placed = self.placed, []
        return out


def _pack(vocabulary: str, end_id: int, capacity: int):
    names = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 40, capacity)
        for batch in batches:
            for rows in text_slices(batch, 1):
                ids, offs = with_end(*encoder(vocabulary).encode(rows.column(1)), end_id)
                for doc, a, b in zip(rows.column(0).to_pylist(), offs[:-1].tolist(), offs[1:].tolist()):
                    packer.add(doc, ids[a:b])
                if done := packer.rows():
                    yield batch_of(done)
        packer.finish()
        if done := packer.rows():
            yield batch_of(done)
        give_back()

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Pack every row of docs (doc_id, text; other columns are ignored) into sequences of at
    most capacity ids; a row per piece. Null and empty texts are end_id alone. Repeated rows
    are packed each for itself; sequence ids are unique, not dense. An empty table gives no
    piece. A sequence shorter than capacity is filled up with padding when it is laid out,
    unless its length is a power of two."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pack(vocabulary or default_vocabulary(), end_id, capacity), PIECE_SCHEMA)
