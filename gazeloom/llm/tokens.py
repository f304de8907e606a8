"""Byte-level BPE ids of whole texts, many texts at a time.

The tokenizers library encodes each distinct piece of text once per worker; texts are cut
into pieces only where the vocabulary's pre-tokenizer cuts them in any case, so the joined
ids are those of the whole text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import span_hashes, text_buffer

#: Most pieces a worker remembers (some 50 bytes each); its tables are as large as this anyway.
CACHE_PIECES = 1 << 20
_JOINABLE = re.compile(r" [A-Za-z](?:.*\S)?\Z", re.S).match
_ENCODERS: dict[str, "PieceEncoder"] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> "PieceEncoder":
    """The worker's encoder for this vocabulary file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run beside each other already
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def piece_starts(data: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Where pieces start: at each text's start and at bytes before which the
    pre-tokenizer (optional space + letters | digits | other, or white space) always cuts."""
    n = len(data)
    white = (data == 32) | ((data >= 9) & (data <= 13)) | ((data >= 28) & (data <= 31))
    ascii_ = data < 128
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    alnum = letter | ((data >= 48) & (data <= 57))
    latin = data == 0xC3  # leads U+00C0 to U+00FF, none of which is white space
    solid_next = np.zeros(n, bool)
    solid_next[:-1] = (ascii_ & ~white)[1:]
    latin_next = np.zeros(n, bool)
    latin_next[:-1] = latin[1:]
    solid_prev = np.zeros(n, bool)
    solid_prev[1:] = (ascii_ & ~white)[:-1]
    solid_prev[2:] |= latin[:-2]
    start = (data == 32) & (solid_next | latin_next)
    dot = (data == 46) | (data == 44)
    line = data == 10
    prev = np.zeros(n, bool)
    prev[1:] = alnum[:-1]
    start |= dot & prev
    start |= line & solid_prev
    prev[1:] = (line & solid_prev)[:-1]
    start |= letter & prev
    start[doc_starts[doc_starts < n]] = True
    return np.flatnonzero(start)


class PieceEncoder:
    """Keeps an open-addressing table from a piece's hash to its ids, probed for all pieces of
    a batch at once. A second hash of every entry tells pieces apart that share the first; a
    batch with such a pair goes to the tokenizer whole."""

    BITS = 21

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.token_bytes = np.zeros(1 << 16, np.int64)  # each character of a token's name stands for a byte
        for token, i in self.tokenizer.get_vocab().items():
            self.token_bytes[i] = len(token)
        self._clear()

    def _clear(self) -> None:
        self.slots, self.entry = np.zeros(1 << self.BITS, np.uint64), np.zeros(1 << self.BITS, np.int32)
        self.at, self.size, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 0
        self.flat, self.used = np.zeros(1 << 16, np.uint16), 0
        self.check = np.zeros(1 << 16, np.uint64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where there is none."""
        mask = np.uint64((1 << self.BITS) - 1)
        slot = (keys & mask).astype(np.int64)
        there = self.slots[slot]
        out = np.where(there == keys, self.entry[slot], -1)
        open_ = np.flatnonzero((there != keys) & (there != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(mask)
            there = self.slots[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.entry[slot[open_[hit]]]
            open_ = open_[~hit & (there != 0)]
        return out

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces and how many each has. Pieces that start with a space and
        an ASCII letter and end in no white space are encoded many at a time, as one text in
        which they are cut apart anyway."""
        order = sorted(range(len(pieces)), key=lambda i: not _JOINABLE(pieces[i]))
        n = sum(1 for p in pieces if _JOINABLE(p))
        ordered = [pieces[i] for i in order]
        texts = ["".join(ordered[i : min(n, i + 4096)]) for i in range(0, n, 4096)] + ordered[n:]
        ids = np.fromiter((i for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids), np.uint16)
        reach = np.cumsum(self.token_bytes[ids])
        ends = np.cumsum(np.fromiter((len(p.encode()) for p in ordered), np.int64, len(ordered)))
        upto = np.searchsorted(reach, ends, side="right")
        size = np.diff(upto, prepend=0)
        back = np.empty(len(pieces), np.int64)
        back[np.array(order, np.int64)] = np.arange(len(pieces))
        starts = (upto - size)[back]
        size = size[back]
        index = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return ids[index], size.astype(np.int32)

    def _learn(self, keys: np.ndarray, checks: np.ndarray, pieces: list[str]) -> None:
        """Encode new distinct pieces and enter them."""
        ids, size = self._encode_pieces(pieces)
        total, n = len(ids), self.count + len(keys)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n > len(self.at):
            self.at, self.size, self.check = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size, self.check))
        self.check[self.count : n] = checks
        self.flat[self.used : self.used + total] = ids
        self.at[self.count : n], self.size[self.count : n] = self.used + np.concatenate([[0], np.cumsum(size)[:-1]]), size
        entries = np.arange(self.count, n, dtype=np.int32)
        self.used, self.count = self.used + total, n
        mask = (1 << self.BITS) - 1
        slot = (keys & np.uint64(mask)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.slots[slot[left]] == 0]
            self.slots[slot[free]] = keys[free]
            won = free[self.slots[slot[free]] == keys[free]]
            self.entry[slot[won]] = entries[won]
            left = left[self.slots[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & mask

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another (uint16), and the n + 1 offsets of the
        texts in them. Null texts are empty."""
        data, offs = text_buffer(texts)
        if len(data) == 0:
            return np.zeros(0, np.uint16), np.zeros(len(offs), np.int64)
        raw = data.tobytes()
        if any(s.encode() in raw for s in self.special):
            return self._plain(texts)
        starts = piece_starts(data, offs[:-1])
        ends = np.append(starts[1:], len(data))
        hashes, checks = span_hashes(data, starts, ends), span_hashes(data, starts, ends, lane=1)
        hashes[hashes == 0] = 1
        found = self._find(hashes)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            keys, first = np.unique(hashes[missing], return_index=True)
            if self.count + len(keys) > CACHE_PIECES:
                self._clear()
                missing = np.arange(len(hashes))
                keys, first = np.unique(hashes, return_index=True)
            which = missing[first]
            self._learn(keys, checks[which], [raw[s:e].decode("utf-8") for s, e in zip(starts[which].tolist(), ends[which].tolist())])
            found[missing] = self._find(hashes[missing])
        if (self.check[found] != checks).any():
            return self._plain(texts)
        at, size = self.at[found], self.size[found].astype(np.int64)
        ends_at = np.cumsum(size)
        index = np.repeat(at - (ends_at - size), size)
        index += np.arange(len(index))
        before = np.concatenate([[0], ends_at])
        return self.flat[index], before[np.searchsorted(starts, offs)]

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]
        size = np.array([len(x) for x in ids], np.int64)
        return np.fromiter((i for x in ids for i in x), np.uint16, int(size.sum())), np.concatenate([[0], np.cumsum(size)])


def with_end(ids: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id after each text."""
    return np.insert(ids, offs[1:], np.uint16(end_id)), offs + np.arange(len(offs))


def text_slices(batch: pa.RecordBatch, column: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about so many bytes of text each, at least one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = int(sizes[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
