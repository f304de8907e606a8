"""Exact n-gram Jaccard join by parity sketches.

A document's set is its distinct word shingles. For a size band the shingles are hashed to the
words of a sketch, and every shingle XORs its 64-bit hash into one word: two sketches differ in
at most as many words as the sets differ in shingles, so the sketches' Hamming distance in words
is a lower bound of the symmetric difference. Two sets with a Jaccard similarity of 3/4 or more
differ in at most a seventh of both sizes together. So

* a set has a partner only if all its words but so many are found in other sets (pigeonhole), and
* of two linked sets, the rarest word they share is among the rarest few of either's words.

Sketches are sized so that a set has more non-empty words than it may differ in; small sets use
a word for each shingle; a set whose words happen to be too few joins by shingles as well, which
keeps the join exact. A set takes part in its own band, and in the one below if it can have a
partner there. A set in a band is called a unit below.

Four steps, each a shuffle of packed rows: words meet by key and are counted; a unit's found words
meet and are counted, and the rarest few of units with enough stay; these meet by key again and
give pairs; pairs that their sizes and missing words don't rule out are compared as whole sets.
In small buckets each is paired with each, in large ones all with two of them. Large buckets in
which this leaves several components are joined block by block until every pair of different
components was compared. Equal sets are one class throughout.

Words that many units of one batch have are known to be found, whatever others hold: they are
dealt out by batch and later by unit, not by key, and the parts of such a bucket meet by
their leads. Sets are named by 62 bits that are checked against 64 more, shingles by 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, mix64, short_batches, small, span_hashes, text_buffer
from .components import components
from .tokens import text_slices

N, PERCENT = 5, 75
#: Sets below this size use a sketch word for each shingle; larger bands double.
FIRST_BAND = 64
#: Sketch words per shingle of a band's largest set.
WORDS_PER = 0.45
#: Up to so many members, a bucket's sets are compared each with each.
SMALL_BUCKET = 8
#: A word of so many units of a batch is dealt out by batch.
COMMON_HERE = 32
#: About so many words are in a part of the key space and in a batch, sets in a part of a common
#: word's bucket, shingles on a side of a block, members with one center in a run, and bytes of
#: sets in a task that compares them.
PART_WORDS, BATCH_WORDS, SALT_SETS, BLOCK_SHINGLES, CENTER_PAIRS, TASK_BYTES = 1_500_000, 1_000_000, 200_000, 1_000_000, 256, 64_000_000
_U = np.uint64
_EVERYWHERE = 65535  # the count of words that are common in some batch
_INFO = np.dtype([("unit", "<u8"), ("size", "<u4"), ("words", "<u4"), ("least", "<u4")])
_ENTRY = np.dtype([("key", "<u4"), ("unit", "<u8"), ("size", "<u4"), ("own", "<u4")])


def shingle_sets(texts: pa.Array, n: int = N) -> list[np.ndarray]:
    """For each text its distinct shingles as sorted 64-bit hashes. A-Z are lower-cased, words
    are parted by space and U+0009 to U+000D. With fewer words than n the whole sequence is
    one; without words, and for null, there are none."""
    data, offs = text_buffer(texts)
    out = [np.zeros(0, _U)] * len(texts)
    if not len(data):
        return out
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offs[1:-1][offs[1:-1] < len(data)]
    first[inner] = solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    words = span_hashes(data, starts, ends)
    upto = np.searchsorted(starts, offs)
    factors = mix64(np.arange(1, n + 1, dtype=_U)) | _U(1)
    if len(words) >= n:
        whole = np.zeros(len(words) - n + 1, _U)
        for j in range(n):
            whole += words[j : len(words) - n + 1 + j] * factors[j]
        whole = mix64(whole)
    for i in range(len(texts)):
        a, b = int(upto[i]), int(upto[i + 1])
        if b - a >= n:
            out[i] = np.unique(whole[a : b - n + 1])
        elif b > a:
            out[i] = mix64((words[a:b] * factors[: b - a]).sum(dtype=_U, keepdims=True) + _U(b - a))
    return out


def set_id(hashes: np.ndarray, salt: int = 0) -> tuple[int, int]:
    """The name of a set: 62 bits (in 64, signed, the last two free), and 64 more."""
    first, second = mix64(hashes ^ _U(0x51ED270B35A0F2C9 + salt)), mix64(hashes ^ _U(0x2545F4914F6CDD1D + salt))
    sums = np.array([first.sum(dtype=_U), second.sum(dtype=_U)]) + _U(len(hashes))
    names = mix64(sums).astype(np.int64)
    return int(names[0]) & ~3 or 4, int(names[1])


def band(size: int) -> int:
    return 0 if size < FIRST_BAND else 1 + int(math.log2(size // FIRST_BAND))


def band_end(b: int) -> int:
    """The first size beyond the band."""
    return FIRST_BAND << b


def may_differ(size: int, percent: int, other_below: int | None = None) -> int:
    """Most shingles in which a set of this size can differ from a linked one (of a size below
    other_below)."""
    other = size * 100 // percent
    if other_below is not None:
        other = min(other, other_below - 1)
    return (size + other) * (100 - percent) // (100 + percent)


def sketch(hashes: np.ndarray, b: int) -> np.ndarray:
    """The keys of the non-empty words of the band's sketch, named by place and content."""
    if b == 0:
        return mix64(hashes ^ _U(0x632BE59BD9B4E019))
    words = int(WORDS_PER * band_end(b))
    place = ((hashes >> _U(32)) * _U(words)) >> _U(32)  # ascends with the hashes
    at = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    content = np.bitwise_xor.reduceat(mix64(hashes), at)
    return mix64(content ^ (place[at] * _U(0x9E3779B97F4A7C15) + _U(b)))


def sketches(hashes: np.ndarray, percent: int) -> list[tuple[int, int, np.ndarray]]:
    """(code, words that must be found elsewhere, keys) for each unit of the set; its code is 0
    in the set's own band, 1 in the band below, 2 by shingles."""
    size, own = len(hashes), band(len(hashes))
    bands = [(0, own, None)]
    if own and -(-size * percent // 100) < band_end(own - 1):
        bands.append((1, own - 1, band_end(own - 1)))
    out, few = [], False
    for code, b, below in bands:
        keys = sketch(hashes, b)
        least = len(keys) - may_differ(size, percent, below)
        out.append((code, max(1, least), keys))
        few |= least < 1
    if few:  # too few words: by shingles too, among sets of this kind
        out.append((2, max(1, size - may_differ(size, percent)), mix64(hashes ^ _U(0x8CB92BA72F3D8DD7))))
    return out


def _by_shingle(unit: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each word of the unit is one shingle."""
    code = unit & _U(3)
    return (code == 2) | (size < (FIRST_BAND << code.astype(np.int64)))


def _base(n: int, salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, 1):
                sets = shingle_sets(rows.column(1), n)
                names = [set_id(s, salt) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in names], pa.int64()), pa.array([x for _, x in names], pa.int64())], names=["doc_id", "n_shingles", "set_id", "more"])
        give_back()

    return run


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows start, and the end."""
    n = len(columns[0])
    if not n:
        return np.zeros(1, np.int64)
    fresh = np.zeros(n, bool)
    fresh[0] = True
    for c in columns:
        fresh[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(fresh), n)


def _packed(group: np.ndarray, unit: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """Entries, in the order of their groups and units, as a row a group: the group, its units,
    how many entries each unit has, and the columns."""
    runs = _edges(group, unit)
    at = runs[:-1]
    counts = np.diff(runs).astype("<u4")
    units = unit[at]
    groups = _edges(group)
    inside = np.searchsorted(at, groups)
    return [(int(group[a]), units[u:v].tobytes(), counts[u:v].tobytes(), *(c[a:b].tobytes() for c in columns)) for a, b, u, v in zip(groups[:-1].tolist(), groups[1:].tolist(), inside[:-1].tolist(), inside[1:].tolist())]


def _flat(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in table[name].to_pylist() if x), kind)


def _of_units(table: pa.Table) -> np.ndarray:
    """The unit of each entry of packed rows."""
    return np.repeat(_flat(table, "units", "<u8"), _flat(table, "runs", "<u4"))


_WORDS = "part int, salt int, units binary, runs binary, keys binary, info binary"


def _words(n: int, percent: int, parts: int, salts: int, name_salt: int):
    """Sketch words by part of the key space, in batches; what is known of a batch's units, by
    the part in which the units' found words will meet."""

    def flush(held: list[np.ndarray], units: list[tuple]) -> pa.RecordBatch:
        info = np.array(units, _INFO)
        keys, unit = np.concatenate(held), np.repeat(info["unit"], info["words"])
        _, place, count = np.unique(keys, return_inverse=True, return_counts=True)
        common = count[place] >= COMMON_HERE
        salt = 1 + int(info["unit"][0] >> _U(2)) % salts
        marks = np.unique(keys[common])  # tell a key's other holders that it is common here
        keys = np.concatenate([keys, marks])
        unit, common = np.concatenate([unit, np.zeros(len(marks), _U)]), np.concatenate([common, np.zeros(len(marks), bool)])
        group = ((keys >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64) * 2 + common
        order = np.argsort(group, kind="stable")  # units stay in order
        rows = [(g >> 1, salt if g & 1 else 0, u, r, k, None) for g, u, r, k in _packed(group[order], unit[order], keys[order].astype("<u4"))]
        home = _home(info["unit"], parts)
        order = np.argsort(home, kind="stable")
        edges = _edges(home[order])
        rows += [(int(home[order[a]]), 0, None, None, None, info[order[a:b]].tobytes()) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["part", "salt", "units", "runs", "keys", "info"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        units: list[tuple] = []
        seen: set[int] = set()
        total = 0
        for batch in batches:
            for rows in text_slices(batch, 1):
                for hashes in shingle_sets(rows.column(1), n):
                    if not len(hashes) or (name := set_id(hashes, name_salt)[0]) in seen:
                        continue
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(name)
                    for code, least, keys in sketches(hashes, percent):
                        held.append(keys)
                        units.append(((name | code) & 0xFFFFFFFFFFFFFFFF, len(hashes), len(keys), least))
                        total += len(keys)
                    if total > BATCH_WORDS:
                        yield flush(held, units)
                        held, units, total = [], [], 0
        if held:
            yield flush(held, units)
        seen.clear()
        give_back()

    return run


def _home(unit: np.ndarray, parts: int) -> np.ndarray:
    """The part in which a unit's words meet."""
    return ((mix64(unit) >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)


_MATCHES = "home int, part int, units binary, runs binary, keys binary, counts binary, info binary"


def _match(parts: int):
    """The words of a part that two sets or more have, by the homes of their units, with the
    number of sets that have them."""

    def run(table: pa.Table) -> pa.Table:
        give_back()  # what the group before left
        part, salt = table["part"][0].as_py(), table["salt"][0].as_py()
        keys, unit = _flat(table, "keys", "<u4"), _of_units(table)
        if salt:
            count = np.full(len(keys), _EVERYWHERE)
        else:
            order = np.argsort(keys, kind="stable")
            edges = _edges(keys[order])
            shared = order[np.repeat(np.diff(edges) > 1, np.diff(edges))]
            order = shared[np.lexsort((unit[shared], keys[shared]))]
            keys, unit = keys[order], unit[order]
            first = _edges(keys, unit)[:-1]  # other tasks saw the same set; a key's marks are one
            keys, unit = keys[first], unit[first]
            edges = _edges(keys)
            size, mark = np.diff(edges), unit[edges[:-1]] == 0 if len(keys) else np.zeros(0, bool)
            count = np.repeat(np.where(mark, _EVERYWHERE, np.minimum(size, _EVERYWHERE - 1)), size)
            keep = (count > 1) & (unit != 0)
            keys, unit, count = keys[keep], unit[keep], count[keep]
        home = _home(unit, parts)
        order = np.lexsort((unit, home))
        rows = [(h, part, u, r, k, c, None) for h, u, r, k, c in _packed(home[order], unit[order], keys[order], count[order].astype("<u2"))]
        rows += [(part, 0, None, None, None, None, x) for x in table["info"].to_pylist() if x]
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 5)
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["home", "part", "units", "runs", "keys", "counts", "info"])

    return run


_RARE = "part int, salt int, entries binary"


def _rare(salts: int):
    """Of the units at one home, those with enough found words: the rarest of these words, as
    many as linked sets need to have one in common."""

    def run(table: pa.Table) -> pa.Table:
        give_back()
        info = _flat(table, "info", _INFO)
        info = info[np.unique(info["unit"], return_index=True)[1]]
        unit = _of_units(table)
        part = np.repeat(table["part"].to_numpy(), [len(x or b"") // 4 for x in table["keys"].to_pylist()])
        keys, count = _flat(table, "keys", "<u4"), _flat(table, "counts", "<u2")
        order = np.lexsort((keys, part, count, unit))
        unit, part, keys, count = unit[order], part[order], keys[order], count[order]
        first = _edges(unit, part, keys)[:-1]
        unit, part, keys, count = unit[first], part[first], keys[first], count[first]
        edges = _edges(unit)
        found = np.diff(edges)
        of = info[np.searchsorted(info["unit"], unit[edges[:-1]])]
        most = np.where(found >= of["least"], found - of["least"].astype(np.int64) + 1, 0)
        place = np.arange(len(unit)) - np.repeat(edges[:-1], found)
        keep = place < np.repeat(most, found)
        who = np.repeat(np.arange(len(of)), found)[keep]
        entries = np.zeros(len(who), _ENTRY)
        entries["key"], entries["unit"], entries["size"] = keys[keep], unit[keep], of["size"][who]
        entries["own"] = (of["words"] - found)[who]
        salt = np.where(count[keep] == _EVERYWHERE, 1 + (mix64(unit[keep] >> _U(2)) % _U(salts)).astype(np.int64), 0)
        order = np.lexsort((salt, part[keep]))
        entries, part, salt = entries[order], part[keep][order], salt[order]
        edges = _edges(part, salt)
        at = edges[:-1]
        return pa.Table.from_arrays([pa.array(part[at], pa.int32()), pa.array(salt[at], pa.int32()), pa.array([entries[a:b].tobytes() for a, b in zip(at.tolist(), edges[1:].tolist())], pa.binary())], names=["part", "salt", "entries"])

    return run


_FOUND = "kind int, a long, b long, part int, entries binary"
_PAIR, _STAR, _LISTED, _LEADS = range(4)


def _may_link(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes, and words that nobody else has, leave room for a link."""
    a, b = x["size"].astype(np.int64), y["size"].astype(np.int64)
    own_a, own_b = x["own"].astype(np.int64), y["own"].astype(np.int64)
    apart = np.where(_by_shingle(x["unit"], a), own_a + own_b, np.maximum(own_a, own_b))
    return (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (apart * (100 + percent) <= (a + b) * (100 - percent))


def _pairs(percent: int, salts: int, listed: bool):
    """Pairs to compare among the entries of a part, and who is in a large bucket with which
    lead. Parts of a common word's bucket count as large and also give their leads; with
    `listed`, all buckets count as large."""

    def run(table: pa.Table) -> pa.Table:
        entries = _flat(table, "entries", _ENTRY)
        entries = entries[np.lexsort((entries["unit"], entries["own"], entries["key"]))]
        edges = _edges(entries["key"], entries["unit"])[:-1]
        entries = entries[edges]
        edges = _edges(entries["key"])
        size, start = np.diff(edges), np.repeat(edges[:-1], np.diff(edges))
        split = salts > 1 and bool(table["salt"][0].as_py())
        large = np.repeat(size > (1 if listed or split else SMALL_BUCKET), size)
        at = np.arange(len(entries))
        kinds, left, right = [], [], []

        def put(kind: int, x: np.ndarray, y: np.ndarray, canonical: bool) -> None:
            a, b = ((entries["unit"][i] & ~_U(3)).view(np.int64) for i in (x, y))
            if canonical:
                a, b = np.minimum(a, b), np.maximum(a, b)
            fit = a != b
            kinds.append(np.full(int(fit.sum()), kind))
            left.append(a[fit])
            right.append(b[fit])

        for step in range(1, SMALL_BUCKET):
            x = at[: max(0, len(at) - step)]
            x = x[(start[x] == start[x + step]) & ~large[x]]
            x = x[_may_link(entries[x], entries[x + step], percent)]
            put(_PAIR, x, x + step, True)
        members = at[large & (at != start)]
        may = _may_link(entries[start[members]], entries[members], percent)
        put(_STAR, start[members[may]], members[may], False)
        put(_LISTED, start[members[~may]], members[~may], False)
        members = members[members != start[members] + 1]
        second = start[members] + 1
        may = _may_link(entries[second], entries[members], percent)
        put(_PAIR, second[may], members[may], False)
        kind, a, b = (np.concatenate(x) for x in (kinds, left, right))
        order = np.lexsort((kind, b, a))
        kind, a, b = kind[order], a[order], b[order]
        first = _edges(a, b, kind)[:-1]
        kind, a, b = kind[first], a[first], b[first]
        part, packed = [None] * len(kind), [None] * len(kind)
        if split:
            kind, a, b = np.append(kind, _LEADS), np.append(a, 0), np.append(b, 0)
            part.append(table["part"][0].as_py())
            packed.append(entries[edges[:-1]].tobytes())
        return pa.Table.from_arrays([pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(part, pa.int32()), pa.array(packed, pa.binary())], names=["kind", "a", "b", "part", "entries"])

    return run


def linked(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def in_common(a: np.ndarray, b: np.ndarray) -> int:
    """Of two sorted sets."""
    if len(a) < len(b):
        a, b = b, a
    return int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())


def _compare(percent: int):
    """Links of runs of rows: a center's set, then its members' sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = np.zeros(0, _U)
        for batch in batches:
            centers, members, packed = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            a, b = [], []
            for i, (c, m) in enumerate(zip(centers, members)):
                own = np.frombuffer(packed[i].as_buffer(), _U)
                if c == m:
                    lead = own.copy()
                elif linked(in_common(lead, own), len(lead), len(own), percent):
                    a.append(c)
                    b.append(m)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _block(percent: int):
    """Links between the sets of two blocks that aren't in one component yet."""

    def run(table: pa.Table) -> pa.Table:
        names, comps, odd = table["member"].to_numpy(), table["comp"].to_numpy(), np.array(table["odd"].to_pylist(), bool)
        sets = [np.frombuffer(x.as_buffer(), _U) for x in table["hashes"]]
        left, right = np.flatnonzero(odd), np.flatnonzero(~odd)
        parent = {c: c for c in set(comps.tolist())}

        def top(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        a, b = [], []
        flat = np.concatenate([sets[j] for j in right]) if len(right) else np.zeros(0, _U)
        owner = np.repeat(np.arange(len(right), dtype=np.int32), [len(sets[j]) for j in right])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        size = np.array([len(sets[j]) for j in right])
        for i in left.tolist():
            lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
            common = np.zeros(len(right), np.int64)
            for at in range(0, len(lo), 512):  # a few hundred thousand hits at once
                spans = hi[at : at + 512] - lo[at : at + 512]
                hits = owner[np.repeat(lo[at : at + 512] - (np.cumsum(spans) - spans), spans) + np.arange(int(spans.sum()))]
                common += np.bincount(hits, minlength=len(right))
            for j in np.flatnonzero(100 * common >= percent * (size + len(sets[i]) - common)).tolist():
                x, y = top(comps[i]), top(comps[right[j]])
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    a.append(int(names[i]))
                    b.append(int(names[right[j]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _sets(n: int, salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for rows in text_slices(batch, 0):
                fresh = []
                for hashes in shingle_sets(rows.column(0), n):
                    if len(hashes) and (name := set_id(hashes, salt)[0]) not in seen:
                        seen.add(name)
                        fresh.append((name, hashes.tobytes()))
                if len(seen) > 200_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in fresh], pa.int64()), pa.array([f[1] for f in fresh], pa.binary())], names=["set_id", "hashes"])
        give_back()

    return run


def _named(texts: DataFrame, n: int) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, n_shingles, set_id) for every row; for every set its least id and number of rows; and
    the salt under which no two sets share a name."""
    salt = 0
    while True:
        base = cut(texts.mapInArrow(_base(n, salt), "doc_id long, n_shingles long, set_id long, more long"), "base")
        names = base.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.max("n_shingles").alias("size"), (F.min("more") != F.max("more")).alias("clash"))
        names = cut(names, "names")
        if names.filter("clash").isEmpty():
            return base.drop("more"), names.drop("clash"), salt
        salt += 1


def classes(docs: DataFrame, n: int = N, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n_shingles, set_id) for every row of docs; (set_id, least, n, size) for every set;
    and (id, root): for every set that isn't the least of its component, the least. percent must be
    over 50."""
    spark = docs.sparkSession
    short_batches(spark)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base, names, salt = _named(texts, n)
    total, n_sets = names.agg(F.sum("size"), F.count("*")).first()
    parts, salts = 1 + (total or 0) * 6 // 10 // PART_WORDS, 1 + n_sets // SALT_SETS
    words = texts.mapInArrow(_words(n, percent, parts, salts, salt), _WORDS)
    matches = words.groupBy("part", "salt").applyInArrow(_match(parts), _MATCHES)
    rare = matches.groupBy("home").applyInArrow(_rare(salts), _RARE)
    found = cut(rare.groupBy("part", "salt").applyInArrow(_pairs(percent, salts, False), _FOUND), "found")
    if salts > 1:  # parts of one bucket meet by their leads
        leads = found.filter(F.col("kind") == _LEADS).select("part", F.lit(0).alias("salt"), "entries")
        found = found.unionByName(cut(leads.groupBy("part").applyInArrow(_pairs(percent, 1, True), _FOUND), "found"))
    pairs = cut(found.filter(F.col("kind").isin(_PAIR, _STAR)).select("a", "b").distinct(), "pairs")
    lists = cut(found.filter(F.col("kind").isin(_STAR, _LISTED)).select("a", "b").distinct(), "lists")
    wanted = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).union(lists.select("a")).union(lists.select("b")).distinct()
    every = texts.select("text").mapInArrow(_sets(n, salt), "set_id long, hashes binary")
    sets = cut(every.join(small(cut(wanted, "wanted")), "set_id", "left_semi").groupBy("set_id").agg(F.first("hashes").alias("hashes")), "sets")
    # A center's members are dealt out in runs of bounded size, each with the center's set.
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(CENTER_PAIRS)).alias("runs"))
    asked = pairs.join(counts, "a").select(F.col("a").alias("center"), F.pmod(F.xxhash64("b"), F.col("runs")).alias("run"), F.col("b").alias("member"))
    asked = asked.union(asked.select("center", "run", F.col("center").alias("member")).distinct())
    size = asked.join(names.select("set_id", "size"), asked["member"] == names["set_id"]).agg(F.sum("size")).first()[0] or 0
    with_sets = asked.join(sets, asked["member"] == sets["set_id"]).select("center", "member", "hashes", "run")
    dealt = with_sets.repartition(max(tasks, size * 8 // TASK_BYTES), "center", "run").sortWithinPartitions("center", "run", F.col("member") != F.col("center"))
    links = cut(dealt.mapInArrow(_compare(percent), "a long, b long"), "links")
    roots = components(links)
    # Large buckets that still hold several components.
    inside = lists.select(F.col("a").alias("list"), F.col("b").alias("member")).union(lists.select("a", "a").distinct())
    inside = cut(inside.join(roots, F.col("member") == roots["id"], "left").select("list", "member", F.coalesce("root", "member").alias("comp")), "lists")
    open_ = cut(inside.groupBy("list").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("list"), "open")
    if open_.isEmpty():
        return base, names, roots
    # Lists that share sets are joined as one: their members differ little.
    held = inside.join(open_, "list")
    joint = components(held.select(F.col("list").alias("a"), F.col("member").alias("b")), "joint")
    people = held.select("member", "comp").distinct().join(joint, F.col("member") == joint["id"], "left").select("member", "comp", F.coalesce("root", "member").alias("joint"))
    people = cut(people.join(names.select(F.col("set_id").alias("member"), "size"), "member"), "people")
    size = people.groupBy("joint", "comp").agg(F.sum("size").alias("n"))
    main = size.groupBy("joint").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    main = cut(main.withColumns({"right": F.ceil(F.col("all") / F.lit(BLOCK_SHINGLES)), "left": F.ceil((F.col("all") - F.col("most")) / F.lit(BLOCK_SHINGLES))}).filter("left > 0"), "main")
    told = people.join(main, "joint")
    turn = lambda c, k: F.pmod(F.xxhash64("member", F.lit(k)), F.col(c))
    odd = told.filter("comp != main").withColumn("i", turn("left", 1)).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("right") - 1))).withColumn("odd", F.lit(True))
    rest = told.withColumn("j", turn("right", 2)).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("left") - 1))).withColumn("odd", F.lit(False))
    columns = ("joint", "i", "j", "odd", "member", "comp")
    blocks = odd.select(*columns).union(rest.select(*columns)).join(sets, F.col("member") == sets["set_id"]).drop("set_id")
    more = cut(blocks.groupBy("joint", "i", "j").applyInArrow(_block(percent), "a long, b long"), "links")
    return base, names, components(links.union(more))


def join(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs (doc_id, text; other columns
    are ignored). Null, empty and blank texts have no shingles and are linked with nothing: their
    component is their own id. Repeated rows are equal sets. A null doc_id is never a
    component's name unless all of its rows have none. An empty table gives an empty result."""
    base, names, roots = classes(docs, n, percent)
    own = cut(names.join(roots, names["set_id"] == roots["id"], "left").select("set_id", "least", "n", F.coalesce("root", "set_id").alias("root")), "classes")
    least = own.groupBy("root").agg(F.min("least").alias("component"), F.sum("n").alias("rows")).filter("rows > 1")
    named = cut(own.join(least, "root").select("set_id", "component"), "named")
    return base.join(small(named), "set_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def survivors(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all their columns, but one of each component: a row of its least
    doc_id stays. Rows without words and rows without id stay. doc_id is taken to name a row;
    where it is repeated, one row of the least id stays."""
    found = join(docs, n, percent)
    gone = cut(found.filter("doc_id != component_id").select("doc_id").distinct(), "gone")
    twice = found.filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    kept = docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
    twice = cut(twice.select("doc_id"), "twice")
    if twice.isEmpty():
        return kept
    again = kept.join(F.broadcast(twice) if twice.count() < 100_000 else twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(small(twice), "doc_id", "left_anti").select(*docs.columns).unionByName(again.select(*docs.columns))
