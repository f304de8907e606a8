"""Phrase collocations by Toivonen mining.

A sample of documents proposes words and pairs that may be frequent. One pass over all documents
then counts exactly all words, the proposed pairs and their negative border: pairs of proposed words,
and triples of proposed pairs. Border phrases that turn out frequent where the sample had not proposed
them are failures: what they are part of has not been counted yet, so another pass counts the phrases
whose parts are all known to be frequent by now and which no pass has counted before, until a pass
finds no failure. The result is exact whatever the sample holds.

"Are all parts frequent" is asked of a bit table (two bits a phrase, of bounded size). What it lets
through wrongly is counted for nothing, which changes no result; what no table has let through is
not frequent, for no phrase is more frequent than its parts. A phrase is counted by the first pass whose table lets
it through, and by no other. Occurrences are summed up inside batches and tasks before they are
shuffled by phrase, so a word that a third of all texts is made of is a row a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, give_back, mix64, small, span_hashes, text_buffer
from .tokens import text_slices

#: Least occurrences of a candidate, results a language, and the share (in percent) of a candidate's
#: occurrences inside one longer candidate from which on it is dropped.
LEAST, TOP, INSIDE = 10, 2000, 50
#: Expected number of documents in the sample.
SAMPLE_ROWS = 10_000
#: Bytes of text whose occurrences are summed up together.
SLICE_BYTES = 8_000_000
#: Bits of a table for each frequent phrase, and in all at most (a bound on what is broadcast).
BITS_EACH, MOST_BITS = 16, 1 << 27
NO_LANGUAGE = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[9, 32]] = True
_BREAK[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix64(first * np.uint64(0x9E3779B97F4A7C15) + second)


class BitTable:
    """Phrases of one or two words by two bits of their hash each: no phrase that was put in is missed."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(64 * len(words) - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in (hashes & self.mask, (hashes >> np.uint64(32)) & self.mask):
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
        return out

    @classmethod
    def of(cls, phrases: DataFrame) -> "BitTable":
        """phrases: (lang, phrase, length), written. Bits are joined in Spark; the table that
        comes to the driver has at most MOST_BITS."""
        n = phrases.count()
        bits = min(MOST_BITS, max(1 << 12, 1 << (BITS_EACH * n).bit_length()))

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hashes = _phrase_hashes(batch)
                at = np.concatenate([hashes, hashes >> np.uint64(32)]) & np.uint64(bits - 1)
                at = np.unique(at)
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bits"])

        found = phrases.select("lang", "phrase").mapInArrow(places, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        words = np.zeros(bits // 64, np.uint64)
        words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        return cls(words)


def _language_salts(langs: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """For each row its language's number, the languages, and a hash of each language."""
    coded = langs.cast(pa.string()).fill_null(NO_LANGUAGE).dictionary_encode()
    data, offs = text_buffer(coded.dictionary)
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, span_hashes(data, offs[:-1], offs[1:], 1)


def _phrase_hashes(batch: pa.RecordBatch) -> np.ndarray:
    """Hashes of (lang, phrase) of one or two words, as _phrases has them."""
    code, _, salt = _language_salts(batch.column(0))
    words = pc.split_pattern(batch.column(1).cast(pa.large_string()), " ", max_splits=1)
    size = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    data, offs = text_buffer(pc.list_flatten(words))
    first = np.cumsum(size) - size
    hashes = span_hashes(data, offs[:-1], offs[1:])
    out = hashes[first] ^ salt[code]
    two = np.flatnonzero(size == 2)
    out[two] = _pair_hash(out[two], hashes[first[two] + 1] ^ salt[code[two]])
    return out


def _spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the number of the piece each is in."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    stop = _BREAK[data]
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~(stop | _BLANK[data])
    starts = np.flatnonzero(solid[1:-1] & (edge[:-1] | ~solid[:-2]))
    ends = np.flatnonzero(solid[1:-1] & (edge[1:] | ~solid[2:])) + 1
    return starts, ends, np.cumsum(stop | edge[:-1], dtype=np.int32)[starts]


def _take_strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    size = ends - starts
    offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    index = np.arange(offs[-1]) + np.repeat(starts - offs[:-1], size)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data[index])))


def _phrases(rows: pa.RecordBatch, table: BitTable | None, earlier: list[BitTable]) -> Iterator[pa.RecordBatch]:
    """Summed occurrences in rows (lang, text): those that the table lets through and no
    earlier one did; all words and pairs if there is none. With the first table, all words too, and each
    language's number of words (as the empty phrase). Keys are language, tab, words."""
    code, langs, salt = _language_salts(rows.column(0))
    data, offs = text_buffer(rows.column(1))
    data = _LOWER[data]
    starts, ends, piece = _spans(data, offs)
    if not len(starts):
        return
    code = np.repeat(code, np.diff(np.searchsorted(starts, offs)))
    word, hashes = pd.factorize(span_hashes(data, starts, ends) ^ salt[code])
    first = np.empty(len(hashes), np.int64)
    first[word[::-1]] = np.arange(len(word) - 1, -1, -1)
    langs = langs.cast(pa.large_string())
    strings = _take_strings(data, starts[first], ends[first])
    leading = pc.binary_join_element_wise(langs.take(pa.array(code[first])), strings, pa.scalar("\t", pa.large_string()))

    def batch(parts: list[np.ndarray], n: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
        columns = [(strings if i else leading).take(pa.array(p)) for i, p in enumerate(parts)]
        keys = pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string())) if len(parts) > 1 else columns[0]
        return pa.RecordBatch.from_arrays([keys.cast(pa.string()), pa.array(known), pa.array(n.astype(np.int64))], names=["key", "known", "n"])

    known = table.has(hashes) if table else np.ones(len(hashes), bool)
    before = [t.has(hashes) for t in earlier]
    if not earlier:
        yield batch([np.arange(len(hashes))], np.bincount(word), known)
        each = np.bincount(code, minlength=len(langs))
        totals = pc.binary_join_element_wise(langs, pa.scalar("", pa.large_string()), pa.scalar("\t", pa.large_string())).cast(pa.string())
        yield pa.RecordBatch.from_arrays([totals, pa.array(np.ones(len(langs), bool)), pa.array(each.astype(np.int64))], names=["key", "known", "n"])
    near = np.flatnonzero(piece[1:] == piece[:-1])  # pairs of words
    left, right = word[near], word[near + 1]
    new = known[left] & known[right]
    for b in before:
        new &= ~(b[left] & b[right])
    if new.any():
        kind, keys = pd.factorize(left[new] * np.int64(len(hashes)) + right[new])
        parts = [keys // len(hashes), keys % len(hashes)]
        yield batch(parts, np.bincount(kind), table.has(_pair_hash(*[hashes[p] for p in parts])) if table else np.ones(len(keys), bool))
    if not table:
        return
    named = _pair_hash(hashes[left], hashes[right])
    known, before = table.has(named), [t.has(named) for t in earlier]
    start = np.flatnonzero((near[1:] == near[:-1] + 1) & known[1:] & known[:-1])  # triples: two pairs that share a word
    for b in before:
        start = start[~(b[start] & b[start + 1])]
    if len(start):
        pair, keys = pd.factorize(left[start] * np.int64(len(hashes)) + right[start])
        kind, ends_with = pd.factorize(pair * np.int64(len(hashes)) + right[start + 1])
        keys, last = keys[ends_with // len(hashes)], ends_with % len(hashes)
        yield batch([keys // len(hashes), keys % len(hashes), last], np.bincount(kind), np.ones(len(last), bool))


def count(docs: DataFrame, table: BitTable | None = None, earlier: tuple[BitTable, ...] = ()) -> DataFrame:
    """docs: (lang, text). lang, phrase, length, known (the table has the phrase itself) and n,
    the exact number of occurrences in all documents."""
    held = docs.sparkSession.sparkContext.broadcast((table, list(earlier)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (rows for batch in batches for rows in text_slices(batch, 1, SLICE_BYTES)):
            yield from _phrases(rows, *held.value)
        give_back()

    summed = docs.select("lang", "text").mapInArrow(run, "key string, known boolean, n long").groupBy("key").agg(F.first("known").alias("known"), F.sum("n").alias("n"))
    # The key is language, tab, phrase; phrases hold no tab.
    told = summed.withColumn("phrase", F.substring_index("key", "\t", -1))
    length = F.when(F.col("phrase") == "", F.lit(0)).otherwise(F.size(F.split("phrase", " ")))
    return told.select(F.expr("substring(key, 1, length(key) - length(phrase) - 1)").alias("lang"), "phrase", length.alias("length"), "known", "n")


def frequent(docs: DataFrame, least: int = LEAST, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(lang, phrase, length, n) of all phrases of one to three words that occur `least` times or more, and of each
    language's words in all (phrase '', length 0)."""
    rows = docs.count()
    share = min(1.0, sample_rows / max(rows, 1))
    dice = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(1 << 20))
    chosen = docs.filter(dice < F.lit(int(share * (1 << 20)) if share < 1 else 1 << 20))
    # Lower than the sample's share of `least`, but no phrase that was seen once; a sample that is the whole table is exact.
    bar = least if share == 1 else max(2, int(0.6 * least * share))
    proposed = cut(count(chosen).filter((F.col("n") >= bar) & (F.col("length") > 0)), "proposed")
    tables, parts = [BitTable.of(proposed)], []
    while True:
        found = count(docs, tables[-1], tuple(tables[:-1]))
        parts.append(cut(found.filter((F.col("n") >= least) | (F.col("length") == 0)), "counted"))
        if parts[-1].filter("length in (1, 2) and not known").isEmpty():  # no border failures
            break
        known = reduce(DataFrame.unionByName, parts).filter("length in (1, 2)")
        tables.append(BitTable.of(known))
    return reduce(DataFrame.unionByName, parts).drop("known")


def _with_parts(candidates: DataFrame, parts: DataFrame, part: Column, name: str, common: int) -> DataFrame:
    """candidates with the count of one of their parts. Where parts are too many to broadcast, those that occur `common`
    times or more still are: with a ten-thousandth of all words as bound they are 10,000 at most. A rarer part is in few
    candidates, each of which occurs some times in it, so no key of the shuffled join is hot."""
    told = parts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_p"), F.col("n").alias(name))
    same = (F.col("lang") == F.col("_lang")) & (F.col("_part") == F.col("_p"))
    given, near = candidates.withColumn("_part", part), small(told)
    if near is not told:
        return given.join(near, same).drop("_lang", "_part", "_p")
    hot = F.broadcast(told.filter(F.col(name) >= common).withColumnsRenamed({"_lang": "_hot_lang", "_p": "_hot", name: "_n"}))
    given = given.join(hot, (F.col("lang") == F.col("_hot_lang")) & (F.col("_part") == F.col("_hot")), "left").drop("_hot_lang", "_hot")
    # Rows that have their count by now are spread over the join's partitions by a key that nothing meets.
    given = given.withColumn("_part", F.when(F.col("_n").isNull(), F.col("_part")).otherwise(F.concat(F.lit(" "), "phrase")))
    both = given.join(told.filter(F.col(name) < common), same, "left").withColumn(name, F.coalesce(name, "_n"))
    return both.drop("_lang", "_part", "_p", "_n")


def _score(a: Column, l: Column, r: Column) -> Column:
    """floor(1000000 * a * a / (l * r)), exact up to counts of 10 ** 15."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(l) * wide(r))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The highest-scoring phrases of two or three words of each language of docs (doc_id, lang, text; other
    columns are ignored). A null language is 'und', a null text empty. Repeated rows count each for itself, rows
    without id like any other; an empty table, or one without frequent phrases, gives an empty result. Ties of scores go
    by count, then by phrase, so that reruns agree.

    lang, rank (from 1), phrase, a (its count), l and r (of its parts), n (words of the language), score."""
    slim = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col("text").cast("string").alias("text"))
    known = frequent(slim, least, sample_rows)
    words, pairs, triples = (known.filter(F.col("length") == i).select("lang", "phrase", "n") for i in (1, 2, 3))
    common = max(1, (known.filter("length = 0").agg(F.sum("n")).first()[0] or 0) // 10_000)
    w = F.split("phrase", " ")
    join = lambda *at: F.concat_ws(" ", *[w[i] for i in at])
    two = pairs.withColumnRenamed("n", "a")
    two = _with_parts(_with_parts(two, words, w[0], "l", common), words, w[1], "r", common)
    three = triples.withColumnRenamed("n", "a")
    for part, source, name in ((w[0], words, "l1"), (join(1, 2), pairs, "r1"), (join(0, 1), pairs, "l2"), (w[2], words, "r2")):
        three = _with_parts(three, source, part, name, common)
    three = three.withColumns({f"score{k}": _score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")) for k in (1, 2)})
    cuts = [F.struct(*[F.col(f"{c}{k}").alias(c) for c in ("l", "r", "score")]) for k in (1, 2)]
    three = three.select("lang", "phrase", "a", F.when(F.col("score2") < F.col("score1"), cuts[1]).otherwise(cuts[0]).alias("_cut")).select("lang", "phrase", "a", "_cut.*")
    # The most frequent triple that holds a pair decides whether the pair is dropped.
    holds = triples.select("lang", F.explode(F.array_distinct(F.array(join(0, 1), join(1, 2)))).alias("_held"), "n").groupBy("lang", "_held").agg(F.max("n").alias("_within"))
    two = two.join(holds.withColumnRenamed("lang", "_lang"), (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_held")), "left")
    two = two.filter(~F.coalesce(100 * F.col("_within") >= inside * F.col("a"), F.lit(False)))
    both = two.select("lang", "phrase", "a", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("score")).unionByName(three)
    # A language's best are among the best of its 64 parts: its last sort has 64 * top rows at most.
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = both.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = best.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_place") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    totals = known.filter(F.col("length") == 0).select(F.col("lang").alias("_lang"), F.col("n").alias("n"))
    return best.join(small(totals), F.col("lang") == F.col("_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
