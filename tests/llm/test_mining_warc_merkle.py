"""Collocations, WARC archives and Merkle manifests against brute force."""

import gzip
import hashlib
import io
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gazeloom.llm import collocations, merkle, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, phrase string, _rank int, hash string, size long"


def odd_rows():
    base = "Of the people; by THE people, for the people\tof the town. "
    texts = [None, "", " \t\n", "one", "a.b,c;d:e!f?g", base, base * 3, base.upper(), "É é ß\x0bof the\x0cof the", "x" * 70_000, "a b " * 9000, "tab\tand  two blanks", "line\nfeeds\r\nhere\n"]
    rows = [(i, ["a", None, "b", "é", ""][i % 5], ["en", None, "und", "l\tx y"][i % 4], [i, None][i % 2], t, "p", i, "h", 1) for i, t in enumerate(texts * 2)]
    return rows + [rows[5], rows[5], rows[12], (None, None, None, None, None, None, None, None, None), (None, "a", "en", 1, base, None, None, None, None), (-5, "a", "en", 1, base + "\n", None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 11: collocations


def brute_collocations(rows, least=10, top=2000, inside=50):
    f, n = Counter(), Counter()
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(upper)):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    dropped = {(lang, q) for (lang, p), a in found.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= inside * f[lang, q]}
    out = {}
    for (lang, p), a in found.items():
        if (lang, p) not in dropped:
            cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    return {(lang, i + 1) + r[3:] for lang, rs in out.items() for i, r in enumerate(sorted(rs)[:top])}


@pytest.mark.parametrize("sample_rows", [10_000, 12, 0])
def test_collocations_are_exact_whatever_the_sample(spark, odd, sample_rows, monkeypatch):
    if not sample_rows:  # the joins of large tables
        monkeypatch.setattr(collocations, "small", lambda df: df)
    for table, least in ((odd, 4), (spark.read.parquet(f"{SF}/documents.parquet"), 10)):
        want = brute_collocations([(r["lang"], r["text"]) for r in table.collect()], least)
        got = [tuple(r) for r in collocations.collocations(table, least=least, sample_rows=sample_rows).collect()]
        assert len(got) == len(want) and set(got) == want


def test_border_failures_are_counted_by_further_passes(spark, monkeypatch):
    """A sample without rows proposes nothing: pairs are found by the second pass, triples by the third."""
    passes = []
    count = collocations.count
    monkeypatch.setattr(collocations, "count", lambda docs, table=None, earlier=(): passes.append(len(earlier)) or count(docs, table, earlier))
    table = spark.createDataFrame([(i, "en", "new york city hall") for i in range(12)], "doc_id long, lang string, text string")
    got = {(r["phrase"], r["length"]): r["n"] for r in collocations.frequent(table, sample_rows=0).collect()}
    assert got[("new york city", 3)] == got[("york city", 2)] == got[("hall", 1)] == 12 and got[("", 0)] == 48 and len(got) == 10
    assert passes == [0, 0, 1, 2]
    passes.clear()
    assert collocations.frequent(table).count() == 10
    assert passes == [0, 0]  # the whole table as sample: nothing is left to find


def test_collocations_of_ties_top_and_inner_phrases(spark):
    rows = [(i, "en", "x y z. x y. " + ("b a, " if i < 10 else "d c, ") * 2) for i in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = [tuple(r)[1:5] for r in collocations.collocations(table).orderBy("rank").collect()]
    # x y is dropped (half of it is in x y z), y z too; of equal scores the more frequent is first, then by name
    assert [g[1] for g in got] == ["b a", "d c", "x y z"] and [g[0] for g in got] == [1, 2, 3]
    assert collocations.collocations(table, top=1).count() == 1


def test_products_beyond_64_bits(spark):
    a, l, r = 3_000_000_017, 4_000_000_037, 5_000_000_029
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(collocations._score(F.col("a"), F.col("l"), F.col("r")).alias("s")).first()
    assert row["s"] == 1_000_000 * a * a // (l * r)


def test_bit_table_misses_nothing(spark):
    rows = [("en" if i % 2 else "de", f"w{i}" if i % 3 else f"w{i} v{i}", 2 - (i % 3 > 0)) for i in range(3000)]
    df = spark.createDataFrame(rows, "lang string, phrase string, length int")
    table = collocations.BitTable.of(df)
    hashes = collocations._phrase_hashes(pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "phrase": [r[1] for r in rows]}))
    assert table.has(hashes).all() and table.has(hashes ^ np.uint64(0x5555)).mean() < 0.1


def test_collocations_of_nothing(spark, empty):
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None)], "doc_id long, lang string, text string")).count() == 0


# --- 12: WARC


def brute_pages(rows):
    top = {}
    for p, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000:
            top[b] = max((x for x in (top.get(b), p) if x is not None), default=None)
    out = []
    for p, h in rows:
        b = (h or "").encode()
        t = top.get(b, p)
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "response" if t == p else "revisit", None if t == p else t))
    return Counter(out)


PAGES = "page_id long, url string, html string, record_type string, _key string"


def odd_pages():
    long = "<p>é漢" + "x" * 1000
    texts = [(i, f"http://a/{i}", [None, "", "short", long, long, long + "y", "\r\n\r\nWARC/1.1\r\n" * 90][i % 7], "a", "b") for i in range(40)]
    return texts + [(39, None, "\r\n\r\nWARC/1.1\r\n" * 90, None, None), (None, "u\r\nWARC-Type: bad", long, None, None), (None, None, "z" * 1500, None, None), (-3, "ü x", long * 400, None, None)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(odd_pages(), PAGES)


@pytest.mark.parametrize("bound", [200_000, 1])
def test_pages_come_back(spark, pages, monkeypatch, bound):
    monkeypatch.setattr(warc, "small", lambda df: F.broadcast(df) if bound > 1 else df)  # with a bound of 1: the joins of large tables
    for table in (pages, spark.read.parquet(f"{SF}/pages.parquet")):
        got = Counter(tuple(r) for r in warc.read_pages(spark, warc.write_pages(table)).collect())
        assert got == brute_pages([(r["page_id"], r["html"]) for r in table.collect()])


def test_a_payload_that_most_rows_share_is_one_response(spark, monkeypatch):
    monkeypatch.setattr(warc, "small", lambda df: df)
    rows = [(i, "u", "same" * 400 if i % 3 else f"{i % 7}" * 1200) for i in range(4000)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Counter(tuple(r) for r in warc.read_pages(spark, warc.write_pages(table)).collect())
    assert got == brute_pages([(r[0], r[2]) for r in rows]) and sum(n for r, n in got.items() if r[3] == "response") == 8


def test_empty_archive(spark):
    none = spark.createDataFrame([], PAGES)
    path = warc.write_pages(none)
    assert warc.read_pages(spark, path).count() == 0 and warc.read(spark, path).count() == 0


def test_archives_are_standard_gzip_members(spark, pages):
    path = warc.write_pages(pages)
    files = spark.read.format("binaryFile").load(path + "/*.warc.gz").collect()
    plain = b"".join(gzip.decompress(bytes(f["content"])) for f in files)
    assert plain.count(b"WARC-Record-ID: <urn:page:") == len(odd_pages()) and b"\r\nWARC-Type: bad" not in plain
    for f in files:  # each member by itself, as its sl field says
        data, at = bytes(f["content"]), 0
        while at < len(data):
            assert data[at + 12 : at + 14] == b"sl"
            size = int.from_bytes(data[at + 16 : at + 20], "little")
            assert gzip.decompress(data[at : at + size]).startswith(b"WARC/1.1\r\n")
            at += size


class Counting(io.BytesIO):
    def __init__(self, data):
        super().__init__(data)
        self.taken = 0

    def size(self):
        return len(self.getbuffer())

    def read(self, n=-1):
        got = super().read(n)
        self.taken += len(got)
        return got


def some_records(payloads, types):
    rows = []
    for i, (p, t) in enumerate(zip(payloads, types)):
        rows.append({"record_type": t, "record_id": f"urn:x:{i}", "target_uri": f"http://{i}", "payload_digest": None, "payload_length": len(p), "payload": p if t != "revisit" else None, "refers_to": "urn:x:0" if t == "revisit" else None})
    return rows


@pytest.mark.parametrize("form", ["sl", "bare", "plain", "one member each, folded"])
def test_unwanted_payloads_are_stepped_over(form):
    rng = np.random.default_rng(3)
    payloads = [rng.bytes(n) for n in (0, 10, 300_000, 70_000, 5, 200_000, 1)]
    rows = some_records(payloads, ["response", "resource", "resource", "revisit", "response", "resource", "response"])
    members = [warc.encode_record(r) for r in rows]
    if form == "bare":
        members = [gzip.compress(gzip.decompress(m)) for m in members]
    elif form == "plain":
        members = [gzip.decompress(m) for m in members]
    elif form != "sl":
        members = [gzip.compress(gzip.decompress(m).replace(b"WARC-Date: ", b"X-More: a\r\n b: c\r\nWARC-Date: ")) for m in members]
    source = Counting(b"".join(members))
    got = list(warc.records(source, lambda r: r["record_type"] == "response", True))
    assert [(r["record_id"], r["payload"], r["payload_length"]) for r in got] == [(rows[i]["record_id"], payloads[i], len(payloads[i])) for i in (0, 4, 6)]
    if form in ("sl", "plain"):
        assert source.taken < 350_000  # of 570,000 bytes; files are read by chunks
    heads = list(warc.records(Counting(b"".join(members)), lambda r: True, False))
    assert [(r["payload"], r["payload_length"]) for r in heads] == [(None, len(p)) for p in payloads]
    assert heads[3]["refers_to"] == "urn:x:0" and heads[1]["content_type"] == "text/html; charset=utf-8"


def test_broken_archives_are_errors():
    with pytest.raises(ValueError):
        list(warc.records(Counting(b"no archive at all"), lambda r: True, True))


def test_predicates_are_pushed_down(spark, pages):
    df = warc.read(spark, warc.write_pages(pages))
    every = df.collect()
    tests = ["record_type = 'revisit'", "record_type <> 'revisit'", "record_type in ('response', 'x')", "target_uri like 'http://a/1%'", "target_uri is null", "refers_to is not null", "payload_length > 1000",
             "payload_length <= 5 and record_type = 'response'", "target_uri <=> 'http://a/3'", "not record_id in ('urn:page:1', 'urn:page:2')", "record_type = 'response' or payload_length = 5", "length(target_uri) = 10", "octet_length(payload) = 5"]
    for test in tests:
        got = df.filter(test)
        want = Counter(map(repr, df.sparkSession.createDataFrame(every, df.schema).filter(test).collect()))
        assert Counter(map(repr, got.collect())) == want, test
    plan = df.filter("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan
    assert "payload#" not in warc.read(spark, "file:///tmp", ["record_id"])._jdf.queryExecution().analyzed().toString()
    df.filter("record_type = 'none'").collect()
    assert df.count() == len(every)  # no predicate of the query before


def test_uncommitted_files_are_not_read(spark, pages, tmp_path):
    path = warc.write_pages(pages)
    n = warc.read(spark, path).count()
    local = path.removeprefix("file://")
    with open(f"{local}/part-lost.warc.gz", "wb") as out:
        out.write(b"half a rec")
    assert warc.read(spark, path).count() == n
    (tmp_path / "a.warc.gz").write_bytes(warc.encode_record(some_records([b"abc"], ["response"])[0]))
    (tmp_path / "b.warc").write_bytes(gzip.decompress(warc.encode_record(some_records([b"abcd"], ["response"])[0])))
    assert sorted(bytes(r["payload"]) for r in warc.read(spark, f"file://{tmp_path}").collect()) == [b"abc", b"abcd"]
    assert warc.read(spark, f"file://{tmp_path}/a.warc.gz").count() == 1


# --- 13: Merkle


def hashed(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: hashed("".join(field(v) for v in (*r[:4], t)))
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r, leaf(r, r[4])))

    def tree(hs):
        levels = [hs]
        while len(levels[-1]) > 1:
            levels.append([hashed("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            j = i // 3 * 3
            yield "".join(level[j:i]), "".join(level[i + 1 : j + 3])
            i //= 3

    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = {s: tree([h for _, h in by[s]]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = Counter()
    for k, s in enumerate(sources):
        for i, (r, h) in enumerate(by[s]):
            steps = [*path(trees[s], i), *path(top, k)]
            now = r[4].replace("\n", "") if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
            folded = leaf(r, now)
            for a, b in steps:
                folded = hashed(a + folded + b)
            root = top[-1][0]
            out[r[0], h, trees[s][-1][0], root, hashed("".join(a + b for a, b in steps)), folded, folded == root] += 1
    return out


def test_manifest_of_odd_rows(odd):
    got = Counter(tuple(r) for r in merkle.manifest(odd).collect())
    assert got == brute_manifest([tuple(r)[:5] for r in odd.collect()])
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [1, 1], [1, 2, 3, 4, 9, 10], [3], [728, 729, 730, 1], [5000, 2]])
def test_manifests_of_all_shapes(spark, sizes):
    """Groups about the size of a block, of several blocks, and single rows."""
    rows = [(1000 * k + i, f"s{k}", "en", i, f"t{i}\n" if i % 2 else "t") for k, n in enumerate(sizes) for i in range(n)]
    got = Counter(tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")).collect())
    assert got == brute_manifest(rows)


def test_manifest_of_many_sources_and_of_none(spark, empty, monkeypatch):
    """Blocks of nine: many rounds, of rows and of sources."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 9)
    rows = [(i, None if i % 97 == 0 else f"s{i % 97}" if i % 3 else "hot", "en", i, "t\n") for i in range(1500)]
    got = Counter(tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")).collect())
    assert got == brute_manifest(rows)
    assert merkle.manifest(empty).count() == 0


def test_groupings_within_blocks_do_not_shuffle(spark):
    rows = spark.range(100).selectExpr("id % 2 as group", "id div 2 as rank", "50L as size", "string(id) as hash", "id as item")
    plan = merkle.roll_up(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
