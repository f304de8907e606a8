"""Gaze operators: golden cases for the rules that are easy to get wrong, randomized comparisons
with sequential models, files, and the SQL of the registered queries on the smallest tables."""

import importlib
import math
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gazeloom.functions import labels as L
from gazeloom.operators import cleaning as C
from gazeloom.operators import events as E
from gazeloom.operators import joins as J
from gazeloom.operators import metrics as M
from gazeloom.operators import percepts as P
from gazeloom.operators import quality as Q
from gazeloom.plans import reference
from gazeloom.sources import tables as T
from gazeloom.sources import tracker as K

SF = "/root/testdata/sf0.001"
KEY = "subject long, run long, "


def rows(spark, columns, *values, trial=1):
    """Samples of one run, 4 ms apart: columns are 'name type' pairs after the keys."""
    data = [(1, 1, 4000 * i, trial, 4000 * i, *v) for i, v in enumerate(values)]
    return spark.createDataFrame(data, KEY + "run_us long, trial long, trial_us long, " + columns)


def column(df, name, order="run_us"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_sections_before_the_first_fixation_point(spark):
    df = rows(spark, "fixpoint1 int, fixpoint2 int", *[(v, 5) for v in (None, None, 1, None, 1, 2)])
    assert column(P.label_sections(df), "section") == [1, 2, 3, 3, 3, 4]


def test_interpolation_at_the_edges(spark):
    df = rows(spark, "x double, y double, diameter double", *[(v, None, v) for v in (None, 1.0, None, None, 2.0, None)])
    out = C.interpolate(df)
    assert column(out, "x") == pytest.approx([1, 1, 4 / 3, 5 / 3, 2, 2]) and column(out, "y") == [None] * 6


def test_ties_and_missing_distances(spark):
    df = rows(spark, "d1 double, d2 double, dc double, image1 string", (1.0, 1.0, 5.0, "house"), (None, 1.0, 5.0, "house"), (1.0, 2.0, 5.0, "face"), (3.0, 2.0, 1.0, "face"), (3.0, 2.0, 2.0, "face"))
    out = P.infer_by_ratio(P.infer(df), 0.0)
    assert column(out, "percept") == ["face", "face", "face", "house", "house"]
    assert column(out, "percept3") == ["face", "face", "face", "mixed", "house"]
    assert column(out, "percept_ratio") == ["mixed", "mixed", "face", "house", "house"]


def test_rounding_and_coding(spark):
    df = spark.createDataFrame([(0.15,), (0.25,), (0.35,), (28.85,)], "v double")
    assert [r[0] for r in df.select(L.rounded(F.col("v"))).collect()] == [0.2, 0.2, 0.4, 28.8]
    df = spark.createDataFrame([("house",), ("face",), ("mixed",), (None,)], "v string")
    assert [tuple(r) for r in df.select(L.encode(F.col("v")), L.decode(L.encode(F.col("v"))), L.decode(L.encode(F.col("v")), False)).collect()] == [(1.0, "house", "house"), (0.0, "face", "face"), (0.5, "mixed", "house"), (0.5, "mixed", "house")]
    cuts = spark.createDataFrame([(0.56,), (0.5,), (0.44,), (None,)], "v double").select(L.dead_band(F.col("v")), L.dead_band(F.col("v"), mixed=False)).collect()
    assert [tuple(r) for r in cuts] == [(1.0, 1.0), (0.5, 1.0), (0.0, 0.0), (None, None)]
    assert L.degrees_per_pixel() == pytest.approx(2 * math.degrees(math.atan(0.5 * (470 / 1920) / 1050)))


def test_section_mode_ties_and_errors(spark):
    df = rows(spark, "section long, percept string, peri_jump boolean, d double", (1, "house", False, 1.0), (1, "face", False, 2.0), (2, "house", True, 9.0), (2, None, True, 1.0))
    assert column(P.aggregate_sections(df, "percept"), "aggregated") == ["face", "face", "house", "house"]
    assert column(P.aggregate_sections(df, "percept", skip_peri_jump=True), "aggregated") == ["face", "face", None, None]
    with pytest.raises(ValueError):
        P.aggregate_sections(df, "nothing")
    with pytest.raises(ValueError):
        P.aggregate_sections(df, "percept", "sum")


def test_offsets_by_rank_and_number(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 1, 3), (1, 1, 3), (1, 1, None)], KEY + "trial long")
    assert column(E.trial_offsets(df), "offset", "trial") == [28.75, 168.75]
    assert column(E.trial_offsets(df, by="number"), "offset", "trial") == [28.75, 308.75]


def merge(epochs, least=1.75):
    """The sequential rule, repeated until nothing changes."""
    e, changed = [list(x) for x in epochs], True
    even = lambda v: float(np.round(v, 1))
    while changed:
        changed, i = False, 0
        while i < len(e):
            if e[i][1] >= least:
                i += 1
            elif i and abs(e[i - 1][0] + e[i - 1][1] - e[i][0]) <= 0.15:
                e[i - 1][1], changed = even(e[i - 1][1] + e[i][1]), True
                del e[i]
            elif i < len(e) - 1 and abs(e[i][0] + e[i][1] - e[i + 1][0]) <= 0.15:
                e[i + 1][0], e[i + 1][1], changed = e[i][0], even(e[i + 1][1] + e[i][1]), True
                del e[i]
            else:
                i += 1
    return [tuple(x) for x in e]


def test_merge_short_epochs_like_the_sequential_rule(spark):
    rng, tables = np.random.default_rng(7), {1: [(0.0, 1.0, "a"), (1.0, 1.0, "b"), (2.0, 3.0, "c")]}
    for run in range(2, 120):
        at, out = 0.0, []
        for _ in range(int(rng.integers(1, 12))):
            at = round(at + float(rng.choice([0, 0, 0, 0.1, 5.0])), 1)
            n = float(rng.choice([0.1, 0.5, 1.0, 1.7, 1.8, 4.0]))
            out.append((at, n, str(rng.choice(["a", "b"]))))
            at = round(at + n, 1)
        tables[run] = out
    df = spark.createDataFrame([(1, run, *e) for run, t in tables.items() for e in t], KEY + "onset double, duration double, trial_type string")
    got = {}
    for r in E.merge_short_epochs(df).orderBy("run", "onset").collect():
        got.setdefault(r["run"], []).append((round(r["onset"], 6), round(r["duration"], 6), r["trial_type"]))
    want = {run: [(round(a, 6), round(b, 6), c) for a, b, c in merge(t)] for run, t in tables.items()}
    assert got == want and got[1] == [(0.0, 2.0, "b"), (2.0, 3.0, "c")]


def reflected(values, size, kind):
    n, half, out = len(values), size // 2, []
    for i in range(n):
        near = []
        for p in range(i - half, i + size - half):
            p %= 2 * n
            near.append(values[p if p < n else 2 * n - 1 - p])
        out.append(sum(near) / size if kind == "uniform" else sorted(near)[size // 2])
    return out


@pytest.mark.parametrize("kind", ["uniform", "median"])
@pytest.mark.parametrize("size", [4, 5, 9])
def test_smoothing_with_reflected_edges(spark, kind, size):
    rng = np.random.default_rng(size)
    data, want = [], []
    for run, n in enumerate((1, 2, 3, 7, 40), 1):  # shorter than the window too
        series = rng.choice(["house", "face", "mixed"], n).tolist()
        code = [{"house": 1.0, "face": 0.0, "mixed": 0.5}[v] for v in series]
        data += [(1, run, 4000 * i, v) for i, v in enumerate(series)]
        want += ["house" if round(v, 9) >= 0.55 else "face" if round(v, 9) <= 0.45 else "mixed" for v in reflected(code, size, kind)]
    df = spark.createDataFrame(data, KEY + "run_us long, percept string")
    assert [r["smoothed"] for r in P.smooth(df, "percept", size, kind).orderBy("run", "run_us").collect()] == want


def test_event_padding_and_coalescing(spark):
    flags = [0, 1, 0, 0, 0, 0, 1, 1, 0, 0, 0]
    df = rows(spark, "blink int", *[(f,) for f in flags])
    assert column(C.pad_events(df, "blink", 1), "blink") == [1, 1, 1, 0, 0, 1, 1, 1, 1, 0, 0]
    assert column(C.coalesce_events(df, "blink", 20_001), "blink") == [0, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0]
    assert column(C.coalesce_events(df, "blink", 20_000), "blink") == flags  # strictly less


def test_chain_suppression(spark):
    kinds = [None, "jump_induced", None, "jump_induced", None, "spontaneous", None]
    smooth = ["house", "face", "face", "house", "house", "mixed", "mixed"]
    df = rows(spark, "smoothed string, transition_type string", *zip(smooth, kinds))
    import unittest.mock as mock

    with mock.patch.object(E, "label_transitions", lambda d, *a: d):
        assert column(E.suppress_jump_induced(df), "suppressed") == ["house"] * 5 + ["mixed"] * 2


def test_reported_epochs_end(spark):
    s = rows(spark, "x double", *[(0.0,)] * 6)
    reports = spark.createDataFrame([(1, 1, 1, "house", 4000, 8000), (1, 1, 1, "face", 16000, 100), (1, 1, 2, "mixed", 0, 10**6)], KEY + "trial long, percept string, onset_us long, duration_us long")
    assert column(J.report_as_of(s, reports), "reported") == [None, "house", "house", None, "face", None]


def test_scores(spark):
    df = spark.createDataFrame([(1, 1, "house", "house"), (1, 1, "house", "face"), (1, 2, "house", "house"), (1, 2, "face", "face"), (1, 2, "face", "mixed"), (1, 2, None, "face"), (1, 3, "face", "face")], KEY + "reported string, inferred string")
    got = {r["run"]: r for r in M.scores(M.confusion(df, ("subject", "run")), ("subject", "run")).collect()}
    assert got[1]["accuracy"] is None and got[3]["mcc"] is None  # one true label only
    assert got[2]["accuracy"] == pytest.approx(2 / 3) and got[2]["f1_macro"] == pytest.approx((1 + 2 / 3 + 0) / 3)
    assert got[2]["f1_weighted"] == pytest.approx((1 + 2 * 2 / 3) / 3) and got[2]["mcc"] == pytest.approx((2 * 3 - 3) / math.sqrt((9 - 3) * (9 - 5)))


def test_low_pass_is_the_identity_unless_asked_for(spark):
    df = rows(spark, "x double, y double", *[(float(i % 2), 5.0) for i in range(60)])
    assert column(C.low_pass(df), "x") == [float(i % 2) for i in range(60)]
    out = C.low_pass(df, apply=True)
    assert max(abs(v - 0.5) for v in column(out, "x")[20:40]) < 0.1 and column(out, "y") == pytest.approx([5.0] * 60)


def test_excluded_trials_keep_samples_outside_trials(spark):
    df = spark.createDataFrame([(1, 1, None, 1), (1, 1, 1, 1), (1, 1, 1, 0), (1, 1, 2, 0)], KEY + "trial long, blink int")
    assert sorted(r["trial"] or 0 for r in C.exclude_trials(df, 0.3).collect()) == [0, 2]
    assert sorted(r["trial"] or 0 for r in C.exclude_trials(df, 0.5).collect()) == [0, 1, 1, 2]


def test_runs_without_parameters(spark):
    s = spark.createDataFrame([(1, 1), (1, 2), (1, 5)], "subject long, run long")
    p = spark.createDataFrame([(1, 2, 7.0), (1, 4, 9.0)], KEY + "x_offset double")
    assert [tuple(r) for r in C.parameters_as_of(s, p).orderBy("run").collect()] == [(1, 2, 2, 7.0), (1, 5, 4, 9.0)]
    assert [tuple(r) for r in C.runs_without_parameters(s, p).collect()] == [(1, 1)]


RECORDING = "\n".join(
    ["** file", "MSG\t1 GAZE_COORDS 0.00 0.00 1919.00 1079.00", "SAMPLES\tGAZE\tLEFT\tRATE\t 250.00", "10\t1\t1\t1", "MSG\t20 SYNCTIME"]
    + ["MSG\t30 Trial #2: type = rivalry, report = 1, image1 = face, angle1 = 45", "MSG\t30 Fix point 1 position: 3", "32\t5.0\t.\t700.0\t...", "SFIX L   32", "36\t5.5\t6.0\t701.0\t...", "MSG\t37 Current percept: house", "40\t.\t6.5\t702.0\t..."]
    + ["EFIX L   32\t36\t4\t5.0\t6.0", "EBLINK L 40\t44\t4", "bad\t1\t2\t3", "41\tx\t2\t3", "MSG\t42 End of trial", "44\t1.0\t1.0\t1.0", "END\t45\tSAMPLES", "48\t9\t9\t9"]
)


def test_recordings_from_files(spark, tmp_path):
    (tmp_path / "s11r02nr.asc").write_text(RECORDING + "\n")
    lines = K.read_lines(spark, str(tmp_path))
    got = [tuple(r) for r in K.parse(lines).orderBy("run_us").collect()]
    assert got == [
        (11, 2, 32000, 5.0, None, 700.0, 2, "rivalry", "face", 3, None, "face", 1, 0, 0),
        (11, 2, 36000, 5.5, 6.0, 701.0, 2, "rivalry", "face", 3, None, "face", 1, 0, 0),
        (11, 2, 40000, None, 6.5, 702.0, 2, "rivalry", "face", 3, None, "house", 0, 0, 1),
        (11, 2, 44000, 1.0, 1.0, 1.0, None, None, None, None, None, None, 0, 0, 1),
    ]
    meta = K.run_metadata(lines).first()
    assert (meta["sampling_rate"], meta["gaze_coords"], meta["n_fixations"], meta["n_saccades"], meta["n_blinks"]) == (250.0, [0.0, 0.0, 1919.0], 1, 0, 1)
    ok = K.validate(lines).first()
    assert ok["valid"] and ok["errors"] == [] and ok["n_messages"] == 6
    assert not K.validate(lines, strict=False).first()["valid"]
    assert tuple(K.trial_metadata(lines).first())[2:] == (2, "rivalry", "face", 45.0)
    assert lines.select("run_type").first()[0] == "no-report"


def long_recording(trials=30):
    """Messages of many trials, some without an end or a fixation point, and END and SYNCTIME lines that don't count."""
    lines, t = ["** file", "MSG\t1 GAZE_COORDS 0.00 0.00 1919.00 1079.00", "END\t2\tearly", "900\t1\t1\t1", "MSG\t20 SYNCTIME"], 1000
    want, state = [], (None, None, None, None, None, None)
    for k in range(trials):
        lines.append(f"MSG\t{t} Trial #{k}: type = rivalry, report = 1, image1 = {'face' if k % 2 else 'house'}, angle1 = 45")
        image = "face" if k % 2 else "house"
        state = (k, "rivalry", image, state[3], state[4], image)
        if k % 3:
            lines.append(f"MSG\t{t} Fix point 1 position: {k % 8}")
            state = (*state[:3], k % 8, *state[4:])
        for j in range(20):
            if j == 7 and k % 4:
                lines.append(f"MSG\t{t} Current percept: mixed")
                state = (*state[:5], "mixed")
            lines.append(f"{t}\t{j}.5\t2.0\t700.0\t...")
            want.append((t * 1000, j + 0.5, 2.0, 700.0, *state))
            t += 4
        if k % 5:
            lines.append(f"MSG\t{t} End of trial")
            state = (None,) * 6
    return "\n".join([*lines, "END\t9\tSAMPLES", "99999\t1\t1\t1", "MSG\t1 SYNCTIME", "END\t10"]) + "\n", want


@pytest.mark.parametrize("split", [200, 1000, 5000, 1 << 27])
def test_one_recording_is_read_in_splits(spark, tmp_path, split):
    """Rows are the same whatever the splits, and splits are read by tasks of their own."""
    text, want = long_recording()
    for name in ("s11r02nr.asc", "s12r01r.asc"):
        (tmp_path / name).write_text(text)
    old = [(k, spark.conf.get(k)) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")]
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        lines = K.read_lines(spark, str(tmp_path))
        found = lines.collect()
        samples = K.parse_samples(lines).collect()
        meta = K.run_metadata(lines).collect()
    finally:
        for k, v in old:
            spark.conf.set(k, v)
    for subject, run in ((11, 2), (12, 1)):
        own = sorted((r for r in found if r["subject"] == subject), key=lambda r: r["line_no"])
        assert [r["value"] for r in own] == text.splitlines() and len({r["line_no"] for r in own}) == len(own)
        assert len({r["block"] for r in own}) >= min(20, len(text) // split)
        assert sorted(tuple(r)[2:] for r in samples if r["subject"] == subject) == want
    assert {tuple(r["gaze_coords"]) for r in meta} == {(0.0, 0.0, 1919.0)} and len(meta) == 2


def test_no_window_spans_a_run_of_lines(spark):
    """State and bounds come from blocks of lines and from a row a block."""
    lines = spark.createDataFrame([(1, 1, i, v) for i, v in enumerate(long_recording()[0].splitlines())], "subject long, run long, line_no long, value string")
    want = long_recording()[1]
    for rows in (7, 40, 100_000):
        blocks = lines.withColumn("block", F.floor(F.col("line_no") / rows))
        assert sorted(tuple(r)[2:] for r in K.parse_samples(blocks).collect()) == want
    plan = K.parse_samples(lines)._jdf.queryExecution().optimizedPlan().toString()
    whole = [w for w in plan.splitlines() if "Window [" in w and "block" not in w and "_sync" not in w]  # _sync: a row a block
    assert not whole, whole


def test_tables_and_sinks(spark, tmp_path):
    s = spark.createDataFrame([(1, 1, 1, 0, 5.0), (2, 2, 1, 0, 6.0)], KEY + "trial long, trial_us long, x double")
    T.write_runs(s, str(tmp_path / "plain"))
    schema = "trial long, trial_us long, x double, subject long, run long"
    back = T.read_runs(spark, str(tmp_path / "plain"), schema, subjects=[2])
    assert [(r["subject"], r["x"], r["run_type"]) for r in back.collect()] == [(2, 6.0, None)]
    T.write_runs(s.withColumn("run_type", F.lit("report")), str(tmp_path / "runs"))  # a run's type is told by its folder, not by its number
    back = T.read_runs(spark, str(tmp_path / "runs"), schema + ", run_type string", subjects=[2])
    assert [(r["subject"], r["x"], r["run_type"]) for r in back.collect()] == [(2, 6.0, "report")]
    made = spark.createDataFrame([(1, 1, 0.5), (1, 7, 0.7)], "subject long, run long, accuracy_2 double")
    assert [(r["subject"], r["r1"], r["r7"]) for r in Q.evaluation_report(made).collect()] == [(1, 0.5, 0.7), (None, None, None)]
    # gaps in trial numbers close up
    gaps = spark.createDataFrame([(1, 1, t) for t in (1, 2, 5, 9)], KEY + "trial long")
    assert [r["offset"] for r in E.trial_offsets(gaps).orderBy("trial").collect()] == [28.75, 168.75, 308.75, 448.75]
    with pytest.raises(ValueError):
        T.require(s, ("nothing",))
    events = spark.createDataFrame([(1, 1, 2.0, 1.0, "b"), (1, 1, 0.5, 1.0, "a")], KEY + "onset double, duration double, trial_type string")
    T.write_events(events, str(tmp_path / "events"))
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "events")).count() == 2
    for name, label in (("s1r01r_perceptData_1.csv", "old"), ("s1r01r_perceptData_2.csv", "new")):
        (tmp_path / "reports").mkdir(exist_ok=True)
        (tmp_path / "reports" / name).write_text(f"trial,type,percept,onset_us,duration_us\n1,rivalry,{label},0,10\n")
    found = T.latest(spark.read.schema(T.REPORT_SCHEMA).option("header", True).csv(str(tmp_path / "reports")).withColumns({"file": F.col("_metadata.file_path"), "subject": F.lit(1), "run": F.lit(1)}), "file")
    assert [r["percept"] for r in found.collect()] == ["new"]
    assert T.sidecar(s).columns == ["subject", "run", "trial_us", "trial"]


def test_normalized_constant_column(spark):
    df = spark.createDataFrame([(1, 1, 2.0, 5.0), (1, 2, 4.0, 5.0)], KEY + "a double, b double")
    assert [tuple(r) for r in Q.normalized(df, ("a", "b")).orderBy("label").collect()] == [("s1r01", 0.0, 0.0), ("s1r02", 1.0, 0.0)]


@pytest.mark.parametrize("name", sorted(reference.QUERIES))
def test_queries_against_sql(spark, name):
    got = reference.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    cursor = con.execute(reference.ORACLES[name])
    at = [d[0] for d in cursor.description]
    even = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    want = sorted(repr([even(r[at.index(c)]) for c in names]) for r in cursor.fetchall())
    assert sorted(at) == names
    assert sorted(repr([even(r[c]) for c in names]) for r in got.collect()) == want


def test_every_query_has_sql():
    assert set(reference.QUERIES) == set(reference.ORACLES)


def test_entry_without_the_corpus_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(reference.QUERIES) and set(entry.oracle_sql()) == set(reference.ORACLES)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
