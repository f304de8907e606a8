"""Operators and queries that do the whole job: against their SQL on the smallest tables, and small
cases that the cut forms couldn't pass."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gazeloom.operators import batch as B
from gazeloom.operators import events as E
from gazeloom.operators import percepts as P
from gazeloom.plans import bind, reference
from gazeloom.sources import tables as T

SF = "/root/testdata/sf0.001"


def against_sql(spark, name, sf=SF):
    got = reference.QUERIES[name](spark, sf)
    names = sorted(got.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    cursor = con.execute(reference.ORACLES[name])
    at = [d[0] for d in cursor.description]
    even = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    want = sorted(repr([even(r[at.index(c)]) for c in names]) for r in cursor.fetchall())
    rows = got.collect()
    assert sorted(at) == names and rows
    assert sorted(repr([even(r[c]) for c in names]) for r in rows) == want
    return rows


def labels_of_a_run(spark):
    """Two sections of 30 samples 4 ms apart in one trial: nearest labels are face for the 13 samples
    about the jump and after it, else house; distances make the ratio weak in the second section."""
    near = lambda i: (2.0, 1.0) if 28 <= i <= 42 else (1.0, 2.0) if i < 30 else (1.0, 1.1)
    data = [(1, 1, 4000 * i, 1, 4000 * i, "rivalry", "house", "house", 1 + i // 30, *near(i)) for i in range(60)]
    df = spark.createDataFrame(data, "subject long, run long, run_us long, trial long, trial_us long, type string, image1 string, reported string, section long, d1 double, d2 double")
    return df.withColumn("percept", F.when(F.col("d1") < F.col("d2"), "house").otherwise("face"))


def test_five_pipelines_differ_as_their_steps_do(spark):
    out = P.pipelines(labels_of_a_run(spark), margin_us=48_000, size=5)
    got = {r["section"]: [r[c] for c in P.PIPELINES] for r in out.select("section", *P.PIPELINES).distinct().collect()}
    # baseline, no_jumps, smoothed, ratio, ratio_smoothed
    assert got == {1: ["house"] * 5, 2: ["house", "house", "house", "house", "mixed"]}
    assert P.pipelines(labels_of_a_run(spark).filter("trial_us < 43 * 4000"), margin_us=48_000, size=5).filter("section = 2").select("baseline", "no_jumps").distinct().collect() == [("face", None)]


def test_all_five_pipelines_are_scored(spark):
    rows = against_sql(spark, "f7_compare_pipelines")
    assert {r["config"] for r in rows} == set(P.PIPELINES)
    by_subject = against_sql(spark, "f7_pipelines_by_subject")
    assert len(by_subject) == len({r["subject"] for r in by_subject})
    assert {r["config"] for r in against_sql(spark, "f7_pipeline_summary")} == set(P.PIPELINES)


@pytest.mark.parametrize("name", ["a9_load_all_runs", "a13_all_subjects"])
def test_all_subjects_are_loaded_and_labelled(spark, name):
    assert {r["subject"] for r in against_sql(spark, name)} == set(range(11, 21))


def test_subject_filter_of_loaded_runs(spark, tmp_path):
    df = spark.createDataFrame([(s, r, float(s)) for s in (1, 2, 3) for r in (1, 2)], "subject long, run long, x double")
    T.write_runs(df, str(tmp_path / "runs"))
    some = T.read_runs(spark, str(tmp_path / "runs"), "x double, subject long, run long", subjects=[1, 3])
    assert sorted((r["subject"], r["run"], r["x"]) for r in some.collect()) == [(1, 1, 1.0), (1, 2, 1.0), (3, 1, 3.0), (3, 2, 3.0)]


def test_batch_stages(spark):
    s, p, r = (f(spark, SF) for f in (bind.samples, bind.stimuli, bind.reports))
    keys = lambda df: {x[0] for x in df.select("subject").distinct().collect()}
    loose = {"threshold": 2.0, "coalesce_us": 9_000, "blink_padding": 1, "share": 1.0}
    everything = B.run_batch(s, p, r, [12, 14], evaluate=True, events=True, cleaning=loose)
    assert list(everything) == ["preprocessed", "percepts", "scores", "events", "switch_events"]
    assert all(keys(df) == {12, 14} for df in everything.values())
    assert everything["switch_events"].filter("duration <> 0").isEmpty() and not everything["events"].filter("duration > 0").isEmpty()
    kinds = {(x["run"] % 2, x["trial_type"].split("_")[0]) for x in everything["events"].collect()}
    assert kinds == {(1, "report"), (0, "no")}
    assert list(B.run_batch(s, p, preprocess_only=True)) == ["preprocessed"]
    only = B.run_batch(s, p, reconstruct_only=True)
    assert list(only) == ["percepts"] and only["percepts"].count() == s.count()
    assert list(B.run_batch(s, p, preprocess_only=True, reconstruct_only=True)) == []
    given = B.run_batch(s, p, r, [12], preprocess_only=True, reconstruct_only=True, events=True, percepts=only["percepts"])
    assert list(given) == ["events", "switch_events"] and keys(given["events"]) == {12}
    with pytest.raises(ValueError):
        B.run_batch(s, p, r, preprocess_only=True, events=True)


def test_every_trial_has_an_offset_and_its_own_onset(spark):
    trials = {tuple(r) for r in bind.samples(spark, SF).select("subject", "run", "trial").distinct().collect()}
    offsets = against_sql(spark, "g1_all_trial_offsets")
    assert {(r["subject"], r["run"], r["trial"]) for r in offsets} == trials
    epochs = against_sql(spark, "g3_collapse_all_epochs")
    assert {(r["subject"], r["run"], r["trial"]) for r in epochs} == trials
    assert all(r["onset"] >= 28.7 for r in epochs)


def test_onsets_with_gaps_in_trial_numbers(spark):
    data = [(1, 1, t, 4000 * i, "rivalry", "house" if i < 50 else "face") for t in (2, 5, 9) for i in range(101)]
    df = spark.createDataFrame(data, "subject long, run long, trial long, trial_us long, type string, aggregated string")
    epochs = E.collapse_to_epochs(df, "aggregated", E.trial_offsets(df), "no_report").orderBy("trial", "onset").collect()
    assert [(r["trial"], r["onset"], r["duration"]) for r in epochs] == [(2, 28.8, 0.2), (2, 29.0, 0.2), (5, 168.8, 0.2), (5, 169.0, 0.2), (9, 308.8, 0.2), (9, 309.0, 0.2)]


@pytest.mark.parametrize("method", ["uniform", "median"])
def test_default_grid_is_the_references(spark, method):
    code, rng = {"house": 1.0, "face": 0.0, "mixed": 0.5}, np.random.default_rng(5)
    true = ["house" if (i // 260) % 2 else "face" for i in range(900)]
    seen = [t if rng.random() < 0.6 else ("house", "face", "mixed")[rng.integers(3)] for t in true]
    df = spark.createDataFrame([(1, 1, 4000 * i, t, s) for i, (t, s) in enumerate(zip(true, seen))], "subject long, run long, run_us long, t string, p string")
    v, t = np.array([code[x] for x in seen]), np.array([code[x] for x in true])
    best = None
    for size in range(200, 2001, 10):
        windows = np.lib.stride_tricks.sliding_window_view(np.pad(v, (size // 2, size - size // 2 - 1), mode="symmetric"), size)
        s = windows.sum(1) / size if method == "uniform" else np.sort(windows, axis=1)[:, size // 2]
        for j, delta in enumerate((0.02, 0.05, 0.07, 0.1)):
            cut = np.where(s >= 0.5 + delta, 1.0, np.where(s <= 0.5 - delta, 0.0, 0.5))
            now = (int((cut != t).sum()), size, j, delta)
            best = now if best is None or now < best else best
    assert [tuple(r) for r in P.grid_search(df, "t", "p", method=method).collect()] == [(1, 1, best[1], best[3], best[0])]


@pytest.mark.parametrize("method", ["uniform", "median"])
@pytest.mark.parametrize("block", [64, 700, 65_536])
def test_grid_search_by_changes_counts_every_sample(spark, method, block):
    """Runs with few changes, many, none and a single sample, in blocks shorter and longer than a window;
    every combination's best against windows over the padded series."""
    rng, code = np.random.default_rng(11), {"house": 1.0, "face": 0.0, "mixed": 0.5, None: 0.5}
    names = ("house", "face", "mixed", None)
    stretch = lambda n, mean: [x for k in range(n) for x in [names[rng.integers(4)]] * (1 + int(rng.exponential(mean)))][:n]
    runs = {1: (stretch(1500, 120), stretch(1500, 150)), 2: (stretch(400, 1), stretch(400, 2)), 3: (["face"] * 90, ["house"] * 90), 4: (["mixed"], ["face"]), 5: (stretch(1400, 300), stretch(1400, 300))}
    rows = [(7, r, 4000 * i, t, s) for r, (true, seen) in runs.items() for i, (t, s) in enumerate(zip(true, seen))]
    df = spark.createDataFrame(rows, "subject long, run long, run_us long, t string, p string")
    windows, deltas, want = (1, 2, 5, 40, 333), (0.3, 0.0, 0.1), []
    for r, (true, seen) in runs.items():
        v, t = np.array([code[x] for x in seen]), np.array([code[x] for x in true])
        options = []
        for size in windows:
            padded = np.lib.stride_tricks.sliding_window_view(np.pad(v, (size // 2, size - size // 2 - 1), mode="symmetric"), size)
            s = padded.sum(1) / size if method == "uniform" else np.sort(padded, axis=1)[:, size // 2]
            options += [(int((np.where(s >= 0.5 + d, 1.0, np.where(s <= 0.5 - d, 0.0, 0.5)) != t).sum()), size, j, d) for j, d in enumerate(deltas)]
        missed, size, _, delta = min(options)
        want.append((7, r, size, delta, missed))
    got = P.grid_search(df, "t", "p", windows, deltas, method=method, block=block)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert P.grid_search(df.filter("false"), "t", "p", windows, deltas, method=method, block=block).isEmpty()


@pytest.mark.parametrize("name", ["d11_full_grid_search", "d11_full_grid_search_median"])
def test_full_grid_against_sql(spark, name):
    assert all(200 <= r["size"] <= 2000 for r in against_sql(spark, name))


def test_stands_without_the_corpus_part(tmp_path):
    """On a copy without the corpus part's folders the entry imports with SQL for every query, and all tests
    are found."""
    here = Path(__file__).resolve().parent.parent
    shutil.copytree(here, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    run = lambda *args: subprocess.run([sys.executable, *args], cwd=tmp_path / "copy", capture_output=True, text=True)
    entry = run("-c", "import __spark_entry__ as e; assert e.queries().keys() == e.oracle_sql().keys() and len(e.queries()) > 90")
    assert entry.returncode == 0, entry.stderr
    found = run("-m", "pytest", "tests", "-q", "--collect-only")
    assert found.returncode == 0, found.stdout
