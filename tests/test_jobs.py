"""Whole jobs over files and runs: named files, report files, batches with broken runs, reports in all
metrics, the low pass and the merging of epochs."""

import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_whole import SF, against_sql

from gazeloom.operators import batch as B
from gazeloom.operators import cleaning as C
from gazeloom.operators import events as E
from gazeloom.operators import quality as Q
from gazeloom.plans import bind, reference
from gazeloom.sources import files as N
from gazeloom.sources import tables as T
from gazeloom.sources import tracker as K

KEY = "subject long, run long, "


@pytest.mark.parametrize("name", ["a10_reports_from_files", "a12_evaluation_files", "a13_isolated_batch", "f6_metric_report", "g4_merge_short_epochs", "h5_quality_report"])
def test_whole_jobs_against_sql(spark, name):
    against_sql(spark, name)


def plain_filtfilt(v, order=4, cutoff=30.0, rate=250.0):
    """The transfer function's polynomials, odd edges, steady first state, sample by sample."""
    w = np.tan(np.pi * cutoff / rate)
    poles = w * np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    z = (1 + poles) / (1 - poles)
    a = np.poly(z).real
    b = np.poly(-np.ones(order)) * a.sum() / 2**order
    companion = np.eye(order) - np.vstack([-a[1:], np.eye(order)[:-1]]).T
    zi = np.linalg.solve(companion, b[1:] - a[1:] * b[0])
    k = min(3 * (order + 1), len(v) - 1)
    x = np.concatenate([2 * v[0] - v[1 : k + 1][::-1], v, 2 * v[-1] - v[-k - 1 : -1][::-1]]) if k else np.array(v)
    for _ in range(2):
        s, out = zi * x[0], []
        for u in x:
            y = b[0] * u + s[0]
            s = np.append(s[1:], 0.0) + b[1:] * u - a[1:] * y
            out.append(y)
        x = np.array(out)[::-1]
    return x[k : len(x) - k]


@pytest.mark.parametrize("order", [2, 4, 6])
def test_low_pass_equals_the_plain_filter(spark, order):
    rng = np.random.default_rng(order)
    x = rng.normal(500, 60, 700).cumsum() / 30
    gone = {0, 1, 90, 300, 301, 303, 699}  # stretches of one sample and of many
    data = [(1, 1, 4000 * i, None if i in gone else float(v), 7.0) for i, v in enumerate(x)]
    df = spark.createDataFrame(data[::-1], KEY + "run_us long, x double, y double")
    got = [(r["x"], r["y"]) for r in C.low_pass(df, order=order, apply=True).orderBy("run_us").collect()]
    cuts = np.flatnonzero(np.diff([i for i in range(700) if i not in gone]) > 1) + 1
    want = [None] * 700
    for part in np.split(np.array([i for i in range(700) if i not in gone]), cuts):
        for i, v in zip(part, plain_filtfilt(x[part], order)):
            want[i] = v
    assert [v is None for v, _ in got] == [v is None for v in want]
    assert max(abs(g - w) for (g, _), w in zip(got, want) if w is not None) < 1e-9
    assert [y for _, y in got] == pytest.approx([7.0] * 700)
    with pytest.raises(ValueError):
        C.low_pass(df, order=3, apply=True)


def test_low_pass_of_runs_without_any_value(spark):
    df = spark.createDataFrame([(1, 1, 0, None, None), (1, 2, 0, 3.0, 4.0)], KEY + "run_us long, x double, y double")
    assert sorted(tuple(r) for r in C.low_pass(df, apply=True).collect()) == [(1, 1, 0, None, None), (1, 2, 0, 3.0, 4.0)]
    assert C.low_pass(df.filter("run = 9"), apply=True).isEmpty()


def test_merging_a_run_of_a_million_epochs(spark):
    """One run, all epochs touching and most of them short."""
    n = 1_000_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("subject"), F.lit(1).cast("long").alias("run"), (F.col("id") * 0.5).alias("onset"), F.lit(0.5).alias("duration"), F.lit("a").alias("trial_type"))
    began = time.perf_counter()
    got = E.merge_short_epochs(df.withColumn("duration", F.when(F.col("onset") % 50 == 0, 2.0).otherwise(0.5)))
    assert got.agg(F.count("*")).first()[0] < n
    assert time.perf_counter() - began < 40


def test_epochs_that_touch_nothing_stay(spark):
    data = [(1, 1, None, 1.0, "a"), (1, 1, 0.0, None, "b"), (1, 1, 0.5, 0.2, "c"), (1, 2, 0.7, 0.1, "d"), (2, 1, 3.0, 1.0, None)]
    df = spark.createDataFrame(data, KEY + "onset double, duration double, trial_type string")
    assert sorted(map(repr, (tuple(r) for r in E.merge_short_epochs(df).collect()))) == sorted(map(repr, data))
    assert E.merge_short_epochs(df.filter("subject = 9")).isEmpty()


def test_named_files(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    data = [("a/one.csv", i, f"v,{i}" if i % 2 else None) for i in range(50)] + [("two.csv", 1, "é"), (None, 1, "gone")]
    df = spark.createDataFrame(data, "f string, k long, v string").repartition(4)
    for _ in range(2):  # a second job replaces the files
        N.write_csv_files(df.select("k", "v", "f"), path, F.col("f"), ("k",))
    files = sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.endswith(".crc"))
    assert files == ["a/one.csv", "two.csv"]
    lines = (tmp_path / "out/a/one.csv").read_text().splitlines()
    assert lines[0] == "k,v,f" and lines[2] == '1,"v,1",a/one.csv' and len(lines) == 51
    back = spark.read.option("header", True).csv(path + "/a/one.csv")
    assert back.count() == 50 and back.filter("v is null").count() == 25
    N.write_json_files(spark.createDataFrame([("x.json", 1, None)], "f string, a long, b double"), path, F.col("f"))
    assert spark.read.option("multiLine", True).json(path + "/x.json").select("a", "f").first() == (1, "x.json")


def test_lines_of_one_file_in_two_tasks_are_an_error(spark, tmp_path):
    spark.dataSource.register(N.NamedFiles)
    df = spark.createDataFrame([("a", str(i)) for i in range(8)], "file string, line string").repartition(2)
    with pytest.raises(Exception, match="several partitions"):
        df.write.format("named_files").mode("append").save(f"file://{tmp_path}/out")
    assert not (tmp_path / "out/a").exists() and not list((tmp_path / "out/_temporary").iterdir())


def test_older_report_files_are_not_opened(spark, tmp_path):
    path = f"file://{tmp_path}/reports"
    r = spark.createDataFrame([(s, run, 1, "rivalry", "face", 0, 1000 * s) for s in (7, 12) for run in (1, 10)], KEY + "trial long, type string, percept string, onset_us long, duration_us long")
    T.write_report_files(r.withColumn("percept", F.lit("old")), path, "20240101")
    T.write_report_files(r.filter("not (subject = 7 and run = 10)"), path, "20240301")
    (tmp_path / "reports/sub-7/notes_report_perceptData_x.csv").write_text("no run\n1\n")
    got = T.read_reports(spark, path)
    assert sorted((x["subject"], x["run"], x["percept"]) for x in got.collect()) == [(7, 1, "face"), (7, 10, "old"), (12, 1, "face"), (12, 10, "face")]
    opened = sorted(f.rsplit("/", 1)[1] for f in got.inputFiles())
    assert opened == [f"sub-{s}_run{run}_report_perceptData_{day}.csv" for s, run, day in ((12, "01", 20240301), (12, "10", 20240301), (7, "01", 20240301), (7, "10", 20240101))]
    (tmp_path / "none").mkdir()
    assert T.read_reports(spark, f"file://{tmp_path}/none").columns == got.columns


def test_names_of_runs(spark):
    df = spark.createDataFrame([(12, 3, "report"), (12, 103, "no-report"), (12, 4, None)], KEY + "run_type string")
    stems = [r[0] for r in df.select(K.run_stem()).collect()]
    assert stems == ["s12r03r", "s12r103nr", "s12r04nr"]
    info = K.run_info(F.concat(K.run_stem(), F.lit("_eval_by_section.csv")))
    assert [tuple(r) for r in df.select(*[c.alias(k) for k, c in info.items()]).collect()] == [(12, 3, "report"), (12, 103, "no-report"), (12, 4, "no-report")]


def test_broken_runs(spark):
    columns = KEY + "trial long, x double, y double, image1 string, run_type string"
    s = spark.createDataFrame([(1, 1, 1, None, 2.0, "house", "report"), (1, 2, None, 1.0, 2.0, "face", "report"), (1, 3, 1, 1.0, 2.0, "tree", "report"), (1, 4, 1, 1.0, 2.0, "face", "report"), (1, 5, 1, 1.0, 2.0, "face", "no-report"), (2, 1, 1, 1.0, 2.0, "face", "no-report"), (3, 1, 1, 1.0, 2.0, "face", "report")], columns)
    stimuli = spark.createDataFrame([(1, 1), (2, 2), (3, 1)], "subject long, run long")
    reports = spark.createDataFrame([(3, 1)], "subject long, run long")
    got = sorted(tuple(r) for r in B.broken_runs(s, stimuli, reports).collect())
    assert got == [(1, 1, "no positions"), (1, 2, "no trials"), (1, 3, "unknown image"), (1, 4, "no reports"), (2, 1, "no parameters")]
    assert (1, 4, "no reports") not in {tuple(r) for r in B.broken_runs(s, stimuli).collect()}


def test_metric_report(spark):
    runs = spark.createDataFrame([(1, 0.5, 0.2), (1, 1.0, None), (2, 0.75, 0.4), (2, None, 0.9)], "subject long, accuracy_2 double, mcc_3 double")
    got = {(r["subject"], r["metric"]): tuple(r)[2:] for r in Q.metric_report(runs, ("accuracy_2", "mcc_3")).collect()}
    assert got[(None, "accuracy_2")] == (3, 2, 0.75, 0.25, 0.5, 1.0)
    assert got[(None, "mcc_3")][:3] == (2, 2, pytest.approx(0.3)) and got[(1, "mcc_3")] == (1, 1, 0.2, None, 0.2, 0.2)
    assert got[(2, "accuracy_2")][:3] == (1, 1, 0.75)


@pytest.fixture(scope="module")
def many_users(tmp_path_factory):
    """The smallest events twice: as they are, and by users so far on that all their y are off the screen."""
    path = tmp_path_factory.mktemp("users")
    duckdb.execute(f"COPY (SELECT * REPLACE (event_id + k * 1000003 AS event_id, user_id + k * 160 * 80 AS user_id) FROM '{SF}/events.parquet', (VALUES (0), (1)) AS t(k)) TO '{path}/events.parquet'")
    return str(path)


def test_runs_without_a_centroid_are_left_out_as_in_sql(spark, many_users):
    assert max(r["subject"] for r in against_sql(spark, "b14_clean_chain", many_users)) < 740
    against_sql(spark, "b10_align_to_center", many_users)
    data = [(1, 1, 0, 900.0, 500.0, 1), (1, 1, 1, None, 500.0, 1), (1, 2, 0, 7.0, None, 1), (1, 3, 0, 7.0, 8.0, 0)]
    df = spark.createDataFrame(data, KEY + "run_us long, x double, y double, fixation int")
    got = lambda **k: sorted((r["run"], r["run_us"], r["x"], r["y"]) for r in C.align_to_center(df, 100.0, **k).collect())
    assert got(uncentered=False) == [(1, 0, 960.0, 540.0), (1, 1, None, 540.0)]
    assert got() == [*got(uncentered=False), (2, 0, 7.0, None), (3, 0, 7.0, 8.0)]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_files_of_runs_grow_with_samples_not_runs(spark, tmp_path, fmt):
    """120 subjects of four runs: a folder for 50 subjects, and only folders of the asked ones are opened.
    Folders of single runs are read as well."""
    s = spark.range(960).select((F.col("id") % 120 + 11).alias("subject"), (F.floor(F.col("id") / 120) % 4 + 1).alias("run"), F.when(F.floor(F.col("id") / 120) % 2 == 0, "report").otherwise("no-report").alias("run_type"), (F.col("id") * 0.5).alias("x"))
    T.write_runs(s, str(tmp_path / "new"), fmt)
    s.write.partitionBy("subject", "run", "run_type").option("header", True).format(fmt).save(str(tmp_path / "old"))
    assert len(list((tmp_path / "new").rglob("part-*"))) <= 3 * 4 < len(list((tmp_path / "old").rglob("part-*")))
    want = sorted(tuple(r) for r in s.collect())
    for name in ("new", "old"):
        back = lambda **k: T.read_runs(spark, str(tmp_path / name), KEY + "run_type string, x double", fmt, **k)
        assert sorted(tuple(r) for r in back().collect()) == want
        assert sorted(tuple(r) for r in back(subjects=[12, 130]).collect()) == [r for r in want if r[0] in (12, 130)]
    kept = T.read_runs(spark, str(tmp_path / "new"), KEY + "run_type string, x double", fmt, subjects=[130, 70])
    assert "PartitionFilters: [(isnull(subjects_from" in kept._jdf.queryExecution().executedPlan().toString()


def test_named_files_are_read_many_a_task(spark, tmp_path):
    """3,000 files of two kinds, and what the readers leave out: other names, hidden ones, blank lines."""
    path = f"file://{tmp_path}/out"
    df = spark.range(6_000).select(F.lit(12).cast("long").alias("subject"), (F.col("id") % 1500).alias("run"), F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, F.concat_ws(",", F.lit('é "x"'), "id")).alias("v"), F.lit("report").alias("run_type"))
    name = lambda what: F.concat(F.lit("some/"), K.run_stem(), F.lit(what))
    N.write_csv_files(df, path, name("_a.csv"), ("k",))
    N.write_json_files(df.filter("k < 1500"), path, name("_a.json"))
    (tmp_path / "out/_s12r01r_a.csv").write_text("h\n1,1,1,1,1\n")
    (tmp_path / "out/s12r9999nr_a.csv").write_text("subject,run,k,v,run_type\r\n\n12,9999,7,,report\n")
    schema = KEY + "k long, v string, run_type string"
    want = {tuple(r) for r in df.collect()}
    got = T.read_run_files(spark, path, "_a.csv", schema)
    assert got.columns == df.columns and got.rdd.getNumPartitions() == 2
    assert {tuple(r) for r in got.collect()} == want | {(12, 9999, 7, None, "no-report")} and got.count() == 6_001
    assert {tuple(r) for r in T.read_run_files(spark, path, "_a.json", schema).collect()} == {r for r in want if r[2] < 1500}
    assert T.read_run_files(spark, path, "_b.csv", schema).isEmpty()


def test_settled_batches_are_the_same_and_clean_each_run_once(spark):
    """With done stages, one run of which is through all; tables that others go on from are settled once, and
    their tasks have a bounded number of rows."""
    s, p, r = (f(spark, SF) for f in (bind.samples, bind.stimuli, bind.reports))
    seen = []

    def settle(df):
        seen.append(reference._settled(df, 100))
        return seen[-1]

    done = spark.createDataFrame([(12, 1, "percepts"), (12, 3, "events"), *[(14, 1, k) for k in ("preprocessed", "percepts", "scores", "events")]], KEY + "stage string")
    make = lambda **k: B.run_batch(s, p, r, [12, 14], evaluate=True, events=True, cleaning={"threshold": 2.0, "coalesce_us": 9_000, "blink_padding": 1, "share": 1.0}, isolate=True, done=done, **k)
    got, want = make(settle=settle), make()
    assert list(got) == list(want) and len(seen) == 3
    rows = lambda df: sorted(repr([round(v, 9) if isinstance(v, float) else v for v in x]) for x in df.select(sorted(df.columns)).collect())
    for stage in ("preprocessed", "percepts", "scores", "events", "errors"):
        assert rows(got[stage]) == rows(want[stage]), stage
    runs = {(x["subject"], x["run"]) for x in seen[0].select("subject", "run").distinct().collect()}
    assert (12, 1) in runs and (14, 1) not in runs
    assert seen[0].rdd.getNumPartitions() == -(-seen[0].count() // 100) > 1
