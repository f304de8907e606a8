"""Preprocessed runs, reports, sidecars and results in files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..functions.windows import RUN
from .files import read_lines, write_csv_files, write_json_files, write_lines
from .tracker import run_info, run_stem

#: Folders of runs hold so many subjects, and are named by the first one they have room for.
FOLDER, TOGETHER = "subjects_from", 50
SIDECAR = ("trial_us", "trial", "type", "percept", "percept3", "section", "aggregated", "reported")
#: Names of report files: subject, run, and a suffix by which the latest is found.
REPORT_NAME = r"sub-(\d+)_run(\d+)_report_perceptData_[^/]*\.csv$"
REPORT_SCHEMA = "trial long, type string, percept string, onset_us long, duration_us long"


def missing_columns(df: DataFrame, required: tuple[str, ...]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require(df: DataFrame, required: tuple[str, ...]) -> DataFrame:
    if gone := missing_columns(df, required):
        raise ValueError(f"missing columns: {', '.join(gone)}")
    return df


def write_runs(df: DataFrame, path: str, fmt: str = "parquet", together: int = TOGETHER) -> None:
    """Sample tables in folders of `together` subjects and, if there, run_type, so that a reader of some
    runs opens only their folders, a run's type is known by its path, and files grow with the samples and not with
    the number of runs. A task writes one run of each of these subjects."""
    kinds = [c for c in df.columns if c == "run_type"]
    folder = F.floor(F.col("subject") / together).cast("long")
    # Reading goes by these keys as the last columns of a file, whatever their place was here.
    rows = df.select(*[c for c in df.columns if c not in (*RUN, *kinds)], *RUN, *kinds, (folder * together).alias(FOLDER))
    rows = rows.repartition(FOLDER, "run").sortWithinPartitions(FOLDER, *kinds, *RUN)
    writer = rows.write.partitionBy(FOLDER, *kinds).mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def read_runs(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", subjects: list[int] | None = None, required: tuple[str, ...] = (), together: int = TOGETHER) -> DataFrame:
    """Runs written by write_runs (or in a folder a run), with run_type as the folders tell it (missing
    where they don't; name it in the schema where they do); only the given subjects' folders are read."""
    given = StructType.fromDDL(schema).fields
    fields = sorted(given, key=lambda f: ("run_type", "run", "subject").index(f.name) if f.name in (*RUN, "run_type") else 3, reverse=True)
    df = spark.read.schema(StructType([*fields, StructField(FOLDER, LongType())])).option("header", True).format(fmt).load(path)
    if subjects is not None:
        folders = sorted({s // together * together for s in subjects})
        df = df.filter(F.col(FOLDER).isNull() | F.col(FOLDER).isin(folders)).filter(F.col("subject").isin(subjects))
    df = df.select(*[f.name for f in given]).withColumns({k: F.col(k).cast("long") for k in RUN})
    df = require(df, (*RUN, *required))
    return df if "run_type" in df.columns else df.withColumn("run_type", F.lit(None).cast("string"))


def report_files(spark: SparkSession, path: str) -> DataFrame:
    """(subject, run, path) of each run's last report file by name, from the listing alone."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*_report_perceptData_*.csv").option("recursiveFileLookup", True).load(path).select("path")
    part = lambda i: F.regexp_extract("path", REPORT_NAME, i)
    found = listed.filter(F.col("path").rlike(REPORT_NAME)).withColumns({"subject": part(1).cast("long"), "run": part(2).cast("long"), "_name": part(0)})
    return found.groupBy(*RUN).agg(F.max_by("path", "_name").alias("path"))


def read_reports(spark: SparkSession, path: str, schema: str = REPORT_SCHEMA) -> DataFrame:
    """Report files; where a run has several, the last by name. Older files are not opened: the
    choice is made on the listing, and the chosen paths (one a run, which the scan's file index
    holds anyway) are read. No files give no rows."""
    chosen = [r["path"] for r in report_files(spark, path).select("path").collect()]
    rows = spark.read.schema(schema).option("header", True).csv(chosen) if chosen else spark.createDataFrame([], schema)
    name = F.col("_metadata.file_path") if chosen else F.lit("")
    part = lambda i: F.regexp_extract(name, REPORT_NAME, i).cast("long")
    return rows.withColumns({"subject": part(1), "run": part(2)})


def latest(df: DataFrame, file: str) -> DataFrame:
    """Rows of each run's last file by name."""
    last = F.max(file).over(Window.partitionBy(*RUN))
    return df.withColumn("_last", last).filter(F.col(file) == F.col("_last")).drop("_last")


def sidecar(df: DataFrame) -> DataFrame:
    """The slim table of derived columns, those of them that are there."""
    return df.select(*RUN, *[c for c in SIDECAR if c in df.columns])


def write_csv(df: DataFrame, path: str, tabs: bool = False) -> None:
    df.write.mode("overwrite").option("header", True).option("sep", "\t" if tabs else ",").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_events(events: DataFrame, path: str) -> None:
    """Events as tab-separated onset, duration, trial_type in order of onset, a folder a run."""
    out = events.select(*RUN, "onset", "duration", "trial_type").repartition(*RUN).sortWithinPartitions(*RUN, "onset")
    out.write.mode("overwrite").partitionBy(*RUN).option("header", True).option("sep", "\t").csv(path)


def write_report_files(reports: DataFrame, path: str, suffix: str) -> None:
    """Reports as one file a run under the names that read_reports looks for; `suffix` (such as a
    time) decides between files of a run."""
    name = F.format_string(f"sub-%d/sub-%d_run%02d_report_perceptData_{suffix}.csv", "subject", "subject", "run")
    rows = reports.select(*RUN, "trial", "type", "percept", "onset_us", "duration_us")
    keyed = rows.withColumn("_name", name)
    columns = F.to_csv(F.struct("trial", "type", "percept", "onset_us", "duration_us"))
    write_lines(keyed, path, F.col("_name"), columns, ("trial", "onset_us"), "trial,type,percept,onset_us,duration_us")


def _of_run(what: str, kind: Column) -> Column:
    return F.concat(run_stem(kind), F.lit(what))


def write_evaluation(summary: DataFrame, sections: DataFrame, trials: DataFrame, path: str) -> None:
    """A run's scores as <run>_eval_summary.json, its sections as <run>_eval_by_section.csv and its
    sections by trial as <run>_eval_by_trial.csv. Evaluated runs are report runs."""
    kind = F.lit("report")
    write_json_files(summary, path, _of_run("_eval_summary.json", kind))
    write_csv_files(sections, path, _of_run("_eval_by_section.csv", kind), ("section",))
    write_csv_files(trials, path, _of_run("_eval_by_trial.csv", kind), ("trial", "section"))


def write_transitions(trials: DataFrame, path: str) -> None:
    """Transitions by trial as <run>_transition_summary.csv; trials carry their run_type."""
    write_csv_files(trials, path, _of_run("_transition_summary.csv", F.col("run_type")), ("trial",))


def read_run_files(spark: SparkSession, path: str, what: str, schema: str, tabs: bool = False) -> DataFrame:
    """Files of runs whose names end with `what`, CSV or JSON, with `run_type` as the name tells it."""
    if what.endswith(".json"):
        rows = read_lines(spark, path, what, whole=True).select("file", F.explode(F.from_json("line", ArrayType(StructType.fromDDL(schema)))).alias("_r"))
    else:
        lines = read_lines(spark, path, what, header=True).filter(F.trim("line") != "")
        rows = lines.select("file", F.from_csv("line", schema, {"sep": "\t" if tabs else ","}).alias("_r"))
    return rows.select("file", "_r.*").withColumn("run_type", run_info(F.col("file"))["run_type"]).drop("file")
