"""Event tables: offsets, epochs, merging, events from reports and from labels.

Onsets and durations are seconds, rounded to a tenth where the function says so.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import ROUND_HALF_EVEN, Decimal
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import rounded
from ..functions.windows import RUN, TRIAL, changed, last_known, running, so_far, trial_order
from .percepts import label_transitions


def seconds(us: Column) -> Column:
    return us / 1e6


def trial_offsets(df: DataFrame, dummies: int = 5, tr: float = 1.75, trial_s: float = 120.0, between: float = 20.0, by: str = "rank") -> DataFrame:
    """(subject, run, trial, offset): when each trial starts, by its rank among the run's trials
    that are there, or by its number."""
    trials = df.select(*TRIAL).filter("trial is not null").distinct()
    place = F.dense_rank().over(Window.partitionBy(*RUN).orderBy("trial")) if by == "rank" else F.col("trial")
    return trials.withColumn("offset", F.lit(dummies * tr + between) + F.lit(between + trial_s) * (place - 1))


def suppress_jump_induced(df: DataFrame, column: str = "percept", jump_us: int = 200_000, window_ms: float = 400.0, rate: float = 250.0) -> DataFrame:
    """suppressed: from a jump-induced transition up to the next spontaneous one (or the trial's
    end) the label before it. Works on the smoothed labels for `percept`, else on the column."""
    out = label_transitions(df, column, jump_us, window_ms, rate)
    work = "smoothed" if column == "percept" else column
    w = trial_order()
    kind = F.col("transition_type")
    out = out.withColumn("_chain", F.count_if(kind == "spontaneous").over(so_far(w)))
    before = F.when(kind == "jump_induced", F.struct(F.coalesce(F.lag(work).over(w), F.col(work)).alias("v")))
    out = out.withColumn("_before", before)
    first = F.first("_before", ignorenulls=True).over(so_far(Window.partitionBy(*TRIAL, "_chain").orderBy("trial_us")))
    out = out.withColumn("_first", first)
    return out.withColumn("suppressed", F.when(F.col("_first").isNotNull(), F.col("_first.v")).otherwise(F.col(work))).drop("_chain", "_before", "_first")


def _epochs(df: DataFrame, column: str) -> DataFrame:
    """A row for each stretch of equal labels of a trial (each missing label is its own): start,
    the next one's start (the last sample for the trial's last), label, trial type."""
    w = trial_order()
    own = F.when(F.col(column).isNull() | (changed(column, w) == 1), 1).otherwise(0)
    rows = df.withColumn("_new", own).withColumn("_e", running("_new", w))
    kinds = rows.groupBy(*TRIAL).agg(F.coalesce(F.lower(F.min(F.when(F.col("type").isNotNull(), F.struct("trial_us", "type")))["type"]), F.lit("rivalry")).alias("kind"), F.max("trial_us").alias("_last"))
    out = rows.groupBy(*TRIAL, "_e").agg(F.min("trial_us").alias("start_us"), F.first(column).alias("label"))
    out = out.join(kinds, list(TRIAL))
    after = F.lead("start_us").over(Window.partitionBy(*TRIAL).orderBy("start_us"))
    return out.withColumn("end_us", F.coalesce(after, F.col("_last"))).drop("_e", "_last")


def collapse_to_epochs(df: DataFrame, column: str, offsets: DataFrame, prefix: str) -> DataFrame:
    """(subject, run, trial, onset, duration, trial_type) of the trials' epochs, to a tenth."""
    out = _epochs(df, column).join(offsets, list(TRIAL), "left")
    onset = rounded(F.coalesce("offset", F.lit(0.0)) + seconds(F.col("start_us")))
    return out.select(*TRIAL, onset.alias("onset"), rounded(seconds(F.col("end_us") - F.col("start_us"))).alias("duration"), F.concat_ws("_", F.lit(prefix), "kind", F.coalesce("label", F.lit("nan"))).alias("trial_type"))


def _tenth(value: float) -> float:
    return float(Decimal(repr(value)).quantize(Decimal("0.1"), ROUND_HALF_EVEN))


def _merged(rows: Iterable[tuple], least: float, tolerance: float) -> Iterator[tuple]:
    """The rule of merge_short_epochs over rows (keys, onset, duration, trial_type) that lie run by
    run in order of onset. Only the last finished epoch and a short one waiting for its successor
    are held; a missing onset or duration touches nothing and is not short."""
    run, last, held = None, None, None
    touch = lambda a, b: None not in (a[1], a[2], b[1]) and abs(a[1] + a[2] - b[1]) <= tolerance
    for row in rows:
        if row[0] != run:
            yield from (e for e in (last, held) if e)
            run, last, held = row[0], None, None
        if held and touch(held, row):
            row = (run, held[1], None if row[2] is None else _tenth(row[2] + held[2]), row[3])
        elif held:
            if last:
                yield last
            last = held
        held = None
        if row[2] is None or row[2] >= least:
            if last:
                yield last
            last = row
        elif last and touch(last, row):
            last = (run, last[1], _tenth(last[2] + row[2]), last[3])
        else:
            held = row
    yield from (e for e in (last, held) if e)


def merge_short_epochs(events: DataFrame, least: float = 1.75, tolerance: float = 0.15) -> DataFrame:
    """Epochs shorter than `least` go into the epoch before if that ends where they start, else into
    the one after if that starts where they end; others stay. Each merge moves an end that the next
    one is compared with, so the rule is sequential in a run: one pass over the sorted epochs that
    holds two of them, however long a run is."""

    def fold(batches):
        def rows():
            for batch in batches:
                at = batch.to_pydict()
                yield from zip(zip(at["subject"], at["run"]), at["onset"], at["duration"], at["trial_type"])

        merged = _merged(rows(), least, tolerance)
        while some := list(islice(merged, 10_000)):
            keys, onset, duration, kind = zip(*some)
            subject, run = zip(*keys)
            yield pa.RecordBatch.from_pydict({"subject": subject, "run": run, "onset": onset, "duration": duration, "trial_type": kind}, schema=schema)

    columns = (*RUN, "onset", "duration", "trial_type")
    slim = events.select(*[F.col(c).cast("long") for c in RUN], F.col("onset").cast("double"), F.col("duration").cast("double"), "trial_type")
    schema = pa.schema([("subject", pa.int64()), ("run", pa.int64()), ("onset", pa.float64()), ("duration", pa.float64()), ("trial_type", pa.string())])
    ordered = slim.repartition(*RUN).sortWithinPartitions(*columns)
    return ordered.mapInArrow(fold, "subject long, run long, onset double, duration double, trial_type string")


def events_from_reports(reports: DataFrame, offsets: DataFrame, labeled: DataFrame | None = None, jump_us: int = 200_000) -> DataFrame:
    """One event for each reported epoch. With labeled samples: epochs that begin within the window
    of a section start of their trial are dropped, and their durations go to the kept epoch before
    them in the run."""
    rows = reports.join(offsets, list(TRIAL), "left").withColumn("offset", F.coalesce("offset", F.lit(0.0)))
    rows = rows.select(*TRIAL, "onset_us", rounded(F.col("offset") + seconds(F.col("onset_us"))).alias("onset"), seconds(F.col("duration_us")).alias("duration"), F.concat_ws("_", F.lit("report"), F.lower("type"), "percept").alias("trial_type"))
    if labeled is None:
        return rows.withColumn("duration", rounded(F.col("duration"))).drop("onset_us", "trial")
    jumps = labeled.withColumn("_j", F.lag("section").over(trial_order()) != F.col("section")).filter("_j").select(*TRIAL, F.col("trial_us").alias("_jump"))
    # Epochs and jumps in one order of time: the nearest jump on either side is carried on (jumps,
    # which have no _epoch, come first among equals).
    both = rows.withColumn("_epoch", F.lit(True)).unionByName(jumps.withColumn("onset_us", F.col("_jump")), allowMissingColumns=True)
    order = Window.partitionBy(*TRIAL)
    sides = {"_b": last_known("_jump", order.orderBy("onset_us", "_epoch")), "_a": last_known("_jump", order.orderBy(F.desc("onset_us"), "_epoch"))}
    near = F.coalesce(F.col("onset_us") - F.col("_b") <= jump_us, F.lit(False)) | F.coalesce(F.col("_a") - F.col("onset_us") <= jump_us, F.lit(False))
    rows = both.withColumns(sides).filter("_epoch").withColumn("_near", F.when(near, F.lit(True))).drop("_epoch", "_jump", "_a", "_b")
    w = Window.partitionBy(*RUN).orderBy("trial", "onset_us")
    rows = rows.withColumn("_kept", F.count_if(F.col("_near").isNull()).over(so_far(w))).filter("_kept > 0")
    first = lambda c: F.max(F.when(F.col("_near").isNull(), F.col(c))).alias(c)
    return rows.groupBy(*RUN, "_kept").agg(first("onset"), rounded(F.sum("duration")).alias("duration"), first("trial_type")).drop("_kept")


def events_from_labels(df: DataFrame, offsets: DataFrame, exclude: bool = False, jump_us: int = 200_000, window_ms: float = 400.0, rate: float = 250.0) -> DataFrame:
    """Epochs of the section labels if they are there, else of the sample labels."""
    base = "aggregated" if "aggregated" in df.columns else "percept"
    if exclude:
        df, base = suppress_jump_induced(df, base, jump_us, window_ms, rate), "suppressed"
    return collapse_to_epochs(df, base, offsets, "no_report")


def with_switches(events: DataFrame) -> DataFrame:
    """Events, and a copy of each with duration 0 (`switch`)."""
    return events.withColumn("switch", F.lit(False)).unionByName(events.withColumns({"duration": F.lit(0.0), "switch": F.lit(True)}))


def changepoints(df: DataFrame, column: str = "percept") -> DataFrame:
    """Unrounded epochs of known labels: trial, type, left image, label, onset, duration (to the
    trial's next epoch, the last one's to the last sample)."""
    rows = df.filter(F.col(column).isNotNull())
    left = rows.groupBy(*TRIAL).agg(F.min_by("image1", "trial_us").alias("left_image"))
    out = _epochs(rows, column).join(left, list(TRIAL))
    return out.select(*TRIAL, F.col("kind").alias("type"), "left_image", F.col("label").alias("percept"), seconds(F.col("start_us")).alias("onset"), seconds(F.col("end_us") - F.col("start_us")).alias("duration"))


def bands(df: DataFrame, column: str) -> DataFrame:
    """Label bands of timelines: (subject, run, trial, label, start_us, end_us)."""
    return _epochs(df, column).filter("label is not null").select(*TRIAL, "label", "start_us", "end_us")


def coverage(df: DataFrame, flag: str) -> DataFrame:
    """Stretches of a run where the flag is set: (subject, run, start_us, end_us, n), the last
    sample's time as their end."""
    w = Window.partitionBy(*RUN).orderBy("run_us")
    rows = df.withColumn("_new", changed(flag, w)).withColumn("_e", running("_new", w)).filter(F.col(flag) == 1)
    return rows.groupBy(*RUN, "_e").agg(F.min("run_us").alias("start_us"), F.max("run_us").alias("end_us"), F.count("*").alias("n")).drop("_e")
