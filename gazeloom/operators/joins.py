"""Joins of samples with sidecars and reported epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import RUN, TRIAL, last_known, trial_order


def with_sidecar(samples: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Samples with the sidecar's further columns, by run, trial and time in the trial."""
    keys = [*TRIAL, "trial_us"]
    extra = [c for c in sidecar.columns if c not in samples.columns]
    return samples.join(sidecar.select(*keys, *extra), keys, "left")


def report_as_of(samples: DataFrame, reports: DataFrame, name: str = "reported") -> DataFrame:
    """The percept of the latest reported epoch of the trial that began at or before the sample;
    missing at and after the epoch's end, and in trials without epochs. Samples and epochs are
    laid in one order and the last epoch is carried on, so no pair of them is joined."""
    columns = samples.columns
    epoch = F.struct("onset_us", "duration_us", "percept").alias("_epoch")
    marks = reports.select(*TRIAL, F.col("onset_us").alias("trial_us"), epoch)
    both = samples.select(*columns, F.lit(None).cast(marks.schema["_epoch"].dataType).alias("_epoch"), F.lit(1).alias("_kind"))
    both = both.unionByName(marks.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    w = trial_order().orderBy("trial_us", "_kind")
    out = both.withColumn("_last", last_known("_epoch", w)).filter("_kind = 1")
    inside = F.col("trial_us") < F.col("_last.onset_us") + F.col("_last.duration_us")
    return out.select(*columns, F.when(inside, F.col("_last.percept")).alias(name))


def quality_with_scores(quality: DataFrame, scores: DataFrame, score: str = "accuracy_2") -> DataFrame:
    """Quality and evaluation rows of the same run, without those that have no score."""
    return quality.join(scores.filter(F.col(score).isNotNull()), list(RUN))
