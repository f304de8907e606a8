"""Quality control: per trial, per run, anomalies, reports and the data behind plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import band
from ..functions.windows import RUN, TRIAL, run_order
from ..sources.tracker import run_stem
from .percepts import transition_summary


def _measures() -> list:
    share = lambda c: (F.avg((F.col(c) == 1).cast("double")) * 100).alias(f"{c}_pct")
    return [
        share("blink"), share("saccade"), share("fixation"), F.stddev("x").alias("std_x"), F.stddev("y").alias("std_y"), F.avg("dc").alias("mean_center"),
        F.median("diameter").alias("median_diameter"), F.try_divide(F.stddev("diameter"), F.avg("diameter")).alias("diameter_cv"),
    ]


def trial_quality(df: DataFrame) -> DataFrame:
    """One row a trial: samples, duration, shares of flags in percent, dispersion, distance from
    the centre and diameter."""
    return df.groupBy(*TRIAL).agg(F.count("*").alias("n_samples"), ((F.max_by("trial_us", "run_us") - F.min_by("trial_us", "run_us")) / 1e6).alias("duration_s"), *_measures())


def run_quality(df: DataFrame) -> DataFrame:
    """One row a run, with its trials. The duration is the last trial-relative time less the
    first."""
    return df.groupBy(*RUN).agg(F.count("*").alias("n_samples"), F.countDistinct("trial").alias("n_trials"), ((F.max_by("trial_us", "run_us") - F.min_by("trial_us", "run_us")) / 1e6).alias("duration_s"), *_measures())


def calibration(df: DataFrame) -> DataFrame:
    """On fixation samples, the distance to the nearer point: mean, median, and shares within one
    and two degrees (missing distances count as not)."""
    near = F.least("d1", "d2")
    within = lambda k: (F.avg(F.coalesce(near <= k, F.lit(False)).cast("double")) * 100)
    return df.filter("fixation = 1").groupBy(*RUN).agg(F.avg(near).alias("mean_distance"), F.median(near).alias("median_distance"), within(1).alias("within_1"), within(2).alias("within_2"))


def _summary(share: float, spike_limit: int = 100, outlier_limit: int = 50) -> Column:
    n, spikes, odd = F.size("high_blink_trials"), F.col("velocity_spikes"), F.col("diameter_outliers")
    told = lambda c, what: F.concat(c.cast("string"), F.lit(what))
    text = F.concat_ws("; ", F.when(n > 0, told(n, f" trials with >{share * 100:.0f}% blinks")), F.when(spikes > spike_limit, told(spikes, " velocity spikes")), F.when(odd > outlier_limit, told(odd, " diameter outliers")))
    return F.when(text == "", "No major anomalies").otherwise(text)


def anomalies(df: DataFrame, share: float = 0.3, step: float = 100.0, deviations: float = 4.0) -> DataFrame:
    """One row a run: trials with many blinks, steps longer than `step` between samples of the run,
    diameters beyond the median by so many sample deviations, and a summary."""
    w = run_order()
    moved = df.withColumn("_step", F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2))
    per = df.groupBy(*RUN).agg(F.median("diameter").alias("_m"), F.stddev("diameter").alias("_s"))
    counted = moved.join(per, list(RUN)).groupBy(*RUN).agg(F.count_if(F.col("_step") > step).alias("velocity_spikes"), F.count_if(F.abs(F.col("diameter") - F.col("_m")) > deviations * F.col("_s")).alias("diameter_outliers"))
    bad = df.filter("trial is not null").groupBy(*TRIAL).agg(F.avg((F.col("blink") == 1).cast("double")).alias("_b")).filter(F.col("_b") > share)
    bad = bad.groupBy(*RUN).agg(F.array_sort(F.collect_list("trial")).alias("high_blink_trials"))
    out = counted.join(bad, list(RUN), "left").withColumn("high_blink_trials", F.coalesce("high_blink_trials", F.array().cast("array<bigint>")))
    return out.withColumn("anomaly_summary", _summary(share))


def quality_report(df: DataFrame, suffix: str = "_preprocessed.csv", spike: float = 100.0, deviations: float = 4.0, share: float = 0.3) -> DataFrame:
    """One row a run over all subjects: type and file name (where df has run_type), quality,
    calibration and anomalies. One shuffle by run: windows give each sample its step, the run's
    diameters and its trial's share of blinks, and one aggregate makes all columns."""
    run, w, trial = Window.partitionBy(*RUN), run_order(), Window.partitionBy(*TRIAL)
    near, fix = F.least("d1", "d2"), F.col("fixation") == 1
    typed = "run_type" in df.columns
    slim = df.select(*TRIAL, "run_us", "trial_us", "x", "y", "dc", "diameter", "blink", "saccade", "fixation", near.alias("_near"), *(["run_type"] if typed else []))
    rows = slim.withColumns({
        "_step": F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2),
        "_m": F.median("diameter").over(run), "_s": F.stddev("diameter").over(run), "_b": F.avg((F.col("blink") == 1).cast("double")).over(trial),
    })
    within = lambda k: (F.avg(F.when(fix, F.coalesce(F.col("_near") <= k, F.lit(False)).cast("double"))) * 100)
    fixed = F.when(fix, F.col("_near"))
    out = rows.groupBy(*RUN).agg(
        *([F.min("run_type").alias("run_type")] if typed else []),
        F.count("*").alias("n_samples"), F.size(F.collect_set("trial")).cast("long").alias("n_trials"), ((F.max_by("trial_us", "run_us") - F.min_by("trial_us", "run_us")) / 1e6).alias("duration_s"), *_measures(),
        F.avg(fixed).alias("mean_distance"), F.median(fixed).alias("median_distance"), within(1).alias("within_1"), within(2).alias("within_2"),
        F.count_if(F.col("_step") > spike).alias("velocity_spikes"), F.count_if(F.abs(F.col("diameter") - F.col("_m")) > deviations * F.col("_s")).alias("diameter_outliers"),
        F.array_sort(F.collect_set(F.when(F.col("_b") > share, F.col("trial")))).alias("high_blink_trials"),
    )
    out = out.withColumn("anomaly_summary", _summary(share))
    return out.withColumn("filename", F.concat(run_stem(), F.lit(suffix))) if typed else out


def quality_flags(report: DataFrame) -> DataFrame:
    """Per subject: runs, means to a tenth, and how many runs have too many blinks or too little
    calibration."""
    mean = lambda c: F.round(F.avg(c), 1).alias(f"mean_{c}")
    return report.groupBy("subject").agg(F.count("*").alias("n_runs"), mean("blink_pct"), mean("within_1"), F.count_if(F.col("blink_pct") > 15).alias("high_blink"), F.count_if(F.col("within_1") < 30).alias("low_calibration"))


def quality_bands(report: DataFrame) -> DataFrame:
    b, c = F.col("blink_pct"), F.col("within_1")
    return report.select(*RUN, band(b, b > 15, b > 8).alias("blink_band"), band(c, c < 30, c < 50).alias("calibration_band"))


def normalized(report: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The columns scaled to 0..1 over all runs (constant ones to 0), with a run label. The extremes
    are one row."""
    ends = report.agg(*[f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max))])
    out = report.join(F.broadcast(ends))
    scaled = [F.when(F.col(f"_hi_{c}") > F.col(f"_lo_{c}"), (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))).otherwise(F.when(F.col(c).isNotNull(), 0.0)).alias(c) for c in columns]
    return out.select(F.concat(F.lit("s"), F.col("subject").cast("string"), F.lit("r"), F.lpad(F.col("run").cast("string"), 2, "0")).alias("label"), *scaled)


def correlation(joined: DataFrame, a: str, b: str) -> DataFrame:
    """(n, r): Pearson's r of two columns over rows with both, if there are more than three."""
    rows = joined.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return rows.agg(F.count("*").alias("n"), F.corr(a, b).alias("_r")).select("n", F.when(F.col("n") > 3, F.col("_r")).alias("r"))


def transition_bins(df: DataFrame, column: str = "percept", bin_us: int = 100_000) -> DataFrame:
    """(subject, run, trial, bin, label): the commonest label of each half-open time bin; ties to
    face, mixed, house in this order."""
    rank = F.when(F.col(column) == "face", 0).when(F.col(column) == "mixed", 1).otherwise(2)
    counts = df.filter(F.col(column).isNotNull()).groupBy(*TRIAL, F.floor(F.col("trial_us") / bin_us).alias("bin"), F.col(column).alias("label"), rank.alias("_k")).agg(F.count("*").alias("_n"))
    return counts.groupBy(*TRIAL, "bin").agg(F.min_by("label", F.struct(-F.col("_n"), "_k")).alias("label"))


def transition_runs(df: DataFrame) -> DataFrame:
    """One row a run: its type, trials, transitions by kind and the share of induced ones. df carries
    transitions."""
    more = df.groupBy(*RUN).agg(F.first("run_type").alias("run_type"), F.countDistinct("trial").alias("n_trials"))
    return transition_summary(df, by_trial=False).join(more, list(RUN))


def transition_subjects(df: DataFrame) -> DataFrame:
    """One row a subject and run type: runs, and means over them of transitions and shares."""
    means = [F.avg(c).alias(f"mean_{c}") for c in ("n_transitions", "n_jump", "n_spontaneous", "pct_jump")]
    return transition_runs(df).groupBy("subject", "run_type").agg(F.count("*").alias("n_runs"), *means)


def transition_report(df: DataFrame) -> DataFrame:
    """Per run type over all runs: runs, transitions, induced ones in percent, medians of the runs'
    shares, transitions a trial. df carries transitions."""
    runs = transition_runs(df)
    return runs.groupBy("run_type").agg(F.count("*").alias("n_runs"), F.sum("n_transitions").alias("n_transitions"), (F.try_divide(F.sum("n_jump") * 100.0, F.sum("n_transitions"))).alias("pct_jump"), F.median("pct_jump").alias("median_pct_jump"), F.try_divide(F.sum("n_transitions"), F.sum("n_trials")).alias("per_trial"))


def gaze_density(df: DataFrame, size: float = 50.0) -> DataFrame:
    """(subject, run, bin_x, bin_y, n): samples in each square of the screen."""
    rows = df.filter("x is not null and y is not null")
    return rows.groupBy(*RUN, F.floor(F.col("x") / size).alias("bin_x"), F.floor(F.col("y") / size).alias("bin_y")).agg(F.count("*").alias("n"))


def evaluation_report(runs: DataFrame, numbers: list[int] | None = None) -> DataFrame:
    """(subject, n_runs, mean, std, min, max of accuracy; runs as columns r<run>), and a row for all
    subjects with a null subject. numbers: the runs that have columns (all there are, found by a
    job; a row a run number)."""
    if numbers is None:
        numbers = sorted(r[0] for r in runs.select("run").distinct().collect() if r[0] is not None)
    stats = lambda: [F.count("accuracy_2").alias("n_runs"), F.avg("accuracy_2").alias("mean"), F.stddev("accuracy_2").alias("std"), F.min("accuracy_2").alias("min"), F.max("accuracy_2").alias("max")]
    pivot = runs.groupBy("subject").pivot("run", numbers).agg(F.first("accuracy_2"))
    pivot = pivot.select("subject", *[F.col(str(k)).alias(f"r{k}") for k in numbers])
    per = runs.groupBy("subject").agg(*stats()).join(pivot, "subject")
    every = runs.agg(*stats()).select(F.lit(None).cast("long").alias("subject"), "n_runs", "mean", "std", "min", "max")
    return per.unionByName(every, allowMissingColumns=True)


def metric_report(runs: DataFrame, metrics: tuple[str, ...] = ("accuracy_2", "f1_macro_2", "mcc_2", "accuracy_3", "f1_macro_3", "mcc_3")) -> DataFrame:
    """(subject, metric, n_runs, n_subjects, mean, std, min, max) of the runs' scores without (_2) and
    with (_3) `mixed`, by subject and, with a null subject, over all; runs whose accuracy_2 is missing
    don't count. One pass: runs in long form, grouped by both sets."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics]))
    rows = runs.filter("accuracy_2 is not null").select("subject", each.alias("_e")).select("subject", F.col("_e.metric").alias("metric"), F.col("_e.v").alias("v"), F.col("subject").alias("_who"))
    s, m = F.col("subject"), F.col("metric")
    return rows.groupingSets([[s, m], [m]], s, m).agg(
        F.count("v").alias("n_runs"), F.countDistinct(F.when(F.col("v").isNotNull(), F.col("_who"))).alias("n_subjects"),
        F.avg("v").alias("mean"), F.stddev("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"),
    ).select("subject", "metric", "n_runs", "n_subjects", "mean", "std", "min", "max")
