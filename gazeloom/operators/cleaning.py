"""Cleaning of sample tables: event flags, masks, outliers, interpolation, centring, trials.

Scalars of a run or trial are taken over windows of the partitioning that the steps before left, so
a chain of steps shuffles its samples once and reads them once.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import RUN, TRIAL, last_known, run_order, running


def detect_blinks(df: DataFrame, threshold: float) -> DataFrame:
    """blink = 1 where the diameter is at or under the threshold."""
    return df.withColumn("blink", F.when(F.col("diameter") <= threshold, 1).otherwise(F.col("blink")))


def coalesce_events(df: DataFrame, column: str = "blink", threshold_us: int = 500_000) -> DataFrame:
    """Fill between two event samples of a run less than the threshold apart."""
    event = F.when(F.col(column) == 1, F.col("run_us"))
    gap = last_known(event, run_order(descending=True)) - last_known(event, run_order())
    return df.withColumn(column, F.when((F.col(column) == 1) | (gap < threshold_us), 1).otherwise(F.col(column)))


def pad_events(df: DataFrame, column: str, samples: int) -> DataFrame:
    """Set the flag on so many samples on either side of each event of a run."""
    w = run_order()
    upto = running(F.when(F.col(column) == 1, 1).otherwise(0), w)
    whole = F.sum(F.when(F.col(column) == 1, 1).otherwise(0)).over(Window.partitionBy(*RUN))
    out = df.withColumns({"_upto": upto, "_all": whole})
    near = F.coalesce(F.lead("_upto", samples).over(w), F.col("_all")) - F.coalesce(F.lag("_upto", samples + 1).over(w), F.lit(0))
    return out.withColumn(column, (near > 0).cast("int")).drop("_upto", "_all")


def mask(df: DataFrame, flags: tuple[str, ...], columns: tuple[str, ...] = ("x", "y", "diameter")) -> DataFrame:
    """Values under a flag become missing."""
    flagged = F.lit(False)
    for flag in flags:
        flagged = flagged | (F.col(flag) == 1)
    return df.withColumns({c: F.when(~flagged, F.col(c)) for c in columns})


def parameters_as_of(df: DataFrame, stimuli: DataFrame) -> DataFrame:
    """The run's stimulus parameters: the latest of the subject up to the run. Runs without any
    are left out; see runs_without_parameters. One row a run is looked up, not one a sample."""
    runs = df.select(*RUN).distinct()
    s = stimuli.withColumnRenamed("run", "_of")
    found = runs.join(s, "subject").filter(F.col("_of") <= F.col("run"))
    fields = [c for c in stimuli.columns if c not in RUN]
    best = found.groupBy(*RUN).agg(F.max_by(F.struct("_of", *fields), "_of").alias("_p"))
    return best.select(*RUN, F.col("_p._of").alias("parameters_run"), *[F.col(f"_p.{c}").alias(c) for c in fields])


def runs_without_parameters(df: DataFrame, stimuli: DataFrame) -> DataFrame:
    return df.select(*RUN).distinct().join(parameters_as_of(df, stimuli).select(*RUN), list(RUN), "left_anti")


def remove_off_screen(df: DataFrame, parameters: DataFrame, width: float = 1920, height: float = 1080) -> DataFrame:
    """x and y beyond the screen become missing, each for itself. parameters: (subject, run,
    x_offset, y_offset)."""
    out = df.join(parameters.select(*RUN, "x_offset", "y_offset"), list(RUN), "left")
    x, y, dx, dy = F.col("x"), F.col("y"), F.col("x_offset"), F.col("y_offset")
    return out.withColumns({"x": F.when((x >= -dx) & (x <= width - dx), x), "y": F.when((y >= -dy) & (y <= height - dy), y)}).drop("x_offset", "y_offset")


def remove_diameter_outliers(df: DataFrame, deviations: float = 3.0) -> DataFrame:
    """Diameters beyond the run's median by so many population deviations become missing."""
    d, run = F.col("diameter"), Window.partitionBy(*RUN)
    out = df.withColumns({"_m": F.median("diameter").over(run), "_s": F.stddev_pop("diameter").over(run)})
    return out.withColumn("diameter", F.when(F.abs(d - F.col("_m")) <= deviations * F.col("_s"), d)).drop("_m", "_s")


def interpolate(df: DataFrame, columns: tuple[str, ...] = ("x", "y", "diameter")) -> DataFrame:
    """Missing values on the line between the known neighbours by row, the nearest one's value at
    a run's ends."""
    up, down = run_order(), run_order(descending=True)
    out = df.withColumn("_i", F.row_number().over(up))
    filled = {}
    for c in columns:
        known = F.when(F.col(c).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(c).alias("v")))
        out = out.withColumns({f"_b_{c}": last_known(known, up), f"_a_{c}": last_known(known, down)})
        b, a = F.col(f"_b_{c}"), F.col(f"_a_{c}")
        line = b["v"] + (a["v"] - b["v"]) * (F.col("_i") - b["i"]) / (a["i"] - b["i"])
        filled[c] = F.coalesce(F.col(c), line, b["v"], a["v"])
    return out.withColumns(filled).drop("_i", *[f"_{s}_{c}" for s in "ab" for c in columns])


def _sections(order: int, cutoff: float, rate: float) -> list[tuple[float, float, float]]:
    """(b0, a1, a2) of the second-order sections of a Butterworth low pass of even order; the
    numerator is b0 * (1, 2, 1)."""
    if order < 2 or order % 2:
        raise ValueError("the order must be even")
    w, out = math.tan(math.pi * cutoff / rate), []
    for k in range(order // 2):
        q = 1 / (2 * math.cos(math.pi * (2 * k + 1) / (2 * order)))
        norm = 1 / (1 + w / q + w * w)
        out.append((w * w * norm, 2 * (w * w - 1) * norm, (1 - w / q + w * w) * norm))
    return out


def _section(u, b0: float, a1: float, a2: float, block: int = 128):
    """One section over a series, from the state that a constant first value would have left. The
    recursion is linear in input and state, so blocks are matrix products: what a block's own
    inputs give, and what its first state gives; only states are carried from block to block."""
    import numpy as np

    a = np.array([[-a1, 1.0], [-a2, 0.0]])  # transposed direct form: y = b0 u + s1
    b = np.array([2 * b0 - a1 * b0, b0 - a2 * b0])
    powers = [np.eye(2)]
    for _ in range(block):
        powers.append(a @ powers[-1])
    free = np.stack([p[0] for p in powers[:block]])  # output of a state, place by place
    answer = np.concatenate([[b0], free[:-1] @ b])  # output of a single input
    lag = np.arange(block)[:, None] - np.arange(block)[None, :]
    own = np.where(lag >= 0, answer[np.maximum(lag, 0)], 0.0)
    left = np.stack([powers[block - 1 - j] @ b for j in range(block)], axis=1)  # state after the block
    n = len(u)
    blocks = np.pad(u, (0, -n % block)).reshape(-1, block)
    ends, states = blocks @ left.T, np.empty((len(blocks), 2))
    s = np.array([(1 - b0) * u[0], (b0 - a2) * u[0]])
    for i, end in enumerate(ends):
        states[i] = s
        s = powers[block] @ s + end
    return (blocks @ own.T + states @ free.T).ravel()[:n]


def _zero_phase(v, sections: list[tuple[float, float, float]], edge: int):
    """Forward and backward over the series, whose ends are continued by reflection through their
    end points (odd), over `edge` places or as many as there are."""
    import numpy as np

    k = min(edge, len(v) - 1)
    out = np.concatenate([2 * v[0] - v[k:0:-1], v, 2 * v[-1] - v[-2 : -k - 2 : -1]])
    for _ in range(2):
        for s in sections:
            out = _section(out, *s)
        out = out[::-1]
    return out[k : k + len(v)]


def low_pass(df: DataFrame, order: int = 4, cutoff: float = 30.0, rate: float = 250.0, apply: bool = False) -> DataFrame:
    """The zero-phase low-pass filter on x and y. By default the frame comes back as it is, which
    is what users of this step have always been given; apply=True filters each run forward and
    backward with cascaded second-order sections, with edges continued over 3 * (order + 1) places.
    Missing values stay missing, and each unbroken stretch of known ones is filtered for itself; one
    recording is in memory at a time."""
    if not apply:
        return df
    sections = _sections(order, cutoff, rate)

    def smooth(group):
        import numpy as np

        group = group.sort_values("run_us", kind="stable")
        for c in ("x", "y"):
            v = group[c].to_numpy(float).copy()
            known = np.flatnonzero(np.isfinite(v))
            for part in np.split(known, np.flatnonzero(np.diff(known) > 1) + 1):
                if len(part):
                    v[part] = _zero_phase(v[part], sections, 3 * (order + 1))
            group[c] = v
        return group

    return df.groupBy(*RUN).applyInPandas(smooth, df.schema)


def centroid(df: DataFrame, threshold: float) -> DataFrame:
    """(subject, run, cx, cy): the mean of points, taken again over those nearer to it than the
    threshold."""
    points = df.select(*RUN, "x", "y").filter("x is not null and y is not null")
    first = points.groupBy(*RUN).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    near = points.join(first, list(RUN)).filter((F.col("x") - F.col("_mx")) ** 2 + (F.col("y") - F.col("_my")) ** 2 < threshold**2)
    return near.groupBy(*RUN).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def align_to_center(df: DataFrame, threshold: float, center: tuple[float, float] = (960.0, 540.0), uncentered: bool = True) -> DataFrame:
    """Shift x and y so that the centroid of fixation samples is the centre. Runs without one (all x
    or all y missing in fixations, say) stay as they are, or are left out if not `uncentered`."""
    x, y, run = F.col("x"), F.col("y"), Window.partitionBy(*RUN)
    used = (F.col("fixation") == 1) & x.isNotNull() & y.isNotNull()
    out = df.withColumns({"_mx": F.avg(F.when(used, x)).over(run), "_my": F.avg(F.when(used, y)).over(run)})
    near = used & ((x - F.col("_mx")) ** 2 + (y - F.col("_my")) ** 2 < threshold**2)
    out = out.withColumns({"_cx": F.avg(F.when(near, x)).over(run), "_cy": F.avg(F.when(near, y)).over(run)})
    out = out if uncentered else out.filter("_cx is not null")
    shift = lambda v, to, at: v + F.coalesce(F.lit(to) - F.col(at), F.lit(0.0))
    return out.withColumns({"x": shift(x, center[0], "_cx"), "y": shift(y, center[1], "_cy")}).drop("_mx", "_my", "_cx", "_cy")


def alignment_threshold(fixation_distance: float = 56.0) -> float:
    """Twice the diagonal of the square of fixation points."""
    return 2 * (2 * fixation_distance**2) ** 0.5


def exclude_trials(df: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Without the trials whose share of blinks is above the threshold; samples outside trials
    stay."""
    share = F.avg((F.col("blink") == 1).cast("double")).over(Window.partitionBy(*TRIAL))
    return df.withColumn("_share", share).filter(F.col("trial").isNull() | (F.col("_share") <= threshold)).drop("_share")


def missing_data(df: DataFrame, columns: tuple[str, ...] = ("x", "y"), threshold: float = 0.3) -> DataFrame:
    """(subject, run, missing, ok): share of missing values in the columns together, and whether
    it is within the threshold."""
    share = sum((F.col(c).isNull().cast("double") for c in columns[1:]), F.col(columns[0]).isNull().cast("double")) / len(columns)
    return df.groupBy(*RUN).agg(F.avg(share).alias("missing")).withColumn("ok", F.col("missing") <= threshold)


def extract_trials(df: DataFrame) -> DataFrame:
    """Times from the run's first remaining sample (run_us) and from the trial's first sample with
    a fixation point (trial_us), in the rows that have one."""
    out = df.withColumn("run_us", F.col("run_us") - F.min("run_us").over(Window.partitionBy(*RUN))).filter("fixpoint1 is not null")
    return out.withColumn("trial_us", F.col("run_us") - F.min("run_us").over(Window.partitionBy(*TRIAL)))


def clean(df: DataFrame, stimuli: DataFrame, threshold: float = 10.0, coalesce_us: int = 40_000, blink_padding: int = 2, saccade_padding: int = 1, share: float = 0.3, uncentered: bool = True) -> DataFrame:
    """All cleaning steps in their order, one lazy plan. uncentered: see align_to_center."""
    out = coalesce_events(detect_blinks(df, threshold), "blink", coalesce_us)
    out = pad_events(pad_events(out, "blink", blink_padding), "saccade", saccade_padding)
    out = remove_off_screen(mask(out, ("blink", "saccade")), parameters_as_of(df, stimuli))
    out = low_pass(interpolate(remove_diameter_outliers(out)))
    out = align_to_center(out, alignment_threshold(), uncentered=uncentered)
    return extract_trials(exclude_trials(out, share))
