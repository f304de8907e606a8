"""Distances, labels, sections and smoothing of label series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.windows import RUN, TRIAL, changed, last_known, mirrored, moving_sums, run_order, running, trial_order
from .grid import grid_search  # noqa: F401

#: The pipelines of `pipelines` and the sample labels whose modes they take.
PIPELINES = {"baseline": "percept", "no_jumps": "percept", "smoothed": "_s", "ratio": "_r0", "ratio_smoothed": "_s2"}


def distances(df: DataFrame, parameters: DataFrame, center: tuple[float, float] = (960.0, 540.0), degrees: float | None = None) -> DataFrame:
    """d1, d2 (to the two fixation points, back-filled by the next known id; ids without a
    position give none) and dc (to the centre), in degrees. parameters: (subject, run,
    positions)."""
    deg = L.degrees_per_pixel() if degrees is None else degrees
    next_ = run_order(descending=True)
    out = df.withColumns({"_f1": last_known("fixpoint1", next_), "_f2": last_known("fixpoint2", next_)})
    out = out.join(parameters.select(*RUN, "positions"), list(RUN), "left")
    at = lambda f: F.when(F.col(f) >= 1, F.try_element_at("positions", F.greatest(F.col(f), F.lit(1))))
    out = out.withColumns({"_p1": at("_f1"), "_p2": at("_f2")})
    x, y = F.col("x"), F.col("y")
    to = lambda p: L.distance(x, y, F.col(f"{p}.x"), F.col(f"{p}.y")) * deg
    return out.withColumns({"d1": to("_p1"), "d2": to("_p2"), "dc": L.distance(x, y, F.lit(center[0]), F.lit(center[1])) * deg}).drop("_f1", "_f2", "_p1", "_p2", "positions")


def infer(df: DataFrame) -> DataFrame:
    """percept: the image of the nearer fixation point; percept3: `mixed` where the centre is."""
    d1, d2, dc, image = (F.col(c) for c in ("d1", "d2", "dc", "image1"))
    return df.withColumns({"percept": L.nearest(d1, d2, image), "percept3": L.nearest_or_mixed(d1, d2, dc, image)})


def infer_by_ratio(df: DataFrame, threshold: float = 0.1) -> DataFrame:
    return df.withColumn("percept_ratio", L.by_ratio(F.col("d1"), F.col("d2"), F.col("image1"), threshold))


def label_sections(df: DataFrame) -> DataFrame:
    """section: counts from 1 and goes up where a forward-filled fixation point changes, and on
    every row before the first known one."""
    w = run_order()
    out = df.withColumns({"_g1": last_known("fixpoint1", w), "_g2": last_known("fixpoint2", w)})
    same = (F.col("_g1") == F.lag("_g1").over(w)) & (F.col("_g2") == F.lag("_g2").over(w))
    out = out.withColumn("_step", F.when(same, 0).otherwise(1))
    return out.withColumn("section", running("_step", w)).drop("_g1", "_g2", "_step")


def mark_peri_jump(df: DataFrame, margin_us: int = 50_000, scope: str = "trial") -> DataFrame:
    """peri_jump: within the margin of a section's start. scope 'trial' looks at starts in the
    sample's trial; 'run' compares trial-relative times over all trials of the run, as earlier
    results did."""
    first = F.lag("section").over(run_order())
    out = df.withColumn("_start", F.when(first.isNotNull() & (first != F.col("section")), F.col("trial_us")))
    keys = TRIAL if scope == "trial" else RUN
    up = Window.partitionBy(*keys).orderBy("trial_us").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys).orderBy(F.desc("trial_us")).rangeBetween(Window.unboundedPreceding, 0)
    before, after = F.max("_start").over(up), F.min("_start").over(down)
    near = F.coalesce(F.col("trial_us") - before <= margin_us, F.lit(False)) | F.coalesce(after - F.col("trial_us") <= margin_us, F.lit(False))
    return out.withColumn("peri_jump", near).drop("_start")


def aggregate_sections(df: DataFrame, column: str, method: str = "mode", skip_peri_jump: bool = False, name: str = "aggregated") -> DataFrame:
    """The section's mode (ties to the smallest label), mean or median of the column on every row;
    missing where all its rows are skipped."""
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    value = F.when(~F.col("peri_jump"), F.col(column)) if skip_peri_jump else F.col(column)
    make = {"mode": lambda v: F.mode(v, True), "mean": F.avg, "median": F.median}.get(method)
    if make is None:
        raise ValueError(f"unknown method {method}")
    whole = Window.partitionBy(*RUN, "section")
    return df.withColumn("_v", value).withColumn(name, make(F.col("_v")).over(whole)).drop("_v")


def labeled(samples: DataFrame, parameters: DataFrame) -> DataFrame:
    """Samples with distances, labels, sections and the section's modal label."""
    return aggregate_sections(label_sections(infer(distances(samples, parameters))), "percept")


def smooth(df: DataFrame, column: str, size: int, method: str = "uniform", threshold: float = 0.5, delta: float = 0.05, keys: tuple[str, ...] = RUN, name: str = "smoothed") -> DataFrame:
    """The label series smoothed over a window of samples with reflected edges (mean, or upper
    median from counts of the three levels), cut by the dead band and decoded. Rows are carried along,
    so that nothing is joined back."""
    order = "run_us" if keys == RUN else "trial_us"
    row = F.struct(*[F.col(c) for c in df.columns if c != name])
    rows = mirrored(df, keys, order, L.encode(F.col(column)), size // 2 + 1, size, row)
    v = F.col("_value")
    if method == "uniform":
        out = moving_sums(rows, keys, {"sum": v}, size).withColumn("_s", F.col("sum") / size)
    elif method == "median":
        counts = moving_sums(rows, keys, {"zeros": (v == 0).cast("int"), "halves": (v == 0.5).cast("int")}, size)
        rank = F.lit(size // 2)
        out = counts.withColumn("_s", F.when(rank < F.col("zeros"), 0.0).when(rank < F.col("zeros") + F.col("halves"), 0.5).otherwise(1.0))
    else:
        raise ValueError(f"unknown method {method}")
    return out.select("_row.*", L.decode(L.dead_band(F.round("_s", 9), threshold, delta)).alias(name))


def pipelines(df: DataFrame, margin_us: int = 50_000, size: int = 150, delta: float = 0.05, scope: str = "trial") -> DataFrame:
    """The modal label of each sample's section by the five reconstruction pipelines, a column each:
    baseline (nearest point), no_jumps (without samples near section starts), smoothed (and by the
    median over `size` samples), ratio (log-ratio beyond 0), ratio_smoothed (beyond 0.2, smoothed).
    All but the baseline leave out samples near section starts."""
    out = mark_peri_jump(df, margin_us, scope)
    ratio = lambda tau: L.by_ratio(F.col("d1"), F.col("d2"), F.col("image1"), tau)
    out = out.withColumns({"_r0": ratio(0.0), "_r2": ratio(0.2)})
    out = smooth(out, "percept", size, "median", delta=delta, name="_s")
    out = smooth(out, "_r2", size, "median", delta=delta, name="_s2")
    for name, column in PIPELINES.items():
        out = aggregate_sections(out, column, skip_peri_jump=name != "baseline", name=name)
    return out.drop("_r0", "_r2", "_s", "_s2")


def label_transitions(df: DataFrame, column: str = "percept", jump_us: int = 200_000, window_ms: float = 400.0, rate: float = 250.0) -> DataFrame:
    """smoothed (per-trial median, odd window), transition (its label changes; never on a trial's
    first sample) and transition_type: jump_induced within the window of a section start of
    the trial, else spontaneous."""
    size = max(1, round(window_ms / (1000.0 / rate)))
    out = smooth(df, column, size + 1 - size % 2, "median", keys=TRIAL)
    w = trial_order()
    jump = F.when(F.lag("section").over(w) != F.col("section"), F.col("trial_us"))
    out = out.withColumns({"_jump": jump, "transition": F.coalesce(F.lag("smoothed").over(w) != F.col("smoothed"), F.lit(False))})
    out = out.withColumns({"_b": last_known("_jump", w), "_a": last_known("_jump", trial_order(descending=True))})
    near = F.coalesce(F.col("trial_us") - F.col("_b") <= jump_us, F.lit(False)) | F.coalesce(F.col("_a") - F.col("trial_us") <= jump_us, F.lit(False))
    kind = F.when(F.col("transition"), F.when(near, "jump_induced").otherwise("spontaneous"))
    return out.withColumn("transition_type", kind).drop("_jump", "_b", "_a")


def transition_summary(df: DataFrame, by_trial: bool = True) -> DataFrame:
    """Counts of transitions by kind and the share of induced ones in percent, per trial with any
    or per run (all runs; the share is missing where there are none)."""
    kind = F.col("transition_type")
    counts = [F.count_if("transition").alias("n_transitions"), F.count_if(kind == "jump_induced").alias("n_jump"), F.count_if(kind == "spontaneous").alias("n_spontaneous")]
    out = df.groupBy(*(TRIAL if by_trial else RUN)).agg(*counts)
    out = out.filter("n_transitions > 0") if by_trial else out
    return out.withColumn("pct_jump", L.rounded(F.try_divide(F.col("n_jump") * 100.0, F.col("n_transitions"))))


def velocity(df: DataFrame, dt: float = 0.004) -> DataFrame:
    """Distance from the trial's sample before, by time."""
    w = trial_order()
    return df.withColumn("velocity", L.distance(F.col("x"), F.col("y"), F.lag("x").over(w), F.lag("y").over(w)) / dt)


def acceleration(df: DataFrame, dt: float = 0.004) -> DataFrame:
    w = trial_order()
    return velocity(df, dt).withColumn("acceleration", (F.col("velocity") - F.lag("velocity").over(w)) / dt)


def fixation_elapsed(df: DataFrame) -> DataFrame:
    """fixation_us: time since the current fixation began; missing outside fixations."""
    w = trial_order()
    out = df.withColumn("_new", changed("fixation", w)).withColumn("_island", running("_new", w))
    begin = F.min("trial_us").over(Window.partitionBy(*TRIAL, "_island"))
    return out.withColumn("fixation_us", F.when(F.col("fixation") == 1, F.col("trial_us") - begin)).drop("_new", "_island")


def rolling_majority(df: DataFrame, column: str = "percept", samples: int = 9) -> DataFrame:
    """majority: the commonest label in the trailing window of the trial; ties to the smallest."""
    w = trial_order()
    out = df
    names = ("face", "house", "mixed")
    for name in names:
        out = out.withColumn(f"_c_{name}", running(F.when(F.col(column) == name, 1).otherwise(0), w))
    for name in names:
        out = out.withColumn(f"_n_{name}", F.col(f"_c_{name}") - F.coalesce(F.lag(f"_c_{name}", samples).over(w), F.lit(0)))
    top = F.greatest(*[F.col(f"_n_{n}") for n in names])
    pick = F
    for name in names:
        pick = pick.when((top > 0) & (F.col(f"_n_{name}") == top), name)
    return out.withColumn("majority", pick).drop(*[f"_{k}_{n}" for k in "cn" for n in names])
