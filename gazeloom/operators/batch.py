"""Many subjects through the stages of one job, each stage a lazy plan over all their runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import RUN
from . import cleaning as C
from . import events as E
from . import joins as J
from . import metrics as M
from . import percepts as P


def broken_runs(samples: DataFrame, stimuli: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """(subject, run, reason) of runs that the stages can't work on: no sample with a position, no
    trial, an image that is neither house nor face, no stimulus parameters up to the run, or (with
    reports) a report run without any. The first reason in this order counts."""
    runs = samples.groupBy(*RUN).agg(
        F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).alias("_points"), F.count("trial").alias("_trials"),
        F.count_if(~F.col("image1").isin("house", "face")).alias("_images"), F.min("run_type").alias("_type"),
    )
    # Parameters hold from their run on, so a subject's first run with some tells enough.
    first = stimuli.groupBy("subject").agg(F.min("run").alias("_from"))
    runs = runs.join(first, "subject", "left")
    untold = F.lit(False)
    if reports is not None:
        runs = runs.join(reports.select(*RUN).distinct().withColumn("_told", F.lit(True)), list(RUN), "left")
        untold = (F.col("_type") == "report") & F.col("_told").isNull()
    reason = (
        F.when(F.col("_points") == 0, "no positions").when(F.col("_trials") == 0, "no trials").when(F.col("_images") > 0, "unknown image")
        .when(F.col("_from").isNull() | (F.col("_from") > F.col("run")), "no parameters").when(untold, "no reports")
    )
    return runs.select(*RUN, reason.alias("reason")).filter("reason is not null")


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(subject, run, stage) of the runs that the tables of run_batch hold."""
    out = None
    for stage, df in tables.items():
        one = df.select(*RUN).distinct().withColumn("stage", F.lit(stage))
        out = one if out is None else out.unionByName(one)
    return out


def run_batch(
    samples: DataFrame, stimuli: DataFrame, reports: DataFrame | None = None, subjects: list[int] | None = None, preprocess_only: bool = False, reconstruct_only: bool = False,
    evaluate: bool = False, events: bool = False, exclude_jump_induced: bool = False, percepts: DataFrame | None = None, cleaning: dict | None = None, margin_us: int | None = 50_000, least: float = 1.75,
    isolate: bool = False, done: DataFrame | None = None, settle: Callable[[DataFrame], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """The tables of the stages that are asked for: preprocessed, percepts, scores, events and
    switch_events, of all subjects or the given ones.

    reconstruct_only takes the samples as preprocessed; preprocess_only makes no percepts, so
    events then need those of an earlier run (`percepts`). evaluate scores the percepts of report
    runs. Samples within margin_us of section starts don't count for section labels (None: all
    count). Report runs have events of their reports (those with none have no events), other runs
    of their labels; epochs shorter than `least` are merged.

    isolate leaves out broken runs and returns them with their reasons as `errors`, so that the
    others go on. done (subject, run, stage; see manifest) leaves out of each stage's input the
    runs that have been through it, so that a stopped batch is taken up where it was.

    settle is given the tables that several stages go on from (cleaned samples, percepts, epochs) and returns
    them, written and read back, say: then no stage does another one's work again, and no task holds the buffers of
    all stages. A run through which all stages are done is left out before."""
    mine = (lambda df: df) if subjects is None else (lambda df: df.filter(F.col("subject").isin(subjects)))
    whole, told = mine(samples), None if reports is None else mine(reports)
    out: dict[str, DataFrame] = {}
    if isolate:
        out["errors"] = broken_runs(whole, mine(stimuli), told if evaluate else None)
        whole = whole.join(out["errors"].select(*RUN), list(RUN), "left_anti")

    def open_runs(df: DataFrame, stage: str) -> DataFrame:
        return df if done is None else df.join(done.filter(F.col("stage") == stage).select(*RUN).distinct(), list(RUN), "left_anti")

    # All steps are run by run, so that runs that a stage has done can be left out after the steps as well as before.
    stages = [stage for stage, asked in (("preprocessed", not reconstruct_only), ("percepts", not preprocess_only), ("scores", evaluate and not preprocess_only), ("events", events and not preprocess_only)) if asked]
    if settle and done is not None:
        closed = done.filter(F.col("stage").isin(stages)).groupBy(*RUN).agg(F.countDistinct("stage").alias("_n")).filter(F.col("_n") == len(stages))
        whole = whole.join(closed.select(*RUN), list(RUN), "left_anti")

    def cleaned(table: DataFrame) -> DataFrame:
        return table if reconstruct_only else C.clean(table, stimuli, **(cleaning or {}))

    def labels(table: DataFrame) -> DataFrame:
        known = P.labeled(table, C.parameters_as_of(table, stimuli))
        if margin_us is not None:
            known = P.aggregate_sections(P.mark_peri_jump(known, margin_us), "percept", skip_peri_jump=True)
        return known if told is None else J.report_as_of(known, told)

    if settle:
        clean_all = settle(cleaned(whole)) if stages else whole
        known_all = clean_all if preprocess_only else settle(labels(clean_all))

    def preprocessed(stage: str) -> DataFrame:
        return open_runs(clean_all, stage) if settle else cleaned(open_runs(whole, stage))

    def labelled(stage: str) -> DataFrame:
        return open_runs(known_all, stage) if settle else labels(preprocessed(stage))

    if not reconstruct_only:
        out["preprocessed"] = preprocessed("preprocessed")
    if not preprocess_only:
        out["percepts"] = labelled("percepts")
        if evaluate:
            if told is None:
                raise ValueError("evaluation needs reports")
            out["scores"] = M.evaluate_run(labelled("scores") if done is not None else out["percepts"])
    if events:
        if preprocess_only and percepts is None:
            raise ValueError("events need percepts: reconstruct first or give them")
        if preprocess_only:
            known = open_runs(mine(percepts), "events")
        else:
            known = labelled("events") if done is not None else out["percepts"]
        offsets = E.trial_offsets(known)
        columns = ("subject", "run", "onset", "duration", "trial_type")
        made = E.events_from_labels(known.filter("run_type <> 'report'"), offsets, exclude_jump_induced).select(*columns)
        if told is not None:
            in_table = told.join(known.select("subject", "run").distinct(), ["subject", "run"], "left_semi")
            made = made.unionByName(E.events_from_reports(in_table, offsets, known if exclude_jump_induced else None).select(*columns))
        made = settle(made) if settle else made
        out["events"] = E.merge_short_epochs(made, least)
        out["switch_events"] = out["events"].withColumn("duration", F.lit(0.0))
    return out
