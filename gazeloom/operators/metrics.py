"""Scores of inferred against reported labels, from confusion counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import RUN, TRIAL


def confusion(df: DataFrame, keys: tuple[str, ...], true: str = "reported", inferred: str = "inferred", exclude_mixed: bool = False) -> DataFrame:
    """(keys, true, inferred, n) over rows that have both labels."""
    rows = df.filter(F.col(true).isNotNull() & F.col(inferred).isNotNull())
    if exclude_mixed:
        rows = rows.filter(F.col(true) != "mixed")
    return rows.groupBy(*keys, F.col(true).alias("true"), F.col(inferred).alias("inferred")).agg(F.count("*").alias("n"))


def per_class(counts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, label, support, predicted, hits, precision, recall, f1) of all labels that occur; from
    confusion counts, which are a handful of rows a key."""
    each = F.array(F.struct(F.col("true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")), F.struct(F.col("inferred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")))
    sides = counts.select(*keys, F.explode(each).alias("s"), F.when(F.col("true") == F.col("inferred"), F.col("n")).otherwise(0).alias("h"))
    out = sides.groupBy(*keys, "s.label").agg(F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), (F.sum("h") / 2).cast("long").alias("hits"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = out.withColumns({"precision": ratio(F.col("hits"), F.col("predicted")), "recall": ratio(F.col("hits"), F.col("support"))})
    return out.withColumn("f1", ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")))


def scores(counts: DataFrame, keys: tuple[str, ...], suffix: str = "") -> DataFrame:
    """(keys, n, accuracy, f1_macro, f1_weighted, mcc) with the suffix: missing under two pairs or
    two true labels. Macro F1 averages over all labels that occur."""
    c = per_class(counts, keys)
    out = c.groupBy(*keys).agg(
        F.sum("support").alias("s"), F.sum("hits").alias("c"), F.avg("f1").alias("macro"), F.sum(F.col("f1") * F.col("support")).alias("weighted"),
        F.sum(F.col("predicted") * F.col("support")).alias("pt"), F.sum(F.col("predicted") * F.col("predicted")).alias("pp"),
        F.sum(F.col("support") * F.col("support")).alias("tt"), F.count_if(F.col("support") > 0).alias("labels"),
    )
    s, hit = F.col("s").cast("double"), F.col("c").cast("double")
    under = (s * s - F.col("pp")) * (s * s - F.col("tt"))
    mcc = F.when(under > 0, (hit * s - F.col("pt")) / F.sqrt(under)).otherwise(0.0)
    enough = (F.col("s") >= 2) & (F.col("labels") >= 2)
    named = {"accuracy": hit / s, "f1_macro": F.col("macro"), "f1_weighted": F.col("weighted") / s, "mcc": mcc}
    return out.select(*keys, F.col("s").alias(f"n{suffix}"), *[F.when(enough, v).alias(f"{k}{suffix}") for k, v in named.items()])


def sections_to_score(df: DataFrame, keys: tuple[str, ...] = (*RUN, "section"), column: str = "aggregated") -> DataFrame:
    """One row a section of rivalry samples with a report: its first trial (without trials as keys), modal report, first
    inferred label, number of samples and whether they match."""
    rows = df.filter((F.col("type") == "rivalry") & F.col("reported").isNotNull())
    known = F.when(F.col(column).isNotNull(), F.struct("run_us", F.col(column)))
    first = {} if "trial" in keys else {"first_trial": F.min_by("trial", "run_us")}
    out = rows.groupBy(*keys).agg(*[c.alias(k) for k, c in first.items()], F.mode("reported", True).alias("reported"), F.min(known).alias("_k"), F.count("*").alias("n_samples"))
    return out.withColumn("inferred", F.col(f"_k.{column}")).drop("_k").withColumn("match", F.col("reported") == F.col("inferred"))


def evaluate_run(df: DataFrame, column: str = "aggregated") -> DataFrame:
    """One row a run with reports: numbers of sections and of sections by trial, and the scores
    without (_2) and with (_3) `mixed` over sections, and over sections by trial (_t2, _t3)."""
    # Samples count for their section and for their trial's part of it: one pass over both.
    over = F.array(F.struct(F.lit("_").alias("_over"), F.lit(None).cast("long").alias("trial")), F.struct(F.lit("_t").alias("_over"), F.col("trial").cast("long").alias("trial")))
    slim = df.select(*RUN, "section", "type", "run_us", "reported", column, F.explode(over).alias("_o"))
    parts = sections_to_score(slim.withColumns({"_over": F.col("_o._over"), "trial": F.col("_o.trial")}), (*RUN, "section", "_over", "trial"), column)
    parts = parts.select(*RUN, "trial", "reported", "inferred", "_over")
    # Each row counts once with `mixed`, and once more without; all scores come from one count.
    both = F.when(F.col("reported") == "mixed", F.array(F.lit("3"))).otherwise(F.array(F.lit("2"), F.lit("3")))
    rows = parts.withColumn("_k", F.explode(both)).withColumn("_v", F.concat("_over", "_k"))
    keys = (*RUN, "_v")
    n = rows.filter("_k = '3'").groupBy(*RUN).agg(F.count_if(F.col("_over") == "_").alias("n_sections"), F.countDistinct("trial").alias("n_trials"))
    each = scores(confusion(rows, keys), keys)
    wide = each.groupBy(*RUN).agg(*[F.max(F.when(F.col("_v") == v, F.col(k))).alias(k + v) for v in ("_2", "_3", "_t2", "_t3") for k in ("accuracy", "f1_macro", "f1_weighted", "mcc")])
    return n.join(wide, list(RUN), "left")


def compare_configurations(frames: dict[str, DataFrame], column: str = "aggregated") -> DataFrame:
    """(config, subject, run, accuracy, f1_macro, mcc) of each configuration's labelled samples."""
    out = None
    for name, df in frames.items():
        rows = sections_to_score(df, column=column).withColumn("config", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return scores(confusion(out, ("config", *RUN), exclude_mixed=True), ("config", *RUN)).drop("n", "f1_weighted")


def compare_columns(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(config, subject, run, accuracy, f1_macro, mcc) of section labels that are columns of one
    frame, each its own configuration; the samples are read once."""
    rows = df.filter((F.col("type") == "rivalry") & F.col("reported").isNotNull())
    first = [F.min(F.when(F.col(c).isNotNull(), F.struct("run_us", F.col(c).alias("v"))))["v"].alias(c) for c in columns]
    sections = rows.groupBy(*RUN, "section").agg(F.mode("reported", True).alias("reported"), *first)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("config"), F.col(c).alias("inferred")) for c in columns]))
    out = sections.select(*RUN, "reported", each.alias("_c")).select("_c.config", *RUN, "reported", "_c.inferred")
    return scores(confusion(out, ("config", *RUN), exclude_mixed=True), ("config", *RUN)).drop("n", "f1_weighted")


def configurations_by_subject(runs: DataFrame, columns: tuple[str, ...], baseline: str) -> DataFrame:
    """A row a subject with the mean accuracy of each configuration, and (delta_) its difference
    from the baseline's."""
    mean = {c: F.avg(F.when(F.col("config") == c, F.col("accuracy"))) for c in columns}
    out = runs.filter("accuracy is not null").groupBy("subject").agg(*[m.alias(c) for c, m in mean.items()])
    return out.withColumns({f"delta_{c}": F.col(c) - F.col(baseline) for c in columns if c != baseline})


def configuration_summary(runs: DataFrame, baseline: str) -> DataFrame:
    """Mean and sample deviation of each score by configuration, and the accuracy's difference from
    the baseline's."""
    out = runs.groupBy("config").agg(F.count("accuracy").alias("n_runs"), *[f(c).alias(f"{k}_{c}") for c in ("accuracy", "f1_macro", "mcc") for k, f in (("mean", F.avg), ("std", F.stddev))])
    base = F.max(F.when(F.col("config") == baseline, F.col("mean_accuracy"))).over(Window.partitionBy(F.lit(0)))  # a row a configuration
    return out.withColumn("delta_accuracy", F.col("mean_accuracy") - base)
