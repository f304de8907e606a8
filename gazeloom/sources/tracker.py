"""Tracker text exports as tables. A lines table has (subject, run, line_no, value); the run comes
from the file's name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.windows import RUN, so_far

#: File names like s11r03nr.asc: subject, run, with or without reports.
NAME = r"s(\d+)r(\d+)(nr|r)(?:_[A-Za-z]+)*\.[A-Za-z]+$"


def run_info(path: Column) -> dict[str, Column]:
    """subject, run and run_type from a path; missing where the name doesn't say."""
    part = lambda i: F.nullif(F.regexp_extract(path, NAME, i), F.lit(""))
    return {"subject": part(1).cast("long"), "run": part(2).cast("long"), "run_type": F.when(part(3) == "nr", "no-report").when(part(3) == "r", "report")}


def run_stem(run_type: Column | str = "run_type") -> Column:
    """The name that files of a run share, such as s11r03nr (missing run types count as no report)."""
    kind = F.col(run_type) if isinstance(run_type, str) else run_type
    return F.format_string("s%dr%02d%s", "subject", "run", F.when(kind == "report", "r").otherwise("nr"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of recordings in their order. Files are read in splits, as Spark plans them; a line's
    number is its split's first byte plus its place there, so it grows along the file (with gaps), and `block` names
    the split. No task holds more than its splits."""
    found = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")).withColumn("_at", F.monotonically_increasing_id())
    lines = found.withColumns(run_info(F.col("path")))
    place = F.row_number().over(Window.partitionBy(*RUN, "block").orderBy("path", "_at"))
    return lines.select("subject", "run", "run_type", "path", (F.col("block") + place - 1).alias("line_no"), "value", "block")


#: Lines that count as one block where a lines table doesn't name its blocks.
BLOCK_LINES = 100_000
#: Lines of one block, the unit that windows over lines look at.
BLOCK = (*RUN, "block")


def _blocks(lines: DataFrame) -> DataFrame:
    return lines if "block" in lines.columns else lines.withColumn("block", F.floor(F.col("line_no") / BLOCK_LINES))


def _parts(lines: DataFrame) -> DataFrame:
    out = _blocks(lines).filter(F.col("value") != "").withColumn("_p", F.split("value", "\t"))
    head = F.col("_p")[0]
    kind = F.when(head.startswith("EFIX"), "EFIX").when(head.startswith("ESACC"), "ESACC").when(head.startswith("EBLINK"), "EBLINK").when(head.rlike("^(SFIX|SSACC|SBLINK)"), "S").when(head.contains("MSG"), "MSG").when(head.contains("END"), "END").otherwise("DATA")
    return out.withColumn("_kind", kind)


def _same_run(other: str) -> Column:
    return F.col("subject").eqNullSafe(F.col(f"{other}_subject")) & F.col("run").eqNullSafe(F.col(f"{other}_run"))


def _bounds(parts: DataFrame) -> DataFrame:
    """(_b_subject, _b_run, _begin, _end): a run's first SYNCTIME and the first END after it. Each block tells its first
    of both and its first END after its own SYNCTIME; a run's row is made of its blocks' rows."""
    synced = F.contains("value", F.lit("SYNCTIME")) & ~F.contains("value", F.lit("GAZE_COORDS"))
    ends = F.when(F.col("_kind") == "END", F.col("line_no"))
    first = F.min(F.when(synced, F.col("line_no"))).over(Window.partitionBy(*BLOCK))
    told = parts.withColumn("_sync", first).groupBy(*BLOCK).agg(F.first("_sync").alias("_sync"), F.min(ends).alias("_any"), F.min(F.when(ends > F.col("_sync"), ends)).alias("_after"))
    told = told.withColumn("_begin", F.min("_sync").over(Window.partitionBy(*RUN)))  # a row a block
    end = F.when(F.col("_sync") == F.col("_begin"), F.col("_after")).when(F.col("_any") > F.col("_begin"), F.col("_any"))
    return told.groupBy(F.col("subject").alias("_b_subject"), F.col("run").alias("_b_run")).agg(F.first("_begin").alias("_begin"), F.min(end).alias("_end"))


def _body(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Header and body lines: the body runs from the first SYNCTIME to the first END after it."""
    parts = _parts(lines)
    placed = parts.join(_bounds(parts), _same_run("_b"), "left").drop("_b_subject", "_b_run")
    header = placed.filter(F.col("_begin").isNull() | (F.col("line_no") < F.col("_begin")))
    body = placed.filter((F.col("line_no") > F.col("_begin")) & (F.col("_end").isNull() | (F.col("line_no") < F.col("_end"))))
    return header, body


def _time(c: Column) -> Column:
    return F.round(F.trim(c).try_cast("double") * 1000).cast("long")


def intervals(lines: DataFrame) -> DataFrame:
    """(subject, run, kind, start_us, end_us) of fixations, saccades and blinks."""
    _, body = _body(lines)
    rows = body.filter(F.col("_kind").isin("EFIX", "ESACC", "EBLINK"))
    first, whole = F.split(F.trim(F.get("_p", F.lit(0))), r"\s+"), F.split(F.trim("value"), r"\s+")
    blink = F.col("_kind") == "EBLINK"
    start = F.when(blink, F.get(whole, F.lit(2))).otherwise(F.get(first, F.lit(2)))
    end = F.when(blink, F.get(whole, F.lit(3))).otherwise(F.get("_p", F.lit(1)))
    enough = (F.col("_kind") != "EFIX") | (F.size("_p") >= 3)
    kind = F.when(blink, "blink").when(F.col("_kind") == "ESACC", "saccade").otherwise("fixation")
    return rows.filter(enough).select(*RUN, kind.alias("kind"), _time(start).alias("start_us"), _time(end).alias("end_us")).filter("start_us is not null and end_us is not null")


def flag_intervals(samples: DataFrame, found: DataFrame) -> DataFrame:
    """samples with fixation, saccade and blink: 1 inside any interval of the kind, ends included.
    Starts and ends are marks among the samples in order of time; no pair is joined."""
    one = lambda k, sign: F.when(F.col("kind") == k, sign).otherwise(0)
    kinds = ("fixation", "saccade", "blink")
    starts = found.select(*RUN, F.col("start_us").alias("run_us"), F.lit(0).alias("_order"), *[one(k, 1).alias(f"_{k}") for k in kinds])
    ends = found.select(*RUN, F.col("end_us").alias("run_us"), F.lit(2).alias("_order"), *[one(k, -1).alias(f"_{k}") for k in kinds])
    own = samples.drop(*kinds)
    marked = own.withColumns({"_order": F.lit(1), **{f"_{k}": F.lit(0) for k in kinds}})
    both = marked.unionByName(starts, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)
    w = so_far(Window.partitionBy(*RUN).orderBy("run_us", "_order"))
    flagged = both.withColumns({k: (F.sum(f"_{k}").over(w) > 0).cast("int") for k in kinds})
    return flagged.filter("_order = 1").select(*own.columns, *kinds)


def _state_before(rows: DataFrame, state: list[str]) -> DataFrame:
    """(_s_subject, _s_run, _s_block, and each state with _before): what holds where a block begins. A block is summed up as
    whether a trial ends in it and what is known at its end; such sums are chained over a run's blocks, a row a block."""
    ends = rows.groupBy(*BLOCK).agg(F.max("_life").alias("_ended"), *[F.max_by(c, F.struct("_life", "line_no")).alias(c) for c in state])
    blocks = Window.partitionBy(*RUN).orderBy("block")
    ends = ends.withColumn("_chain", F.count_if(F.col("_ended") > 0).over(so_far(blocks)))
    chain = so_far(Window.partitionBy(*RUN, "_chain").orderBy("block"))
    ends = ends.withColumns({c: F.last(c, ignorenulls=True).over(chain) for c in state})
    before = {f"{c}_before": F.lag(c).over(blocks) for c in state}
    return ends.withColumns(before).select(F.col("subject").alias("_s_subject"), F.col("run").alias("_s_run"), F.col("block").alias("_s_block"), *before)


def parse_samples(lines: DataFrame) -> DataFrame:
    """Samples with the trial state of the messages before them: run_us, x, y, diameter, trial,
    type, image1, fixpoint1, fixpoint2, percept. Malformed lines are left out."""
    _, body = _body(lines)
    message = F.when(F.col("_kind") == "MSG", F.array_join(F.slice("_p", F.lit(2), F.greatest(F.size("_p") - 1, F.lit(0))), "\t"))
    rows = body.withColumn("_m", message)
    m = F.col("_m")
    take = lambda pattern: F.nullif(F.regexp_extract(m, pattern, 1), F.lit(""))
    trial = m.contains("Trial #")
    ended = m.contains("End of trial") & ~trial
    one = m.contains("Fix point 1") & ~trial & ~ended
    two = m.contains("Fix point 2") & ~trial & ~ended & ~one
    percept = m.contains("percept:") & ~trial & ~ended & ~one & ~two
    position = take(r"position: (\d+)").cast("int")
    state = {
        "_trial": F.when(trial, F.struct(take(r"Trial #(\d+)").cast("long").alias("trial"), take(r"type = (\w+)").alias("type"), take(r"image1 = (\w+)").alias("image1"))),
        "_one": F.when(one, F.struct(position.alias("v"))),
        "_two": F.when(two, F.struct(position.alias("v"))),
        "_percept": F.when(trial, F.struct(take(r"image1 = (\w+)").alias("v"))).when(percept, F.struct(take(r"percept: (\w+)").alias("v"))),
    }
    order = Window.partitionBy(*BLOCK).orderBy("line_no")
    rows = rows.withColumn("_life", F.count_if(ended).over(so_far(order))).withColumns(state)
    life = so_far(Window.partitionBy(*BLOCK, "_life").orderBy("line_no"))
    rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(life) for c in state})
    # A block's lines before its first end of a trial go on with what the blocks before it leave.
    given = _state_before(rows, list(state))
    rows = rows.join(given, _same_run("_s") & (F.col("block") == F.col("_s_block")), "left")
    rows = rows.withColumns({c: F.coalesce(c, F.when(F.col("_life") == 0, F.col(f"{c}_before"))) for c in state})
    p = lambda i: F.trim(F.get("_p", F.lit(i)))
    number = lambda i: F.when(p(i) != ".", p(i).try_cast("double"))
    fine = (F.col("_kind") == "DATA") & (F.size("_p") >= 4) & F.regexp_replace(p(0), r"\.", "").rlike(r"^\d+$") & _time(p(0)).isNotNull()
    fine = fine & ((p(1) == ".") | number(1).isNotNull()) & ((p(2) == ".") | number(2).isNotNull()) & number(3).isNotNull()
    return rows.filter(fine).select(*RUN, _time(p(0)).alias("run_us"), number(1).alias("x"), number(2).alias("y"), number(3).alias("diameter"), "_trial.trial", "_trial.type", "_trial.image1", F.col("_one.v").alias("fixpoint1"), F.col("_two.v").alias("fixpoint2"), F.col("_percept.v").alias("percept"))


def parse(lines: DataFrame) -> DataFrame:
    """Samples with state and event flags."""
    return flag_intervals(parse_samples(lines), intervals(lines))


def run_metadata(lines: DataFrame) -> DataFrame:
    """(subject, run, sampling_rate, gaze_coords, n_fixations, n_saccades, n_blinks)."""
    header, _ = _body(lines)
    tokens = F.split(F.trim("value"), r"\s+")
    coords = F.when(F.contains("value", F.lit("GAZE_COORDS")), F.transform(F.slice(tokens, 4, 3), lambda t: t.try_cast("double")))
    rate = F.when(F.contains("value", F.lit("SAMPLES")) & ~F.contains("value", F.lit("GAZE_COORDS")), F.nullif(F.regexp_extract("value", r"\bRATE\s+(\S+)", 1), F.lit("")).try_cast("double"))
    meta = header.groupBy(*RUN).agg(F.max_by(rate, F.when(rate.isNotNull(), F.col("line_no"))).alias("sampling_rate"), F.max_by(coords, F.when(coords.isNotNull(), F.col("line_no"))).alias("gaze_coords"))
    n = intervals(lines).groupBy(*RUN).agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}s") for k in ("fixation", "saccade", "blink")])
    out = meta.join(n, list(RUN), "left")
    return out.withColumns({f"n_{k}s": F.coalesce(f"n_{k}s", F.lit(0)).cast("long") for k in ("fixation", "saccade", "blink")})


def validate(lines: DataFrame, strict: bool = True) -> DataFrame:
    """(subject, run, n_lines, n_samples, n_messages, has_gaze_coords, has_trials, valid, errors).
    Not strict: coordinates count only outside message lines, as they did in earlier reports."""
    text = F.col("value")
    message = text.startswith("MSG")
    coords = text.contains("GAZE_COORDS") & (F.lit(True) if strict else ~message)
    out = lines.groupBy(*RUN).agg(F.count("*").alias("n_lines"), F.count_if(text.rlike(r"^\d")).alias("n_samples"), F.count_if(message).alias("n_messages"), F.coalesce(F.bool_or(coords), F.lit(False)).alias("has_gaze_coords"), F.coalesce(F.bool_or(message & text.contains("Trial #")), F.lit(False)).alias("has_trials"))
    errors = F.array_compact(F.array(F.when(F.col("n_lines") < 10, "truncated"), F.when(F.col("n_samples") == 0, "no samples"), F.when(~F.col("has_gaze_coords"), "no gaze coordinates"), F.when(~F.col("has_trials"), "no trials")))
    # A recording without trials is noted but valid.
    return out.withColumn("errors", errors).withColumn("valid", F.size(F.array_remove("errors", "no trials")) == 0)


def trial_metadata(lines: DataFrame) -> DataFrame:
    """(subject, run, trial, type, image1, orientation) from the trial messages."""
    text = F.col("value")
    take = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return lines.filter(text.startswith("MSG") & text.contains("Trial #")).select(*RUN, take(r"Trial #(\d+)").cast("long").alias("trial"), take(r"type = (\w+)").alias("type"), take(r"image1 = (\w+)").alias("image1"), take(r"angle1 = (-?[\d.]+)").try_cast("double").alias("orientation"))
