"""Gaze tables derived from the given tables, in Spark and as DuckDB SQL.

`events` become samples at 250 Hz; some positions and fixation points are made missing. The SQL
texts are common table expressions for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STEP_US = 4000
# Screen centre, distance of the eight points from it, their directions.
CENTER_X, CENTER_Y, OFFSET = 960.0, 540.0, 56.0
DIRECTIONS = ((-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0))
_X = [CENTER_X + OFFSET * dx for dx, _ in DIRECTIONS]
_Y = [CENTER_Y + OFFSET * dy for _, dy in DIRECTIONS]


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 160 users are ten subjects of four runs each, so that the number of runs grows with the
    users and a run stays some minutes long at any scale. subject, run, sample_idx, run_us, trial, trial_us, x, y, diameter, blink, saccade, fixation,
    fixpoint1, fixpoint2, image1, type, run_type."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    e = e.withColumns({"subject": (11 + F.col("user_id") % 10 + 10 * F.floor(F.col("user_id") / 160)).cast("long"), "run": (1 + F.floor(F.col("user_id") / 10) % 4).cast("long")})
    order = Window.partitionBy("subject", "run").orderBy("ts", "event_id")
    i, kind, gone = F.col("sample_idx"), F.col("event_type"), F.col("event_id") % 17 == 0
    e = e.withColumn("sample_idx", (F.row_number().over(order) - 1).cast("long"))
    return e.select(
        "subject", "run", "sample_idx", (i * STEP_US).alias("run_us"),
        (1 + F.floor(i / 100)).cast("long").alias("trial"), ((i % 100) * STEP_US).alias("trial_us"),
        F.when(~gone, (760 + (F.col("event_id") * 7919) % 401).cast("double")).alias("x"),
        F.when(~gone, (340 + (F.col("event_id") * 104729) % 401).cast("double")).alias("y"),
        F.col("value").cast("double").alias("diameter"),
        (kind == "error").cast("int").alias("blink"), (kind == "click").cast("int").alias("saccade"),
        kind.isin("view", "signup", "purchase").cast("int").alias("fixation"),
        F.when(F.col("event_id") % 29 != 0, (1 + F.floor(i / 25) % 8).cast("int")).alias("fixpoint1"),
        (1 + (F.floor(i / 25) + 4) % 8).cast("int").alias("fixpoint2"),
        F.when((F.col("subject") + F.col("run")) % 2 == 0, "house").otherwise("face").alias("image1"),
        F.when((1 + F.floor(i / 100)) % 5 == 0, "replay").otherwise("rivalry").alias("type"),
        F.when(F.col("run") % 2 == 0, "no-report").otherwise("report").alias("run_type"),
    )


SAMPLES = """
numbered AS (
  SELECT event_id, value, event_type, 11 + user_id % 10 + 10 * (user_id // 160) AS subject, 1 + (user_id // 10) % 4 AS run,
    row_number() OVER (PARTITION BY user_id % 10, user_id // 160, (user_id // 10) % 4 ORDER BY ts, event_id) - 1 AS i
  FROM events),
g AS (
  SELECT subject::BIGINT AS subject, run::BIGINT AS run, i AS sample_idx, i * 4000 AS run_us, 1 + i // 100 AS trial, (i % 100) * 4000 AS trial_us,
    CASE WHEN event_id % 17 <> 0 THEN (760 + (event_id * 7919) % 401)::DOUBLE END AS x,
    CASE WHEN event_id % 17 <> 0 THEN (340 + (event_id * 104729) % 401)::DOUBLE END AS y,
    value::DOUBLE AS diameter, (event_type = 'error')::INTEGER AS blink, (event_type = 'click')::INTEGER AS saccade,
    (event_type IN ('view', 'signup', 'purchase'))::INTEGER AS fixation,
    CASE WHEN event_id % 29 <> 0 THEN (1 + (i // 25) % 8)::INTEGER END AS fixpoint1, (1 + ((i // 25) + 4) % 8)::INTEGER AS fixpoint2,
    CASE WHEN (subject + run) % 2 = 0 THEN 'house' ELSE 'face' END AS image1,
    CASE WHEN (1 + i // 100) % 5 = 0 THEN 'replay' ELSE 'rivalry' END AS type,
    CASE WHEN run % 2 = 0 THEN 'no-report' ELSE 'report' END AS run_type
  FROM numbered)"""


def stimuli(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, run, x_offset, y_offset, positions: parameters for runs 1 and 3 of each subject."""
    subjects = samples(spark, sf_dir).select("subject").distinct()
    points = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in zip(_X, _Y)])
    return subjects.withColumn("run", F.explode(F.array(F.lit(1).cast("long"), F.lit(3).cast("long")))).select("subject", "run", (F.col("run") * 10.0).alias("x_offset"), (F.col("subject") * 1.0).alias("y_offset"), points.alias("positions"))


STIMULI = "stimuli AS (SELECT DISTINCT subject, r.run::BIGINT AS run, r.run * 10.0::DOUBLE AS x_offset, subject::DOUBLE AS y_offset FROM g, (VALUES (1), (3)) AS r(run))"


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, run, trial, type, percept, onset_us, duration_us: two epochs with a gap after
    each, for the trials of report runs."""
    trials = samples(spark, sf_dir).filter("run_type = 'report'").select("subject", "run", "trial", "type").distinct()
    k = F.col("k")
    pick = F.element_at(F.array(F.lit("house"), F.lit("face"), F.lit("mixed")), ((F.col("subject") + F.col("run") + F.col("trial") + k) % 3 + 1).cast("int"))
    return trials.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select("subject", "run", "trial", "type", pick.alias("percept"), (k * 200_000).cast("long").alias("onset_us"), F.lit(160_000).cast("long").alias("duration_us"))


REPORTS = """
reports AS (
  SELECT DISTINCT subject, run, trial, type, ['house', 'face', 'mixed'][(subject + run + trial + k) % 3 + 1] AS percept, (k * 200000)::BIGINT AS onset_us, 160000::BIGINT AS duration_us
  FROM g, (VALUES (0), (1)) AS t(k) WHERE run_type = 'report')"""

_DEG = "(2 * degrees(atan(0.5 * (470.0::DOUBLE / 1920) / 1050)))"
_PX, _PY = (", ".join(f"{v}::DOUBLE" for v in vs) for vs in (_X, _Y))
#: Distances in degrees (back-filled points), the two labels, sections, and the section's modal label.
LABELED = f"""
filled AS (
  SELECT *, first_value(fixpoint1 IGNORE NULLS) OVER w AS f1, first_value(fixpoint2 IGNORE NULLS) OVER w AS f2
  FROM g WINDOW w AS (PARTITION BY subject, run ORDER BY run_us ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
d AS (
  SELECT * EXCLUDE (f1, f2),
    sqrt((x - [{_PX}][f1]) * (x - [{_PX}][f1]) + (y - [{_PY}][f1]) * (y - [{_PY}][f1])) * {_DEG} AS d1,
    sqrt((x - [{_PX}][f2]) * (x - [{_PX}][f2]) + (y - [{_PY}][f2]) * (y - [{_PY}][f2])) * {_DEG} AS d2,
    sqrt((x - {CENTER_X}) * (x - {CENTER_X}) + (y - {CENTER_Y}) * (y - {CENTER_Y})) * {_DEG} AS dc
  FROM filled),
labels AS (
  SELECT *, CASE WHEN d1 < d2 THEN image1 WHEN image1 = 'house' THEN 'face' ELSE 'house' END AS percept,
    CASE WHEN dc < d1 AND dc < d2 THEN 'mixed' WHEN d1 < d2 THEN image1 WHEN image1 = 'house' THEN 'face' ELSE 'house' END AS percept3
  FROM d),
forward AS (
  SELECT *, last_value(fixpoint1 IGNORE NULLS) OVER w AS f1, last_value(fixpoint2 IGNORE NULLS) OVER w AS f2
  FROM labels WINDOW w AS (PARTITION BY subject, run ORDER BY run_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
steps AS (
  SELECT *, CASE WHEN lag(f1) OVER w IS NULL OR lag(f1) OVER w IS DISTINCT FROM f1 OR lag(f2) OVER w IS NULL OR lag(f2) OVER w IS DISTINCT FROM f2 THEN 1 ELSE 0 END AS step
  FROM forward WINDOW w AS (PARTITION BY subject, run ORDER BY run_us)),
sections AS (
  SELECT * EXCLUDE (f1, f2, step), (sum(step) OVER (PARTITION BY subject, run ORDER BY run_us))::BIGINT AS section FROM steps),
modes AS (
  SELECT subject, run, section, percept AS aggregated,
    row_number() OVER (PARTITION BY subject, run, section ORDER BY count(*) DESC, percept) AS place
  FROM sections GROUP BY subject, run, section, percept),
labeled AS (SELECT s.*, m.aggregated FROM sections s JOIN modes m USING (subject, run, section) WHERE m.place = 1)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"
