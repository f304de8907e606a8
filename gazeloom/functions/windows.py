"""Window shapes shared by the operators.

Every operator over the samples of a run uses the one window of `run_order`, so that one exchange
and one sort serve many columns. Long frames are replaced by running sums and fixed offsets, and
"next value" by "last value" in descending order, since neither depends on the frame's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

RUN = ("subject", "run")
TRIAL = (*RUN, "trial")


def run_order(descending: bool = False) -> WindowSpec:
    return Window.partitionBy(*RUN).orderBy(F.desc("run_us") if descending else F.asc("run_us"))


def trial_order(descending: bool = False) -> WindowSpec:
    return Window.partitionBy(*TRIAL).orderBy(F.desc("trial_us") if descending else F.asc("trial_us"))


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def last_known(c: Column | str, w: WindowSpec) -> Column:
    """The last value that isn't null, up to and with this row; over a descending order, the
    next one."""
    return F.last(c, ignorenulls=True).over(so_far(w))


def running(c: Column | str, w: WindowSpec) -> Column:
    return F.sum(c).over(so_far(w))


def changed(c: Column | str, w: WindowSpec) -> Column:
    """1 where the value differs from the row before (nulls equal each other), and on the first
    row."""
    c = F.col(c) if isinstance(c, str) else c
    first = F.row_number().over(w) == 1
    return F.when(first | ~F.lag(c).over(w).eqNullSafe(c), 1).otherwise(0)


def mirrored(df: DataFrame, keys: tuple[str, ...], order: str, value: Column, before: int, after: int, row: Column | None = None) -> DataFrame:
    """(keys, _at, _value, _own, _row): each group's series by position from 0, continued by `before`
    and `after` places with reflected edges (d c b a | a b c d | d c b a), however short it is.
    _own marks the real places, which carry `row` where one is given."""
    w = Window.partitionBy(*keys)
    rows = df.select(*keys, (F.row_number().over(w.orderBy(order)) - 1).cast("long").alias("_i"), F.count("*").over(w).alias("_n"), value.alias("_value"), (F.lit(None) if row is None else row).alias("_row"))
    turns = F.ceil(F.lit(float(max(before, after))) / F.col("_n")).cast("int") + 1
    period = F.sequence(-turns, turns)
    even = F.transform(period, lambda k: 2 * F.col("_n") * k + F.col("_i"))
    odd = F.transform(period, lambda k: 2 * F.col("_n") * k - 1 - F.col("_i"))
    places = F.filter(F.concat(even, odd), lambda p: (p >= -before) & (p < F.col("_n") + after))
    out = rows.select(*keys, F.explode(places).alias("_at"), "_value", "_n", "_row").withColumn("_own", (F.col("_at") >= 0) & (F.col("_at") < F.col("_n")))
    return out.drop("_row") if row is None else out.withColumn("_row", F.when(F.col("_own"), F.col("_row")))


def moving_sums(rows: DataFrame, keys: tuple[str, ...], measures: dict[str, Column], size: int) -> DataFrame:
    """For the real places of mirrored rows the sums of measures over a window of `size` places,
    size // 2 of them before."""
    w = Window.partitionBy(*keys).orderBy("_at")
    before, after = size // 2, size - size // 2 - 1
    run = {f"_{k}": running(c, w) for k, c in measures.items()}
    out = rows.withColumns(run)
    moving = {k: F.lead(f"_{k}", after).over(w) - F.coalesce(F.lag(f"_{k}", before + 1).over(w), F.lit(0)) for k in measures}
    return out.withColumns(moving).filter("_own").select(*keys, "_at", *measures, *(c for c in rows.columns if c == "_row"))
