"""Mixing sources to target weights by Pareto order sampling.

Every source has a target number of words. A document's expected number of copies is in
proportion to a power of its length (times a weight of its own where one is given), at most
`most`, and such that the expected words of the source meet its target. The whole part is
certain; the fraction is the inclusion probability p, which differs inside a source. Documents of a
source are ranked by random odds over inclusion odds, [u / (1 - u)] / [p / (1 - p)], and drawn in
that order as long as they fit into the words still wanted: a sample of fixed size (in words) with
unequal probabilities. What the length of the first one that doesn't fit leaves open is filled by
further documents that are short enough, long ones first, until no document is. u is a hash of the document, so
reruns agree.

No source's documents meet in one task: weights are by classes of documents, the cut is found by
summing words into 65,536 ranges of ranks, and only the documents of the one range that holds
the cut are ordered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small, word_count

WEIGHTS, MOST_COPIES = (1, 2, 3), 3
#: A document twice as long is expected 2 ** LENGTH_POWER times as often (0: all alike).
LENGTH_POWER = 0.25
_RANGES = 1 << 16


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """sizes: (source, source_size), a row a source. With target: shares of all words by
    weights that repeat in the order of sources (code points, null last); no target exceeds
    `most` times the source's size, and what that leaves over is shared among the others by
    weight until none exceeds it."""
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source, not a document
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    table = cut(sizes.withColumn("_w", pick).withColumn("_cap", F.lit(float(most)) * F.col("source_size")), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0  # words for each unit of weight; capped sources stay capped as it rises
    while True:
        free = F.col("_cap") > F.lit(level) * F.col("_w")
        row = table.agg(F.sum(F.when(~free, F.col("_cap"))), F.sum(F.when(free, F.col("_w")))).first()
        raised = (total - (row[0] or 0.0)) / row[1] if row[1] else level
        if not row[1] or raised <= level * (1 + 1e-12):
            break
        level = raised
    return table.select("source", "source_size", F.least(F.col("_cap"), F.lit(level) * F.col("_w")).cast("double").alias("target"))


def _unit(*cols: Column | str) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))


def _near(table: DataFrame, *more: str) -> tuple[DataFrame, Column]:
    """A small table by source (and more columns), and what joins it to documents."""
    same = F.col("source").eqNullSafe(F.col("_source"))
    for name in more:
        table, same = table.withColumnRenamed(name, f"_{name}"), same & (F.col(name) == F.col(f"_{name}"))
    return small(table.withColumnRenamed("source", "_source")), same


def _expected(cells: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """cells: (source, class, weight, words), a row for each class of documents of a source. With
    source_size, target and copies: the least of `most` and weight times a factor of the
    source, such that copies times words add up to the target."""
    joined = cells.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    heavy = Window.partitionBy("source").orderBy(F.desc("weight"), "class").rowsBetween(Window.unboundedPreceding, -1)
    light = Window.partitionBy("source").orderBy(F.asc("weight"), F.desc("class")).rowsBetween(Window.unboundedPreceding, 0)
    # If the heavier classes are full, the rest share what is left; the first class that then stays within `most` sets the factor.
    left = F.col("target") - F.lit(float(most)) * F.coalesce(F.sum("words").over(heavy), F.lit(0))
    mass = F.sum(F.col("weight") * F.col("words")).over(light)
    steps = joined.withColumn("_factor", F.when(mass > 0, left / mass).otherwise(F.lit(0.0)))
    fits = F.when((F.col("weight") > 0) & (F.col("_factor") * F.col("weight") <= F.lit(float(most) * (1 + 1e-12))), F.col("_factor"))
    factor = F.coalesce(F.max_by(fits, F.when(fits.isNotNull(), F.col("weight"))).over(Window.partitionBy("source")), F.lit(float("inf")))
    return steps.withColumn("copies", F.least(F.lit(float(most)), F.when(F.col("weight") > 0, factor * F.col("weight")).otherwise(F.lit(0.0)))).drop("_factor")


def _place(fills: Column | bool) -> Column:
    """Where a document stands in a step's order: by its rank; in steps that fill a gap, by its length's class (a power
    of two, long ones first, so that a gap takes few documents), then its rank."""
    fills = F.lit(fills) if isinstance(fills, bool) else fills
    return F.col("_rank") + F.when(fills, 64 - F.length(F.bin("size"))).otherwise(F.lit(0))


def _drawn() -> Column:
    """Whether a document, joined with its source's steps, is drawn by one of them: not too long for it, and
    not behind the last place that it took."""
    upto = lambda s: F.struct(_place(s["fills"]).alias("place"), F.col("_row").alias("row")) <= s["upto"]
    return F.coalesce(F.exists("_steps", lambda s: (F.col("size") <= s["longest"]) & upto(s)), F.lit(False))


def _step(ranked: DataFrame, state: DataFrame, fills: bool) -> DataFrame:
    """state: (source, _gap, _longest, _steps). In the order of places, the documents that no step has drawn and that are
    not longer than _longest, until one doesn't fit into the gap: state with one more step and the gap that is left, for
    the sources that still have such documents. Written."""
    near, same = _near(state)
    left = ranked.join(near, same).drop("_source").filter(F.col("_rank").isNotNull() & (F.col("size") <= F.col("_longest")) & ~_drawn()).withColumn("_at", _place(fills)).withColumn("_range", F.floor(F.col("_at") * F.lit(float(_RANGES))).cast("int"))
    sums = cut(left.groupBy("source", "_range").agg(F.sum("size").alias("_words"), F.first("_gap").alias("_gap")), "ranges")
    upto = F.sum("_words").over(Window.partitionBy("source").orderBy("_range"))  # 65,536 rows a source and class at most
    over = sums.withColumn("_upto", upto).filter("_upto > _gap").groupBy("source").agg(F.min("_range").alias("_end"), F.min_by(F.col("_gap") - F.col("_upto") + F.col("_words"), "_range").alias("_room"))
    ends = cut(sums.groupBy("source").agg((F.first("_gap") - F.sum("_words")).alias("_rest")).join(over.withColumnRenamed("source", "_o"), F.col("source").eqNullSafe(F.col("_o")), "left").drop("_o"), "ends")
    near, same = _near(ends.filter("_end is not null").select("source", F.col("_end").alias("_e"), "_room"))
    edge = left.join(near, same).filter(F.col("_range") == F.col("_e")).drop("_source")
    run = F.sum("size").over(Window.partitionBy("source").orderBy("_at", "_row").rowsBetween(Window.unboundedPreceding, 0))
    last = edge.withColumn("_run", run).filter("_run <= _room").groupBy("source").agg(F.max(F.struct(F.col("_at").alias("place"), F.col("_row").alias("row"))).alias("_last"), F.max("_run").alias("_taken"))
    told = ends.join(last.withColumnRenamed("source", "_o"), F.col("source").eqNullSafe(F.col("_o")), "left").drop("_o")
    # All that are left fit; or all before the range of the first that doesn't, and some of that range.
    before = F.struct((F.col("_end") / F.lit(float(_RANGES))).alias("place"), F.lit(-1).cast("bigint").alias("row"))
    key = F.when(F.col("_end").isNull(), F.struct(F.lit(float("inf")).alias("place"), F.lit(0).cast("bigint").alias("row"))).otherwise(F.coalesce("_last", before))
    gap = F.when(F.col("_end").isNull(), F.col("_rest")).otherwise(F.col("_room") - F.coalesce("_taken", F.lit(0)))
    told = told.select(F.col("source").alias("_o"), key.alias("_key"), gap.alias("_now"))
    step = F.array(F.struct(F.lit(fills).alias("fills"), F.col("_longest").alias("longest"), F.col("_key").alias("upto")))
    out = state.join(told, F.col("source").eqNullSafe(F.col("_o")))
    return cut(out.select("source", F.col("_now").alias("_gap"), F.col("_now").alias("_longest"), F.concat("_steps", step).alias("_steps")), "steps")


def _draw(ranked: DataFrame, most: int) -> DataFrame:
    """ranked: source, size, target, copies (whole ones), _rank, _row and more, written. copies with those drawn. The first step
    takes all documents that come before the first one that doesn't fit into the words still wanted; further steps go on
    with the documents that are short enough for the gap, and then once more with one more copy of
    them, until none is short enough. If the shortest one then brings its source nearer to
    its target from above, it is drawn too. A step is a row a source; documents are written once for each copy
    more, `most` times at most."""
    may = F.col("_rank").isNotNull() & (F.col("copies") < most)
    longest, fills = F.lit(float("inf")), False
    while True:
        wanted = ranked.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("_gap"))
        none = F.expr("cast(array() as array<struct<fills:boolean,longest:double,upto:struct<place:double,row:bigint>>>)")
        state = cut(wanted.filter("_gap > 0").select("source", "_gap", longest.alias("_longest"), none.alias("_steps")), "steps")
        open_, done = ranked.withColumn("_rank", F.when(may, F.col("_rank"))), []
        while True:
            after = _step(open_, state, fills)
            done.append(state.join(after.select(F.col("source").alias("_o")), F.col("source").eqNullSafe(F.col("_o")), "left_anti"))
            if after.isEmpty():
                break
            state, fills = after, True
        if len(done) == 1:
            break
        near, same = _near(cut(reduce(DataFrame.unionByName, done).select("source", "_steps"), "steps"))
        ranked = cut(ranked.join(near, same, "left").withColumn("copies", F.col("copies") + (_drawn() & may).cast("int")).select(ranked.columns), "pareto")
        longest = F.col("_gap")
    near, same = _near(state.select("source", "_gap"))
    shortest = ranked.filter(may).join(near, same).groupBy("source").agg(F.min(F.struct("size", "_rank", "_row")).alias("_min"), F.first("_gap").alias("_gap"))
    nearer = cut(shortest.filter(F.col("_min.size") < 2 * F.col("_gap")).select(F.col("_min._row").alias("_one")), "nearer")  # a row a source at most
    out = ranked.join(small(nearer), F.col("_row") == F.col("_one"), "left")
    return out.withColumn("copies", F.col("copies") + F.col("_one").isNotNull().cast("int")).select(ranked.columns)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 5, length_power: float = LENGTH_POWER, weight_col: str | None = None) -> DataFrame:
    """How much of every row of docs (doc_id, text, source; more columns are ignored) the mix
    takes. A null text has size 0, a null source is a source of its own. Repeated rows are
    drawn each for itself; rows that agree in all of these columns share their random number,
    so which of them is taken makes no difference. An empty table gives an empty result.
    length_power: see LENGTH_POWER; lengths count by powers of two. weight_col: positive weights
    of documents besides, of few distinct values (missing: 1).

    doc_id, size, source_size, target, taken (words, whole copies)."""
    ranked = _copies(docs, weights, most, seed, length_power, weight_col)
    return ranked.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def repeat(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 5, length_power: float = LENGTH_POWER) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; see mix(). Documents without words
    take no part in the counts and stay once. Rows that share a doc_id are counted together:
    each is repeated as often as the first of them."""
    taken = _copies(docs, weights, most, seed, length_power, None)
    times = taken.filter("size > 0 and copies != 1").groupBy("doc_id").agg(F.min("copies").cast("int").alias("_copies"))
    times = cut(times.withColumnRenamed("doc_id", "_id"), "copies")
    # The row as one column: its own columns may have any names.
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("doc_id").cast("long").alias("_key"))
    out = rows.join(small(times), F.col("_key").eqNullSafe(F.col("_id")), "left").withColumn("_copies", F.coalesce("_copies", F.lit(1)))
    return out.filter("_copies > 0").select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_doc.*")


def _copies(docs: DataFrame, weights: tuple[int, ...], most: int, seed: int, length_power: float, weight_col: str | None) -> DataFrame:
    own = F.coalesce(F.col(weight_col).cast("double"), F.lit(1.0)) if weight_col else F.lit(1.0)
    dice = _unit(F.lit(seed), F.col("doc_id"), F.coalesce("source", F.lit("")), F.col("source").isNull(), F.coalesce("text", F.lit("")))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), dice.alias("_u"), own.alias("_own"))
    weight = F.when(F.col("size") > 0, F.col("_own") * F.pow(F.lit(2.0), F.lit(length_power) * F.length(F.bin("size")))).otherwise(F.lit(0.0))
    slim = cut(slim.withColumn("weight", weight).withColumn("class", F.xxhash64("weight")).drop("_own"), "sizes")
    cells = cut(slim.groupBy("source", "class").agg(F.first("weight").alias("weight"), F.sum("size").alias("words")), "cells")
    targets = source_targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    expected = cut(_expected(cells, targets, most).select("source", "class", "source_size", "target", "copies"), "expected")
    near, same = _near(expected, "class")
    # 1e-9: a target of exactly `most` times the size must not lose a copy to rounding.
    whole = F.floor(F.col("copies") + F.lit(1e-9))
    p = F.greatest(F.lit(0.0), F.col("copies") - whole)
    odds = (F.col("_u") / (1 - F.col("_u"))) / (p / (1 - p))
    rank = F.when((p > 1e-6) & (F.col("size") > 0), F.least(odds / (1 + odds), F.lit(1 - 2.0**-52)))
    ranked = slim.join(near, same).select("doc_id", "source", "size", "source_size", "target", whole.alias("copies"), rank.alias("_rank"))
    ranked = cut(ranked.withColumn("_row", F.monotonically_increasing_id()), "pareto")
    return _draw(ranked, most)
