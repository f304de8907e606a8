"""Balanced label propagation: documents are dealt to shards so that linked documents meet.

Documents that share a group (a hyperedge: equal texts, and equal values of more columns where
asked for) are linked. Every document starts in the shard its id hashes to. In each round Spark
joins count a group's members in each shard, every document that isn't where most of its
neighbours are (full shards left out) asks to move there, and a shard accepts as many as its quota
has room for.
Documents of the same groups that started in the same shard are alike, so the state is one row for
each such cell with a count: equal texts that are a third of all documents are some dozens of
rows, never one task's list. The labels are the result, but for the rows that a shard has beyond its
exact share: these, unlinked ones first, fill the shards that have fewer. For that, rows are
ranked by (shard, linked or not, group, doc_id) over range partitions.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small

SHARDS, ROUNDS = 40, 3
#: A shard takes in rows up to this share above its even part while labels are propagated.
SLACK = 0.25


def global_rank(df: DataFrame, by: list[Column | str], name: str, partitions: int) -> DataFrame:
    """df, written, with each row's rank from 0 in the order of by. Rows are ranked inside
    range partitions and moved by the rows of the partitions before; no task sees more than
    its range, and equal rows may take each other's rank."""
    inside = F.monotonically_increasing_id()
    ordered = df.repartitionByRange(partitions, *by).sortWithinPartitions(*by)
    placed = cut(ordered.withColumn("_at", inside), "ranked").withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = placed.groupBy("_part").count()  # one row a partition
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def propagate(cells: DataFrame, loads: DataFrame, shards: int, total: int, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """cells: (cell, groups array<long>, n, shard), documents that are alike, n of them; loads:
    (shard, load), the rows without links. cells after some rounds of moves."""
    quota = int(total / shards * (1 + slack)) + 1
    for _ in range(rounds):
        load = loads.unionByName(cells.groupBy("shard").agg(F.sum("n").alias("load"))).groupBy("shard").agg(F.sum("load").alias("load"))  # a row a shard
        load = F.broadcast(cut(load.select(F.col("shard").alias("to"), "load"), "loads"))
        each = cells.select("cell", "n", "shard", F.element_at("groups", 1).alias("first"), F.explode("groups").alias("group"))
        counts = each.groupBy("group", F.col("shard").alias("to")).agg(F.sum("n").alias("near"))
        votes = each.join(counts, "group").groupBy("cell", "shard", "first", "to").agg(F.sum("near").alias("near"))
        votes = votes.join(load, "to").filter(F.col("load") < quota)
        best = votes.groupBy("cell").agg(F.max_by("to", F.struct("near", F.xxhash64("first", "to"))).alias("to"))  # a group's ties have one winner
        state = cut(cells.join(best, "cell", "left").withColumn("to", F.coalesce("to", "shard")), "asks")
        asks = state.filter("shard != to").groupBy("to").agg(F.sum("n").alias("asked"))
        room = asks.join(load, "to", "left")
        share = F.greatest(F.lit(0.0), (F.lit(quota) - F.coalesce("load", F.lit(0))) / F.col("asked"))
        dice = F.pmod(F.xxhash64("cell", F.lit(17)), F.lit(1 << 20)) / F.lit(float(1 << 20))
        moved = state.join(F.broadcast(room.select("to", share.alias("share"))), "to", "left")
        goes = (F.col("shard") != F.col("to")) & (dice < F.coalesce("share", F.lit(0.0)))
        cells = cut(moved.select("cell", "groups", "n", F.when(goes, F.col("to")).otherwise(F.col("shard")).alias("shard")), "labels")
    return cells


def _even(loads: dict[int, int], shards: int, total: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """By shard: rows before it, its exact share, the surplus before it and the free places before it."""
    share = [total // shards + (s < total % shards) for s in range(shards)]
    before, over, free = [0], [0], [0]
    for s in range(shards):
        n = loads.get(s, 0)
        before.append(before[-1] + n)
        over.append(over[-1] + max(0, n - share[s]))
        free.append(free[-1] + max(0, share[s] - n))
    return before, share, over, free


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, link_by: tuple[str, ...] = ()) -> DataFrame:
    """Every row of docs (doc_id, text; other columns are ignored) with its shard and its slot
    there. Equal texts are linked, null texts with each other, empty texts too; with link_by, so
    are rows with equal values in one of these columns (null: no link). Ids may be null or
    repeated; each row has its own slot. An empty table gives an empty result.

    doc_id, size (UTF-8 bytes + 16), text_crc32, law ('rows'), shard, slot, grown_shard (null)."""
    spark = docs.sparkSession
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    text = F.col("text")
    more = [F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(c), F.col(c))) for c in link_by]
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit("")), text.isNull()).alias("_hash"),
        F.array_compact(F.array(F.lit(None).cast("long"), *more)).alias("_more"),
    )
    same = F.xxhash64("_hash", "text_crc32", "size")
    slim = slim.withColumn("group", same).withColumn("groups", F.concat(F.array("group"), "_more")).drop("_hash", "_more")
    slim = slim.withColumn("home", F.pmod(F.xxhash64("doc_id", "group"), F.lit(shards)).cast("int"))
    slim = cut(slim.withColumn("cell", F.xxhash64("groups", "home")), "slim")
    total = slim.count()
    cells = cut(slim.groupBy("cell").agg(F.first("groups").alias("groups"), F.count("*").alias("n"), F.first("home").alias("shard")), "cells")
    several = cells.select("n", F.explode("groups").alias("group")).groupBy("group").agg(F.sum("n").alias("n")).filter("n > 1").select("group")
    tied = cells.select("cell", F.explode("groups").alias("group")).join(several, "group", "left_semi").select("cell").distinct()
    tied = cut(cells.join(tied, "cell", "left_semi"), "labels")
    alone = cut(cells.join(tied.select("cell"), "cell", "left_anti").groupBy("shard").agg(F.sum("n").alias("load")), "loads")
    labels = propagate(tied, alone, shards, total, rounds)
    loads = dict(map(tuple, alone.unionByName(labels.groupBy("shard").agg(F.sum("n").alias("load"))).groupBy("shard").agg(F.sum("load")).collect()))  # a row a shard
    told = slim.join(small(labels.select("cell", F.col("shard").alias("label"))), "cell", "left")
    told = told.withColumns({"_free": F.col("label").isNull(), "label": F.coalesce("label", "home")}).drop("groups", "cell", "home")
    ranked = global_rank(told, ["label", "_free", "group", "doc_id"], "_rank", partitions)
    before, share, over, free = _even(loads, shards, total)
    at = lambda values, i: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (i + 1).cast("int"))
    place = F.col("_rank") - at(before, F.col("label"))
    moves = F.col("_place") >= at(share, F.col("label"))
    turn = at(over, F.col("label")) + F.col("_place") - at(share, F.col("label"))  # among all rows that move
    to = F.size(F.filter(F.array(*[F.lit(v).cast("long") for v in free[1:]]), lambda v: v <= F.col("_turn"))).cast("int")
    out = ranked.withColumn("_place", place).withColumn("_turn", F.when(moves, turn)).withColumn("shard", F.when(moves, to).otherwise(F.col("label")))
    taken = at([loads.get(s, 0) for s in range(shards)], F.col("shard"))
    slot = F.when(F.col("_turn").isNull(), F.col("_place")).otherwise(taken + F.col("_turn") - at(free, F.col("shard")))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
