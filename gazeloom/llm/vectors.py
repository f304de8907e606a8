"""Vector tables cut into shards and query blocks, for searches of every query in every shard.

A shard is a few thousand rows by a hash of their ids, indexed in one task and kept as one
binary row. Queries are packed into blocks of about a thousand. A search joins blocks with
shards, so a task holds one block and one shard at a time, however large the table is.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARD_ROWS, BLOCK_ROWS = 8192, 1024
HIT_SCHEMA = "query_row long, query_id long, vec_id long, score {score}"


def to_image(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def from_image(image: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(image), allow_pickle=False) as f:
        return {k: f[k] for k in f.files}


def usable(table: DataFrame, drop_zero: bool) -> DataFrame:
    """(row, vec_id, vec array<double>, dim) of the rows that take part: id and vector not null, no
    null or non-finite component, at least one component (with drop_zero: not all zero). Rows
    that repeat an id stand each for itself, told apart by `row`. To be written before use."""
    vec = F.col("embedding").cast("array<double>")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~bad & (F.size("vec") > 0))
    if drop_zero:
        rows = rows.filter(F.exists("vec", lambda x: x != 0))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vec", F.size("vec").alias("dim"))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def shard_images(rows: DataFrame, build: Callable[[np.ndarray, np.ndarray, np.ndarray], bytes], shard_rows: int) -> DataFrame:
    """(dim, shard, shards, image): each shard of rows indexed by build(row, vec_id, vec)."""
    sizes = rows.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(float(shard_rows))).cast("int").alias("shards"))
    dealt = rows.join(F.broadcast(sizes), "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id", "row"), F.col("shards")).cast("int"))

    def index(group: pa.Table) -> pa.Table:
        order = np.argsort(group["vec_id"].to_numpy(), kind="stable")
        dim = group["dim"][0].as_py()
        image = build(group["row"].to_numpy()[order], group["vec_id"].to_numpy()[order], matrix(group["vec"], dim)[order])
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([group["shard"][0].as_py()], pa.int32()), "shards": pa.array([group["shards"][0].as_py()], pa.int32()), "image": pa.array([image], pa.binary())})

    return cut(dealt.groupBy("dim", "shard").applyInArrow(index, "dim int, shard int, shards int, image binary"), "shards")


def query_blocks(rows: DataFrame, is_query: Column, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(dim, block, image): the queries among rows, packed."""
    picked = cut(rows.filter(is_query), "queries")
    sizes = picked.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(float(block_rows))).cast("int").alias("blocks"))
    dealt = picked.join(F.broadcast(sizes), "dim").withColumn("block", F.pmod(F.xxhash64("vec_id", "row", F.lit(3)), F.col("blocks")).cast("int"))

    def pack(group: pa.Table) -> pa.Table:
        order = np.argsort(group["vec_id"].to_numpy(), kind="stable")
        dim = group["dim"][0].as_py()
        image = to_image(rows=group["row"].to_numpy()[order], ids=group["vec_id"].to_numpy()[order], vecs=matrix(group["vec"], dim)[order])
        return pa.table({"dim": pa.array([dim], pa.int32()), "block": pa.array([group["block"][0].as_py()], pa.int32()), "image": pa.array([image], pa.binary())})

    return cut(dealt.groupBy("dim", "block").applyInArrow(pack, "dim int, block int, image binary"), "blocks")


def pairs(blocks: DataFrame, shards: DataFrame, which: Column | None = None) -> DataFrame:
    """A row for each block and shard of its dimension (those for which `which` holds, over
    dim, block, shard and shards), with both images and the block's other columns."""
    numbers = shards.groupBy("dim").agg(F.max("shards").alias("shards"))
    spread = blocks.withColumnRenamed("image", "queries").join(F.broadcast(numbers), "dim")
    spread = spread.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    if which is not None:
        spread = spread.filter(which)
    return spread.drop("shards").join(shards.drop("shards"), ["dim", "shard"])


def each_pair(fn: Callable[[dict], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield fn({name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)})

    return run


def best(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each query row, ranked from 1; ties to the smaller vec_id."""
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
