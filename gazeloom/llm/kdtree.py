"""Exact top-k inner product with a KD-tree per shard.

A tree parts its points at the median of the dimension with the widest spread and keeps a tight
box for every node. Over a box, the inner product with q is at most the sum of
max(q_j lo_j, q_j hi_j); nodes are visited best bound first, and a node is passed over only if
its bound is below the k-th score so far, so ties are found. The k-th score starts from what a
first shard gave the query's block, carried to all the other shards.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import cut

LEAF = 256
_HITS = vectors.HIT_SCHEMA.format(score="long")
_NONE = -(2**63)


def build(rows: np.ndarray, ids: np.ndarray, points: np.ndarray) -> bytes:
    """The tree over points: nodes in preorder with boxes, point ranges and children."""
    order, nodes = np.arange(len(ids)), []
    todo = [(0, len(ids), -1, 0)]
    while todo:
        start, end, parent, side = todo.pop()
        at = len(nodes)
        own = points[order[start:end]]
        low, high = own.min(axis=0), own.max(axis=0)
        nodes.append([low, high, start, end, -1, -1])
        if parent >= 0:
            nodes[parent][4 + side] = at
        wide = high - low
        axis = int(np.argmax(wide))
        if end - start > LEAF and wide[axis] > 0:
            middle = (end - start) // 2
            order[start:end] = order[start:end][np.argsort(own[:, axis], kind="stable")]
            todo += [(start + middle, end, at, 1), (start, start + middle, at, 0)]
    return vectors.to_image(rows=rows[order], ids=ids[order], points=points[order], low=np.array([n[0] for n in nodes]), high=np.array([n[1] for n in nodes]), nodes=np.array([n[2:] for n in nodes], np.int64))


def search(tree: dict[str, np.ndarray], query_rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> list[tuple[int, int, int, int]]:
    """(query_row, query_id, vec_id, score) of each query's best k points here that reach its kth."""
    rows, ids, points, nodes = tree["rows"], tree["ids"], tree["points"], tree["nodes"].tolist()
    top = float(np.abs(points).max(initial=0)) * float(np.abs(queries).max(initial=0)) * points.shape[1]
    kind = np.float64 if top < 2**53 else object  # doubles hold these integers exactly, or Python's do
    points, queries = points.astype(kind), queries.astype(kind)
    bounds = np.maximum(queries, 0) @ tree["high"].astype(kind).T + np.minimum(queries, 0) @ tree["low"].astype(kind).T
    out = []
    for i, (query_row, query_id) in enumerate(zip(query_rows.tolist(), query_ids.tolist())):
        q, bound, least = queries[i], bounds[i], int(kth[i])
        found: list[tuple[int, int]] = []  # (score, -vec_id), the worst of k first
        heap = [(-bound[0], 0)]
        while heap and -heap[0][0] >= least:
            _, node = heapq.heappop(heap)
            start, end, left, right = nodes[node]
            if left >= 0:
                for child in (left, right):
                    if bound[child] >= least:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            scores = points[start:end] @ q
            near = np.flatnonzero(scores >= least)
            if len(near) > 4 * k:
                cutoff = np.partition(scores[near].astype(np.float64), -(k + 1))[-(k + 1)]  # one more: the query itself may be here
                near = near[scores[near] >= cutoff]
            for j in near.tolist():
                hit = (int(scores[j]), -int(ids[start + j]))
                if rows[start + j] == query_row:
                    continue
                if len(found) < k:
                    heapq.heappush(found, hit)
                elif hit > found[0]:
                    heapq.heapreplace(found, hit)
            if len(found) == k:
                least = max(least, found[0][0])
        out += [(query_row, query_id, -minus, score) for score, minus in found]
    return out


def top_k(table: DataFrame, every: int = 50, k: int = 5, shard_rows: int = vectors.SHARD_ROWS) -> DataFrame:
    """For each row of table (vec_id, embedding; more columns are ignored) whose vec_id is
    divisible by `every`, its k highest integer inner products among all other rows of its
    dimension, over floor(256 x). Rows that take no part: see vectors.usable. An empty table
    gives an empty result; with fewer rows than k there are fewer hits.

    query_id, rank, vec_id, score (a score beyond 64 bits is an error)."""
    rows = vectors.usable(table, drop_zero=False)
    rows = cut(rows.withColumn("vec", F.transform("vec", lambda x: F.floor(256.0 * x))), "vectors")
    shards = vectors.shard_images(rows, build, shard_rows)
    blocks = vectors.query_blocks(rows, F.pmod("vec_id", F.lit(every)) == 0)

    def first(pair: dict) -> pa.RecordBatch:
        block = vectors.from_image(pair["queries"])
        hits = search(vectors.from_image(pair["image"]), block["rows"], block["ids"], block["vecs"], np.full(len(block["ids"]), _NONE), k)
        kept: dict[int, list[int]] = {}
        for q, _, _, score in hits:
            kept.setdefault(q, []).append(score)
        kth = np.array([min(kept[q]) if len(kept.get(q, ())) == k else _NONE for q in block["rows"].tolist()], np.int64)
        found = np.array(hits, np.int64).reshape(-1, 4)
        return pa.RecordBatch.from_arrays([pa.array([pair["dim"]], pa.int32()), pa.array([pair["block"]], pa.int32()), pa.array([vectors.to_image(kth=kth, hits=found)], pa.binary())], names=["dim", "block", "begun"])

    def rest(pair: dict) -> pa.RecordBatch:
        block = vectors.from_image(pair["queries"])
        return batch_of(search(vectors.from_image(pair["image"]), block["rows"], block["ids"], block["vecs"], vectors.from_image(pair["begun"])["kth"], k))

    def unpack(row: dict) -> pa.RecordBatch:
        return batch_of(vectors.from_image(row["begun"])["hits"].tolist())

    def batch_of(hits: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([h[i] for h in hits], pa.int64()) for i in range(4)], names=["query_row", "query_id", "vec_id", "score"])

    home = F.col("shard") == F.pmod("block", "shards")
    begun = cut(vectors.pairs(blocks, shards, home).mapInArrow(vectors.each_pair(first), "dim int, block int, begun binary"), "begun")
    others = vectors.pairs(blocks.join(begun, ["dim", "block"]), shards, ~home).mapInArrow(vectors.each_pair(rest), _HITS)
    return vectors.best(begun.mapInArrow(vectors.each_pair(unpack), _HITS).unionByName(others), k)
