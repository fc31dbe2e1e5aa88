"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

A ball with centre c and radius r holds no vector whose inner product with q is above q.c + |q| r. Leaves are read in
the order of that bound. The shards share the current k-th score: a first round reads only each shard's most
promising leaf, and the k-th best of all these is where every shard's full search starts.

On vectors without clusters, such as points spread evenly over a sphere of 64 dimensions, no ball is far from any query
and nearly all leaves are read; the search stays exact.
"""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored
from quire.llm.vector_shards import Node, halves, search, top, usable


def ball_tree(leaf_rows: int):
    def describe(node: Node, x: np.ndarray) -> np.ndarray:
        node.center = x.mean(axis=0)
        far = ((x - node.center) ** 2).sum(axis=1)
        node.radius = float(np.sqrt(far.max()))
        a = x[far.argmax()]
        b = x[((x - a) ** 2).sum(axis=1).argmax()]
        return x @ (b - a)

    return lambda x: halves(x, leaf_rows, describe)


def bounds(q: np.ndarray, root: Node, leaves: int, known: np.ndarray) -> np.ndarray:
    out, length = np.full((len(q), leaves), -np.inf), np.sqrt((q**2).sum(axis=1))

    def visit(node: Node, rows: np.ndarray, above: np.ndarray) -> None:
        most = q[rows] @ node.center + length[rows] * node.radius
        most = np.minimum(above, most + 1e-9 * (1 + np.abs(most)))
        keep = most >= known[rows]
        rows, most = rows[keep], most[keep]
        if not len(rows):
            return
        if node.leaf >= 0:
            out[rows, node.leaf] = most
        else:
            visit(node.left, rows, most)
            visit(node.right, rows, most)

    visit(root, np.arange(len(q)), np.full(len(q), np.inf))
    return out


def top_k(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 64.0, k: int = 20, shard_rows: int = 8192, block_rows: int = 4096, leaf_rows: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is_query selects, the k other rows with the largest inner
    product, ties to the smaller id, where each component x counts as floor(scale * x), so scores are whole numbers.

    is_query is a condition on the column vec_id. Queries with fewer than k candidates return all of them. Null
    vectors and such with null or non-finite components take no part; rows that repeat an id count once, with the
    least vector; vectors of different dimensions don't meet; an empty table returns no rows. Scores are exact while
    they stay below 2**53. shard_rows, block_rows: what one task holds at most."""
    rows = stored(usable(vectors, vec_id, vector, lambda x: F.floor(x * F.lit(scale))))
    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "dim")
    found = top(search(rows, asked, ball_tree(leaf_rows), bounds, k, shard_rows, block_rows), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast("long").alias("score"))
