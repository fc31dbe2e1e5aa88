"""Approximate nearest neighbours by inner product: a vantage-point tree per shard.

With M the greatest length of all vectors, x gets one more component sqrt(M^2 - |x|^2) and a query gets 0 there; then
the distance of a query from a vector falls as their inner product grows, and the triangle inequality holds. A subtree
whose distances from its vantage point lie in [low, high] is no nearer to a query at distance d than
max(d - high, low - d). That limit is multiplied by a factor before it prunes: factor 1 is exact search, a larger one
reads fewer leaves and may miss neighbours.
"""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored
from quire.llm.vector_shards import Node, halves, read_leaves, search, top, usable


def lifted(x: np.ndarray, reach: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(reach**2 - (x**2).sum(axis=1), 0))[:, None]], axis=1)


def vp_tree(leaf_rows: int, reach: float):
    """reach: M, no vector is longer."""

    def describe(node: Node, x: np.ndarray) -> np.ndarray:
        tries = x[:: max(1, len(x) // 8)][:8]  # the one that spreads the rows best
        far = [np.sqrt(np.maximum(((x - t) ** 2).sum(axis=1), 0)) for t in tries]
        pick = int(np.argmax([f.std() for f in far]))
        node.center = tries[pick]
        return far[pick]

    return lambda x: halves(lifted(x, reach), leaf_rows, describe)


def vp_bounds(factor: float, reach: float):
    def bounds(q: np.ndarray, root: Node, leaves: int, known: np.ndarray) -> np.ndarray:
        out = np.full((len(q), leaves), -np.inf)
        long2 = (q**2).sum(axis=1)
        q = np.concatenate([q, np.zeros((len(q), 1))], axis=1)

        def visit(node: Node, rows: np.ndarray, least: np.ndarray) -> None:
            most = (long2[rows] + reach**2 - (factor * least) ** 2) / 2
            keep = most >= known[rows] - 1e-9
            rows, least, most = rows[keep], least[keep], most[keep]
            if not len(rows):
                return
            if node.leaf >= 0:
                out[rows, node.leaf] = most
                return
            d = np.sqrt(np.maximum(((q[rows] - node.center) ** 2).sum(axis=1), 0))
            for child, (low, high) in zip((node.left, node.right), node.spans, strict=True):
                visit(child, rows, np.maximum(least, np.maximum(d - high, low - d) - 1e-9))

        if root is not None:
            visit(root, np.arange(len(q)), np.zeros(len(q)))
        return out

    return bounds


#: Factors that are tried, the exact one last.
FACTORS = (8.0, 7.0, 6.0, 5.0, 4.0, 3.5, 3.0, 2.5, 2.0, 1.75, 1.5, 1.25, 1.0)


def recall_and_leaves(x: np.ndarray, asked: np.ndarray, factor: float, reach: float, k: int, leaf_rows: int) -> tuple[float, float]:
    """The share of the true k best of x that a search for the rows `asked` finds, and the share of leaves that it reads,
    when it starts from the true k-th score, as the later of many shards do."""
    root, order, leaves = vp_tree(leaf_rows, reach)(x)
    v, q = x[order], x[asked]
    score = q @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    known = np.sort(score, axis=1)[:, -k] - 1e-9
    i, j, read = read_leaves(q, v, order, asked, leaves, vp_bounds(factor, reach)(q, root, len(leaves), known), k, known, None, 0.0)
    return float((score[i, order[j]] >= known[i]).sum() / (k * len(asked))), read / (len(asked) * len(leaves))


def tuned(rows: DataFrame, reach: float, k: int, leaf_rows: int, sample: int, least: float) -> float:
    """The greatest of FACTORS with which a search of a sample of vectors of one dimension reaches the recall `least`."""
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v", "dim").collect()  # a bounded sample
    dims = [r["dim"] for r in got]
    x = np.array([r["v"] for r in got if r["dim"] == max(set(dims), key=dims.count)]) if got else np.zeros((0, 1))
    if len(x) <= 2 * k:
        return 1.0
    asked = np.arange(0, len(x), max(1, len(x) // 128))
    return next(f for f in FACTORS if f == 1.0 or recall_and_leaves(x, asked, f, reach, k, leaf_rows)[0] >= least)


def nearest(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20, factor: float | None = None, shard_rows: int = 8192, block_rows: int = 4096, leaf_rows: int = 256, sample: int = 8192, recall: float = 0.98) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is_query selects, the k other rows found with the largest
    inner product, in double precision, nearest first, ties to the smaller id.

    is_query is a condition on the column vec_id. Every row is indexed. factor: 1 for exact search, more for less
    work and less recall; None for the greatest that reaches `recall` on a sample of `sample` vectors, a bounded one
    of the size of a shard. Null and all-zero vectors and such with null or non-finite components take no part; rows
    that repeat an id count once, with the least vector; vectors of different dimensions don't meet; an empty table
    returns no rows. shard_rows, block_rows: what one task holds at most."""
    rows = stored(usable(vectors, vec_id, vector, zero=False))
    reach = float(np.sqrt(rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0] or 0.0))
    factor = tuned(rows, reach, k, leaf_rows, sample, recall) if factor is None else factor
    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "dim")
    found = search(rows, asked, vp_tree(leaf_rows, reach), vp_bounds(factor, reach), k, shard_rows, block_rows, slack=1e-12 * max(1.0, reach**2))
    return top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
