"""Exact and approximate top-k search by a tree per shard.

Vectors are dealt into shards by the nearest of some pivots, large regions in several shards, so that a shard's ball is
tight where the data have clusters. Each shard's tree is built once and stored beside its vectors. Queries are dealt
into blocks of bounded size by the same pivots. A query goes to the shards whose ball may reach its k-th score so far;
each pair of a shard and a block with such a query is one group of a cogroup, so no task holds more than one shard and
one block. A group gives each query an upper bound of the score in each leaf, and reads leaves in the order of these
bounds until no leaf can reach the query's k-th score.

A first round reads one leaf of each shard and gives a score that the k-th best row reaches; the second round starts
from it, so a shard gives back only rows that may be among the best.
"""

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import lean, stored, tidy

FOUND = "query_id long, vec_id long, score double"
#: Pivots at most, and bytes of the shards' balls that go to every task; with more, queries go to all shards.
PIVOTS, BALLS = 256, 64_000_000


@dataclass
class Node:
    """A subtree over rows[start:end] of the shard; left and right are None in a leaf."""

    start: int
    end: int
    center: np.ndarray | None = None
    radius: float = 0.0
    spans: tuple = ()
    left: "Node | None" = None
    right: "Node | None" = None
    leaf: int = -1


def usable(df: DataFrame, vec_id: str, vector: str, element: Callable[[Column], Column] = lambda x: x, zero: bool = True) -> DataFrame:
    """(vec_id, v array<double>, dim): a row per id. Rows with a null id or vector, or with null or non-finite
    components, are left out, and all-zero vectors too unless zero; of rows that repeat an id the least vector
    counts. Other columns are dropped, so extra columns of any name do no harm."""
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite)
    if not zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    return rows.select("vec_id", F.transform("v", element).cast("array<double>").alias("v"), F.size("v").alias("dim"))


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), dim)


def halves(x: np.ndarray, leaf_rows: int, describe: Callable) -> tuple[Node, np.ndarray, list[Node]]:
    """A balanced tree over x's rows: its root, the order that puts each node's rows together, and its leaves.

    describe(node, rows of x) fills in what the node knows of its rows and returns a key; the half of the rows with
    the smaller keys goes left. Rows of x come by id and stay so in a leaf, so that ties there are in order."""
    order, leaves = np.arange(len(x)), []

    def build(start: int, end: int) -> Node:
        here = Node(start, end)
        key = describe(here, x[order[start:end]])
        if end - start <= leaf_rows:
            order[start:end].sort()
            here.leaf = len(leaves)
            leaves.append(here)
            return here
        mid = (end - start) // 2
        part = np.argpartition(key, mid)
        order[start:end], key = order[start:end][part], key[part]
        here.spans = ((key[:mid].min(), key[:mid].max()), (key[mid:].min(), key[mid:].max()))
        here.left, here.right = build(start, start + mid), build(start + mid, end)
        return here

    return build(0, len(x)), order, leaves


def read_leaves(q: np.ndarray, v: np.ndarray, ids: np.ndarray, own: np.ndarray, leaves: list[Node], bound: np.ndarray, k: int, known: np.ndarray, most: int | None, slack: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (query, row) that hold each query's k best rows of this shard, and maybe more; and how many leaves were read.

    bound: the most that a row of the leaf can score, -inf where the tree ruled it out. known: a score that the k-th
    best row of all shards reaches. most: read so many leaves a query at most (None: as many as needed)."""
    order, least = np.argsort(-bound, axis=1, kind="stable"), known.copy()
    best = np.full((len(q), k), -np.inf)
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    read = 0
    for turn in range(len(leaves) if most is None else min(most, len(leaves))):
        leaf = order[:, turn]
        b = bound[np.arange(len(q)), leaf]
        active = np.flatnonzero((b > -np.inf) & (b >= least - slack))
        if not len(active):
            break
        read += len(active)
        active = active[np.argsort(leaf[active], kind="stable")]
        cuts = np.flatnonzero(np.diff(leaf[active])) + 1
        for rows in np.split(active, cuts):
            at = leaves[leaf[rows[0]]]
            score = q[rows] @ v[at.start : at.end].T
            score[ids[at.start : at.end][None, :] == own[rows][:, None]] = -np.inf
            both = np.concatenate([best[rows], score], axis=1)
            best[rows] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            least[rows] = np.maximum(least[rows], best[rows].min(axis=1))
            floor = least[rows][:, None] - slack
            hit = (score >= floor) & (score > -np.inf)
            if hit.sum(axis=1).max(initial=0) > 2 * k:  # ties: in a leaf, only the first k by id can count
                tie = hit & (score <= floor + 2 * slack)
                hit &= ~tie | (np.cumsum(tie, axis=1) <= k)
            i, j = np.nonzero(hit)
            hits.append((rows[i], j + at.start))
    if not hits:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), read
    return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits]), read


def best_of(pairs: tuple[np.ndarray, np.ndarray], q: np.ndarray, v: np.ndarray, qid: np.ndarray, ids: np.ndarray, k: int, known: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and of rows, and scores: each query's k best pairs that reach what is known, best first."""
    i, j = pairs
    score = np.concatenate([np.einsum("ij,ij->i", q[i[a : a + 65536]], v[j[a : a + 65536]]) for a in range(0, len(i), 65536)] or [np.zeros(0)])
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    keep = (np.arange(len(i)) - np.searchsorted(i, i) < k) & (score >= known[i] - slack)
    return i[keep], j[keep], score[keep]


def pivots_of(vectors: DataFrame, shard_rows: int, n: int) -> dict[int, np.ndarray]:
    """By dimension, the pivots: as many vectors as there are to be shards, at most PIVOTS, those whose ids have the least hashes."""
    got = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(PIVOTS, -(-n // shard_rows))).select("v", "dim").collect()
    return {d: np.array([r["v"] for r in got if r["dim"] == d]) for d in {r["dim"] for r in got}}


def with_region(rows: DataFrame, column: str, pivots: dict[int, np.ndarray]) -> DataFrame:
    """rows with `region`, the number of the nearest pivot of their dimension; 0 without one."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS vectors at most
    at, d = rows.columns.index(column), rows.columns.index("dim")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", region int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, region = batch.column(d).to_numpy(), np.zeros(batch.num_rows, np.int32)
            for dim, p in sent.value.items():
                own = np.flatnonzero(dims == dim)
                for part in np.array_split(own, -(-len(own) // 4096) or 1):
                    x = matrix(pa.chunked_array([batch.column(at).take(pa.array(part))]), dim)
                    region[part] = (x @ p.T - (p**2).sum(axis=1) / 2).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region)], names=[*batch.schema.names, "region"])

    return lean(rows).mapInArrow(tidy(run), schema)


def dealt(rows: DataFrame, id_: str, most: int, name: str) -> DataFrame:
    """rows with `name`, a part of at most about `most` rows: a region, or one of its lots where it has more."""
    counts = rows.groupBy("dim", "region").agg(F.ceil(F.count("*") / most).alias("lots"))
    both = rows.join(counts, ["dim", "region"])  # AQE broadcasts or splits: there are at most PIVOTS regions of a dimension
    return both.withColumn(name, F.concat_ws("/", "region", F.pmod(F.xxhash64(id_), F.col("lots")))).drop("lots")


def shards_of(vectors: DataFrame, pivots: dict[int, np.ndarray], tree: Callable, shard_rows: int) -> DataFrame:
    """A stored row for each shard: (dim, shard, center, radius, ids, v, tree). vectors: (vec_id, v, dim)."""
    schema = pa.schema([("dim", pa.int32()), ("shard", pa.string()), ("center", pa.list_(pa.float64())), ("radius", pa.float64()), ("ids", pa.binary()), ("v", pa.binary()), ("tree", pa.binary())])

    def build(rows: pa.Table) -> pa.Table:
        dim, ids = rows["dim"][0].as_py(), rows["vec_id"].to_numpy()
        by_id = np.argsort(ids, kind="stable")
        ids, v = ids[by_id], matrix(rows["v"], dim)[by_id]
        root, order, leaves = tree(v)
        v, ids = v[order], ids[order]
        center = v.mean(axis=0)
        radius = float(np.sqrt(((v - center) ** 2).sum(axis=1).max())) * (1 + 1e-9)
        row = [dim, rows["shard"][0].as_py(), center, radius, ids.tobytes(), v.tobytes(), pickle.dumps((root, leaves))]
        return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types, strict=True)], schema=schema)

    parts = dealt(with_region(vectors, "v", pivots), "vec_id", shard_rows, "shard")
    made = parts.groupBy("dim", "shard").applyInArrow(build, "dim int, shard string, center array<double>, radius double, ids binary, v binary, tree binary")
    return stored(made)


def routed(queries: DataFrame, shards: DataFrame) -> DataFrame:
    """queries (query_id, q, dim, block, known) with each `shard` of their dimension whose ball may hold a score that
    reaches `known`."""
    balls = shards.select("dim", "shard", "center", "radius")
    size = balls.agg(F.sum(F.col("dim") * 8 + 100)).first()[0] or 0
    if size > BALLS:
        return queries.join(balls.select("dim", "shard"), "dim").select("query_id", "q", "known", "dim", "block", "shard")
    by_dim: dict[int, tuple] = {}
    for r in balls.collect():
        by_dim.setdefault(r["dim"], ([], [], []))
        for into, x in zip(by_dim[r["dim"]], (r["shard"], r["center"], r["radius"]), strict=True):
            into.append(x)
    sent = queries.sparkSession.sparkContext.broadcast({d: (names, np.array(c), np.array(r)) for d, (names, c, r) in by_dim.items()})
    names = ["query_id", "q", "known", "dim", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims):
                shard, center, radius = sent.value.get(int(dim), ([], np.zeros((0, dim)), np.zeros(0)))
                own = np.flatnonzero(dims == dim)
                for part in np.array_split(own, -(-len(own) // 256)):
                    rows = batch.take(pa.array(part))
                    q, known = matrix(pa.chunked_array([rows.column(1)]), int(dim)), rows.column(2).to_numpy()
                    reach = q @ center.T + np.sqrt((q**2).sum(axis=1))[:, None] * radius
                    i, j = np.nonzero(reach + 1e-9 * (1 + np.abs(reach)) >= known[:, None])
                    if len(i):
                        yield pa.RecordBatch.from_arrays([*rows.take(pa.array(i)).columns, pa.array(np.array(shard, object)[j], pa.string())], names=[*names, "shard"])

    return lean(queries.select(*names)).mapInArrow(tidy(run), "query_id long, q array<double>, known double, dim int, block string, shard string")


def searched(shards: DataFrame, queries: DataFrame, bounds: Callable, k: int, most: int | None, slack: float, schema: str, answer: Callable) -> DataFrame:
    """What answer(query ids, places of queries, row ids, scores) makes of each pair of a shard and a block."""
    pairs = routed(queries, shards)
    needed = pairs.select("dim", "shard", "block").distinct()
    anew = lambda df: df.select(*(F.col(c).alias(c) for c in df.columns))  # noqa: E731  a self-cogroup needs attributes of its own
    left = anew(shards.select("dim", "shard", "ids", "v", "tree").join(needed, ["dim", "shard"]))
    key = ["dim", "shard", "block"]

    def group(rows: pa.Table, asked: pa.Table) -> pa.Table:
        dim = asked["dim"][0].as_py() if asked.num_rows else 0
        own = rows.to_pylist()  # one shard
        ids = np.frombuffer(own[0]["ids"], np.int64) if own else np.zeros(0, np.int64)
        v = np.frombuffer(own[0]["v"], float).reshape(len(ids), -1) if own else np.zeros((0, dim))
        root, leaves = pickle.loads(own[0]["tree"]) if own else (None, [])
        qid, q, known = asked["query_id"].to_numpy(), matrix(asked["q"], dim), asked["known"].to_numpy()
        bound = bounds(q, root, len(leaves), known)
        i, j, _ = read_leaves(q, v, ids, qid, leaves, bound, k, known, most, slack)
        i, j, score = best_of((i, j), q, v, qid, ids, k, known, slack)
        return answer(qid, i, ids[j], score)

    return left.groupBy(*key).cogroup(anew(pairs).groupBy(*key)).applyInArrow(group, schema)


def search(vectors: DataFrame, queries: DataFrame, tree: Callable, bounds: Callable, k: int, shard_rows: int, block_rows: int, slack: float = 0.0) -> DataFrame:
    """Rows that hold each query's k best: (query_id, vec_id, score).

    vectors: (vec_id, v, dim); queries: (query_id, q, dim). tree(rows) returns a root, an order of the rows and the
    leaves; bounds(q, root, leaves, known) the most that each query can score in each leaf. Only vectors of a query's
    own dimension are its candidates."""
    pivots = pivots_of(vectors, shard_rows, vectors.count())
    shards = shards_of(vectors, pivots, tree, shard_rows)
    asked = stored(dealt(with_region(queries, "q", pivots), "query_id", block_rows, "block").select("query_id", "q", "dim", "block"))
    found = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def best_scores(qid: np.ndarray, i: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.Table:
        at = np.flatnonzero(np.diff(i, prepend=-1))  # where each query begins
        lists = pa.ListArray.from_arrays(np.append(at, len(i)).astype(np.int32), pa.array(score))
        return pa.table({"query_id": qid[i[at]], "scores": lists})

    first = searched(shards, asked.withColumn("known", F.lit(float("-inf"))), bounds, k, 1, slack, "query_id long, scores array<double>", best_scores)
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    each = first.select("query_id", F.explode("scores").alias("score")).withColumn("n", F.row_number().over(by))
    kth = stored(each.where(F.col("n") <= k).groupBy("query_id").agg(F.min(F.when(F.col("n") == k, F.col("score"))).alias("kth")))
    known = asked.join(kth, "query_id", "left").withColumn("known", F.coalesce("kth", F.lit(float("-inf")))).drop("kth")
    return searched(shards, known, bounds, k, None, slack, FOUND, lambda qid, i, ids, score: pa.table({"query_id": qid[i], "vec_id": ids, "score": score}).cast(found))


def top(found: DataFrame, k: int) -> DataFrame:
    """Each query's k best of what the shards found, best first, ties to the smaller vec_id."""
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
