"""Vector operators: exact cosine against stored vectors, in double precision."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    wide = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(wide, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    return F.round(dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), 6)


def scored(vectors: DataFrame, query: DataFrame, id_: str = "item_id") -> DataFrame:
    """vectors with their score against the one row of `query`, column q; all-zero and null vectors score null."""
    return vectors.crossJoin(F.broadcast(query.select("q"))).withColumn("score", cosine("vector", "q")).drop("q").where(F.col("score").isNotNull())


def one(vectors: DataFrame, id_: int, name: str = "item_id") -> DataFrame:
    """The stored vector of one id, column q; one row, or none."""
    return vectors.where(F.col(name) == id_).select(F.col("vector").alias("q")).limit(1)


def top_k(vectors: DataFrame, query: DataFrame, k: int, name: str = "item_id") -> DataFrame:
    """The k nearest, ties to the smaller id."""
    return scored(vectors, query).orderBy(F.desc("score"), name).limit(k)


def similar(vectors: DataFrame, id_: int, k: int) -> DataFrame:
    """The k nearest to a stored one, itself left out; none if it isn't stored."""
    return top_k(vectors.where(F.col("item_id") != id_), one(vectors, id_), k)


def capped(ranked: DataFrame, nearest: int, per_document: int) -> DataFrame:
    """Rows in order of score while fewer than `nearest` are kept, at most per_document of a document; `kept` tells
    which are, and rows after the last kept one are dropped once `nearest` are.

    The first per_document rows of a document are the only ones that can be kept, so a few rows of each document are
    numbered, not all rows in one task."""
    own = Window.partitionBy("doc_id").orderBy(F.desc("score"), "item_id")
    all_ = ranked.withColumn("own", F.row_number().over(own))
    kept = all_.where(F.col("own") <= per_document).orderBy(F.desc("score"), "item_id").limit(nearest)
    last = kept.agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max_by("item_id", F.struct(-F.col("score"), F.col("item_id"))).alias("last"))
    all_ = all_.join(kept.select("item_id", F.lit(True).alias("kept")), "item_id", "left").crossJoin(F.broadcast(last))  # one row
    before = (F.col("score") > F.col("least")) | (F.col("score") == F.col("least")) & (F.col("item_id") <= F.col("last"))
    return all_.where(before | (F.col("n") < nearest)).select("item_id", "doc_id", "score", F.coalesce("kept", F.lit(False)).alias("kept"))


def passed_over(ranked: DataFrame, nearest: int, per_document: int) -> DataFrame:
    """How many items of each document the cap left out before the list was full."""
    out = capped(ranked, nearest, per_document).where(~F.col("kept"))
    return out.groupBy("doc_id").agg(F.count("*").alias("passed"), F.max("score").alias("best")).orderBy(F.desc("best"), "doc_id")


def labelled(items: DataFrame, vectors: DataFrame, query: DataFrame, doc: int, labels: list[str], most: int = 32) -> DataFrame:
    own = items.where((F.col("doc_id") == doc) & F.col("label").isin(labels)).join(vectors.select("item_id", "vector"), "item_id")
    return scored(own, query).orderBy(F.desc("score"), "item_id").limit(most).select("item_id", "label", "score")


#: Bytes of stored concepts that go to every task; with more, pairs are made by a join.
CONCEPT_BYTES = 64_000_000


def nearest_concept(vectors: DataFrame, concepts: DataFrame) -> DataFrame:
    """(item_id, concept_id, score): each vector's nearest concept, ties to the smaller id. Vectors that are null, all
    zero or of another dimension than the concepts' greatest take no part, on either side.

    Where the concepts' vectors are few enough to be sent to every task, a block of vectors is multiplied by all of
    them at once; else the pairs of one vector are scored where a join makes them, and only the best leaves a task."""
    rows, width = concepts.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    usable = (F.size("vector") == width) & F.exists("vector", lambda x: x != 0) & F.forall("vector", lambda x: x.isNotNull())
    vectors, concepts = vectors.where(usable), concepts.where(usable)
    if rows * width * 8 > CONCEPT_BYTES:
        pairs = vectors.select("item_id", "vector").crossJoin(concepts.select("concept_id", F.col("vector").alias("c")))
        best = pairs.groupBy("item_id").agg(F.max(F.struct(cosine("vector", "c").alias("score"), (-F.col("concept_id")).alias("least"))).alias("b"))
        return best.select("item_id", (-F.col("b.least")).alias("concept_id"), F.col("b.score").alias("score"))
    stored = sorted((r["concept_id"], r["vector"]) for r in concepts.select("concept_id", "vector").collect())
    ids, c = np.array([i for i, _ in stored], np.int64), np.array([v for _, v in stored], float).reshape(len(stored), width)
    length = np.sqrt((c**2).sum(axis=1))
    sent = vectors.sparkSession.sparkContext.broadcast((ids[length > 0], c[length > 0] / length[length > 0, None]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unit = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows if len(ids) else 0, 1024):
                part = batch.slice(at, 1024)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)
                own = np.sqrt((x**2).sum(axis=1))
                score = np.round(x @ unit.T / np.maximum(own, 1e-300)[:, None], 6)
                best = score.argmax(axis=1)  # the first of equal ones, so the smallest id
                keep = pa.array(own > 0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids[best]), pa.array(score[np.arange(len(best)), best])], names=["item_id", "concept_id", "score"]).filter(keep)

    known = vectors.select(F.col("item_id").cast("long"), F.col("vector").cast("array<double>"))
    return known.mapInArrow(run, "item_id long, concept_id long, score double")


def resolution(named: Column, score: Column, link: float = 0.95, create: float = 0.75) -> Column:
    """What becomes of a name: its exact match, else by the score of the nearest concept."""
    return F.when(named, "exact").when(score >= link, "link").when(score.isNull() | (score < create), "create").otherwise("ask")
