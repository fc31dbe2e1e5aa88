"""Names of a batch resolved to concepts, each as if those before it had been resolved already.

A name goes to the concept of its exact name or alias, else to the nearest one by meaning if that is near enough, else
it makes a concept of its own, which later names may then go to. Only earlier names that are near matter to a name, so
all names whose near ones are settled are settled at once, round by round; the rounds are as many as the longest chain of
names that each depend on the one before. Names are taken in runs of `RUN`, in their order: to a later run, earlier names
are concepts or nothing, of which the nearest is enough, so pairs are only made within a run."""

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import normalised
from quire.operators.vectors import nearest_concept
from quire.sources.lineage import written

#: Most vectors of one side that a task holds at once.
BLOCK = 16_384
#: Names that are settled together, about.
RUN = 131_072
#: Rules by which a name makes a concept.
MAKES = ("create", "different")


def compared(names: DataFrame, others: DataFrame, least: float, block: int, nearest: bool) -> DataFrame:
    """(name_id, other, score): the others with smaller ids whose vectors score `least` or more, and more than `above`,
    with each name's; or, of these, one block's best, ties to the smaller id. Spark deals blocks of both sides against
    each other, so nothing passes the driver. names: (name_id, vector, above), above may be null; others: (other, vector);
    all of one dimension; all-zero and null vectors are near none."""
    there = F.exists("vector", lambda x: x != 0)
    names, others = names.where(there), others.where(there)
    n, m = (max(-(-size // block), min(4, -(-size // 1024)), 1) for size in (names.count(), others.count()))
    dealt = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    all_of = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = names.select(dealt("name_id", n).alias("i"), all_of(m).alias("j"), F.col("name_id").cast("long"), F.col("vector").alias("own"), F.coalesce(F.col("above").cast("double"), F.lit(float("-inf"))).alias("above"))
    right = others.select(all_of(n).alias("i"), dealt("other", m).alias("j"), F.col("other").cast("long"), F.col("vector").alias("its"))

    def matrix(t: pa.Table, c: str) -> np.ndarray:
        return t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, -1)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        if a.num_rows and b.num_rows:
            b = b.sort_by("other")
            ids, unit = b.column("other").to_numpy(), matrix(b, "its")
            unit /= np.sqrt((unit**2).sum(axis=1))[:, None]
            for at in range(0, a.num_rows, 256):
                part = a.slice(at, 256)
                x, name, above = matrix(part, "own"), part.column("name_id").to_numpy(), part.column("above").to_numpy()
                score = x @ unit.T / np.sqrt((x**2).sum(axis=1))[:, None]
                r, c = np.nonzero(score >= np.maximum(least, above)[:, None] - 1e-6)
                s = np.round(score[r, c], 6)
                keep = (s >= least) & (s > above[r]) & (ids[c] < name[r])
                r, c, s = r[keep], c[keep], s[keep]
                if nearest and len(r):
                    by = np.lexsort((ids[c], -s, r))
                    by = by[np.unique(r[by], return_index=True)[1]]
                    r, c, s = r[by], c[by], s[by]
                found.append((name[r], ids[c], s))
        kinds = zip(("name_id", "other", "score"), (np.int64, np.int64, float), strict=True)
        return pa.table({k: np.concatenate([f[i] for f in found]) if found else np.zeros(0, t) for i, (k, t) in enumerate(kinds)})

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, "name_id long, other long, score double")


def near_pairs(names: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(name_id, other, score): names and those before them whose vectors score `least` or more; compared()."""
    return compared(names, names.select(F.col("name_id").alias("other"), "vector"), least, block, False)


def nearest_made(names: DataFrame, made: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(name_id, best): each name's nearest of concepts that earlier names made, as (score, -id). made: (other, vector)."""
    return compared(names, made, least, block, True).groupBy("name_id").agg(F.max(best_of()).alias("best"))


def best_of() -> Column:
    """A pair's rank for its name: the greater score, then the earlier of the others."""
    return F.struct("score", (-F.col("other")).alias("earlier"))


def settle(left: DataFrame, pairs: DataFrame, same: Callable[[Column, Column], Column], link: float, create: float) -> DataFrame:
    """(name_id, concept, rule, score) of resolve() for one run of names. A round tells the pairs only what the last one
    settled: pairs of settled names go, and those that a name's best concept so far beats.

    left: (name_id, stored_score, stored_concept, best); pairs: (name_id, other, score) of names of the run."""
    settled = []
    step = written(pairs.withColumn("made", F.lit(None).cast("boolean")))
    while True:
        of = lambda c: F.max(F.when(c, best_of()))
        near = step.groupBy("name_id").agg(of(F.col("made")).alias("found"), of(F.col("made").isNull()).alias("open"))
        rows = left.join(near, "name_id", "left").withColumn("best", F.greatest("best", "found"))
        # A concept that an earlier name has made is nearest only if it beats the stored one.
        newer = F.col("best").isNotNull() & ~F.coalesce(F.col("stored_score") >= F.col("best.score"), F.lit(False))
        score = F.when(newer, F.col("best.score")).otherwise(F.col("stored_score"))
        concept = F.when(newer, F.concat(F.lit("new "), (-F.col("best.earlier")).cast("string"))).otherwise(F.col("stored_concept"))
        beats = F.when(newer, F.col("best") > F.col("open")).otherwise(F.col("stored_score") >= F.col("open.score"))
        ready = F.col("open").isNull() | F.coalesce(beats, F.lit(False))
        answer = same(F.col("name_id"), F.col("concept"))
        rule = F.when(F.col("score") >= link, "link").when(F.col("score").isNull() | (F.col("score") < create), "create").when(answer, "same").when(~answer, "different").otherwise("ask")
        rows = rows.withColumns({"score": score, "concept": concept, "ready": ready}).withColumn("rule", F.when(F.col("ready"), rule))
        rows = written(rows.drop("found", "open"))
        done, left = rows.where("ready"), rows.where("NOT ready").select("name_id", "stored_score", "stored_concept", "best")
        goes = F.when(F.col("rule").isin(*MAKES), F.concat(F.lit("new "), F.col("name_id").cast("string"))).when(F.col("rule") != "ask", F.col("concept"))
        settled.append(done.select("name_id", goes.alias("concept"), "rule", "score"))
        if left.isEmpty():
            return reduce(DataFrame.union, settled)
        still = step.where("made IS NULL").join(left.select("name_id", "best"), "name_id").where(F.col("best").isNull() | (best_of() > F.col("best")))
        told = done.select(F.col("name_id").alias("other"), F.col("rule").isin(*MAKES).alias("made"))
        step = written(still.select("name_id", "other", "score").join(told, "other", "left").where("made IS NULL OR made"))


def resolve(names: DataFrame, concepts: DataFrame, aliases: DataFrame, same: Callable[[Column, Column], Column], link: float = 0.95, create: float = 0.75) -> DataFrame:
    """(name_id, concept, rule, score). rule: `exact`, `link` from the score `link` on, `create` below `create`, in between
    as `same` answers for a name's id and a concept: `same`, `different`, or `ask` where it has no answer, and nothing is
    written then. A concept is a stored one's id, or `new` and the id of the name that made it. A name that repeats one
    before it, by its normalised form, goes where that went. Of equal scores the stored concept comes first, then the
    earlier name.

    names: (name_id, name, vector), in the order of name_id; concepts: (concept_id, name, vector); aliases: (concept_id, alias)."""
    stored = concepts.select(normalised("name").alias("form"), "concept_id").union(aliases.select(normalised("alias"), "concept_id"))
    stored = stored.groupBy("form").agg(F.min("concept_id").cast("string").alias("concept"))
    forms = names.withColumn("form", normalised("name"))
    exact = forms.join(stored, "form").select("name_id", "concept", F.lit("exact").alias("rule"), F.lit(None).cast("double").alias("score"))
    rest = written(forms.join(stored, "form", "left_anti"))
    firsts = rest.groupBy("form").agg(F.min("name_id").alias("name_id"))
    own = rest.join(firsts.select("name_id"), "name_id").select("name_id", "vector")
    nearest = nearest_concept(own.withColumnRenamed("name_id", "item_id"), concepts).select(F.col("item_id").alias("name_id"), F.col("score").alias("stored_score"), F.col("concept_id").cast("string").alias("stored_concept"))
    own = written(own.join(nearest, "name_id", "left").withColumn("best", F.lit(None).cast("struct<score:double,earlier:long>")))
    runs = max(-(-own.count() // RUN), 1)
    ends = sorted({float("inf"), *own.approxQuantile("name_id", [k / runs for k in range(1, runs)], 0.001)}) if runs > 1 else [float("inf")]
    settled, made, start = [], None, float("-inf")
    for end in ends:
        left = own.where((F.col("name_id") > start) & (F.col("name_id") <= end))
        if made is not None:
            better = nearest_made(left.select("name_id", "vector", F.col("stored_score").alias("above")), made, create)
            left = written(left.drop("best").join(better, "name_id", "left"))
        vectors = left.select("name_id", "vector", F.greatest("stored_score", "best.score").alias("above"))
        done = settle(left.drop("vector"), near_pairs(vectors, create), same, link, create)
        settled.append(done)
        if end != ends[-1]:
            new = vectors.join(done.where(F.col("rule").isin(*MAKES)), "name_id").select(F.col("name_id").alias("other"), "vector")
            made = written(new if made is None else made.union(new))
        start = end
    settled = reduce(DataFrame.union, settled)
    first = rest.join(firsts.withColumnRenamed("name_id", "first"), "form").join(settled.withColumnRenamed("name_id", "first"), "first")
    again = (F.col("name_id") != F.col("first")) & (F.col("rule") != "ask")
    return exact.union(first.select("name_id", "concept", F.when(again, "exact").otherwise(F.col("rule")).alias("rule"), F.when(~again, F.col("score")).alias("score")))
