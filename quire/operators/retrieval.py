"""Steps of a search: concept frontier, candidates, what the kept ones cite, and checks of an answer's sources."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.graph import both_ways
from quire.sources.library import Library


def frontier(lib: Library, question: DataFrame, seeds: DataFrame) -> DataFrame:
    """(concept_id, stage, place): concepts of the question, then those that seeds mention, then one hop on; each once,
    where it comes first. question: (concept_id, place); seeds: (item_id)."""
    asked = question.select("concept_id", F.lit(0).alias("stage"), F.col("place").cast("long").alias("place"))
    said = lib.mention.join(seeds.select("item_id"), "item_id", "left_semi").groupBy("concept_id").agg((-F.count("*")).alias("place")).withColumn("stage", F.lit(1))
    near = asked.union(said.select("concept_id", "stage", "place"))
    hop = both_ways(lib).join(near.select("concept_id").distinct(), "concept_id", "left_semi").select(F.col("other").alias("concept_id"), F.lit(2).alias("stage"), F.lit(0).cast("long").alias("place")).distinct()
    first = near.union(hop).groupBy("concept_id").agg(F.min(F.struct("stage", "place")).alias("first"))
    return first.select("concept_id", "first.stage", "first.place")


def candidates(lib: Library, concepts: DataFrame, seeds: DataFrame, most: int = 50) -> DataFrame:
    """(item_id, reason): seeds, and the items that mention most of the concepts (the cap counts seeds too), with the
    first of these as reason; -1 stands for a seed."""
    near = lib.mention.join(concepts, "concept_id")
    other = near.groupBy("item_id").agg(F.count("*").alias("n"), F.min(F.struct("stage", "place", "concept_id")).alias("first")).orderBy(F.desc("n"), "item_id").limit(most)
    other = other.join(seeds.select("item_id"), "item_id", "left_anti").select("item_id", F.col("first.concept_id").alias("reason"))
    return seeds.select("item_id", F.lit(-1).cast("long").alias("reason")).union(other)


def cited(items: DataFrame, kept: DataFrame) -> DataFrame:
    """(item_id, label, by): items of the same document that kept ones cite by label, with the first that does.
    kept: (item_id, place). What is pulled in pulls in nothing further."""
    wanted = items.join(kept, "item_id").select("doc_id", "place", F.explode("cites").alias("label"))
    found = items.select("item_id", "doc_id", "label").join(wanted, ["doc_id", "label"]).join(kept.select("item_id"), "item_id", "left_anti")
    return found.groupBy("item_id", "label").agg(F.min("place").alias("by"))


def claim_faults(claims: DataFrame, shown: int) -> DataFrame:
    """(claim_id, sources, fault): source numbers, each once in order; a claim without sources or with one not shown has a fault."""
    own = F.array_distinct("sources")
    fault = F.when(F.size("sources") == 0, "no source").when(F.exists("sources", lambda s: (s < 1) | (s > shown)), "unknown source")
    return claims.select("claim_id", own.alias("sources"), fault.alias("fault"))


def only_piece(pieces: DataFrame) -> DataFrame:
    """Pieces that are the only one of their page, kind and label."""
    same = Window.partitionBy("doc_id", "page", "kind", "label")
    return pieces.where(F.col("label").isNotNull()).withColumn("n", F.count("*").over(same)).where(F.col("n") == 1).drop("n")
