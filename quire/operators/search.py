"""A search from end to end: reach, scope, seeds, concepts, candidates, rank and cap, what the kept ones cite, pages of results.

A step that may find nothing gives an empty table, so a search in an empty scope reads nothing further.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import retrieval, vectors
from quire.operators.graph import both_ways, concept_document_counts, mention_counts
from quire.sources.library import Library
from quire.sources.lineage import checkpointed


@dataclass(frozen=True)
class Reach:
    """How far a search goes: items kept, items of one document, concepts nearest to the question, hops over relations,
    items that concepts add."""

    nearest: int
    per_document: int
    question_concepts: int
    hops: int
    expansion: int


# The three reaches that a caller can name.
FOCUSED, BALANCED, BROAD = Reach(5, 2, 1, 0, 20), Reach(8, 3, 3, 1, 50), Reach(14, 5, 6, 2, 120)
REACHES = {"focused": FOCUSED, "balanced": BALANCED, "broad": BROAD}


def scoped(items: DataFrame, kind: str | None = None, documents: DataFrame | None = None, within: DataFrame | None = None) -> DataFrame:
    """items of a kind, of documents (doc_id) and of a given set (item_id); what isn't given lets all through, and an
    empty table lets none."""
    rows = items if kind is None else items.where(F.col("kind") == kind)
    rows = rows if documents is None else rows.join(documents.select("doc_id"), "doc_id", "left_semi")
    return rows if within is None else rows.join(within.select("item_id"), "item_id", "left_semi")


def named_concepts(lib: Library, question: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(concept_id, stage, place): the question's concepts, those of the seeds by how often they are mentioned and by
    name, then hop after hop by name those related to all before; each where it comes first.

    question: (concept_id, place); seeds: (item_id)."""
    name = lib.concept.select("concept_id", "normalised_name")
    asked = question.select("concept_id", F.lit(0).alias("stage"), F.struct(F.col("place").cast("long").alias("n"), F.lit("").alias("name")).alias("place"))
    said = lib.mention.join(seeds.select("item_id"), "item_id", "left_semi").groupBy("concept_id").agg((-F.count("*")).alias("n")).join(name, "concept_id")
    said = said.select("concept_id", F.lit(1).alias("stage"), F.struct("n", F.col("normalised_name").alias("name")).alias("place"))
    found = checkpointed(first_of(asked.union(said)))  # each step reads all before twice
    for hop in range(hops):
        near = both_ways(lib).join(found.select("concept_id"), "concept_id", "left_semi").select(F.col("other").alias("concept_id")).distinct()
        near = near.join(found, "concept_id", "left_anti").join(name, "concept_id")
        near = near.select("concept_id", F.lit(2 + hop).alias("stage"), F.struct(F.lit(0).cast("long").alias("n"), F.col("normalised_name").alias("name")).alias("place"))
        found = checkpointed(found.union(near))
    return found


def first_of(concepts: DataFrame) -> DataFrame:
    first = concepts.groupBy("concept_id").agg(F.min(F.struct("stage", "place")).alias("f"))
    return first.select("concept_id", "f.stage", "f.place")


@dataclass
class Found:
    """hits(place, item_id, doc_id, score, reason, by), concepts(concept_id, stage), ranked(item_id, doc_id, score),
    capped(item_id, doc_id, score), seeds(item_id, score)."""

    hits: DataFrame
    concepts: DataFrame
    candidates: DataFrame
    ranked: DataFrame
    capped: DataFrame
    seeds: DataFrame

    def trace(self) -> DataFrame:
        """One row: how many seeds, concepts of each stage, candidates, ranked, capped and kept items there were."""
        stages = self.concepts.agg(F.count_if(F.col("stage") == 0).alias("question_concepts"), F.count_if(F.col("stage") == 1).alias("seed_concepts"), F.count_if(F.col("stage") > 1).alias("related_concepts"))
        counts = {"seeds": self.seeds, "candidates": self.candidates, "ranked": self.ranked, "capped": self.capped, "kept": self.hits.where(F.col("by").isNull())}
        out = stages
        for name, rows in counts.items():
            out = out.crossJoin(rows.agg(F.count("*").alias(name)))  # one row each
        return out


def search(lib: Library, stored: DataFrame, query: DataFrame, question: DataFrame, reach: Reach = BALANCED, kind: str | None = None, documents: DataFrame | None = None, within: DataFrame | None = None) -> Found:
    """stored: (item_id, doc_id, kind, vector); query: one row, column q; question: (concept_id, place), the concepts
    nearest to the question. kind, documents, within: as in scoped(). A search without a kind pulls in what its hits
    cite in their documents, after the hits and within the scope."""
    own = scoped(stored, kind, documents, within)
    scores = vectors.scored(own, query).select("item_id", "doc_id", "score")
    seeds = checkpointed(scores.orderBy(F.desc("score"), "item_id").limit(reach.nearest))  # a few rows, as are the tables below
    # Nothing nearest to the question is in the scope: no concept is asked for.
    asked = question.where(F.col("place") < reach.question_concepts).join(seeds.select("item_id").limit(1), F.lit(True), "left_semi")
    concepts = named_concepts(lib, asked, seeds, reach.hops)
    candidates = checkpointed(retrieval.candidates(lib, concepts, seeds.select("item_id"), reach.expansion))
    ranked = checkpointed(scores.join(candidates, "item_id").select("item_id", "doc_id", "score", "reason"))
    kept = vectors.capped(ranked.drop("reason"), reach.nearest, reach.per_document)
    place = F.row_number().over(Window.orderBy(F.desc("score"), "item_id"))  # at most `nearest` rows
    hits = kept.where("kept").join(ranked.select("item_id", "reason"), "item_id").withColumn("place", place)
    hits = checkpointed(hits.select("place", "item_id", "doc_id", "score", "reason", F.lit(None).cast("int").alias("by")))
    if kind is None:
        pulled = retrieval.cited(lib.item, hits.select("item_id", "place")).join(own.select("item_id", "doc_id"), "item_id", "left_semi")
        more = pulled.groupBy("item_id").agg(F.min("by").alias("by")).join(scores, "item_id")
        after = F.row_number().over(Window.orderBy("by", F.desc("score"), "item_id")) + F.lit(0)  # what a few hits cite
        total = hits.agg(F.coalesce(F.max("place"), F.lit(0)).alias("n"))
        more = more.withColumn("after", after).crossJoin(total).select((F.col("after") + F.col("n")).alias("place"), "item_id", "doc_id", "score", F.lit(None).cast("long").alias("reason"), "by")
        hits = hits.union(more)
    return Found(hits, concepts, candidates, ranked, kept.where(~F.col("kept")), seeds)


def page(hits: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page of the hits, with whether there are more after it."""
    total = hits.agg(F.max("place").alias("n"))
    rows = hits.where((F.col("place") > offset) & (F.col("place") <= offset + limit))
    return rows.crossJoin(total).withColumn("more", F.col("n") > offset + limit).drop("n")


def nothing_found(documents_searched: Column, hits: Column) -> Column:
    """Why a search found nothing; null where it found something."""
    why = F.when(documents_searched == 0, "no document has the labels").when(documents_searched.isNotNull(), "no item matches the filters").otherwise("library holds no items")
    return F.when(hits == 0, why)


def concept_aliases(aliases: DataFrame) -> DataFrame:
    """(concept_id, aliases): each concept's aliases in the order they were added. aliases: (concept_id, alias, seq)."""
    own = aliases.groupBy("concept_id").agg(F.sort_array(F.collect_list(F.struct("seq", "alias"))).alias("a"))
    return own.select("concept_id", F.transform("a", lambda x: x["alias"]).alias("aliases"))


def described(lib: Library, found: DataFrame, aliases: DataFrame) -> DataFrame:
    """found (concept_id, score) with name, definition, aliases, mentions and documents; a hit whose concept isn't
    stored is left out."""
    rows = found.join(lib.concept.select("concept_id", "name", "definition"), "concept_id")
    near = Library(lib.document, lib.item, rows.select("concept_id"), lib.mention.join(rows.select("concept_id"), "concept_id", "left_semi"), lib.relation)
    for counts in (mention_counts(near), concept_document_counts(near), concept_aliases(aliases)):
        rows = rows.join(counts, "concept_id", "left")
    return rows.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
