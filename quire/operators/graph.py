"""Reads of the concept graph: joins, groups and exact orders over mentions and relations."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.library import Library


def located(lib: Library) -> DataFrame:
    """Mentions with their item's place: (item_id, concept_id, doc_id, page, kind)."""
    return lib.mention.join(lib.item.select("item_id", "doc_id", "page", "kind"), "item_id")


def documents_for_concept(lib: Library, concept: int) -> DataFrame:
    counts = located(lib).where(F.col("concept_id") == concept).groupBy("doc_id").agg(F.count("*").alias("mentions"))
    return counts.join(lib.document, "doc_id").select("doc_id", "title", "mentions").orderBy(F.desc("mentions"), "title", "doc_id")


def concept_document_counts(lib: Library) -> DataFrame:
    """Distinct documents of each concept; concepts without mentions keep 0."""
    counts = located(lib).groupBy("concept_id").agg(F.countDistinct("doc_id").alias("n"))
    return lib.concept.select("concept_id").join(counts, "concept_id", "left").select("concept_id", F.coalesce("n", F.lit(0)).alias("documents"))


def mention_counts(lib: Library) -> DataFrame:
    counts = lib.mention.groupBy("concept_id").agg(F.count("*").alias("n"))
    return lib.concept.select("concept_id").join(counts, "concept_id", "left").select("concept_id", F.coalesce("n", F.lit(0)).alias("mentions"))


def documents_sharing(lib: Library, concepts: DataFrame, without: int) -> DataFrame:
    """Documents other than one, by how many of the concepts they mention."""
    near = located(lib).where(F.col("doc_id") != without).join(concepts, "concept_id", "left_semi")
    counts = near.groupBy("doc_id").agg(F.countDistinct("concept_id").alias("shared"))
    return counts.join(lib.document, "doc_id").select("doc_id", "title", "shared").orderBy(F.desc("shared"), "title", "doc_id")


def concepts_of(lib: Library, doc: int) -> DataFrame:
    return located(lib).where(F.col("doc_id") == doc).select("concept_id").distinct()


def related_documents(lib: Library, doc: int, least: int = 3, most: int = 5) -> DataFrame:
    return documents_sharing(lib, concepts_of(lib, doc), doc).where(F.col("shared") >= least).orderBy(F.desc("shared"), "title", "doc_id").limit(most)


def concepts_shared(lib: Library, docs: list[int]) -> DataFrame:
    """Each concept of the documents, with its total and its count in each of them, listed by document."""
    each = located(lib).where(F.col("doc_id").isin(docs)).groupBy("concept_id", "doc_id").agg(F.count("*").alias("n"))
    both = each.groupBy("concept_id").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("doc_id", "n"))).alias("each"))
    named = both.join(lib.concept, "concept_id").select("concept_id", "normalised_name", "total", "each")
    return named.orderBy(F.desc("total"), "normalised_name", "concept_id")


def compare_documents(lib: Library, docs: list[int], most: int = 50) -> DataFrame:
    """(bucket, place, concept_id, total): concepts shared by two or more of the documents, and those of one only."""
    shared = concepts_shared(lib, docs)
    bucket = F.when(F.size("each") > 1, F.lit("shared")).otherwise(F.concat(F.lit("only "), F.col("each")[0]["doc_id"].cast("string")))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("total"), "normalised_name", "concept_id"))
    ranked = shared.withColumn("bucket", bucket).withColumn("place", place)
    return ranked.where(F.col("place") <= most).select("bucket", "place", "concept_id", "total")


def items_mentioning(lib: Library, concept: int, doc: int | None = None, kind: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    found = located(lib).where(F.col("concept_id") == concept)
    if doc is not None:
        found = found.where(F.col("doc_id") == doc)
    if kind is not None:
        found = found.where(F.col("kind") == kind)
    found = found.join(lib.document, "doc_id").select("title", "doc_id", "page", "kind", "item_id")
    return found.orderBy("title", "doc_id", "page", "kind", "item_id").offset(offset).limit(limit)


def item_places(lib: Library, items: list[int]) -> DataFrame:
    return lib.item.where(F.col("item_id").isin(items)).join(lib.document, "doc_id").select("item_id", "doc_id", "title", "page")


def find_concept(lib: Library, name: str) -> DataFrame:
    """The concept of this normalised name, or else the first with this alias."""
    own = lib.concept.where((F.col("normalised_name") == name) | (F.lower("alias") == name))
    return own.orderBy(F.col("normalised_name") != name, "concept_id").limit(1).select("concept_id", "name", "definition")


def concepts_by_mentions(lib: Library, mentions: DataFrame) -> DataFrame:
    counts = mentions.groupBy("concept_id").agg(F.count("*").alias("mentions"))
    return counts.join(lib.concept, "concept_id").select("concept_id", "name", "normalised_name", "mentions").orderBy(F.desc("mentions"), "normalised_name", "concept_id")


def concepts_for_items(lib: Library, items: list[int]) -> DataFrame:
    return concepts_by_mentions(lib, lib.mention.where(F.col("item_id").isin(items)))


def document_concepts(lib: Library, doc: int, page: int | None = None) -> DataFrame:
    own = located(lib).where(F.col("doc_id") == doc)
    return concepts_by_mentions(lib, own if page is None else own.where(F.col("page") == page))


def top_concepts(lib: Library, limit: int = 20) -> DataFrame:
    return concepts_by_mentions(lib, lib.mention).limit(limit)


def items_for_concepts(lib: Library, concepts: list[int], limit: int = 50) -> DataFrame:
    shared = lib.mention.where(F.col("concept_id").isin(concepts)).groupBy("item_id").agg(F.sort_array(F.collect_set("concept_id")).alias("concepts"))
    return shared.orderBy(F.desc(F.size("concepts")), "item_id").limit(limit)


def both_ways(lib: Library) -> DataFrame:
    """(concept_id, other): relations seen from either end."""
    forth = lib.relation.select(F.col("from_id").alias("concept_id"), F.col("to_id").alias("other"))
    return forth.union(lib.relation.select("to_id", "from_id"))


def related_concepts(lib: Library, concepts: list[int]) -> DataFrame:
    near = both_ways(lib).where(F.col("concept_id").isin(concepts) & ~F.col("other").isin(concepts)).select(F.col("other").alias("concept_id")).distinct()
    return near.join(lib.concept, "concept_id").select("concept_id", "normalised_name").orderBy("normalised_name", "concept_id")


def relations_among(lib: Library, concepts: DataFrame) -> DataFrame:
    """Relations with both ends in concepts (concept_id)."""
    ends = [concepts.select(F.col("concept_id").alias(c)) for c in ("from_id", "to_id")]
    return lib.relation.join(ends[0], "from_id", "left_semi").join(ends[1], "to_id", "left_semi").select(*lib.relation.columns).orderBy("from_id", "to_id", "type")


def mentions_between(lib: Library, items: DataFrame, concepts: DataFrame) -> DataFrame:
    """Mentions of concepts (concept_id) in items (item_id)."""
    return lib.mention.join(items, "item_id", "left_semi").join(concepts, "concept_id", "left_semi").select(*lib.mention.columns).orderBy("item_id", "concept_id")


def touching(concepts: Column, direction: str) -> Column:
    ends = {"out": ("from_id",), "in": ("to_id",), "both": ("from_id", "to_id")}[direction]
    return reduce(lambda a, b: a | b, (F.array_contains(concepts, F.col(e)) for e in ends))


def neighbours(lib: Library, concepts: list[int], direction: str, kinds: tuple[str, ...] = (), limit: int = 100) -> DataFrame:
    """Each relation that touches the concepts once; no kinds let every kind through."""
    edges = lib.relation.where(touching(F.array(*map(F.lit, concepts)), direction))
    edges = edges.where(F.col("type").isin(*kinds)) if kinds else edges
    return edges.orderBy("from_id", "to_id", "type").limit(limit)


def neighbours_depth2(lib: Library, concept: int, limit: int = 100) -> DataFrame:
    """(step, from_id, to_id, type): relations of the concept, then further ones of what these touch."""
    first = lib.relation.where((F.col("from_id") == concept) | (F.col("to_id") == concept)).select("from_id", "to_id", "type")
    near = first.select(F.explode(F.array("from_id", "to_id")).alias("id")).where(F.col("id") != concept).distinct()
    key = ["from_id", "to_id", "type"]
    ends = [lib.relation.join(near, F.col(e) == F.col("id"), "left_semi").select(*key) for e in ("from_id", "to_id")]
    second = ends[0].union(ends[1]).distinct().join(first, key, "left_anti")
    both = first.withColumn("step", F.lit(1)).union(second.withColumn("step", F.lit(2)))
    return both.orderBy("step", *key).limit(limit).select("step", *key)


def shortest_path(lib: Library, start: int, end: int, most: int = 4) -> DataFrame:
    """(path): the relations (from_id, to_id, type) on the shortest way from start to end, of `most` at most, each in its
    own direction but taken in any; of equal ways the least. Each step keeps one way for each concept it reaches and
    drops those reached before. The same concept twice is an error."""
    if start == end:
        raise ValueError("a path needs two concepts")
    edge = F.struct("from_id", "to_id", "type").alias("edge")
    forth = lib.relation.select(F.col("from_id").alias("concept_id"), F.col("to_id").alias("other"), edge)
    steps = forth.union(lib.relation.select("to_id", "from_id", edge))
    first = lib.concept.where(F.col("concept_id") == start).select(F.col("concept_id").alias("at"))
    frontier = found = first.select("at", F.array().cast(f"array<{steps.schema['edge'].dataType.simpleString()}>").alias("path"))
    for _ in range(most):
        further = frontier.join(steps, F.col("at") == F.col("concept_id")).select(F.col("other").alias("at"), F.concat("path", F.array("edge")).alias("path"))
        frontier = further.join(found.select("at"), "at", "left_anti").groupBy("at").agg(F.min("path").alias("path"))
        found = found.union(frontier)
    return found.where(F.col("at") == end).select("path")


def document_records(lib: Library) -> DataFrame:
    """Documents with how many items of each kind they have."""
    counts = lib.item.groupBy("doc_id").agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("chunk", "formula", "figure", "table", "code")))
    filled = {f"n_{k}": F.coalesce(f"n_{k}", F.lit(0)) for k in ("chunk", "formula", "figure", "table", "code")}
    return lib.document.join(counts, "doc_id", "left").withColumns(filled).select("doc_id", "title", "media", "category", *filled)


def section_concept_counts(lib: Library) -> DataFrame:
    """Distinct concepts of each page."""
    return located(lib).groupBy("doc_id", "page").agg(F.countDistinct("concept_id").alias("concepts"))


def concept_overview(lib: Library, concept: int) -> DataFrame:
    """One row: mentions, documents, the first five items and the related concepts, twenty at most."""
    own = lib.concept.where(F.col("concept_id") == concept).select("concept_id", "name", "alias")
    said = located(lib).where(F.col("concept_id") == concept).agg(F.count("*").alias("mentions"), F.countDistinct("doc_id").alias("documents"))
    items = items_mentioning(lib, concept, limit=5).agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    near = related_concepts(lib, [concept]).limit(20).agg(F.sort_array(F.collect_list("concept_id")).alias("related"))
    return own.crossJoin(said).crossJoin(items).crossJoin(near)  # each side is one row


def concept_graph(lib: Library, concepts: list[int], pool: int = 40, most: int = 6) -> DataFrame:
    """(concept_id, links): related concepts by how many of the given ones they are linked with."""
    near = related_concepts(lib, concepts).limit(pool)
    links = both_ways(lib).where(F.col("concept_id").isin(concepts)).distinct().groupBy("other").agg(F.count("*").alias("links"))
    both = near.join(links, F.col("concept_id") == F.col("other"))
    return both.orderBy(F.desc("links"), "normalised_name", "concept_id").limit(most).select("concept_id", "links")
