"""Changes to the library's tables, each as a new table: upserts, additions, deletions."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import normalised


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def add_mentions(mentions: DataFrame, new: DataFrame, items: DataFrame, concepts: DataFrame) -> DataFrame:
    """The last wording of each pair stays; rows without their item or concept are left out. new: (item_id, concept_id, wording, seq)."""
    known = new.join(items.select("item_id"), "item_id", "left_semi").join(concepts.select("concept_id"), "concept_id", "left_semi")
    last = known.groupBy("item_id", "concept_id").agg(F.max_by("wording", "seq").alias("wording"))
    return mentions.join(last, ["item_id", "concept_id"], "left_anti").unionByName(last)


def add_relations(relations: DataFrame, new: DataFrame) -> DataFrame:
    """The first item that states a relation stays. new: (from_id, to_id, type, item_id, seq)."""
    key = ["from_id", "to_id", "type"]
    first = new.groupBy(*key).agg(F.min_by("item_id", "seq").alias("item_id"))
    return relations.unionByName(first.join(relations, key, "left_anti"))


def add_aliases(concepts: DataFrame, new: DataFrame) -> DataFrame:
    """concepts: (concept_id, normalised_name, aliases); new: (concept_id, alias, seq). An alias whose normalised form is
    that of the name or of an alias that is there adds nothing; of new ones with one form the first is added."""
    first = new.groupBy("concept_id", normalised("alias").alias("form")).agg(F.min(F.struct("seq", "alias")).alias("a"))
    listed = first.groupBy("concept_id").agg(F.sort_array(F.collect_list("a")).alias("more"))
    more = F.coalesce(F.transform("more", lambda x: x["alias"]), F.array().cast("array<string>"))
    known = lambda a: (normalised(a) == F.col("normalised_name")) | F.exists("aliases", lambda x: normalised(x) == normalised(a))
    return concepts.join(listed, "concept_id", "left").withColumn("aliases", F.concat("aliases", F.filter(more, lambda a: ~known(a)))).drop("more")


def delete_document(table: DataFrame, doc: int) -> DataFrame:
    """Rows of other documents; concepts and relations aren't touched by a deletion."""
    return table.where(~F.col("doc_id").eqNullSafe(F.lit(doc)))


def without_mentions_of(mentions: DataFrame, items: DataFrame, doc: int) -> DataFrame:
    return mentions.join(items.where(F.col("doc_id") == doc), "item_id", "left_anti")


def in_order(items: DataFrame) -> DataFrame:
    """(item_id, next_id): each item and the one after it in its document."""
    return items.select("item_id", F.lead("item_id").over(Window.partitionBy("doc_id").orderBy("position")).alias("next_id"))


def rejected_mentions(new: DataFrame, items: DataFrame, concepts: DataFrame) -> DataFrame:
    """(asked, written, missing): how many pairs were to be added, and how many lack their item or concept."""
    pairs = new.select("item_id", "concept_id").distinct()
    known = pairs.join(items.select("item_id"), "item_id", "left_semi").join(concepts.select("concept_id"), "concept_id", "left_semi")
    counts = known.agg(F.count("*").alias("written")).crossJoin(pairs.agg(F.count("*").alias("asked")))  # one row each
    return counts.select("asked", "written", (F.col("asked") - F.col("written")).alias("missing"))


def removed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(removed): by how many rows a table got shorter."""
    return old.agg(F.count("*").alias("a")).crossJoin(new.agg(F.count("*").alias("b"))).select((F.col("a") - F.col("b")).alias("removed"))


def of_media(title: str):
    return F.lower(F.trim("media")) == title.strip().lower()


def delete_media(documents: DataFrame, items: DataFrame, title: str) -> tuple[DataFrame, DataFrame]:
    """The documents of other media and their items; capitals and outer spaces of the title don't matter."""
    gone = documents.where(F.coalesce(of_media(title), F.lit(False)))
    return documents.join(gone.select("doc_id"), "doc_id", "left_anti"), items.join(gone.select("doc_id"), "doc_id", "left_anti")


def author_list(names):
    """Names trimmed, without blank ones, each once in order."""
    return F.array_distinct(F.filter(F.transform(names, lambda a: F.trim(a)), lambda a: a != ""))


def relabel_media(documents: DataFrame, title: str, category: str | None = None, authors: list[str] | None = None, tags: list[str] | None = None) -> DataFrame:
    """documents with the given labels on each document of the media; its own tags stay."""
    own = F.coalesce(of_media(title), F.lit(False))
    new = {"category": F.lit(category) if category is not None else None, "authors": author_list(F.array(*map(F.lit, authors))) if authors is not None else None, "media_tags": F.array(*map(F.lit, tags)) if tags is not None else None}
    return documents.withColumns({c: F.when(own, v).otherwise(F.col(c)) for c, v in new.items() if v is not None})


def mark_ingested(documents: DataFrame, doc: int, items: int | None) -> DataFrame:
    """The mark of a document that is stored whole, with the number of its items; null clears it."""
    return documents.withColumn("ingested_items", F.when(F.col("doc_id") == doc, F.lit(items).cast("long")).otherwise(F.col("ingested_items")))


def replace_run(old: DataFrame, new: DataFrame) -> DataFrame:
    """Items of an earlier run of the documents in `new` give way to the new ones."""
    return old.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)


def upsert_concepts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Concepts with new names and definitions; aliases that are stored stay. new: (concept_id, name, normalised_name, definition)."""
    rest = [c for c in new.columns if c != "concept_id"]
    both = old.join(new.select("concept_id", F.struct(*rest).alias("new")), "concept_id", "full")
    kept = {c: F.when(F.col("new").isNotNull(), F.col("new")[c]).otherwise(F.col(c)) for c in rest}
    return both.withColumns(kept).drop("new").select(*old.columns)
