"""The library model (documents, items, concepts, mentions, relations, vectors) over the driver tables."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import normalised
from quire.sources.tables import table

# Kinds of items, of relations and of media.
KINDS = ("chunk", "formula", "figure", "table", "code")
RELATIONS = ("DERIVED_FROM", "ASSUMES", "GENERALISES", "PART_OF", "USED_FOR")
CATEGORIES = ("book", "paper", "other")


@dataclass
class Library:
    """document(doc_id, title, media, category, tags, authors, media_tags), item(item_id, doc_id, page, kind, position, label, cites),
    concept(concept_id, name, normalised_name, definition, alias), mention(item_id, concept_id),
    relation(from_id, to_id, type, item_id)."""

    document: DataFrame
    item: DataFrame
    concept: DataFrame
    mention: DataFrame
    relation: DataFrame


def one_of(values: tuple[str, ...], number):
    return F.element_at(F.array(*map(F.lit, values)), number + 1)


def library(spark: SparkSession, sf_dir: str) -> Library:
    customer, nation, orders, part, line = (table(spark, sf_dir, t) for t in ("customer", "nation", "orders", "part", "lineitem"))
    document = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"], "left").select(
        F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("title"), F.col("n_name").alias("media"),
        one_of(CATEGORIES, (F.col("c_custkey") % 3).cast("int")).alias("category"), F.array(F.lower("c_mktsegment")).alias("tags"),
        F.array(F.concat(F.lit("Author "), F.col("c_nationkey").cast("string")), F.concat(F.lit("Writer "), (F.col("c_custkey") % 7).cast("string"))).alias("authors"), F.array(F.lower("n_name")).alias("media_tags"),
    )
    kind = one_of(KINDS, F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    last = lambda n: F.floor(F.col("o_orderkey") / n) % 10
    item = orders.select(
        F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("doc_id"), F.month("o_orderdate").alias("page"), kind.alias("kind"),
        F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("position"),
        F.when(kind != "chunk", F.concat_ws(" ", kind, last(1).cast("string"))).alias("label"),
        F.when(kind == "chunk", F.array(F.concat(F.lit("figure "), last(1).cast("string")), F.concat(F.lit("formula "), last(10).cast("string")))).otherwise(F.array().cast("array<string>")).alias("cites"),
    )
    name = F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))
    concept = part.select(F.col("p_partkey").alias("concept_id"), name.alias("name"), normalised(name).alias("normalised_name"), F.col("p_type").alias("definition"), F.col("p_brand").alias("alias"))
    mention = line.select(F.col("l_orderkey").alias("item_id"), F.col("l_partkey").alias("concept_id")).distinct()
    first = mention.groupBy("concept_id").agg(F.min("item_id").alias("item_id"))
    n = part.select(F.count("*").alias("n"))  # one row
    edges = part.crossJoin(F.broadcast(n)).select(F.col("p_partkey").alias("from_id"), one_of(RELATIONS, (F.col("p_partkey") % 5).cast("int")).alias("type"), F.explode(F.array((F.col("p_partkey") * 7 + 3) % F.col("n"), (F.col("p_partkey") * 13 + 5) % F.col("n"))).alias("to_id"))
    relation = edges.where("from_id <> to_id").distinct().join(first, F.col("from_id") == F.col("concept_id"), "left").select("from_id", "to_id", "type", "item_id")
    return Library(document, item, concept, mention, relation)


#: The same tables in SQL.
SQL = """WITH document AS (
    SELECT c_custkey AS doc_id, c_name AS title, n_name AS media, (['book', 'paper', 'other'])[c_custkey % 3 + 1] AS category, [lower(c_mktsegment)] AS tags,
        ['Author ' || c_nationkey, 'Writer ' || c_custkey % 7] AS authors, [lower(n_name)] AS media_tags
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
), kinds AS (
    SELECT *, (['chunk', 'formula', 'figure', 'table', 'code'])[CAST(o_orderpriority[1] AS INTEGER)] AS kind FROM orders
), item AS (
    SELECT o_orderkey AS item_id, o_custkey AS doc_id, CAST(month(o_orderdate) AS INTEGER) AS page, kind,
        CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS position,
        CASE WHEN kind <> 'chunk' THEN kind || ' ' || (o_orderkey % 10) END AS label,
        CASE WHEN kind = 'chunk' THEN ['figure ' || (o_orderkey % 10), 'formula ' || ((o_orderkey // 10) % 10)] ELSE [] END AS cites
    FROM kinds
), concept AS (
    SELECT p_partkey AS concept_id, p_name || ' ' || p_partkey AS name, trim(regexp_replace(lower(p_name || ' ' || p_partkey), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS normalised_name, p_type AS definition, p_brand AS alias FROM part
), mention AS (
    SELECT DISTINCT l_orderkey AS item_id, l_partkey AS concept_id FROM lineitem
), edges AS (
    SELECT p_partkey AS p, unnest([(p_partkey * 7 + 3) % n, (p_partkey * 13 + 5) % n]) AS to_id FROM part, (SELECT count(*) AS n FROM part)
), relation AS (
    SELECT DISTINCT p AS from_id, to_id, (['DERIVED_FROM', 'ASSUMES', 'GENERALISES', 'PART_OF', 'USED_FOR'])[p % 5 + 1] AS type, first_item AS item_id
    FROM edges LEFT JOIN (SELECT concept_id, min(item_id) AS first_item FROM mention GROUP BY 1) f ON p = f.concept_id WHERE p <> to_id
)
"""
