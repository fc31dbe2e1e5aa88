"""From raw documents to packed token sequences, in five stages.

Quality classifier, n-gram Jaccard join, personal data, mixing to target weights, best-fit packing. Each stage works
on all that the one before kept; all but the last return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import jaccard, mixing, packing, pii, quality
from quire.llm.common import WORD, fresh, stored
from quire.llm.queries import tokenizer_file
from quire.sources import table

#: Documents whose probability of label 1 is less are rejected.
LEAST_QUALITY = 0.3


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier doesn't reject; empty texts get a score like others."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), quality.learned())
    name = fresh("quality score", docs.columns)
    return quality.score(docs, model, score_column=name).where(F.col(name) >= LEAST_QUALITY).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id, of rows without an id the one whose text has the
    least hash; rows that repeat id and text count as copies. Documents without words are in no group and stay."""
    linked = jaccard.link(docs, mark=F.xxhash64("text")).where(F.col("class").isNotNull())
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    heads = linked.groupBy("class").agg(F.min(order).alias("h")).select(F.col("h.doc_id").alias("head id"), F.col("h.mark").alias("head mark"))
    same = F.col("doc_id").eqNullSafe(F.col("head id")) & (F.xxhash64("text") == F.col("head mark"))
    kept = docs.where(F.regexp_like("text", F.lit(WORD))).join(heads, same, "left_semi")
    again = linked.groupBy("doc_id", "mark").count().where("count > 1").select(F.col("doc_id").alias("head id"), F.col("mark").alias("head mark"))
    rest = [c for c in docs.columns if c != "doc_id"]
    several = kept.join(again, same, "left_semi").groupBy("doc_id", F.xxhash64("text").alias("head mark")).agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("row")).select("doc_id", "row.*").select(*docs.columns)
    return kept.join(again, same, "left_anti").union(several).union(docs.where(~F.coalesce(F.regexp_like("text", F.lit(WORD)), F.lit(False))))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its personal data masked; n_chars is that of the new text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or up to three times."""
    return mixing.mixed(docs, F.array("source"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in which sequence."""
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", one_of_each_group),
    ("personal_data", without_personal_data),
    ("mixing", to_target_weights),
    ("packing", packed),
]

#: Trained models and packing can't be written in SQL; tests/llm/test_pipeline.py holds each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
