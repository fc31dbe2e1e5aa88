"""How far documents, their descriptions and their jobs are; what a training set holds."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Targets that one question asks for, and the bytes that it may have.
BATCH, MOST_BYTES = 20, 1_000_000
#: A page that is cut out but not saved counts as so much of a page.
CUT_SHARE = 0.15
COUNTED_STAGES = ("writing artifacts", "reading concepts", "linking concepts")


def artifact_state(chapters: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, state, done, total): no-folder; too-large if some batch of the pending targets, twenty in order, is over
    the bytes of a question; ready if none is pending; partial if the file is of this source and policy; stale if there
    is a file; else missing. A file of another source counts for nothing.

    chapters: (doc_id, has_folder, has_file, current); targets: (doc_id, place, bytes, described)."""
    own = targets.join(chapters.select("doc_id", "current"), "doc_id").withColumn("done", F.col("described") & F.col("current"))
    listed = own.groupBy("doc_id").agg(F.count_if("done").alias("done"), F.count("*").alias("total"), F.array_sort(F.collect_list(F.when(~F.col("done"), F.struct("place", "bytes")))).alias("open"))
    batches = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size("open") - 1, F.lit(0)) / BATCH).cast("int")), lambda b: F.slice("open", b * BATCH + 1, BATCH))
    size = F.transform(batches, lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x["bytes"]))
    rows = chapters.join(listed.withColumn("large", F.array_max(size) > MOST_BYTES), "doc_id", "left")
    state = (
        F.when(~F.col("has_folder"), F.lit("no-folder")).when(F.coalesce("large", F.lit(False)), F.lit("too-large"))
        .when(F.coalesce(F.size("open"), F.lit(0)) <= 0, F.lit("ready")).when(F.col("current"), F.lit("partial")).when(F.col("has_file"), F.lit("stale")).otherwise(F.lit("missing"))
    )
    return rows.select("doc_id", state.alias("state"), F.coalesce("done", F.lit(0)).alias("done"), F.coalesce("total", F.lit(0)).alias("total"))


def document_state(stored: Column, artifacts_ready: Column, insights_missing: Column, other_source: Column, folder: Column, finished: Column) -> Column:
    """Where a document stands: what is stored says it first, then its folder."""
    return (
        F.when(stored & ~artifacts_ready, "ingested without metadata").when(stored & insights_missing, "ingested without insights").when(stored, "ingested")
        .when(folder & other_source, "other source").when(folder & finished, "converted").when(folder, "partly converted").otherwise("new")
    )


def insights_need(part_of_book: Column, folder: Column, saved: Column) -> Column:
    return F.when(part_of_book, "book part").when(~folder, "no chapter").when(saved, "already saved").otherwise("write")


def stage_share(stage: Column, done: Column, before: Column, total: Column) -> Column:
    """The share of a stage that is done; null for stages that don't count. `before`: pages saved before this run."""
    cut = before + CUT_SHARE * F.greatest(done - before, F.lit(0))
    saved = done + CUT_SHARE * F.greatest(total - done, F.lit(0))
    own = F.when(stage == "preparing pages", cut).when(stage == "converting", saved).when(stage.isin(*COUNTED_STAGES), done.cast("double"))
    return F.when(total > 0, own / total)


def judge_kept(faithful: Column, claims: Column, score: Column, answers: bool = False) -> Column:
    """Texts are kept from 3 to 5 and answers from 4 on, faithful and without claims that the source doesn't support."""
    return faithful & (F.size(claims) == 0) & ((score >= 4) if answers else score.between(3, 5))


def method(task: Column, run_code: bool) -> Column:
    """How an answer is verified."""
    return F.when(task.isin("calculation", "derivation"), "agreement-and-judge").when((task == "code-pot") & F.lit(run_code), "python-exec").otherwise("judge")


def reasoning(task: Column) -> Column:
    return F.when(task.isin("calculation", "derivation", "code-pot"), "think").otherwise("direct")


def sft_records(asked: DataFrame) -> DataFrame:
    """(id, file, task, reasoning, messages, difficulty, split): a record for each question. One that failed goes to the
    rejected file, others to that of their split; a question without a kept answer has its user's message alone.

    asked: (section, number, task, question, answer, difficulty, heldout, failure)."""
    split = F.when(F.col("heldout"), "heldout").otherwise("train")
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    said = F.filter(F.array(message("user", F.col("question")), message("assistant", F.col("answer"))), lambda m: m["content"].isNotNull())
    return asked.select(
        F.concat_ws("-", F.col("section").cast("string"), F.lpad(F.col("number").cast("string"), 4, "0")).alias("id"), F.when(F.col("failure").isNotNull(), "rejected").otherwise(split).alias("file"),
        "task", reasoning(F.col("task")).alias("reasoning"), said.alias("messages"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "difficulty")).alias("difficulty"), split.alias("split"),
    )


def split_counts(sections: DataFrame) -> DataFrame:
    return sections.agg(F.count_if(~F.col("heldout")).alias("train"), F.count_if("heldout").alias("heldout"))


def manifest_documents(documents: DataFrame, kept: DataFrame) -> DataFrame:
    """(doc_id, title, sections, n_tokens): every document with its kept sections. kept: (doc_id, n_tokens)."""
    own = kept.groupBy("doc_id").agg(F.count("*").alias("sections"), F.sum("n_tokens").alias("n_tokens"))
    return documents.select("doc_id", "title").join(own, "doc_id", "left").fillna(0, ["sections", "n_tokens"])


def manifest_files(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(path, sha256, lines, n_tokens) of the files that a build wrote, by Spark in parts of bounded size.

    files: (path, content), as the reader of binary files gives them; lines: (path, n_tokens), a row a record."""
    own = lines.groupBy("path").agg(F.count("*").alias("lines"), F.sum("n_tokens").alias("n_tokens"))
    return files.select("path", F.sha2("content", 256).alias("sha256")).join(own, "path", "left").fillna(0, ["lines", "n_tokens"])


def dataset_version(files: DataFrame) -> DataFrame:
    """(version): the digest of a line for each file, its digest and its path, by path; files are few."""
    line = F.concat(F.col("sha256"), F.lit("  "), F.col("path"), F.lit("\n"))
    return files.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("l")))), lambda x: x["l"]), ""), 256).alias("version"))
