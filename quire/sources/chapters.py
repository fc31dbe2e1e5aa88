"""Scans of converted chapters: <root>/<media>/<document>/chapter.json, its pages, their pieces, and the files beside it.

Files are read by Spark's readers, so the root may lie in any store that Spark reads. What can't be read hides nothing else.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names and fields of the files, and the version that is read.
VERSION = 1
CHAPTER = "`format-version` int, `media-title` string, name struct<chapter:struct<number:int,name:string>,title:string>, `source-file` string, `source-sha256` string, `page-count` int, finished boolean"
PIECE = "struct<number:int,file:string,kind:string,rank:int,`printed-number`:string,label:string,marker:string,language:string,cites:array<struct<kind:string,label:string>>>"
PAGE = f"`format-version` int, `page-position` int, `printed-page-number` string, `starts-mid-sentence` boolean, `ends-mid-sentence` boolean, pieces array<{PIECE}>, relationships array<struct<kind:string,from:int,to:int>>"


def files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, value): the files that a pattern names, each whole; none is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    if found is None or not len(found):
        return spark.createDataFrame([], "path string, value string")
    return spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def folder(path: Column | str, up: int = 1) -> Column:
    return F.regexp_replace(path, r"(?:/[^/]*){" + str(up) + "}$", "")


def read_json(rows: DataFrame, schema: str, needed: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows with `x`, what their value says, and the paths of those that aren't JSON or lack what is needed."""
    read = rows.withColumn("x", F.from_json("value", schema + ", `not json` string", {"columnNameOfCorruptRecord": "not json"}))
    good = F.col("x").isNotNull() & F.col("x.`not json`").isNull()
    for c in needed:
        good = good & F.col(f"x.`{c}`").isNotNull()
    return read.where(good).drop("value"), read.where(~F.coalesce(good, F.lit(False))).select("path")


def catalogue(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The chapters (folder, media, number, title, source_sha256, page_count, finished, version), by media folder, then
    by number, then by title; and (path) of chapter files that can't be read. A missing root holds none."""
    good, bad = read_json(files(spark, f"{root}/*/*/chapter.json"), CHAPTER, ["format-version", "media-title", "name", "source-sha256", "page-count", "finished"])
    own = good.select(
        folder("path").alias("folder"), F.col("x.`media-title`").alias("media"), F.col("x.name.chapter.number").alias("number"), F.coalesce("x.name.chapter.name", "x.name.title").alias("title"),
        F.col("x.`source-sha256`").alias("source_sha256"), F.col("x.`page-count`").alias("page_count"), F.col("x.finished").alias("finished"), F.col("x.`format-version`").alias("version"),
    )
    return own.orderBy(folder("folder"), F.col("number").isNull(), "number", "title", "folder"), bad


def pages(spark: SparkSession, root: str) -> DataFrame:
    """(folder, page, printed, starts, ends, pieces, relationships) of the pages of finished chapters of the version."""
    ready = catalogue(spark, root)[0].where(F.col("finished") & (F.col("version") == VERSION)).select("folder", "page_count")
    good, _ = read_json(files(spark, f"{root}/*/*/page-num-*/page.json"), PAGE, ["format-version", "page-position", "pieces"])
    own = good.where(F.col("x.`format-version`") == VERSION).select(folder("path", 2).alias("folder"), F.col("x.`page-position`").alias("page"), F.col("x.`printed-page-number`").alias("printed"), F.col("x.`starts-mid-sentence`").alias("starts"), F.col("x.`ends-mid-sentence`").alias("ends"), "x.pieces", "x.relationships")
    return own.join(ready, "folder").where(F.col("page") <= F.col("page_count")).drop("page_count")


def pieces(spark: SparkSession, root: str, of: DataFrame | None = None) -> DataFrame:
    """(folder, page, number, kind, rank, label, marker, language, cites, content): the pieces of pages(), with the text
    of their files without one closing line break. of: pages(), where it is at hand."""
    rows = (pages(spark, root) if of is None else of).select("folder", "page", F.explode("pieces").alias("p")).select("folder", "page", "p.*")
    return rows.join(piece_files(spark, root), ["folder", "page", "file"]).select("folder", "page", "number", "kind", "rank", "label", "marker", "language", "cites", "content")


def faults(spark: SparkSession, root: str) -> DataFrame:
    """(folder, fault): why a chapter can't be read: it isn't finished, has another version, lacks a page or has one that
    can't be read or of another version, a page gives a piece's number twice, or a piece's file is missing."""
    known = catalogue(spark, root)[0]
    state = F.when(~F.col("finished"), "not finished").when(F.col("version") != VERSION, F.concat(F.lit("version "), F.col("version").cast("string")))
    found = known.select("folder", state.alias("fault")).where("fault IS NOT NULL")
    ready = known.where(F.col("finished") & (F.col("version") == VERSION) & (F.col("page_count") > 0))
    good, _ = read_json(files(spark, f"{root}/*/*/page-num-*/page.json"), PAGE, ["format-version", "page-position", "pieces"])
    own = good.select(folder("path", 2).alias("folder"), F.col("x.`page-position`").alias("page"), F.col("x.`format-version`").alias("version"), "x.pieces")
    rows = ready.select("folder", F.explode(F.sequence(F.lit(1), "page_count")).alias("page")).join(own, ["folder", "page"], "left")
    page = F.concat(F.lit("page "), F.col("page").cast("string"))
    wrong = F.when(F.col("version").isNull(), F.concat(page, F.lit(" is missing or can't be read"))).when(F.col("version") != VERSION, F.concat(page, F.lit(" has version "), F.col("version").cast("string")))
    found = found.union(rows.select("folder", wrong.alias("fault")).where("fault IS NOT NULL"))
    read = rows.where(F.col("version") == VERSION)
    found = found.union(repeated_pieces(read).select("folder", F.concat(page, F.lit(" has two pieces "), F.col("number").cast("string"))))
    listed = read.select("folder", "page", F.explode("pieces.file").alias("file"))
    there = piece_files(spark, root).select("folder", "page", "file")
    return found.union(listed.join(there, ["folder", "page", "file"], "left_anti").select("folder", F.concat(page, F.lit(" lacks "), "file")))


def whole_chapters(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The pieces() of the chapters that have no faults, and the faults() of the others; a chapter is read whole or not."""
    wrong = faults(spark, root)
    return pieces(spark, root, pages(spark, root).join(wrong, "folder", "left_anti")), wrong


def piece_files(spark: SparkSession, root: str) -> DataFrame:
    """(folder, page, file, content): the files of pieces, without one closing line break."""
    texts = files(spark, f"{root}/*/*/page-num-*/[0-9]*-*")
    return texts.select(folder("path", 2).alias("folder"), F.regexp_extract("path", r"/page-num-([0-9]+)/[^/]*$", 1).cast("int").alias("page"), F.element_at(F.split("path", "/"), -1).alias("file"), F.regexp_replace("value", r"\n\z", "").alias("content"))


def repeated_pieces(of: DataFrame) -> DataFrame:
    """(folder, page, number) of piece numbers that a page gives twice; each is an error. of: pages()."""
    rows = of.select("folder", "page", F.explode("pieces.number").alias("number"))
    return rows.groupBy("folder", "page", "number").count().where("count > 1").drop("count")


def beside(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """(folder, x): what the file of this name in each chapter's folder says; null where there is none that can be read."""
    good, _ = read_json(files(spark, f"{root}/*/*/{name}"), schema, [])
    return catalogue(spark, root)[0].select("folder").join(good.select(folder("path").alias("folder"), "x"), "folder", "left")


def pictures(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """(folder, x) of the pictures that stand alone, by folder; those that can't be read are left out."""
    good, _ = read_json(files(spark, f"{root}/images/*/image.json"), schema, [])
    return good.select(folder("path").alias("folder"), "x").orderBy("folder")


def kept_answers(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """asked (key) with the `answer` kept under each key; one that isn't JSON counts as none. answers: (key, value)."""
    good = answers.where(F.try_parse_json("value").isNotNull())
    return asked.join(good.select("key", F.col("value").alias("answer")), "key", "left")


def write_lines(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Records as lines of JSON; Spark's committer makes them all visible or none. mode "append" adds to a log."""
    records.write.mode(mode).json(path)
