"""Reads of the library's catalogue, spending and jobs: filters, pages, budgets, tallies."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import excerpt, same_name
from quire.sources.library import KINDS, Library


def fits(document: str | None = None, media: str | None = None, category: str | None = None, tags: tuple[str, ...] = (), author: str | None = None) -> Column:
    """Documents that fit all that is given: id or whole title, media and any author by name, category, every tag among
    those of the media and the document's own. Nothing given: all fit."""
    out = F.lit(True)
    if document is not None:
        out &= (F.col("doc_id").cast("string") == document) | same_name(F.col("title"), F.lit(document))
    if author is not None:
        out &= F.exists("authors", lambda a: same_name(a, F.lit(author)))
    if media is not None:
        out &= same_name(F.col("media"), F.lit(media))
    if category is not None:
        out &= F.col("category") == category
    for t in tags:
        out &= F.array_contains(F.concat("tags", "media_tags"), t)
    return F.coalesce(out, F.lit(False))


def roles(documents: DataFrame, is_chapter: Column) -> DataFrame:
    """(doc_id, role): chapter; part, if untitled ones of its media are chapters; else document."""
    with_ = documents.withColumn("chapter", is_chapter)
    media = with_.groupBy("media").agg(F.bool_or("chapter").alias("has"))
    role = F.when(F.col("chapter"), "chapter").when(F.col("has"), "part").otherwise("document")
    return with_.join(media, "media").select("doc_id", role.alias("role"))


def page_of(documents: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page by title and id, with the number of all rows. The total is counted beside, not by a window over all."""
    total = documents.agg(F.count("*").alias("total"))
    rows = documents.orderBy("title", "doc_id").offset(offset).limit(limit)
    return rows.crossJoin(F.broadcast(total))  # one row


def media_list(lib: Library) -> DataFrame:
    items = lib.item.groupBy("doc_id").agg(F.count("*").alias("items"))
    both = lib.document.join(items, "doc_id", "left")
    return both.groupBy(F.lower(F.trim("media")).alias("media")).agg(F.count("*").alias("documents"), F.sum(F.coalesce("items", F.lit(0))).alias("items")).orderBy("media")


def facet(documents: DataFrame, column: str) -> DataFrame:
    return documents.select(F.explode(column).alias(column)).distinct().orderBy(column)


def tag_change(documents: DataFrame, add: list[str], remove: list[str]) -> DataFrame:
    tags = F.array_sort(F.array_except(F.array_union("tags", F.array(*map(F.lit, add))), F.array(*map(F.lit, remove))))
    return documents.withColumn("tags", tags)


def tag_difference(wanted: Column, current: Column) -> tuple[Column, Column]:
    """What to add and what to remove."""
    return F.array_sort(F.array_except(wanted, current)), F.array_sort(F.array_except(current, wanted))


def contents_counts(lib: Library) -> DataFrame:
    """Items of each document by kind; chunks aren't counted."""
    own = lib.item.where(F.col("kind") != "chunk")
    return own.groupBy("doc_id").pivot("kind", list(KINDS[1:])).count().fillna(0)


def within_budget(units: DataFrame, chars: int) -> DataFrame:
    """Whole units of each document in order while they fit, the one at the border cut. units: (doc_id, position, text)."""
    by = Window.partitionBy("doc_id").orderBy("position")
    start = F.sum(F.length("text")).over(by) - F.length("text")
    rows = units.withColumn("start", start).where(F.col("start") < chars)
    return rows.select("doc_id", "position", F.substring("text", F.lit(1), (F.lit(chars) - F.col("start")).cast("int")).alias("text"))


def cited_by(lib: Library, texts: DataFrame) -> DataFrame:
    """(item_id, by, excerpt): items that other items of their document cite by label. texts: (item_id, text)."""
    cites = lib.item.select("doc_id", F.col("item_id").alias("by"), F.explode("cites").alias("label"))
    found = lib.item.select("item_id", "doc_id", "label").join(cites, ["doc_id", "label"])
    return found.join(texts.select(F.col("item_id").alias("by"), excerpt("text").alias("excerpt")), "by", "left").select("item_id", "by", "excerpt")


def canonical_model(model: Column | str) -> Column:
    """Without a date at the end and a mark of the context's size."""
    return F.regexp_replace(F.regexp_replace(model, r"\[[^\]]*\]$", ""), r"-[0-9]{8}$", "")


#: What is counted of a model's use, and what a million of each costs.
COUNTERS = ("input", "output", "cache_read", "cache_write")


def usage_tally(usage: DataFrame) -> DataFrame:
    """usage: (model, reported, estimated) and the COUNTERS; a counter that a table lacks is 0."""
    own = usage.withColumns({c: F.lit(0).cast("long") for c in COUNTERS if c not in usage.columns})
    sums = [F.sum(c).alias(c) for c in (*COUNTERS, "reported")]
    return own.groupBy(canonical_model("model").alias("model")).agg(*sums, F.bool_or("estimated").alias("estimated"))


def usage_cost(tally: DataFrame, price: DataFrame) -> DataFrame:
    """(models, usd): null if one model has neither price nor a reported cost; 0 without rows. price: (model, in_price,
    out_price) and, for what is read from and written to caches, read_price and write_price."""
    named = dict(zip(COUNTERS, ("in_price", "out_price", "read_price", "write_price"), strict=True))
    own = sum((F.col(c) * F.col(p) for c, p in named.items() if c in tally.columns and p in price.columns), F.lit(0.0)) / 1e6
    each = tally.join(price, "model", "left").withColumn("usd", F.coalesce(own, F.col("reported")))
    return each.agg(F.count("*").alias("models"), F.when(~F.coalesce(F.bool_or(F.col("usd").isNull()), F.lit(False)), F.round(F.coalesce(F.sum("usd"), F.lit(0.0)), 6)).alias("usd"))


def latest_jobs(events: DataFrame, most: int = 100) -> DataFrame:
    """Each job's last event, the newest jobs first. events: (event_id, job_id, stage, share, ts)."""
    last = events.groupBy("job_id").agg(F.max_by(F.struct("event_id", "stage", "share", "ts"), F.struct("ts", "event_id")).alias("e"))
    return last.select("job_id", "e.*").orderBy(F.desc("ts"), F.desc("event_id")).limit(most)


def progress(events: DataFrame, weights: DataFrame) -> DataFrame:
    """(event_id, job_id, overall): weights of the stages before plus this stage's weight times its share."""
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # a row for each stage
    table = weights.withColumn("before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    return events.join(F.broadcast(table), "stage").select("event_id", "job_id", F.round((F.col("before") + F.col("weight") * F.col("share")) / 100, 3).alias("overall"))


def increases(progressed: DataFrame) -> DataFrame:
    """Events that raise their job's overall progress."""
    before = Window.partitionBy("job_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return progressed.withColumn("best", F.max("overall").over(before)).where(F.col("best").isNull() | (F.col("overall") > F.col("best"))).drop("best")


def decisions_by_rule(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("rule").agg(F.count("*").alias("n"))


def estimate(pages: Column, usd: Column) -> tuple[Column, Column]:
    """Dollars rounded up to the cent after rounding to millionths, and minutes at 28 seconds a page."""
    return F.ceil(F.round(usd * 1e6) / 10000) / 100, F.ceil(pages * 28 / 60)


def selected(documents: DataFrame, media: list[str], named: list[str], book_parts: bool = False) -> DataFrame:
    """The finished documents of chosen media and those named by id or title; nothing chosen chooses all. Parts of a
    book come on request, or as an appendix. documents: (doc_id, title, media, finished, role)."""
    same = lambda c, names: F.lower(F.trim(F.col(c).cast("string"))).isin([n.strip().lower() for n in names])
    rows = documents.where(F.col("finished"))
    rows = rows.where(same("media", media)) if media else rows
    rows = rows.where(same("title", named) | same("doc_id", named)) if named else rows
    return rows.where((F.col("role") != "part") | F.lit(book_parts) | F.contains(F.lower("title"), F.lit("appendix")))


def unknown_names(documents: DataFrame, names: DataFrame) -> DataFrame:
    """(name): the entries of a selection that no document has as its id or title; each is an error."""
    known = documents.select(F.lower(F.trim("title")).alias("key")).union(documents.select(F.col("doc_id").cast("string"))).distinct()
    return names.withColumn("key", F.lower(F.trim("name"))).join(known, "key", "left_anti").select("name")


def split_of(documents: DataFrame, holdout: DataFrame) -> DataFrame:
    """documents with `split`: heldout where named by id or title. holdout: (name), which a caller gives."""
    keys = holdout.select(F.lower(F.trim("name")).alias("key")).distinct()
    by_id = documents.join(keys, F.col("doc_id").cast("string") == F.col("key"), "left_semi").select("doc_id")
    by_title = documents.join(keys, F.lower(F.trim("title")) == F.col("key"), "left_semi").select("doc_id")
    held = by_id.union(by_title).distinct().withColumn("held", F.lit(True))
    return documents.join(held, "doc_id", "left").withColumn("split", F.when(F.col("held"), "heldout").otherwise("train")).drop("held")


def in_catalogue_order(documents: DataFrame) -> DataFrame:
    """(media_place, place, media, doc_id, title): media by title, those without one last; of each, chapters by their
    number, then other documents by title. documents: (doc_id, title, media, number)."""
    media = documents.select("media").distinct().withColumn("media_place", F.row_number().over(Window.orderBy(F.col("media").isNull(), F.lower("media"), "media")))  # a row a media
    place = F.row_number().over(Window.partitionBy("media_place").orderBy(F.col("number").isNull(), "number", "title", "doc_id"))
    both = documents.join(media, documents["media"].eqNullSafe(media["media"])).drop(media["media"])
    return both.withColumn("place", place).select("media_place", "place", "media", "doc_id", "title")


def counts_text(counts: dict[str, Column]) -> Column:
    """'2 passages, 1 formula, 0 figures and 3 tables'; code listings come last and only where there are some."""
    noun = {"chunk": "passage", "formula": "formula", "figure": "figure", "table": "table", "code": "code listing"}
    say = {k: F.concat(c.cast("string"), F.lit(f" {noun[k]}"), F.when(c == 1, "").otherwise("s")) for k, c in counts.items()}
    first = F.concat_ws(", ", say["chunk"], say["formula"], say["figure"])
    return F.when(counts["code"] == 0, F.concat(first, F.lit(" and "), say["table"])).otherwise(F.concat(first, F.lit(", "), say["table"], F.lit(" and "), say["code"]))


def overview(lib: Library, concepts: DataFrame, most: int = 10) -> DataFrame:
    """(doc_id, place, concept_id, mentions): each document's most mentioned concepts. concepts: (doc_id, concept_id, normalised_name, mentions)."""
    by = Window.partitionBy("doc_id").orderBy(F.desc("mentions"), "normalised_name", "concept_id")
    return concepts.withColumn("place", F.row_number().over(by)).where(F.col("place") <= most).select("doc_id", "place", "concept_id", "mentions")
