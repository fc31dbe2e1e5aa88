"""Checks of what models answer: concepts and relations of a reply, insights, short texts, tables, routes of pages."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import normalised
from quire.sources.library import RELATIONS

EXTRACTION = "struct<concepts:array<struct<name:string,definition:string>>,relations:array<struct<from:string,type:string,to:string>>>"
#: The least words of a page's text layer.
ALMOST_EMPTY = 20
#: A copy is kept if both shares of matching words are as high.
COPY_MATCH = 0.96
LOW_MATCH = 0.60


def extraction_fault(reply: Column | str) -> Column:
    """Of a reply as JSON text: 'shape' where a field is missing, 'relation type' where one isn't known, else null."""
    read = F.from_json(reply, EXTRACTION)
    whole = lambda xs, names: F.forall(xs, lambda x: ~F.exists(F.array(*(x[n].isNull() for n in names)), lambda m: m))
    good = read["concepts"].isNotNull() & read["relations"].isNotNull() & whole(read["concepts"], ("name", "definition")) & whole(read["relations"], ("from", "type", "to"))
    known = F.forall(read["relations"], lambda r: r["type"].isin(*RELATIONS))
    return F.when(~F.coalesce(good, F.lit(False)), "shape").when(~known, "relation type")


def reply_mentions(named: DataFrame) -> DataFrame:
    """(item_id, concept_id, wording): the concepts of each reply, in its first wording. A name without letters and
    digits, or whose normalised form an earlier one has, is left out. named: (item_id, place, name, concept_id)."""
    own = named.withColumn("key", normalised("name")).where(F.col("key") != "")
    first = own.groupBy("item_id", "key").agg(F.min(F.struct("place", "name", "concept_id")).alias("f")).select("item_id", "f.*")
    return first.groupBy("item_id", "concept_id").agg(F.min_by("name", "place").alias("wording"))


def reply_relations(told: DataFrame, named: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, from_id, to_id, type), each once, and (item_id, dropped): relations whose ends are the reply's own
    names, else stored ones; those without an end, or from a concept to itself, are dropped and counted.

    told: (item_id, from, to, type); named: (item_id, place, name, concept_id); stored: (key, concept_id), a row a key."""
    own = named.withColumn("key", normalised("name")).groupBy("item_id", "key").agg(F.min_by("concept_id", "place").alias("own"))
    rows = told
    for end in ("from", "to"):
        rows = rows.withColumn("key", normalised(end)).join(own, ["item_id", "key"], "left")
        rows = rows.join(stored.select("key", F.col("concept_id").alias("kept")), "key", "left")
        rows = rows.withColumn(f"{end}_id", F.coalesce("own", "kept")).drop("key", "own", "kept")
    good = F.coalesce(F.col("from_id") != F.col("to_id"), F.lit(False))
    kept = rows.where(good).select("item_id", "from_id", "to_id", "type").distinct()
    return kept, rows.groupBy("item_id").agg(F.count_if(~good).alias("dropped"))


def insight_pages(pages: Column | str, shown: Column | str) -> Column:
    """The pages of an insight that were shown, sorted, each once."""
    return F.array_sort(F.array_intersect(pages, shown))


def empty_part(insights: Column, takeaways: Column, sheet: Column) -> Column:
    """The first part of a reply that holds nothing."""
    none = lambda xs: ~F.exists(xs, lambda x: F.trim(x) != "")
    return F.when(none(insights), "insight").when(none(takeaways), "takeaway").when(F.trim(sheet) == "", "cheat sheet")


def text_fault(text: Column | str, most: int) -> Column:
    """What keeps a short text from being shown on one plain line: the first of these that holds."""
    t = F.col(text) if isinstance(text, str) else text
    bare = F.trim(F.regexp_replace(t, r"^[\s ]+|[\s ]+$", ""))
    # Emphasis: stars not after a letter, digit, underscore or star, around text that doesn't end in a space or a star.
    starred = t.rlike(r"(?<![\p{IsAlphabetic}\p{N}_*])(\*+)(?!\*)(?!\s)(?:(?!\1).|\*)*?(?<![\s*])\1(?![\p{IsAlphabetic}\p{N}_*])")
    formatted = F.contains(t, F.lit("`")) | t.rlike(r"^(?:#+|[*+-])\s") | starred
    return (
        F.when(bare == "", "empty").when(bare != t, "whitespace").when(F.length(t) > most, "length")
        .when(t.rlike("[\n\r  ]"), "break").when(t.rlike(r"\p{Cc}"), "control").when(formatted, "formatting")
    )


def artifact_faults(replies: DataFrame, targets: DataFrame) -> DataFrame:
    """(reply, fault, id): the first fault of each reply in its order, an id that wasn't asked for, a repeated one or a
    text that can't be shown; else the least id that is missing. Replies without faults have a null.

    replies: (reply, place, id, title, description); targets: (reply, id)."""
    asked = targets.select("reply", "id", F.lit(True).alias("asked"))
    first = replies.groupBy("reply", "id").agg(F.min("place").alias("first"))
    rows = replies.join(asked, ["reply", "id"], "left").join(first, ["reply", "id"], "left")
    text = F.coalesce(text_fault("title", 80), text_fault("description", 280))
    fault = F.when(F.col("asked").isNull(), "unknown").when(F.col("place") > F.col("first"), "duplicate").when(text.isNotNull(), "text")
    bad = rows.withColumn("fault", fault).where(F.col("fault").isNotNull()).groupBy("reply").agg(F.min(F.struct("place", "fault", "id")).alias("f"))
    gone = targets.join(replies, ["reply", "id"], "left_anti").groupBy("reply").agg(F.min("id").alias("gone"))
    out = targets.select("reply").union(replies.select("reply")).distinct().join(bad, "reply", "left").join(gone, "reply", "left")
    missing = F.when(F.col("gone").isNotNull(), "missing")
    return out.select("reply", F.coalesce("f.fault", missing).alias("fault"), F.coalesce("f.id", "gone").alias("id"))


def table_fault(markdown: Column | str) -> Column:
    """Of a Markdown table: the first rule it breaks."""
    t = F.regexp_replace(markdown, r"\r?\n$", "")
    lines = F.split(t, r"\r?\n")
    bars = lambda line: F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
    framed = F.forall(lines, lambda x: F.startswith(x, F.lit("|")) & F.endswith(x, F.lit("|")))
    level = F.forall(lines, lambda x: bars(x) == bars(lines[0]))
    return F.when((F.size(lines) < 2) | (t == ""), "lines").when(~framed, "frame").when(~level, "cells").when(~F.get(lines, F.lit(1)).rlike(r"^[|:\- ]*-[|:\- ]*$"), "separator")


def route_reasons(math: Column, figure: Column, table_: Column, check: Column, words: Column) -> Column:
    """Why a page's text layer can't be copied as it is, in this order; an empty array if nothing speaks against it."""
    each = (
        (math, "tags-report-math"), (figure, "tags-report-figure"), (table_, "tags-report-table"),
        (check.isin("inline", "block", "both"), "math-check-reports-math"), (check == "no-answer", "math-check-failed"), (words < ALMOST_EMPTY, "text-layer-almost-empty"),
    )
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in each)))


def copy_kept(pieces_in_layer: Column, layer_in_pieces: Column) -> Column:
    return (pieces_in_layer >= COPY_MATCH) & (layer_in_pieces >= COPY_MATCH)


def math_placement(lines: DataFrame, formula: float = 0.3, words: float = 0.5) -> DataFrame:
    """(page_id, placement): inline, block or both by the lines' scores, null without formulas; 'error' where an answer
    is missing. lines: (page_id, formula, words)."""
    has = F.col("formula") > formula
    each = lines.groupBy("page_id").agg(F.bool_or(F.col("formula").isNull() | F.col("words").isNull()).alias("gone"), F.bool_or(has & (F.col("words") > words)).alias("inline"), F.bool_or(has & ~(F.col("words") > words)).alias("block"))
    placement = F.when(F.col("gone"), "error").when(F.col("inline") & F.col("block"), "both").when(F.col("inline"), "inline").when(F.col("block"), "block")
    return each.select("page_id", placement.alias("placement"))


def pages_to_check(pages: DataFrame) -> DataFrame:
    """(doc_id, page, reasons) of pages that a reader should look at.

    pages: (doc_id, page, route, piece_words, layer_words, lone_math, whole_page, most_of_page, has_text, body_text, unchecked)."""
    low = (F.col("route") != "copy") & ((F.col("piece_words") < LOW_MATCH) | (F.col("layer_words") < LOW_MATCH))
    each = ((low, "low word match"), (F.col("lone_math"), "displayed math without a formula"), (F.col("whole_page"), "figure is the whole page"), (F.col("has_text") & F.col("most_of_page"), "figure is most of the page"), (F.col("body_text"), "figure holds body text"), (F.col("unchecked"), "figure was not checked"))
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in each)))
    return pages.select("doc_id", "page", reasons.alias("reasons")).where(F.size("reasons") > 0)


def claim_rows(claims: DataFrame) -> DataFrame:
    """(claim_id, place, source): the sources of each claim, each once in order. claims: (claim_id, sources)."""
    return claims.select("claim_id", F.posexplode(F.array_distinct("sources")).alias("place", "source"))


def follow_ups(asked: Column | str, most: int = 4) -> Column:
    """Questions on one line, without blank and repeated ones, the first few."""
    lines = F.filter(F.transform(asked, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return F.slice(F.array_distinct(lines), 1, most)
