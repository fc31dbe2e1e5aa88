"""A document's text as it is asked about as a whole, and what comes back."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import estimated_tokens

#: The most estimated tokens of one question.
MOST = 100_000


def body() -> Column:
    """What an item says: a formula between dollar signs, code in a fence, a table or a figure as it is embedded."""
    formula = F.concat_ws(" ", F.concat(F.lit("$$"), "text", F.lit("$$")), "label")
    code = F.concat_ws("\n", "label", F.concat(F.lit("```"), F.coalesce("language", F.lit("")), F.lit("\n"), "text", F.lit("\n```")))
    return F.when(F.col("kind") == "formula", formula).when(F.col("kind") == "code", code).when(F.col("kind").isin("figure", "table"), F.col("embed_text")).otherwise(F.col("text"))


def document_texts(items: DataFrame, most: int = MOST) -> DataFrame:
    """(doc_id, text, pages, tokens, fault): the items of each document in order, with a marker where a page begins and a
    line where a section does; `pages` are those that a marker names. A text of more than `most` tokens is refused: its
    fault is `too long`, and it is null. A document without items has no row.

    items: (doc_id, doc_title, position, page, printed, title, kind, text, label, language, embed_text), an item's title being
    the document's with the headings above behind it."""
    by = Window.partitionBy("doc_id").orderBy("position")
    start = F.concat("doc_title", F.lit(" > "))
    headings = F.nullif(F.when(F.startswith("title", start), F.substr("title", F.length(start) + 1)), F.lit(""))
    rows = items.withColumn("headings", headings)
    turned = F.row_number().over(by) == 1
    turned = turned | ~F.col("page").eqNullSafe(F.lag("page").over(by))
    entered = F.col("headings").isNotNull() & ~F.col("headings").eqNullSafe(F.lag("headings").over(by))
    marker = F.concat(F.lit("[page "), F.col("page").cast("string"), F.coalesce(F.concat(F.lit(", printed "), "printed"), F.lit("")), F.lit("]"))
    lines = F.array_compact(F.array(F.when(turned, marker), F.when(entered, F.concat(F.lit("Section: "), "headings")), body()))
    each = rows.select("doc_id", "doc_title", "position", "page", lines.alias("lines"))
    whole = each.groupBy("doc_id").agg(F.min_by("doc_title", "position").alias("doc_title"), F.sort_array(F.collect_list(F.struct("position", "lines"))).alias("l"), F.array_sort(F.collect_set("page")).alias("pages"))
    text = F.concat_ws("\n\n", F.concat(F.lit("Document: "), "doc_title"), F.flatten(F.transform("l", lambda x: x["lines"])))
    whole = whole.withColumn("text", text).withColumn("tokens", estimated_tokens("text"))
    long = F.col("tokens") > most
    return whole.select("doc_id", F.when(~long, F.col("text")).alias("text"), "pages", "tokens", F.when(long, "too long").alias("fault"))


def cheat_sheet(reply: Column | str) -> Column:
    r"""A reply's cheat sheet. One without a line break that holds a `\n` was escaped once too often, so its `\n`, `\"` and
    `\\` are a line break, a quote and a backslash. A last quote that none opens is dropped."""
    text = F.trim(reply)
    units = F.regexp_extract_all(text, F.lit(r"\\[\s\S]|[^\\]++|\\"), F.lit(0))
    plain = F.array_join(F.transform(units, lambda u: F.when(u == "\\n", "\n").when(u == '\\"', '"').when(u == "\\\\", "\\").otherwise(u)), "")
    text = F.when(~F.contains(text, F.lit("\n")) & F.contains(text, F.lit("\\n")), F.regexp_replace(plain, r"^\s+|\s+\z", "")).otherwise(text)
    quotes = F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))
    return F.when(F.endswith(text, F.lit('"')) & (quotes % 2 == 1), F.regexp_replace(F.substr(text, F.lit(1), F.length(text) - 1), r"\s+\z", "")).otherwise(text)
