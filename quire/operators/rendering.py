"""From a chapter's pieces to blocks of Markdown in reading order, and from these to records of sections.

Places are made by windows over a chapter: a footnote's block gets the place of the text that carries it and a rank after
it, pairs that must stay together become ranges whose starts and ends are summed up, and a section's images get the
characters before them. Only the cut at headings is a fold over a chapter's blocks.

pieces: as in operators.pieces; of caption, printed_number, name, statement, symbols array<struct<symbol,meaning>>,
printed_text array<string> and image, those that are missing count as null."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import estimated_tokens, fence, inline_math, joined_cut, same_name
from quire.operators import cutting
from quire.operators.passages import FIGURE_NOTE
from quire.operators.pieces import KEY, attached_footnotes, bridged_lead_ins, footnote_links, in_paragraphs, in_reading_order, lead_ins, paragraphs, sections
from quire.sources import lineage

#: Stands before the words printed in a figure, at the end of its explanation.
PRINTED = "\n\nText printed in the figure: "
_OPTIONAL = {"caption": "string", "printed_number": "string", "name": "string", "statement": "string", "symbols": "array<struct<symbol:string,meaning:string>>", "printed_text": "array<string>", "image": "string"}


def filled(text: Column | str) -> Column:
    """A text without spaces at its ends, or null when nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def in_parentheses(label: Column) -> Column:
    return F.when(label.startswith("(") & label.endswith(")"), label).otherwise(F.concat(F.lit("("), label, F.lit(")")))


def figure_name(label: Column) -> Column:
    return F.when(label.isNull(), "Figure").when(F.lower(label).startswith("figure"), inline_math(label)).otherwise(F.concat(F.lit("Figure "), inline_math(label)))


def explanation(content: Column | str) -> Column:
    """A figure's content before the words printed in it."""
    whole = F.col(content) if isinstance(content, str) else content
    parts = F.split(whole, PRINTED, -1)
    return F.trim(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), PRINTED))


def written() -> Column:
    """The Markdown of a piece other than a text."""
    label, caption = filled("label"), filled("caption")
    formula = F.concat(F.lit("$$\n"), F.trim("content"), F.lit("\n$$"), F.coalesce(F.concat(F.lit("\n"), in_parentheses(label)), F.lit("")))
    line = F.nullif(F.concat_ws(": ", inline_math(label), inline_math(caption)), F.lit(""))
    with_line = lambda body: F.concat_ws("\n", line, body)
    code = F.concat(fence("content"), F.coalesce("language", F.lit("")), F.lit("\n"), F.col("content"), F.lit("\n"), fence("content"))
    figure = F.concat(F.lit("["), F.concat_ws(": ", figure_name(label), inline_math(caption)), F.lit(FIGURE_NOTE), inline_math(explanation("content")), F.lit("]"))
    note = F.concat(F.coalesce(F.concat(F.lit("[^"), "marker", F.lit("]: ")), F.lit("Footnote: ")), inline_math("content"))
    heading = F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.col("rank"), F.lit(6)))), F.lit(" "), inline_math(F.concat_ws(" ", "printed_number", "content")))
    kinds = {"heading": heading, "formula": formula, "table": with_line(inline_math("content")), "code": with_line(code), "figure": figure, "footnote": note}
    return F.coalesce(*(F.when(F.col("kind") == k, c) for k, c in kinds.items()))


def told() -> Column:
    """What a model that writes from a piece is told besides its text: a formula's name, statement and symbols, the words
    printed in a figure; or null."""
    label = F.coalesce(F.concat(F.lit(" "), in_parentheses(filled("label"))), F.lit(""))
    name = F.concat(F.regexp_replace(filled("name"), r"\.+$", ""), F.lit("."))
    each = F.array_join(F.transform("symbols", lambda s: F.concat_ws(": ", s["symbol"], s["meaning"])), "; ")
    symbols = F.when(F.size("symbols") > 0, F.concat(F.lit("Symbols: "), each))
    parts = F.nullif(F.concat_ws(" ", name, filled("statement"), symbols), F.lit(""))
    printed = F.array_join(F.transform("printed_text", lambda t: F.concat(F.lit('"'), t, F.lit('"'))), "; ")
    figure = F.when(F.size("printed_text") > 0, F.concat(figure_name(filled("label")), F.lit(" printed text: "), printed))
    return F.when(F.col("kind") == "formula", F.concat(F.lit("Formula"), label, F.lit(": "), parts)).when(F.col("kind") == "figure", figure)


def with_paths(pieces: DataFrame) -> DataFrame:
    """pieces with `path`, the numbers of the headings open at each in the order of the chapter's headings, from 1; a
    heading's own is the last of its path; and `heading`, its number."""
    heading = F.col("kind") == "heading"
    number = F.sum(F.when(heading, 1).otherwise(0)).over(in_reading_order()).cast("int")
    # Their numbers stand for the headings' names, so that equal names are told apart.
    open_ = sections(pieces.withColumn("heading", number).withColumn("own content", F.col("content")).withColumn("content", F.when(heading, F.col("heading").cast("string")).otherwise("")))
    path = F.transform("path", lambda h: h.cast("int"))
    return open_.withColumn("path", F.when(heading, F.concat(path, F.array("heading"))).otherwise(path)).withColumn("content", F.col("own content")).drop("own content")


def blocks(pieces: DataFrame) -> DataFrame:
    """(doc_id, position, path, text, tokens, transcribed, model_written, note, image, with_next, lone_note, pieces): a
    chapter's blocks from position 0. A footnote follows the first text that shows its mark and lies under that text's
    headings; one that no text shows stays where it is, alone. with_next: a text that leads into a formula stays with all
    blocks up to it."""
    return blocks_of(read_with_paths(pieces))


def read_with_paths(pieces: DataFrame) -> DataFrame:
    """with_paths() of pieces with all their columns, written, as each step from there reads them again."""
    return lineage.written(with_paths(pieces.withColumns({c: F.lit(None).cast(t) for c, t in _OPTIONAL.items() if c not in pieces.columns})))


def blocks_of(own: DataFrame) -> DataFrame:
    """blocks() of read_with_paths()."""
    texts = in_paragraphs(own)
    parts = F.sort_array(F.collect_list(F.struct("page", "number", inline_math("content").alias("text"))))
    paths = F.min_by("path", F.struct("page", "number"))
    joined = texts.groupBy("doc_id", "run", "paragraph").agg(parts.alias("parts"), paths.alias("path"), F.sum(estimated_tokens("content")).alias("transcribed"))
    place = F.struct(F.col("parts")[0]["page"].alias("page"), F.col("parts")[0]["number"].alias("number"))
    text = F.aggregate(F.slice("parts", 2, 1_000_000), F.col("parts")[0]["text"], lambda acc, p: joined_cut(acc, p["text"]))
    none = F.lit(None).cast("string")
    no = F.lit(False)
    zero = F.lit(0).cast("long")
    said = joined.select("doc_id", place.alias("slot"), zero.alias("after"), "path", text.alias("text"), "transcribed", zero.alias("model_written"), none.alias("note"), none.alias("image"), no.alias("lone_note"), F.transform("parts", lambda p: F.struct(p["page"], p["number"])).alias("pieces"))
    carriers = joined.select("doc_id", "run", "paragraph", place.alias("carrier"), F.col("path").alias("carried path"))
    notes = attached_footnotes(own, paragraphs(own), footnote_links(own)).join(carriers, ["doc_id", "run", "paragraph"], "left").drop("run", "paragraph")
    figure = F.col("kind") == "figure"
    transcribed = F.when(figure, 0).otherwise(estimated_tokens("content")).cast("long")
    model = F.when(figure, estimated_tokens(explanation("content"))).otherwise(0).cast("long")
    others = own.where(F.col("kind") != "text").join(notes, KEY, "left")
    at = F.struct("page", "number")
    footnote = F.col("kind") == "footnote"
    after = F.when(F.col("carrier").isNotNull(), F.row_number().over(Window.partitionBy("doc_id", "carrier").orderBy("page", "number"))).otherwise(0).cast("long")
    others = others.select("doc_id", F.coalesce("carrier", at).alias("slot"), after.alias("after"), F.coalesce("carried path", "path").alias("path"), written().alias("text"), transcribed.alias("transcribed"), model.alias("model_written"), told().alias("note"), F.when(figure, F.col("image")).alias("image"), (footnote & F.col("carrier").isNull()).alias("lone_note"), F.array(at).alias("pieces"))
    both = said.union(others).withColumn("position", (F.row_number().over(Window.partitionBy("doc_id").orderBy("slot", "after")) - 1).cast("int"))
    return stay_together(both, leads(own)).withColumn("tokens", estimated_tokens("text")).select("doc_id", "position", "path", "text", "tokens", "transcribed", "model_written", "note", "image", "with_next", "lone_note", "pieces")


def leads(pieces: DataFrame) -> DataFrame:
    """(doc_id, from, to): the texts that introduce formulas, of one page or over its border, as (page, number)."""
    saved = lead_ins(pieces)
    over = bridged_lead_ins(pieces, saved)
    at = lambda page, c: F.struct(page.alias("page"), F.col(c).alias("number"))
    row = lambda df, page: df.select("doc_id", at(F.col("page"), "from").alias("from"), at(page, "to").alias("to"))
    return row(saved, F.col("page")).union(row(over, (F.col("page") + 1).cast(pieces.schema["page"].dataType)))


def stay_together(placed: DataFrame, pairs: DataFrame) -> DataFrame:
    """placed (doc_id, position, pieces) with `with_next`: whether a block lies from that of a pair's first piece up to
    before that of its second. pairs: (doc_id, from, to). Ranges are summed up from their ends, so they may overlap."""
    where = placed.select("doc_id", "position", F.explode("pieces").alias("piece"))
    of = lambda c: where.select("doc_id", F.col("piece").alias(c), F.col("position").alias(f"{c} at"))
    ranges = pairs.join(of("from"), ["doc_id", "from"]).join(of("to"), ["doc_id", "to"]).where(F.col("from at") < F.col("to at"))
    ends = F.explode(F.array(F.struct(F.col("from at").alias("position"), F.lit(1).alias("step")), F.struct(F.col("to at").alias("position"), F.lit(-1).alias("step"))))
    steps = ranges.select("doc_id", ends.alias("e")).groupBy("doc_id", F.col("e.position").alias("position")).agg(F.sum("e.step").alias("step"))
    open_ = F.sum(F.coalesce("step", F.lit(0))).over(Window.partitionBy("doc_id").orderBy("position"))
    return placed.join(steps, ["doc_id", "position"], "left").withColumn("with_next", open_ > 0).drop("step")


def section_records(pieces: DataFrame, titles: DataFrame, most: int = cutting.MOST, least: int = cutting.LEAST) -> DataFrame:
    """(doc_id, id, section_path, pages, pieces, markdown, notes, images, n_tokens, transcribed, model_written): a record for
    each part of a section. images: struct<ref, pos>, pos being the characters of the text before the figure's note.

    titles: (doc_id, slug, media, title); a document named as its media says the name once."""
    own = read_with_paths(pieces)
    made = lineage.written(blocks_of(own))
    cut = lineage.written(cutting.cut(made.select("doc_id", "position", "path", "tokens", "with_next", "lone_note"), most, least))
    saved = own.where("kind = 'heading'").select("doc_id", "heading", F.concat_ws(" ", "printed_number", "content").alias("saved"))
    parts = cut.where("place = 0").select("doc_id", "section", "part", "parts", "path")
    names = parts.select("doc_id", "section", "part", F.posexplode("path").alias("depth", "heading")).join(saved, ["doc_id", "heading"])
    names = names.groupBy("doc_id", "section", "part").agg(F.sort_array(F.collect_list(F.struct("depth", "saved")))["saved"].alias("section_path"))
    head = parts.join(names, ["doc_id", "section", "part"], "left").join(titles, "doc_id", "left")
    own_path = F.coalesce("section_path", F.array().cast("array<string>"))
    line = F.concat(F.array("media"), F.when(same_name(F.col("media"), F.col("title")), F.array().cast("array<string>")).otherwise(F.array("title")), own_path)
    head = head.withColumn("section_path", own_path).withColumn("line", F.concat(F.lit("# "), F.array_join(F.transform(line, inline_math), " › ")))
    number = F.lpad((F.col("section") + 1).cast("string"), F.greatest(F.lit(3), F.length((F.col("section") + 1).cast("string"))), F.lit("0"))
    name = F.concat("slug", F.lit(":s"), number, F.when(F.col("parts") > 1, F.concat(F.lit(":p"), (F.col("part") + 1).cast("string"))).otherwise(""))
    head = head.select("doc_id", "section", "part", name.alias("id"), "section_path", "line")
    placed = cut.drop("path", "parts").join(made.drop("path"), ["doc_id", "position"]).join(head.select("doc_id", "section", "part", F.length("line").alias("ahead")), ["doc_id", "section", "part"])
    before = Window.partitionBy("doc_id", "section", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    # The heading line, then each block before, with an empty line after each.
    pos = F.col("ahead") + 2 + F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0))
    placed = placed.withColumn("picture", F.when(F.col("image").isNotNull(), F.struct(F.col("image").alias("ref"), pos.cast("long").alias("pos"))))
    order = lambda *c: F.sort_array(F.collect_list(F.struct("place", *c)))
    each = placed.groupBy("doc_id", "section", "part").agg(order("text", "note", "pieces").alias("b"), F.sort_array(F.collect_list(F.when(F.col("picture").isNotNull(), F.struct("place", "picture")))).alias("i"), F.sum("transcribed").alias("transcribed"), F.sum("model_written").alias("model_written"))
    markdown = F.concat_ws("\n\n", "line", F.transform("b", lambda x: x["text"]))
    records = each.join(head, ["doc_id", "section", "part"]).withColumn("markdown", markdown).withColumn("pieces", F.flatten(F.transform("b", lambda x: x["pieces"])))
    notes = F.array_join(F.filter(F.transform("b", lambda x: x["note"]), lambda n: n.isNotNull()), "\n\n")
    pages = F.array_sort(F.array_distinct(F.transform("pieces", lambda p: p["page"])))
    return records.select("doc_id", "id", "section_path", pages.alias("pages"), "pieces", "markdown", notes.alias("notes"), F.transform("i", lambda x: x["picture"]).alias("images"), estimated_tokens("markdown").alias("n_tokens"), "transcribed", "model_written")
