"""From a chapter's pieces to its items: sections, links between pieces, paragraphs, footnotes, listings.

piece: (doc_id, page, number, kind, rank, content, label, marker, language, starts, ends); `starts` and `ends` tell of a
text piece that a page break cut its paragraph before or after it.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.dataset import packed_paragraphs

#: Ranks of headings, outermost first.
RANKS = (1, 2, 3, 4)
#: Kinds that may stand between a paragraph's halves, and those that hold marks of footnotes.
FLOATS = ("figure", "table", "footnote", "code")
CARRIERS = ("heading", "text", "table")
KEY = ["doc_id", "page", "number"]


def in_reading_order(*more: str) -> Window:
    return Window.partitionBy("doc_id", *more).orderBy("page", "number")


def mid_sentence(pieces: DataFrame, pages: DataFrame) -> DataFrame:
    """pieces with `starts` and `ends`, from those of their page: its first and its last text get them.
    pages: (doc_id, page, starts, ends)."""
    text = F.when(F.col("kind") == "text", F.col("number"))
    page = Window.partitionBy("doc_id", "page")
    rows = pieces.join(pages, ["doc_id", "page"], "left").withColumns({"first text": F.min(text).over(page), "last text": F.max(text).over(page)})
    flag = lambda c, at: F.coalesce(F.col(c) & (F.col("number") == F.col(at)), F.lit(False))
    return rows.withColumns({"starts": flag("starts", "first text"), "ends": flag("ends", "last text")}).drop("first text", "last text")


def sections(pieces: DataFrame) -> DataFrame:
    """pieces with `path`: the headings open at each, outermost first. A heading closes those of its rank and below and
    isn't in its own path. Ranks are few, so each open heading is the last of its rank since one of a lower rank."""
    before = in_reading_order().rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct("page", "number")
    heading = F.col("kind") == "heading"
    last = {r: F.max(F.when(heading & (F.col("rank") == r), F.struct(at.alias("at"), F.col("content").alias("name")))).over(before) for r in RANKS}
    rows = pieces.withColumns({f"open {r}": c for r, c in last.items()})

    def live(r: int) -> Column:
        """The heading of rank r is open unless one of a lower rank came later, or this piece closes it."""
        own = F.col(f"open {r}")
        closed = F.lit(False)
        for lower in range(1, r):
            closed = closed | F.coalesce(F.col(f"open {lower}")["at"] > own["at"], F.lit(False))
        closed = closed | F.coalesce(heading & (F.col("rank") <= r), F.lit(False))
        return F.when(own.isNotNull() & ~closed, own["name"])

    return rows.withColumn("path", F.array_compact(F.array(*map(live, RANKS)))).drop(*(f"open {r}" for r in RANKS))


def lead_ins(pieces: DataFrame) -> DataFrame:
    """(doc_id, page, from, to): the text that introduces each formula: the nearest piece before it on its page that
    isn't a formula, if that is a text."""
    before = Window.partitionBy("doc_id", "page").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    other = F.when(F.col("kind") != "formula", F.struct("number", "kind"))
    near = pieces.withColumn("near", F.last(other, ignorenulls=True).over(before))
    found = near.where((F.col("kind") == "formula") & (F.col("near.kind") == "text"))
    return found.select("doc_id", "page", F.col("near.number").alias("from"), F.col("number").alias("to"))


def bridged_lead_ins(pieces: DataFrame, saved: DataFrame) -> DataFrame:
    """(doc_id, page, from, to): the formulas that open the page after `page` and the last text of `page`, where that
    page ends mid-sentence, only floats follow the text and no lead-in is saved. saved: lead_ins()."""
    page = Window.partitionBy("doc_id", "page").orderBy("number")
    whole = page.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = F.max("ends").over(whole)
    last = F.last(F.when(~F.col("kind").isin(*FLOATS), F.struct("number", "kind")), ignorenulls=True).over(whole)
    texts = pieces.withColumns({"last": last, "cut": ends}).where(F.col("cut") & (F.col("last.kind") == "text"))
    texts = texts.select("doc_id", "page", F.col("last.number").alias("from")).distinct()
    opening = F.coalesce(F.max(F.col("kind") != "formula").over(page.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))
    formulas = pieces.withColumn("late", opening).where(~F.col("late")).select("doc_id", "page", F.col("number").alias("to"))
    formulas = formulas.join(saved.select("doc_id", "page", "to"), ["doc_id", "page", "to"], "left_anti")
    return texts.join(formulas.select("doc_id", (F.col("page") - 1).alias("page"), "to"), ["doc_id", "page"]).select("doc_id", "page", "from", "to")


def markers(text: Column | str) -> Column:
    """The marks of footnotes in a text, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[\^([^\]]+)\]"), F.lit(1)))


def footnote_links(pieces: DataFrame) -> DataFrame:
    """(doc_id, page, from, to): each footnote with a mark, and the headings, texts and tables of its page that show it."""
    shown = pieces.where(F.col("kind").isin(*CARRIERS)).select("doc_id", "page", F.col("number").alias("to"), F.explode(markers("content")).alias("marker"))
    notes = pieces.where((F.col("kind") == "footnote") & F.col("marker").isNotNull()).select("doc_id", "page", F.col("number").alias("from"), "marker")
    return notes.join(shown, ["doc_id", "page", "marker"]).select("doc_id", "page", "from", "to")


def kept_cites(cites: Column | str) -> Column:
    """Labels of figures, tables and equations, trimmed, each once in order; blank ones and footnotes are left out."""
    own = F.filter(cites, lambda c: (c["kind"] != "footnote") & (F.trim(c["label"]) != ""))
    return F.array_distinct(F.transform(own, lambda c: F.trim(c["label"])))


def in_paragraphs(pieces: DataFrame) -> DataFrame:
    """The texts that aren't blank, with `run`, the heading that they come after, and `paragraph`, its number there. Two
    are one paragraph where the earlier ends and the later starts mid-sentence with no other text between."""
    run = F.sum(F.when(F.col("kind") == "heading", 1).otherwise(0)).over(in_reading_order())
    texts = pieces.withColumn("run", run).where((F.col("kind") == "text") & (F.trim("content") != ""))
    joins = F.coalesce(F.lag("ends").over(in_reading_order("run")) & F.col("starts"), F.lit(False))
    return texts.withColumn("paragraph", F.sum(F.when(joins, 0).otherwise(1)).over(in_reading_order("run")))


def paragraphs(pieces: DataFrame) -> DataFrame:
    """(doc_id, run, paragraph, page, number, text): the texts between headings. Two pieces are one paragraph, joined by
    a space, where the earlier ends and the later starts mid-sentence with no other text between."""
    texts = in_paragraphs(pieces)
    parts = F.sort_array(F.collect_list(F.struct("page", "number", "content")))
    both = texts.groupBy("doc_id", "run", "paragraph").agg(parts.alias("p"))
    first = F.col("p")[0]
    return both.select("doc_id", "run", "paragraph", first["page"].alias("page"), first["number"].alias("number"), F.array_join(F.transform("p", lambda x: x["content"]), " ").alias("text"), F.transform("p", lambda x: F.struct(x["page"], x["number"])).alias("pieces"))


def attached_footnotes(pieces: DataFrame, made: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, page, number, run, paragraph): the paragraph that each footnote goes to: that of the first text piece
    which shows its mark; run is null for one that no text shows. made: paragraphs(); links: footnote_links()."""
    places = made.select("doc_id", "run", "paragraph", F.explode("pieces").alias("x")).select("doc_id", "run", "paragraph", F.col("x.page").alias("page"), F.col("x.number").alias("to"))
    found = links.join(places, ["doc_id", "page", "to"]).groupBy("doc_id", "page", F.col("from").alias("number")).agg(F.min(F.struct("to", "run", "paragraph")).alias("t"))
    notes = pieces.where(F.col("kind") == "footnote").select(*KEY)
    return notes.join(found, KEY, "left").select(*KEY, F.col("t.run").alias("run"), F.col("t.paragraph").alias("paragraph"))


def chunks(pieces: DataFrame, tokens: int = 500) -> DataFrame:
    """(doc_id, page, number, text): paragraphs with their footnotes, packed in order while a chunk has at most `tokens`,
    within a run between headings; and a chunk for each footnote that no text shows."""
    made = paragraphs(pieces)
    notes = attached_footnotes(pieces, made, footnote_links(pieces))
    told = notes.join(pieces.select(*KEY, "marker", "content"), KEY)
    line = F.when(F.col("marker").isNotNull(), F.concat(F.lit("[^"), "marker", F.lit("]: "), "content")).otherwise(F.concat(F.lit("Footnote: "), "content"))
    of = told.where(F.col("run").isNotNull()).groupBy("doc_id", "run", "paragraph").agg(F.sort_array(F.collect_list(F.struct("page", "number", line.alias("line")))).alias("notes"))
    blocks = made.join(of, ["doc_id", "run", "paragraph"], "left")
    more = F.coalesce(F.transform("notes", lambda x: x["line"]), F.array().cast("array<string>"))
    blocks = blocks.select("doc_id", "run", "page", "number", F.array_join(F.concat(F.array("text"), more), "\n\n").alias("block"))
    # One run between headings is what a reader holds at once.
    runs = blocks.groupBy("doc_id", "run").agg(F.sort_array(F.collect_list(F.struct("page", "number", "block"))).alias("b"))
    runs = runs.withColumn("c", packed_paragraphs(F.transform("b", lambda x: x["block"]), tokens))
    each = runs.select("doc_id", "run", F.explode(F.arrays_zip("b", "c")).alias("x")).select("doc_id", "run", F.col("x.c").alias("chunk"), "x.b.*")
    packed = each.groupBy("doc_id", "run", "chunk").agg(F.sort_array(F.collect_list(F.struct("page", "number", "block"))).alias("b"))
    packed = packed.select("doc_id", F.col("b")[0]["page"].alias("page"), F.col("b")[0]["number"].alias("number"), F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("text"))
    return packed.union(told.where(F.col("run").isNull()).select("doc_id", "page", "number", F.col("content").alias("text")))


def listings(pieces: DataFrame) -> DataFrame:
    """(doc_id, page, number, listing, language): code pieces by the listing they belong to. A piece carries on the one
    before it on the page before, if it has no label, their languages agree or one is unknown, and only footnotes are
    between. A listing's language is the first known one of its pieces."""
    rows = pieces.where(F.col("kind") != "footnote")
    by = in_reading_order()
    near = {f"last {c}": F.lag(c).over(by) for c in ("kind", "page", "language")}
    code = rows.withColumns(near).where(F.col("kind") == "code")
    agrees = F.coalesce(F.col("language") == F.col("last language"), F.lit(True))
    goes_on = (F.col("last kind") == "code") & (F.col("last page") + 1 == F.col("page")) & F.col("label").isNull() & agrees
    number = F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(by)
    code = code.withColumn("listing", number)
    whole = Window.partitionBy("doc_id", "listing").orderBy("page", "number").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return code.select(*KEY, "listing", F.first("language", ignorenulls=True).over(whole).alias("language"))


def context_line(title: Column, path: Column) -> Column:
    """The document's title and the headings above, outermost first."""
    return F.array_join(F.concat(F.array(title), path), " > ")


def embed_text(*parts: Column) -> Column:
    """The parts that aren't blank, an empty line between."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (F.trim(p) != "")), "\n\n")


def piece_drafts(pieces: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, page, number, kind, embed_text): formulas, figures and tables with the last text that introduces them,
    their content and their label. links: lead_ins()."""
    last = links.groupBy("doc_id", "page", F.col("to").alias("number")).agg(F.max("from").alias("from"))
    texts = pieces.select("doc_id", "page", F.col("number").alias("from"), F.col("content").alias("lead"))
    own = pieces.where(F.col("kind").isin("formula", "figure", "table")).join(last, KEY, "left").join(texts, ["doc_id", "page", "from"], "left")
    label = F.when(F.trim("label") != "", F.concat(F.lit("Label: "), F.trim("label")))
    return own.select(*KEY, "kind", embed_text(F.col("lead"), F.col("content"), label).alias("embed_text"))


def items(pieces: DataFrame, tokens: int = 500) -> DataFrame:
    """(doc_id, position, page, number, kind): a document's items from position 0, by the piece that each starts at."""
    drafts = chunks(pieces, tokens).select(*KEY, F.lit("chunk").alias("kind"))
    drafts = drafts.union(piece_drafts(pieces, lead_ins(pieces)).select(*KEY, "kind"))
    first = listings(pieces).groupBy("doc_id", "listing").agg(F.min(F.struct("page", "number")).alias("f"))
    drafts = drafts.union(first.select("doc_id", "f.page", "f.number", F.lit("code")))
    return drafts.withColumn("position", F.row_number().over(in_reading_order()) - 1).select("doc_id", "position", "page", "number", "kind")


def outline(pieces: DataFrame) -> DataFrame:
    """(doc_id, section, heading, first_page, last_page, chars, formula, figure, table, code): a row for each run under a
    heading, numbered from 1, with its pages, its characters and its pieces of each kind."""
    run = F.sum(F.when(F.col("kind") == "heading", 1).otherwise(0)).over(in_reading_order())
    own = pieces.withColumn("run", run)
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in ("formula", "figure", "table", "code")]
    name = F.min(F.when(F.col("kind") == "heading", F.col("content"))).alias("heading")
    rows = own.groupBy("doc_id", "run").agg(name, F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.sum(F.length("content")).alias("chars"), *counts)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("run"))
    return rows.withColumn("section", number).select("doc_id", "section", "heading", "first_page", "last_page", "chars", "formula", "figure", "table", "code")


def sections_named(rows: DataFrame, name: str) -> DataFrame:
    """(doc_id, section, fault): the section of each document that a name means; a name that several have is ambiguous.
    rows: outline()."""
    found = rows.where(F.lower(F.trim("heading")) == name.strip().lower()).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("section").alias("section"))
    return found.select("doc_id", F.when(F.col("n") == 1, F.col("section")).alias("section"), F.when(F.col("n") > 1, F.lit("ambiguous")).alias("fault"))


def page_texts(pieces: DataFrame, first: int, last: int, chars: int) -> DataFrame:
    """(doc_id, text): the pieces of the pages first to last in order, cut at so many characters."""
    own = pieces.where(F.col("page").between(first, last))
    both = own.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "number", "content"))).alias("p"))
    return both.select("doc_id", F.substring(F.array_join(F.transform("p", lambda x: x["content"]), "\n\n"), 1, chars).alias("text"))
