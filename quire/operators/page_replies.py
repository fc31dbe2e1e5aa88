"""The first fault of a model's reply for a page: its strings and pieces as rows, each rule as rows of what breaks it, and
of these the one of the first rule, and there of the first place.

replies: (page_id, printed, header, starts, ends, layer_words, pieces, discusses array<struct<piece,about>>); a piece has
number, kind, content (its text, Markdown, LaTeX, code or explanation), label, caption, printed_number, name, statement,
symbols array<struct<symbol,meaning>>, printed_text array<string>, note, summary, language, marker, cites array<string>
and bounds struct<left,top,right,bottom>."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import latex
from quire.operators.replies import table_fault

#: The words of a layer that isn't almost empty, those of a figure's explanation, and a figure's least side.
WORDS, EXPLANATION, SIDE = 20, 60, 20
#: The strings of a piece by its kind, in order, and what each holds; a field of another name than its column after a dot.
FIELDS = {
    "heading": (("printed_number", "plain"), ("content", "mixed")),
    "text": (("content", "mixed"), ("cites", "plain")),
    "formula": (("content", "formula"), ("label", "plain"), ("name", "plain"), ("statement", "plain"), ("symbols", "symbol")),
    "figure": (("label", "plain"), ("caption", "mixed"), ("printed_text", "plain"), ("content", "mixed")),
    "table": (("label", "plain"), ("caption", "mixed"), ("content", "mixed"), ("note", "mixed"), ("summary", "plain")),
    "footnote": (("marker", "plain"), ("content", "mixed"), ("cites", "plain")),
    "code": (("label", "plain"), ("caption", "mixed"), ("language", "plain"), ("content", "code"), ("summary", "plain")),
}
_STRING = "array<struct<field:string,role:string,text:string>>"


def strings(piece: Column) -> Column:
    """A piece's strings in order; those that are null are none."""
    one = lambda name, role, text: F.struct(F.lit(name).alias("field"), F.lit(role).alias("role"), text.alias("text"))

    def of(name: str, role: str) -> Column:
        value = piece[name]
        if name == "symbols":
            return F.flatten(F.transform(value, lambda s: F.array(one(name, "symbol", s["symbol"]), one(name, "plain", s["meaning"]))))
        return F.transform(value if name in ("cites", "printed_text") else F.array(value), lambda t: one(name, role, t))

    none = F.array().cast(_STRING)
    found = F.coalesce(*(F.when(piece["kind"] == k, F.concat(*(F.coalesce(of(*f).cast(_STRING), none) for f in fields))) for k, fields in FIELDS.items()), none)
    return F.filter(found, lambda s: s["text"].isNotNull())


def control_sign(text: Column) -> Column:
    """Which control character that JSON made of a lost backslash a text holds first."""
    first = F.regexp_extract(text, "[\t\b\f\r]", 0)
    return F.when(first == "\t", "tab").when(first == "\b", "backspace").when(first == "\f", "form feed").when(first == "\r", "carriage return")


def displayed(text: Column) -> Column:
    """What displayed math a text holds that should be a formula of its own."""
    names = [F.when(F.contains(text, F.lit("\\begin{" + n)), n) for n in ("equation", "align", "gather", "multline")]
    return F.coalesce(F.when(text.rlike(r"(?s)\$\$.*\$\$"), "dollars"), *names)


def bounds_fault(b: Column) -> Column:
    sides = [b[s] for s in ("left", "top", "right", "bottom")]
    outside = reduce(lambda x, y: x | y, (~s.between(0, 1000) for s in sides))
    small = (b["right"] - b["left"] < SIDE) | (b["bottom"] - b["top"] < SIDE)
    return F.when(outside, "outside").when(b["left"] >= b["right"], "left").when(b["top"] >= b["bottom"], "top").when((b["right"] <= 100) & (b["bottom"] <= 100), "percent").when(small, "small")


def first_faults(replies: DataFrame) -> DataFrame:
    """(page_id, fault, piece, field, seen) of each reply, all null for one without a fault. The rules, in this order:
    numbers, no-pieces, empty, lost-backslash (or aligned), unbalanced, typeset, explanation, table, link, starts, ends,
    displayed, bounds. Each rule reads all strings or pieces of a page before the next one does."""
    found = []

    def rule(rows: DataFrame, name: str | Column, wrong: Column, piece=None, field=None, seen=None, order=None):
        """Rows that break a rule; its place among the rules is that of its call."""
        text = lambda c: F.lit(None).cast("string") if c is None else c
        at = F.lit(0) if order is None else order
        found.append(rows.where(wrong).select("page_id", F.lit(len(found)).alias("rule"), at.cast("int").alias("place"), (F.lit(name) if isinstance(name, str) else name).alias("fault"), (F.lit(None) if piece is None else piece).cast("int").alias("piece"), text(field).alias("field"), text(seen).alias("seen")))

    pieces = replies.select("page_id", F.posexplode("pieces").alias("at", "p")).select("page_id", "at", "p", F.col("p.number").alias("number"), F.col("p.kind").alias("kind"), F.col("p.content").alias("content"))
    of_page = F.array(*(F.struct(F.lit(n).alias("field"), F.lit("plain").alias("role"), F.col(n).alias("text")) for n in ("printed", "header")))
    own = replies.select("page_id", F.lit(-1).alias("at"), F.lit(None).cast("int").alias("number"), F.posexplode(F.filter(of_page, lambda s: s["text"].isNotNull())).alias("k", "s"))
    fields = own.union(pieces.select("page_id", "at", F.col("number").cast("int"), F.posexplode(strings(F.col("p"))).alias("k", "s"))).select("page_id", "number", "at", "s.*", "k")
    fields = fields.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("at", "k")))
    mixed, whole = F.col("role") == "mixed", F.col("role").isin("formula", "symbol")
    marks = latex.math_spans("text")
    parts = F.when(whole, F.array("text")).when(mixed, F.coalesce(marks["spans"], F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    fields = fields.withColumn("marks", F.when(mixed, marks["fault"])).withColumn("parts", parts)
    placed = {"piece": F.col("number"), "field": F.col("field"), "order": F.col("place")}
    in_piece = F.col("number").isNotNull()
    first = lambda f: F.get(F.filter(F.transform("parts", f), lambda x: x.isNotNull()), F.lit(0))

    rule(pieces, "numbers", F.col("number") != F.col("at") + 1, F.col("number"), order=F.col("at"))
    rule(replies, "no-pieces", (F.size("pieces") == 0) & (F.col("layer_words") >= WORDS))
    rule(fields, "empty", in_piece & F.col("text").rlike(r"^\s*$"), **placed)
    lines = F.exists("parts", lambda p: F.contains(p, F.lit("\n")))
    lost = F.coalesce(control_sign(F.col("text")), F.when(lines, "line break"))
    aligned = (F.col("role") == "formula") & latex.aligned_without_row_break("text")
    rule(fields, F.when(lost.isNull(), "aligned").otherwise("lost-backslash"), lost.isNotNull() | aligned, seen=lost, **placed)
    wrong = F.coalesce("marks", first(latex.unbalanced))
    rule(fields, "unbalanced", in_piece & wrong.isNotNull(), seen=wrong, **placed)
    wrong = F.coalesce(F.when(F.col("role") == "formula", latex.wrapped("text")), first(latex.bare_sign))
    rule(fields, "typeset", in_piece & wrong.isNotNull(), seen=wrong, **placed)
    by_piece = {"piece": F.col("number"), "order": F.col("at")}
    words = F.size(F.filter(F.split("content", r"\s+"), lambda w: w != ""))
    rule(pieces, "explanation", (F.col("kind") == "figure") & (words < EXPLANATION), **by_piece)
    rule(pieces, "table", (F.col("kind") == "table") & table_fault("content").isNotNull(), seen=table_fault("content"), **by_piece)
    links = replies.select("page_id", F.posexplode("discusses").alias("at", "l")).select("page_id", "at", F.col("l.piece").alias("from"), F.col("l.about").alias("about"))
    kinds = pieces.groupBy("page_id", "number").agg(F.min_by("kind", "at").alias("kind"))
    of = lambda c: kinds.select("page_id", F.col("number").alias(c), F.col("kind").alias(f"{c} kind"))
    links = links.join(of("from"), ["page_id", "from"], "left").join(of("about"), ["page_id", "about"], "left")
    wrong = F.when(F.col("from kind").isNull() | F.col("about kind").isNull(), "number").when(~F.col("from kind").isin("text", "footnote"), "piece").when(~F.col("about kind").isin("figure", "table"), "about")
    rule(links, "link", wrong.isNotNull(), F.col("from"), seen=wrong, order=F.col("at"))
    body = F.filter("pieces", lambda p: ~p["kind"].isin("figure", "table", "footnote", "code"))
    text_at = lambda i: F.coalesce(F.get(F.transform(body, lambda p: p["kind"]), i) == "text", F.lit(False))
    rule(replies, "starts", F.col("starts") & ~text_at(F.lit(0)))
    rule(replies, "ends", F.col("ends") & ~text_at(F.size(body) - 1))
    shown = displayed(F.col("content"))
    rule(pieces, "displayed", F.col("kind").isin("heading", "text", "footnote") & shown.isNotNull(), seen=shown, **by_piece)
    wrong = bounds_fault(F.col("p.bounds"))
    rule(pieces, "bounds", (F.col("kind") == "figure") & wrong.isNotNull(), seen=wrong, **by_piece)
    best = reduce(DataFrame.union, found).groupBy("page_id").agg(F.min_by(F.struct("fault", "piece", "field", "seen"), F.struct("rule", "place")).alias("f"))
    return replies.select("page_id").join(best, "page_id", "left").select("page_id", "f.*")
