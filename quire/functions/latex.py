r"""LaTeX and math marks in texts, as column expressions.

A backslash and the letters after it, or the one other character after it, are one unit, so `\\{` is a row break and an
opening brace. Loops in the patterns are possessive, so a text of any length is read in one pass without a deep stack.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units that a formula's structure depends on, with the name in braces after \begin and \end as the first group.
_STRUCTURE = r"\\(?:begin|end)(?![A-Za-z])(?=(\{[^\\}]*+(?:\\[\s\S][^\\}]*+)*+\})|)|\\[A-Za-z]++|\\[\s\S]|[{}]"
_UNIT = r"\\[A-Za-z]++|\\[\s\S]|[\s\S]"
# Environments that a formula written alone must not be wrapped in.
WRAPPING = ("equation", "equation*", "align", "align*", "gather", "gather*", "multline", "multline*")
#: Stands for a dollar sign after a backslash while spans are looked for; no character of a text.
_DOLLAR = "\uffff"
#: Display math up to the next two dollars, inline math up to the next one, or math that never ends.
_MATH = r"\$\$[\s\S]*?\$\$|\$(?!\$)[^$]*+\$|\$[\s\S]*+"


def found(text: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def math_spans(text: Column | str) -> Column:
    r"""struct(spans, fault): the texts between \( and \), or how they open and close wrongly: `nested`, `unopened` or
    `unclosed`, whichever comes first."""
    marks = F.filter(found(text, r"\\[\s\S]"), lambda u: u.isin("\\(", "\\)"))
    # In order, they must be open and close by turns.
    wrong = F.filter(F.transform(marks, lambda u, i: F.when((u == "\\(") != (i % 2 == 0), F.when(u == "\\(", "nested").otherwise("unopened"))), lambda f: f.isNotNull())
    fault = F.coalesce(F.get(wrong, F.lit(0)), F.when(F.size(marks) % 2 == 1, "unclosed"))
    inside = found(text, r"\G(?:[^\\]|\\[^(])*+\\\(((?:[^\\]|\\[^)])*+)\\\)", 1)
    return F.struct(F.when(fault.isNull(), inside).alias("spans"), fault.alias("fault"))


def unbalanced(latex: Column | str) -> Column:
    r"""The first fault of a formula's structure, or null: `closing-brace` without an opening one, `end` without a \begin
    of its name, `opening-brace`, `begin` without an end, `left-right` of unequal number."""
    zero = "named_struct('depth', 0, 'open', array(), 'sides', 0, 'fault', null)"
    kinds = "struct<depth:int,open:array<string>,sides:int,fault:string>"
    text = F.col(latex) if isinstance(latex, str) else latex
    units = F.arrays_zip(found(text, _STRUCTURE).alias("u"), found(text, _STRUCTURE, 1).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        u, name, depth = x["u"], x["n"], acc["depth"]
        depth = F.when(u == "{", depth + 1).when(u == "}", depth - 1).otherwise(depth)
        begins, ends = (u == "\\begin") & (name != ""), (u == "\\end") & (name != "")
        top = F.get(acc["open"], F.size(acc["open"]) - 1)
        stack = F.when(begins, F.concat(acc["open"], F.array(name))).when(ends, F.slice(acc["open"], F.lit(1), F.greatest(F.size(acc["open"]) - 1, F.lit(0)))).otherwise(acc["open"])
        sides = acc["sides"] + F.when(u == "\\left", 1).when(u == "\\right", -1).otherwise(0)
        fault = F.coalesce(acc["fault"], F.when(depth < 0, "closing-brace"), F.when(ends & ~top.eqNullSafe(name), "end"))
        return F.struct(depth.alias("depth"), stack.alias("open"), sides.alias("sides"), fault.alias("fault"))

    def last(acc: Column) -> Column:
        return F.coalesce(acc["fault"], F.when(acc["depth"] > 0, "opening-brace"), F.when(F.size(acc["open"]) > 0, "begin"), F.when(acc["sides"] != 0, "left-right"))

    return F.aggregate(units, F.expr(zero).cast(kinds), step, last)


def bare_sign(latex: Column | str) -> Column:
    """`percent` or `dollar`, whichever the formula first holds without a backslash before it; else null."""
    sign = F.get(F.filter(found(latex, r"\\[\s\S]|[%$]"), lambda u: u.isin("%", "$")), F.lit(0))
    return F.when(sign == "%", "percent").when(sign == "$", "dollar")


def wrapped(latex: Column | str) -> Column:
    r"""What a formula, to be written alone, is wrapped in: `parentheses`, `brackets`, `dollars` or an `environment`; or
    `label` if it holds a \tag or \label; else null."""
    text = F.regexp_replace(latex, r"^\s+", "")
    names = "|".join(w.replace("*", r"\*") for w in WRAPPING)
    environment = text.rlike(rf"^\\begin\{{(?:{names})\}}")
    labelled = F.exists(found(text, r"\\[A-Za-z]++|\\[\s\S]"), lambda u: u.isin("\\tag", "\\label"))
    return F.when(text.startswith("\\("), "parentheses").when(text.startswith("\\["), "brackets").when(text.startswith("$"), "dollars").when(environment, "environment").when(labelled, "label")


def aligned_without_row_break(latex: Column | str) -> Column:
    opens = F.exists(F.arrays_zip(found(latex, _STRUCTURE).alias("u"), found(latex, _STRUCTURE, 1).alias("n")), lambda x: (x["u"] == "\\begin") & (x["n"] == "{aligned}"))
    return opens & ~F.exists(found(latex, r"\\[A-Za-z]++|\\[\s\S]"), lambda u: u == "\\\\")


def mended_row_breaks(latex: Column | str) -> Column:
    """A row break and the line break after it as a row break and a space, unless a letter comes next: there a
    backslash may have been lost, which a check must still see."""
    return F.regexp_replace(latex, r"(?<!\\)((?:\\\\)++)\x20*+\r?\n(?!\p{IsAlphabetic})", "$1 ")


def bare_row_break(latex: Column | str) -> Column:
    """Whether a row break is outside all braces and environments."""
    text = F.col(latex) if isinstance(latex, str) else latex
    units = F.arrays_zip(found(text, _STRUCTURE).alias("u"), found(text, _STRUCTURE, 1).alias("n"))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("open"), F.lit(False).alias("bare"))

    def step(acc: Column, x: Column) -> Column:
        u, named = x["u"], x["n"] != ""
        depth = acc["depth"] + F.when(u == "{", 1).when(u == "}", -1).otherwise(0)
        opened = acc["open"] + F.when(named & (u == "\\begin"), 1).when(named & (u == "\\end"), -1).otherwise(0)
        return F.struct(depth.alias("depth"), opened.alias("open"), (acc["bare"] | ((u == "\\\\") & (acc["depth"] == 0) & (acc["open"] == 0))).alias("bare"))

    return F.aggregate(units, zero, step, lambda acc: acc["bare"])


def dollar_spans(prose: Column | str) -> Column:
    """array<struct<latex, closed>>: the math between single or double dollar signs, in order; a dollar sign after a
    backslash marks none. Math that never ends reaches to the end of the text."""
    # An odd run of backslashes escapes what follows it.
    hidden = F.regexp_replace(prose, r"(?<!\\)((?:\\\\)*+)\\\$", "$1\\\\" + _DOLLAR)

    def span(s: Column) -> Column:
        closed = s.rlike(r"^\$\$[\s\S]*\$\$\z|^\$[^$]+\$\z")
        width = F.when(s.startswith("$$"), 2).otherwise(1)
        inside = F.substr(s, width + 1, F.length(s) - width - F.when(closed, width).otherwise(0))
        return F.struct(F.regexp_replace(inside, _DOLLAR, "\\$").alias("latex"), closed.alias("closed"))

    return F.transform(found(hidden, _MATH), span)


def parses(latex: Column) -> Column:
    """Whether a formula's structure can be typeset: balanced, each script with its argument, no two of one kind in a row,
    no lone backslash at its end, no alignment mark outside an environment."""
    signs = found(latex, r"\\[A-Za-z]++|\\[\s\S]|[\s\S]")
    lone = F.element_at(F.concat(F.array(F.lit("")), signs), -1) == "\\"
    plain = F.array_join(F.transform(signs, lambda u: F.when(u.startswith("\\"), "x").otherwise(u)), "")
    script = plain.rlike(r"[\^_]\s*(?:[\^_}&]|\z)")
    mark = plain.contains("&") & ~F.exists(signs, lambda u: u == "\\begin")
    return unbalanced(latex).isNull() & ~lone & ~script & ~mark


def renders(prose: Column | str) -> Column:
    """Whether all math between dollar signs is closed and parses; null for a text without any."""
    spans = dollar_spans(prose)
    good = F.forall(spans, lambda s: s["closed"] & parses(F.trim(s["latex"])))
    return F.when(F.contains(F.col(prose) if isinstance(prose, str) else prose, F.lit("$")) & (F.size(spans) > 0), good)


def restored_backslashes(text: Column | str) -> Column:
    r"""The backslashes that JSON took for control characters: tab, backspace, form feed and carriage return are always
    commands; a line break is one only between \( and \) and before a letter."""
    # Runs outside math and whole math spans, the last of which may never end.
    parts = found(text, r"(?:[^\\]|\\[^(])++|\\\((?:[^\\]|\\[^)])*+(?:\\\)|\\?\z)|\\\z")
    mended = F.array_join(F.transform(parts, lambda p: F.when(p.startswith("\\("), F.regexp_replace(p, r"\n(?=[A-Za-z])", r"\\n")).otherwise(p)), "")
    for sign, letter in (("\t", "t"), ("\b", "b"), ("\f", "f"), ("\r", "r")):
        mended = F.replace(mended, F.lit(sign), F.lit("\\" + letter))
    return mended


def code_names_out_of_math(text: Column | str) -> Column:
    r"""Names from code between \( and \), as an underscore with two or more letters after it shows, in backticks."""
    span = r"\\\([\s\S]*?(?:\\\)|\z)"  # one that never ends is text
    inside = F.transform(found(text, span), lambda s: F.regexp_replace(F.regexp_replace(s, r"^\\\(\s*+|\\\)\z", ""), r"\s++\z", ""))
    named = lambda c: c.rlike(r"^[A-Za-z0-9_]+\z") & c.rlike("_[A-Za-z0-9]{2}")
    each = F.transform(F.arrays_zip(found(text, span).alias("s"), inside.alias("c")), lambda x: F.when(x["s"].endswith("\\)") & (F.length(x["s"]) > 3) & named(x["c"]), F.concat(F.lit("`"), x["c"], F.lit("`"))).otherwise(x["s"]))
    return F.array_join(F.flatten(F.transform(F.arrays_zip(F.split(text, span, -1).alias("t"), each.alias("s")), lambda x: F.array_compact(F.array(x["t"], x["s"])))), "")


def mended_claim(text: Column | str) -> Column:
    return code_names_out_of_math(restored_backslashes(text))
