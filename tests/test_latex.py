"""LaTeX scanners, listings and mending of claims against loops over characters."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import latex, markdown

PIECES = ["\\frac{a}{b}", "{", "}", "\\left(", "\\right)", "\\begin{aligned}", "\\end{aligned}", "\\begin{m", "\\end{m}", "\\begin", "\\\\", "\\{", "x^2", "%", "\\%", "$", "$$", "\\$", "\\tag{1}", "\\(", "\\)", "\\", "\n", "\\\\ \n", "nu", "a_bc", " ", "é", "&", "\t", "\r\n", "_", "\\lefty"]


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(9)
    return ["", *("".join(draw.choices(PIECES, k=draw.randrange(1, 9))) for _ in range(3000))]


def checked(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8)
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def units(t):
    out, i = [], 0
    while i < len(t):
        j = i + 1
        if t[i] == "\\" and j < len(t):
            j += 1
            if t[i + 1].isascii() and t[i + 1].isalpha():
                while j < len(t) and t[j].isascii() and t[j].isalpha():
                    j += 1
        out.append(t[i:j])
        i = j
    return out


def name_at(us, k):
    if us[k + 1 : k + 2] != ["{"] or "}" not in us[k + 2 :]:
        return None
    return "".join(us[k + 2 : us.index("}", k + 2)])


def unbalanced(t):
    us, depth, stack, sides = units(t), 0, [], 0
    for k, u in enumerate(us):
        depth += (u == "{") - (u == "}")
        sides += (u == "\\left") - (u == "\\right")
        if depth < 0:
            return "closing-brace"
        if u in ("\\begin", "\\end") and (name := name_at(us, k)) is not None:
            if u == "\\begin":
                stack.append(name)
            elif not stack or stack.pop() != name:
                return "end"
    return "opening-brace" if depth else "begin" if stack else "left-right" if sides else None


def bare_row_break(t):
    us, depth, opened = units(t), 0, 0
    for k, u in enumerate(us):
        if u == "\\\\" and depth == opened == 0:
            return True
        depth += (u == "{") - (u == "}")
        if u in ("\\begin", "\\end") and name_at(us, k) is not None:
            opened += 1 if u == "\\begin" else -1
    return False


def spans(t):
    out, at, where = [], None, 0
    for u in units(t):
        if u == "\\(":
            if at is not None:
                return None, "nested"
            at = where + 2
        elif u == "\\)":
            if at is None:
                return None, "unopened"
            out.append(t[at:where])
            at = None
        where += len(u)
    return (None, "unclosed") if at is not None else (out, None)


def dollars(t):
    out, kind, own, i = [], 0, "", 0
    while i < len(t):
        step = 1
        if t[i] == "\\":
            step = 2
            own += t[i : i + 2]
        elif t[i] != "$":
            own += t[i]
        elif kind == 0:
            kind = step = 2 if t[i + 1 : i + 2] == "$" else 1
            own = ""
        elif kind == 1 or t[i + 1 : i + 2] == "$":
            step = kind
            out.append((own, True))
            kind = 0
        else:
            own += "$"
        i += step
    return out + ([(own, False)] if kind else [])


def test_structure(spark, texts):
    assert checked(spark, texts, latex.unbalanced("t")) == [unbalanced(t) for t in texts]
    assert checked(spark, texts, latex.bare_row_break("t")) == [bare_row_break(t) for t in texts]
    assert {unbalanced(t) for t in texts} == {None, "closing-brace", "end", "opening-brace", "begin", "left-right"}


def test_spans(spark, texts):
    got = checked(spark, texts, latex.math_spans("t"))
    assert [(r.spans, r.fault) for r in got] == [spans(t) for t in texts]
    assert [[tuple(s) for s in r] for r in checked(spark, texts, latex.dollar_spans("t"))] == [dollars(t) for t in texts]


def test_signs_and_wrappings(spark, texts):
    first = lambda t: next(({"%": "percent", "$": "dollar"}[u] for u in units(t) if u in "%$" and u), None)
    assert checked(spark, texts, latex.bare_sign("t")) == [first(t) for t in texts]
    aligned = lambda us: any(u == "\\begin" and name_at(us, k) == "aligned" for k, u in enumerate(us)) and "\\\\" not in us
    assert checked(spark, texts, latex.aligned_without_row_break("t")) == [aligned(units(t)) for t in texts]
    own = [" \\(x\\)", "\\[x", "$x$", " \\begin{align*}x", "\\begin{aligned}x", "x \\tag{1}", "x \\tagged", "\\\\tag"]
    assert checked(spark, own, latex.wrapped("t")) == ["parentheses", "brackets", "dollars", "environment", None, "label", None, None]


def test_row_breaks(spark):
    own = ["a \\\\ \n b", "a \\\\\r\n\\nu", "a \\\\\nu", "a \\\\", "\\\\\\\n x", "\\\\\\\\  \n", "\\\\\n\n"]
    assert checked(spark, own, latex.mended_row_breaks("t")) == ["a \\\\  b", "a \\\\ \\nu", "a \\\\\nu", "a \\\\", "\\\\\\\n x", "\\\\\\\\ ", "\\\\ \n"]


def test_renders(spark):
    own = ["no math", "$$\n\\frac{a}{b\n$$", "$\\frac{a}{b}$", "costs \\$5", "costs $5", "$a$ and $$b", "$x^$", "$x_a^b$", "$x^a^2$", "$a & b$", "$\\begin{m}a & b\\end{m}$", "$a^^b$", "$$ $$", "\\\\$a$", "", None]
    assert checked(spark, own, latex.renders("t")) == [None, False, True, None, False, False, False, True, True, False, True, False, True, True, None, None]


def restored(t):
    out, math, after = "", False, False
    for i, c in enumerate(t):
        if c in "\t\b\f\r":
            out += "\\" + {"\t": "t", "\b": "b", "\f": "f", "\r": "r"}[c]
        elif c == "\n" and math and t[i + 1 : i + 2].isascii() and t[i + 1 : i + 2].isalpha():
            out += "\\n"
        else:
            out += c
        if after and c in "()":
            math = c == "("
        after = c == "\\" and not after
    return out


def renamed(t):
    out = ""
    while "\\(" in t and "\\)" in t[t.index("\\(") + 2 :]:
        a = t.index("\\(")
        z = t.index("\\)", a + 2)
        name = t[a + 2 : z].strip()
        code = all(c.isascii() and (c.isalnum() or c == "_") for c in name) and any(len(p) > 1 for p in name.split("_")[1:])
        out, t = out + t[:a] + (f"`{name}`" if code else t[a : z + 2]), t[z + 2 :]
    return out + t


def test_claims(spark, texts):
    own = [*texts, "the \\( a_bc \\) and \\(x_i\\)", "\\(\nu\\) a\nb \\(\theta", "\\(a_b_cd1\\)\\(_\\)"]
    assert checked(spark, own, latex.restored_backslashes("t")) == [restored(t) for t in own]
    assert checked(spark, own, latex.code_names_out_of_math("t")) == [renamed(t) for t in own]


def split_listings(text):
    prose, found, fence = [], [], None
    for line in text.split("\n"):
        n = len(line) - len(line.lstrip("`"))
        if fence is not None and line == fence:
            fence = None
        elif fence is not None:
            found[-1][1].append(line)
        elif n >= 3:
            fence = "`" * n
            found.append((line[n:].strip(), []))
        else:
            prose.append(line)
    return "\n".join(prose), [(x, "\n".join(own)) for x, own in found]


def test_listings(spark):
    draw = random.Random(3)
    lines = ["", "text", "```", "```", "````", "```python", "```` rust ", " ```", "a ``` b", "``"]
    own = ["\n".join(draw.choices(lines, k=draw.randrange(9))) for _ in range(3000)]
    want = [split_listings(t) for t in own]
    assert checked(spark, own, markdown.prose("t")) == [p for p, _ in want]
    assert [[tuple(x) for x in r] for r in checked(spark, own, markdown.listings("t"))] == [x for _, x in want]


def test_long_texts(spark):
    """No deep stack, and time in proportion to the text."""
    n = 60_000
    own = ["\\(" + "\\alpha {x} " * n + "\\)", "$$" + "$ a " * n, "```\n" + "code ``` \n" * n, "\\begin{" + "\\x" * n, "$" + "\\$" * n + "$"]
    assert [r.fault for r in checked(spark, own, latex.math_spans("t"))] == [None] * 5
    assert [len(r) for r in checked(spark, own, latex.dollar_spans("t"))] == [0, 1, 0, 0, 1]
    assert [len(r) for r in checked(spark, own, markdown.listings("t"))] == [0, 0, 1, 0, 0]
    assert checked(spark, own, F.length(latex.mended_claim("t")))[0] == len(own[0])
    assert checked(spark, own[3:4], latex.unbalanced("t")) == ["opening-brace"]
