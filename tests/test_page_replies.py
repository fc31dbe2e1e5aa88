"""A planted reply for each rule, and which of two faults comes first."""

import pytest

from quire.operators import page_replies

PIECE = "struct<number:int,kind:string,content:string,label:string,caption:string,printed_number:string,name:string,statement:string,symbols:array<struct<symbol:string,meaning:string>>,printed_text:array<string>,note:string,summary:string,language:string,marker:string,cites:array<string>,bounds:struct<left:int,top:int,right:int,bottom:int>>"
SCHEMA = f"page_id int, printed string, header string, starts boolean, ends boolean, layer_words int, pieces array<{PIECE}>, discusses array<struct<piece:int,about:int>>"
LONG, GOOD = "word " * 60, "|a|b|\n|---|---|\n|1|2|"


def piece(number, kind, content="x", **more):
    return {"number": number, "kind": kind, "content": content, **({"bounds": (0, 0, 500, 500)} if kind == "figure" else {}), **more}


def figure(number=1, **more):
    return piece(number, "figure", LONG, **more)


def reply(*pieces, starts=False, ends=False, words=0, links=(), printed=None, header=None):
    return printed, header, starts, ends, words, list(pieces), list(links)


CASES = [
    (reply(piece(1, "text"), piece(2, "formula", "a")), None),
    (reply(piece(1, "text", " "), piece(3, "text")), ("numbers", 3, None, None)),
    (reply(words=20), ("no-pieces", None, None, None)),
    (reply(words=19), None),
    (reply(piece(1, "text", "a\tb"), piece(2, "heading", "x", printed_number=" ")), ("empty", 2, "printed_number", None)),
    (reply(piece(1, "text"), header="a\fb"), ("lost-backslash", None, "header", "form feed")),
    (reply(piece(1, "formula", "a\nb")), ("lost-backslash", 1, "content", "line break")),
    (reply(piece(1, "text", "\\(a\nb\\)")), ("lost-backslash", 1, "content", "line break")),
    (reply(piece(1, "formula", "\\begin{aligned}a\\end{aligned}")), ("aligned", 1, "content", None)),
    (reply(piece(1, "code", "a\nb {", summary="s")), None),
    (reply(piece(1, "code", "a\tb", summary="s")), ("lost-backslash", 1, "content", "tab")),
    (reply(piece(1, "text", "\\(a")), ("unbalanced", 1, "content", "unclosed")),
    (reply(piece(1, "formula", "a", symbols=[("x}", "}")])), ("unbalanced", 1, "symbols", "closing-brace")),
    (reply(piece(1, "text", "50% \\(a%\\)")), ("typeset", 1, "content", "percent")),
    (reply(piece(1, "formula", "$a$")), ("typeset", 1, "content", "dollars")),
    (reply(piece(1, "formula", "a\\tag{1}"), piece(2, "text", "\\(a{\\)")), ("unbalanced", 2, "content", "opening-brace")),
    (reply(piece(1, "figure", "too few words")), ("explanation", 1, None, None)),
    (reply(piece(1, "table", "|a|\n|b|", summary="s")), ("table", 1, None, "separator")),
    (reply(piece(1, "text"), figure(2), links=[(1, 2)]), None),
    (reply(piece(1, "text"), figure(2), links=[(1, 2), (1, 9)]), ("link", 1, None, "number")),
    (reply(piece(1, "text"), figure(2), links=[(2, 1)]), ("link", 2, None, "piece")),
    (reply(piece(1, "text"), piece(2, "footnote"), links=[(1, 2)]), ("link", 1, None, "about")),
    (reply(figure(1), piece(2, "text"), starts=True, ends=True), None),
    (reply(piece(1, "heading"), piece(2, "text"), starts=True), ("starts", None, None, None)),
    (reply(piece(1, "text"), piece(2, "formula", "a"), ends=True), ("ends", None, None, None)),
    (reply(ends=True), ("ends", None, None, None)),
    (reply(figure(1, bounds=(700, 200, 100, 500)), piece(2, "text", "We have $$a$$ here")), ("displayed", 2, None, "dollars")),
    (reply(piece(1, "text", "costs $$5")), None),
    (reply(piece(1, "heading", "\\begin{align*}")), ("displayed", 1, None, "align")),
    (reply(figure(1, bounds=(0, 0, 1001, 9))), ("bounds", 1, None, "outside")),
    (reply(figure(1, bounds=(0, 0, 90, 90))), ("bounds", 1, None, "percent")),
    (reply(figure(1, bounds=(0, 0, 500, 19))), ("bounds", 1, None, "small")),
]


@pytest.fixture(scope="module")
def got(spark):
    names = [f.split(":")[0] for f in PIECE[7:].replace("array<struct<symbol:string,meaning:string>>", "x").replace("struct<left:int,top:int,right:int,bottom:int>", "x").rstrip(">").split(",")]
    rows = [(i, *r[:5], [tuple(p.get(n) for n in names) for p in r[5]], r[6]) for i, (r, _) in enumerate(CASES)]
    return {r.page_id: r for r in page_replies.first_faults(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_each_rule(got):
    told = {i: (r.fault, r.piece, r.field, r.seen) if r.fault else None for i, r in got.items()}
    assert told == {i: want for i, (_, want) in enumerate(CASES)}
