"""A document's text for one question against a loop, and cheat sheets case by case."""

import random

from quire.operators import questions

SCHEMA = "doc_id int, doc_title string, position int, page int, printed string, title string, kind string, text string, label string, language string, embed_text string"


def looped(items):
    blocks, page, section = [f"Document: {items[0][1]}"], None, None
    for _, doc, _, p, printed, title, kind, text, label, language, embedded in items:
        if p != page:
            blocks.append(f"[page {p}, printed {printed}]" if printed else f"[page {p}]")
            page = p
        own = title.removeprefix(doc + " > ") if title.startswith(doc + " > ") else None
        own = own or None
        if own != section:
            if own:
                blocks.append(f"Section: {own}")
            section = own
        if kind == "formula":
            text = f"$${text}$$ {label}" if label else f"$${text}$$"
        elif kind == "code":
            text = (f"{label}\n" if label else "") + f"```{language or ''}\n{text}\n```"
        elif kind in ("figure", "table"):
            text = embedded
        blocks.append(text)
    return "\n\n".join(blocks)


def test_document_texts(spark):
    draw, rows = random.Random(3), []
    for d in range(30):
        page = 1
        for k in range(draw.randrange(1, 9)):
            page += draw.randrange(2)
            title = draw.choice(["Doc", "Doc > A", "Doc > A > B", "Doc > A", "Other > A", "Doc > "])
            rows.append((d, "Doc", k, page, draw.choice([None, "x"]), title, draw.choice(["chunk", "formula", "code", "figure", "table"]), "text", draw.choice([None, "(1)"]), draw.choice([None, "c"]), "embedded"))
    got = {r.doc_id: r for r in questions.document_texts(spark.createDataFrame(rows, SCHEMA), 60).collect()}
    for d in range(30):
        own = [r for r in rows if r[0] == d]
        text = looped(own)
        tokens = -(-len(text) // 4)
        assert (got[d].text, got[d].fault) == ((text, None) if tokens <= 60 else (None, "too long"))
        assert got[d].tokens == tokens and got[d].pages == sorted({r[3] for r in own})


def test_cheat_sheets(spark):
    cases = {"a\\nb \\\\frac": "a\nb \\frac", "a\nb\\n": "a\nb\\n", 'x\\n\\"q\\" \\alpha': 'x\n"q" \\alpha', ' says "a" "': 'says "a"', '"a"': '"a"', "\\n a \\n": "a", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(questions.cheat_sheet("t")).collect()] == list(cases.values())
