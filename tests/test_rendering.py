"""Blocks, their places and section records against loops over a chapter's pieces."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quire.operators import cutting, pieces, rendering

SCHEMA = "doc_id long, page int, number int, kind string, rank int, content string, label string, marker string, language string, starts boolean, ends boolean, caption string, printed_number string, name string, statement string, symbols array<struct<symbol:string,meaning:string>>, printed_text array<string>, image string"
NAMES = re.findall(r"(\w+) (?:long|int|string|boolean|array)", SCHEMA)


def chapters(seed, docs):
    draw, out = random.Random(seed), []
    for d in range(docs):
        for page in range(1, draw.randrange(2, 6)):
            rows = []
            for number in range(1, draw.randrange(2, 9)):
                kind = draw.choice(["heading", "text", "text", "text", "formula", "figure", "table", "code", "footnote"])
                r = dict.fromkeys(NAMES) | {"doc_id": d, "page": page, "number": number, "kind": kind, "starts": False, "ends": False}
                r["content"] = draw.choice(["cost $5 [^1] and [^2]", "a \\(x\\) b-", "more text", "  ", "and so on [^1]", "ends `` here"])
                r["label"] = draw.choice([None, " ", "(3)", "7", "Figure 2"])
                r["caption"] = draw.choice([None, "", "Costs in $"])
                if kind == "heading":
                    r |= {"rank": draw.randrange(1, 5), "printed_number": draw.choice([None, "1.2"]), "content": draw.choice(["Rates", "Prices"])}
                elif kind == "figure":
                    r |= {"content": r["content"] + draw.choice(["", "\n\nText printed in the figure: x"]), "printed_text": draw.choice([None, [], ["x", "y"]]), "image": draw.choice([None, "f.png"])}
                elif kind == "formula":
                    r |= {"name": draw.choice([None, "Bayes.."]), "statement": draw.choice(["", " it holds "]), "symbols": draw.choice([None, [], [("x", "a rate"), ("y", "b")]])}
                elif kind == "footnote":
                    r["marker"] = draw.choice([None, "1", "2"])
                elif kind == "code":
                    r["language"] = draw.choice([None, "python"])
                rows.append(r)
            texts = [r for r in rows if r["kind"] == "text"]
            if texts:
                texts[0]["starts"], texts[-1]["ends"] = draw.random() < 0.5, draw.random() < 0.5
            out += rows
    return out


def math_marks(t):
    return re.sub(r"\\[()]", "$", re.sub(r"(?<!\\)\$", r"\\$", t))


def blank(t):
    return (t or "").strip() or None


def rounded(label):
    return label if label.startswith("(") and label.endswith(")") else f"({label})"


def named(label):
    return "Figure" if not label else math_marks(label) if label.lower().startswith("figure") else f"Figure {math_marks(label)}"


def tokens(t):
    return math.ceil(len(t) / 4)


def written(p):
    label, caption = blank(p["label"]), blank(p["caption"])
    line = ": ".join(math_marks(x) for x in (label, caption) if x)
    body = math_marks(p["content"])
    if p["kind"] == "heading":
        return "#" * p["rank"] + " " + math_marks(" ".join(x for x in (p["printed_number"], p["content"]) if x is not None))
    if p["kind"] == "formula":
        return f"$$\n{p['content'].strip()}\n$$" + (f"\n{rounded(label)}" if label else "")
    if p["kind"] == "footnote":
        return (f"[^{p['marker']}]: " if p["marker"] else "Footnote: ") + body
    if p["kind"] == "figure":
        head = named(label) + (f": {math_marks(caption)}" if caption else "")
        return f"[{head} — description (model-written): {math_marks(explained(p))}]"
    if p["kind"] == "code":
        fence = "`" * max(3, 1 + max(map(len, re.findall("`+", p["content"])), default=0))
        body = f"{fence}{p['language'] or ''}\n{p['content']}\n{fence}"
    return f"{line}\n{body}" if line else body


def explained(p):
    return p["content"].rsplit("\n\nText printed in the figure: ", 1)[0].strip()


def noted(p):
    label = blank(p["label"])
    if p["kind"] == "figure" and p["printed_text"]:
        return f"{named(label)} printed text: " + "; ".join(f'"{t}"' for t in p["printed_text"])
    if p["kind"] == "formula":
        parts = [p["name"].rstrip(".") + "."] if blank(p["name"]) else []
        parts += [p["statement"].strip()] if blank(p["statement"]) else []
        parts += ["Symbols: " + "; ".join(f"{s}: {m}" for s, m in p["symbols"])] if p["symbols"] else []
        return f"Formula{' ' + rounded(label) if label else ''}: {' '.join(parts)}" if parts else None
    return None


def rendered(own, links, leads):
    """Slots in reading order, then footnotes behind their carriers, then marks of what stays together."""
    slots, open_, headings, last, place = [], [], 0, None, {}
    for p in own:
        key = (p["page"], p["number"])
        b = {"text": None, "pieces": [key], "transcribed": tokens(p["content"]), "model": 0, "note": noted(p), "image": None, "lone": False, "carrier": None}
        if p["kind"] == "heading":
            headings += 1
            open_ = [h for h in open_ if h[0] < p["rank"]] + [(p["rank"], headings)]
            last = None
        b["path"] = [h for _, h in open_]
        if p["kind"] == "text":
            if not p["content"].strip():
                continue
            if last and last[1] and p["starts"]:
                into = slots[last[0]]
                text, more = into["text"], math_marks(p["content"])
                into["text"] = text[:-1] + more if text.endswith("-") and more[:1].islower() else f"{text} {more}"
                into["pieces"].append(key)
                into["transcribed"] += b["transcribed"]
                place[key] = last[0]
                last = (last[0], p["ends"])
                continue
            b["text"], place[key], last = math_marks(p["content"]), len(slots), (len(slots), p["ends"])
        else:
            b["text"] = written(p)
        if p["kind"] == "figure":
            b |= {"transcribed": 0, "model": tokens(explained(p)), "image": p["image"]}
        if p["kind"] == "footnote":
            b |= {"lone": True, "carrier": [(p["page"], to) for to in sorted(links.get(key, []))]}
        slots.append(b)
    after, out = {}, []
    for k, b in enumerate(slots):
        at = next((place[c] for c in b["carrier"] or [] if c in place), None)
        if at is not None:
            b |= {"lone": False, "path": slots[at]["path"]}
            after.setdefault(at, []).append(b)
        else:
            out.append((k, b))
    blocks = [x for k, b in out for x in (b, *after.get(k, []))]
    where = {key: k for k, b in enumerate(blocks) for key in b["pieces"]}
    for b in blocks:
        b["next"] = False
    for a, z in leads:
        for k in range(where.get(a, 0), where.get(z, 0)) if a in where and z in where else ():
            blocks[k]["next"] = True
    return blocks


@pytest.fixture(scope="module")
def chapter(spark):
    rows = chapters(11, 60)
    df = spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], SCHEMA).cache()
    links, leads, want = {}, {}, {}
    for r in pieces.footnote_links(df).collect():
        links.setdefault(r.doc_id, {}).setdefault((r.page, r["from"]), []).append(r.to)
    for r in rendering.leads(df).collect():
        leads.setdefault(r.doc_id, []).append((tuple(r["from"]), tuple(r["to"])))
    for d in {r["doc_id"] for r in rows}:
        want[d] = rendered([r for r in rows if r["doc_id"] == d], links.get(d, {}), leads.get(d, []))
    return df, want


def test_blocks(chapter):
    df, want = chapter
    got = {}
    for r in rendering.blocks(df).orderBy("doc_id", "position").collect():
        own = got.setdefault(r.doc_id, [])
        assert r.position == len(own) and r.tokens == tokens(r.text)
        own.append((r.text, r.path, [tuple(p) for p in r.pieces], r.transcribed, r.model_written, r.note, r.image, r.lone_note, r.with_next))
    plain = lambda b: (b["text"], b["path"], b["pieces"], b["transcribed"], b["model"], b["note"], b["image"], b["lone"], b["next"])
    assert got == {d: [plain(b) for b in own] for d, own in want.items() if own}
    flat = [b for own in want.values() for b in own]
    assert sum(b["lone"] for b in flat) and sum(b["next"] for b in flat) and any(len(b["pieces"]) > 1 for b in flat)


@pytest.mark.parametrize(("most", "least"), [(8000, 0), (30, 8)])
def test_section_records(spark, chapter, most, least):
    df, want = chapter
    titles = df.select("doc_id").distinct().select("doc_id", F.concat(F.lit("m:d"), "doc_id").alias("slug"), F.lit("Media").alias("media"), F.when(F.col("doc_id") % 2 == 0, " media").otherwise("Own $").alias("title"))
    got = {}
    for r in rendering.section_records(df, titles, most, least).collect():
        got[r.id] = r
    names = {}
    for r in df.where("kind = 'heading'").orderBy("doc_id", "page", "number").collect():
        names.setdefault(r.doc_id, []).append(" ".join(x for x in (r.printed_number, r.content) if x is not None))
    count = 0
    for d, own in want.items():
        sizes = [tokens(b["text"]) for b in own]
        runs = cutting.joined(cutting.runs_of([tuple(b["path"]) for b in own], sizes, most), sizes, least) if own else []
        for s, (path, inside) in enumerate(runs):
            parts = cutting.parts_of(inside, sizes, [b["next"] for b in own], most)
            for p, part in enumerate(parts):
                part = sorted((own[k] for k in part), key=lambda b: b["lone"])
                r = got[f"m:d{d}:s{s + 1:03d}" + (f":p{p + 1}" if len(parts) > 1 else "")]
                heading = "# " + " › ".join(["Media", *(["Own \\$"] if d % 2 else []), *(math_marks(names[d][h - 1]) for h in path)])
                assert r.markdown == "\n\n".join([heading, *(b["text"] for b in part)])
                assert r.section_path == [names[d][h - 1] for h in path] and [tuple(x) for x in r.pieces] == [x for b in part for x in b["pieces"]]
                assert r.pages == sorted({x[0] for b in part for x in b["pieces"]}) and r.notes == "\n\n".join(b["note"] for b in part if b["note"])
                assert (r.transcribed, r.model_written, r.n_tokens) == (sum(b["transcribed"] for b in part), sum(b["model"] for b in part), tokens(r.markdown))
                images = [b for b in part if b["image"]]
                assert [x.ref for x in r.images] == [b["image"] for b in images]
                assert [r.markdown[x.pos : x.pos + len(b["text"])] for x, b in zip(r.images, images, strict=True)] == [b["text"] for b in images]
                count += 1
    assert count == len(got)
