"""Main text of web pages: the best contiguous region by a maximum-scoring subsequence.

A page is a sequence of words and tags. A word scores the share of words in its kind of element that belong to main
text, a tag scores minus the share of such tags outside it. The shares are counted on labelled pages: those whose
mark-up names its one article, a bounded sample of them. One scan over the scores finds the contiguous region with the
greatest sum; its text is the page's, without the elements that never hold any.
"""

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fresh, tidy

# Element names of HTML by what they do.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object")
ASIDE = ("head", "nav", "header", "footer", "aside", "form", "dialog", "menu", "button", "select")
INLINE = ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "dfn", "em", "font", "i", "img", "ins", "del", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
CLOSED_BY_LIKE = ("p", "li", "dt", "dd", "option", "tr", "td", "th")
#: Words of an id, class or role that name what isn't main text.
NAMES = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer form header login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo related search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
MAIN = ("article",)
#: Elements that hold a whole page or its article; their names say how the page looks, not what they hold.
WHOLE = ("html", "body", "main", *MAIN)

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<[!?][^>]*>"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>"""
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_REST = re.compile(r"(?P<text>(?:(?!<!--).)+)(?P<tag>)?(?P<end>)?", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def tokens(page: str) -> Iterator[re.Match]:
    """Comments and raw elements, tags, texts. No tag begins after the last one ends, so what follows is text, unless a
    comment or a raw element is still open there."""
    end, last = page.rfind(">") + 1, None
    for last in _TOKEN.finditer(page, 0, end):  # noqa: B007
        yield last
    open_ = last is not None and (last[0].startswith("<!--") and not last[0].endswith("-->") or last["raw"] and not re.search(rf"</{last['raw']}\s*>$", last[0], re.I))
    if not open_ and (rest := _REST.match(page, end)):
        yield rest


class Open:
    """The open elements, how many there are of each name, and the kind of the nearest that isn't inline; every
    step takes the same time however many are open, but for a closing tag, which takes as long as what it closes."""

    def __init__(self):
        self.stack: list[tuple[str, bool, str]] = []
        self.names: Counter = Counter()
        self.out = 0

    @property
    def kind(self) -> str:
        return "out" if self.out else self.stack[-1][2] if self.stack else "body"

    def push(self, tag: str, named: bool) -> None:
        block = tag if tag not in INLINE else self.stack[-1][2] if self.stack else "body"
        self.stack.append((tag, named, block))
        self.names[tag] += 1
        self.out += named

    def pop(self) -> str:
        tag, named, _ = self.stack.pop()
        self.names[tag] -= 1
        self.out -= named
        return tag


def parts(page: str) -> Iterator[tuple[str, str, str]]:
    """("word", kind of element, text), ("tag", name, ""), ("block", "", "") where a block of text ends. Text of
    elements that never hold main text comes as kind "out", and their tags as "out ..."."""
    open_ = Open()
    for m in tokens(page):
        text, tag = m["text"], m["tag"]
        if text is not None:
            yield "word", open_.kind, text
        elif tag:
            tag = tag.lower()
            if tag not in INLINE:
                yield "block", "", ""
            if m["end"]:
                if open_.names[tag]:
                    while open_.pop() != tag:
                        pass
                yield "tag", ("out " if open_.out else "") + "/" + tag, ""
                continue
            named = tag in ASIDE or tag not in WHOLE and any(w in NAMES for a in _NAMED.findall(m["attributes"] or "") for w in re.split(r"[\s_-]+", "".join(a).lower()))
            yield "tag", "out" if named else ("out " if open_.out else "") + tag, ""
            if tag not in VOID and not (m["attributes"] or "").endswith("/"):
                if tag in CLOSED_BY_LIKE and open_.stack and open_.stack[-1][0] == tag:
                    open_.pop()
                open_.push(tag, named)


def counts(page: str) -> Counter:
    """Of a page that names one main element: how often each kind of word and tag is inside and outside it."""
    inside, found = 0, Counter()
    for what, kind, text in parts(page):
        if what == "tag" and kind.lstrip("/") in MAIN:
            inside += -1 if kind[0] == "/" else 1
        elif what == "tag":
            found["tag", kind, inside > 0] += 1
        elif what == "word":
            found["word", kind, inside > 0] += len(text.split())
    return found


def weights(pages: DataFrame, page_id: str, page: str, most: int, kinds: int = 10_000, longest: int = 100) -> dict[tuple[str, str], float]:
    """Scores by kind, from at most `most` pages with one main element, those whose ids have the least hashes.

    kinds: the commonest that get a score of their own; others score as unseen ones do. Names of elements are compared
    by their first `longest` letters, so that the table's size is bounded whatever a page calls its elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for p in batch.column(0):
                total.update({(what, kind[:longest], main): n for (what, kind, main), n in counts(p.as_py() or "").items()})
        rows = [(*k, v) for k, v in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_(), pa.int64()))], names=["what", "kind", "main", "n"])

    one = F.regexp_count(F.col(page), F.lit(f"(?i)<(?:{'|'.join(MAIN)})[ >]")) == 1
    ids = pages.where(one).select(F.col(page_id).alias("i")).distinct().orderBy(F.xxhash64("i"), "i").limit(most)
    sample = pages.join(F.broadcast(ids), pages[page_id] == F.col("i"), "left_semi").where(one).select(page)  # at most `most` ids
    got = sample.mapInArrow(tidy(run), "what string, kind string, main boolean, n long").groupBy("what", "kind").agg(F.sum(F.when(F.col("main"), F.col("n")).otherwise(0)).alias("a"), F.sum("n").alias("n"))
    top = got.orderBy(F.col("n").desc(), "what", "kind").limit(kinds).collect()  # at most `kinds` rows
    return {(r["what"], r["kind"]): (r["a"] + 0.5) / (r["n"] + 1) for r in top}


def extract(page: str, share: dict[tuple[str, str], float], longest: int = 100) -> str:
    items = list(parts(page))
    best, best_at, run, start = 0.0, (0, 0), 0.0, 0
    for i, (what, kind, text) in enumerate(items):
        if what == "block":
            continue
        if what == "tag":
            run -= 0.02 + 4 * (1 - share.get(("tag", kind[:longest]), 0.97))
        elif kind != "out":
            run += len(text.split()) * share.get(("word", kind[:longest]), 0.5)
        if run <= 0:
            run, start = 0.0, i + 1
        elif run >= best:
            best, best_at = run, (start, i + 1)
    blocks, own = [], []
    for what, kind, text in [*items[slice(*best_at)], ("block", "", "")]:
        if what == "word" and kind != "out":
            own.append(html.unescape(text))
        elif what == "tag" and kind == "br":
            own.append(" ")
        elif what == "block":
            if line := " ".join("".join(own).split()):
                blocks.append(line)
            own = []
    return "\n\n".join(blocks)


def main_text(pages: DataFrame, page_id: str = "page_id", page: str = "html", most: int = 2000, text_column: str = "text") -> DataFrame:
    """pages with text_column in place of `page`: the main text, blocks parted by an empty line; empty if there is none.

    The whole page is read; character references are decoded, white space in a block becomes one space. A null or
    empty page gives an empty text; repeated rows each get theirs; a column named text_column is replaced, others stay.
    most: labelled pages that the weights are counted on."""
    sent = pages.sparkSession.sparkContext.broadcast(weights(pages, page_id, page, most))  # a bounded table of numbers
    kept = [c for c in pages.columns if c not in (page, text_column)]
    rows = pages.select(*kept, F.col(page).alias(fresh("page of " + text_column, kept)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]) + f", `{text_column}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p.as_py() or "", sent.value) for p in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*kept, text_column])

    return rows.mapInArrow(tidy(run), schema)
