"""Personal data by weak supervision, in DataFrame expressions.

Patterns find exact spans of four kinds, which always stay, and candidates of these and other kinds. Labelers vote on
each candidate for, against or not at all: its form, a gazetteer, the words around it, what touches it. How often each
pattern of votes occurs is a table of bounded size; expectation-maximisation on it estimates how reliable each labeler
is, and so how likely each pattern is personal data. A logistic model of kind, votes, length and the characters that a
candidate is made of, which no labeler sees, is trained on these probabilities and decides which candidates are added.
"""

import math
from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fresh, stored

BASE = ("email", "ip", "card", "phone")
# Runs are taken whole (possessive), and begin where a run begins or a match has ended, so long runs cost no retries.
_LOCAL = r"A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+",  # fewer digits make no card
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further kinds, found as candidates only. The value follows what a lookbehind can hold, so a match is the span.
CANDIDATES = {
    "secret": r"""(?<=(?i:token|secret|password|passwd|apikey|api_key|access_key)\s{0,2}[=:]\s{0,2}["']?)[A-Za-z0-9_+/.=-]{8,}+""",
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\s?[\[({]\s?at\s?[\])}]\s?[a-z0-9-]++(?:\s?[\[({]\s?dot\s?[\])}]\s?[a-z0-9-]++)+",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{2,4}\)\x20?|[0-9]{3}[.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra|Don|Doña)\.?\x20\p{Lu}\p{Ll}{1,}+(?:\x20\p{Lu}\p{Ll}{1,}+)?",
}
# Words that stand near personal data of a kind, in four languages, and words that stand near other numbers.
NEAR = {
    "email": "mail|e-mail|email|contact|kontakt|courriel|correo",
    "ip": r"\bip\b|address|host|server|adresse|serveur|servidor",
    "card": "card|visa|mastercard|amex|credit|karte|carte|tarjeta",
    "phone": "phone|call|tel|fax|mobile|telefon|anruf|appel|llama",
    "secret": "token|secret|password|passwd|key",
    "ssn": "ssn|social|security|insurance|versicherung|securite|seguro",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "name": "name|called|signed|dear|author|regards|lieber|cher|estimado",
}
OTHER = r"version|isbn|issn|order|invoice|serial|figure|table|chapter|section|page|build|release|article|doi|\bid\b"
# Endings of names in the network, first digits of cards, first names.
GAZETTEER = {
    "email": r"(?i)(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info|biz|ch|at|it|nl|us|ca|mx)$",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)",
    "phone": r"^(?:\+|\(?[0-9]{2,4}\)?)",
    "secret": r"^(?:[0-9a-f]{32,64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_.-]{20,})$",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "iban": "^(?:AD|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM)",
    "name": "(?:Anna|Antonio|Carlos|Carmen|Charles|Claire|David|Elena|Emma|Hans|Jack|James|Jean|John|José|Julia|Karl|Klaus|Laura|Luis|Maria|María|Marie|Mary|Michael|Miguel|Paul|Peter|Pierre|Robert|Sarah|Sophie|Thomas|William)",
}
LABELERS = ("form", "gazetteer", "context", "border")
KINDS = (*BASE, "secret", "ssn", "iban", "name")
_SPAN = "array<struct<start:int,stop:int,value:string>>"


#: Entries of a block of a running total, and code points of a part of a text.
_BLOCK, _PART = 256, 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is made once, though body names it often or within a function of an array's entries."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """Running totals of whole numbers (sums, or maxima of such as aren't negative). Appending copies what there is, so
    totals are made within blocks, then over the blocks; the work grows with the array, not with its square."""
    none = F.array().cast("array<int>")
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(0))
    more = lambda acc, x: F.concat(acc, F.array(add(last(acc), x)))

    def within(v: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.call_function("div", F.size(v) - 1, F.lit(_BLOCK)).cast("int"))
        return F.transform(numbers, lambda b: F.aggregate(F.slice(v, b * _BLOCK + 1, _BLOCK), none, more))

    def over(blocks: Column) -> Column:
        before = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, own: more(acc, last(own)))
        moved = F.zip_with(blocks, before, lambda own, b: F.transform(own, lambda x: add(b, x)))
        return F.flatten(F.slice(moved, F.lit(1), F.size(blocks)))

    return let(values, lambda v: let(within(v), over))


def parts_of(text: Column) -> Column:
    """A text in parts of 1,024 code points, as Spark looks for a place in a string from its beginning."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PART}}}"), F.lit(0))


def cut_out(parts: Column, start: Column, stop: Column) -> Column:
    """The code points from start up to stop of a text in parts."""
    number = lambda at: F.call_function("div", at, F.lit(_PART)).cast("int")
    near = F.array_join(F.slice(parts, number(start) + 1, number(stop) - number(start) + 1), "")
    return F.substr(near, start % _PART + 1, stop - start)


def found(text: Column, pattern: str, given: Column) -> Column:
    """The texts of a pattern's leftmost matches, each with the code points between the one before and itself, where
    `given` holds; else none."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    both = F.zip_with(values, F.slice(gaps, F.lit(1), F.size(values)), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
    return F.when(given, both).otherwise(F.array().cast("array<struct<value:string,gap:int>>"))


def located(matches: Column) -> Column:
    """Starts, ends and texts of what `found` gives, in code points."""
    stops = running(F.transform(matches, lambda m: m["gap"] + F.length(m["value"])), lambda a, b: a + b)
    return F.zip_with(matches, stops, lambda m, z: F.struct((z - F.length(m["value"])).alias("start"), z.alias("stop"), m["value"].alias("value")))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits(value)).between(12, 19) & F.call_function("luhn_check", digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def candidate(kind: str, span: Column, parts: Column, exact: Column) -> Column:
    """The span with its labelers' votes, 1, 0 or -1, the class of its length and that of its characters: the share of
    digits in quarters, and whether there are capitals and marks."""
    right = cut_out(parts, span["stop"], span["stop"] + 1)
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    one_digit = F.length(F.array_join(F.array_distinct(F.split(digits(span["value"]), "")), "")) <= 2
    size = F.least(F.floor(F.log2((span["stop"] - span["start"]).cast("double"))), F.lit(7)).cast("int")
    share = F.least(F.floor(F.length(digits(span["value"])) * 4 / F.greatest(F.length(span["value"]), F.lit(1))), F.lit(3)).cast("int")
    shape = share * 4 + span["value"].rlike(r"\p{Lu}").cast("int") * 2 + span["value"].rlike(r"[^\p{L}\p{N}]").cast("int")

    def voted(ahead: Column) -> Column:
        """ahead: the 40 code points before the span."""
        before, left = F.lower(ahead), F.substr(ahead, F.length(ahead), F.lit(1))
        touched = F.when(span["start"] > 0, left.rlike("[A-Za-z0-9]")).otherwise(False) | right.rlike("[A-Za-z0-9]")
        votes = (
            vote(exact, F.lit(True) if kind in ("ip", "card") else F.lit(False)),
            vote(span["value"].rlike(GAZETTEER[kind]), F.lit(kind in ("card", "ssn", "iban"))),
            vote(before.rlike(NEAR[kind]), before.rlike(OTHER)),
            F.when(touched | (one_digit if kind in ("card", "phone", "ssn") else F.lit(False)), -1).otherwise(1),
        )
        return F.struct(span["start"].alias("start"), span["stop"].alias("stop"), F.lit(kind).alias("kind"), *(v.alias(n) for v, n in zip(votes, LABELERS, strict=True)), size.alias("size"), shape.alias("shape"))

    return let(cut_out(parts, F.greatest(span["start"] - 40, F.lit(0)), span["start"]), voted)


_CANDIDATE = "array<struct<start:int,stop:int,kind:string," + ",".join(f"{n}:int" for n in LABELERS) + ",size:int,shape:int>>"


def spans(docs: DataFrame, text: str, names: tuple[str, str] = ("base", "candidates")) -> DataFrame:
    """docs with two columns: base spans (start, order, stop, kind), sorted, and candidates with votes, sorted.

    Null texts count as empty and have none, long texts are read whole; columns of these two names are replaced."""
    base, more = names
    mark = "found"
    while any(c.lower().startswith(mark) for c in docs.columns):  # so no column of docs has one of the names below
        mark += "'"
    t = F.coalesce(F.col(text), F.lit(""))
    given = {
        "email": F.contains(t, F.lit("@")), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike("[0-9]"), "phone": F.contains(t, F.lit("+")),
        "secret": F.contains(t, F.lit("=")) | F.contains(t, F.lit(":")), "at": t.rlike(r"[\[({]\s?[aA][tT]\s?[\])}]"), "digits": t.rlike("[0-9]"), "title": t.rlike(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra|Don|Doña)\b"),
    }
    raw = {f"{mark} {base} {k}": found(t, PATTERNS[k], given[k]) for k in BASE}
    when = {"secret": "secret", "email": "at", "phone": "digits", "ssn": "digits", "iban": "digits", "name": "title"}
    raw |= {f"{mark} {more} {k}": found(t, p, given[when[k]]) for k, p in CANDIDATES.items()}
    df = docs.withColumns(raw)
    # The text in parts is only made where something is found.
    some = F.greatest(*(F.size(f"`{c}`") for c in raw)) > 0
    df = df.withColumns({c: located(F.col(f"`{c}`")) for c in raw} | {f"{mark} parts": F.when(some, parts_of(t))})
    parts = F.col(f"`{mark} parts`")

    def exact(kind: str) -> Column:
        own = F.filter(F.col(f"`{mark} {base} {kind}`"), lambda x: valid(kind, x["value"]))
        return F.transform(own, lambda x: F.struct(x["start"].alias("start"), F.lit(BASE.index(kind)).alias("order"), x["stop"].alias("stop"), F.lit(kind).alias("kind")))

    def judged(kind: str) -> Column:
        own = F.col(f"`{mark} {base} {kind}`")
        if kind == "card":  # short runs of digits are no candidates
            own = F.filter(own, lambda x: F.length(digits(x["value"])).between(12, 19))
        return F.transform(own, lambda x: candidate(kind, x, parts, valid(kind, x["value"])))

    def further(kind: str) -> Column:
        return F.transform(F.col(f"`{mark} {more} {kind}`"), lambda x: candidate(kind, x, parts, F.lit(kind in ("secret", "ssn", "iban"))))

    votes = [judged(k) for k in BASE] + [further(k) for k in CANDIDATES]
    df = df.withColumns({base: F.array_sort(F.concat(*(exact(k) for k in BASE))), more: F.array_sort(F.concat(*(v.cast(_CANDIDATE) for v in votes)))})
    return df.drop(*raw, f"{mark} parts")


def reliabilities(patterns: dict[tuple[int, ...], float], rounds: int = 60) -> dict[tuple[int, ...], float]:
    """The probability that a pattern of votes is personal data: two classes, a table of votes for each labeler."""
    half = {p: 1 / (1 + math.exp(-2 * sum(p))) for p in patterns}
    for _ in range(rounds):
        share = (sum(half[p] * n for p, n in patterns.items()) + 1) / (sum(patterns.values()) + 2)
        tables = []
        for i in range(len(LABELERS)):
            table = {}
            for v, yes in product((-1, 0, 1), (True, False)):
                lean = 2.0 if (v == 1) == yes and v else 0.5  # a labeler is taken to be right more often than not
                own = sum((half[p] if yes else 1 - half[p]) * n for p, n in patterns.items() if p[i] == v)
                table[v, yes] = own + lean
            for yes in (True, False):
                whole = sum(table[v, yes] for v in (-1, 0, 1))
                for v in (-1, 0, 1):
                    table[v, yes] /= whole
            tables.append(table)
        for p in patterns:
            z = math.log(share / (1 - share)) + sum(math.log(t[v, True] / t[v, False]) for t, v in zip(tables, p, strict=True))
            half[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    return half


def classifier(rows: dict[tuple[str, tuple[int, ...], int, int], float], steps: int = 300, rate: float = 0.5, decay: float = 1e-3) -> dict[str, float]:
    """Weights by feature of a logistic model, trained on how likely each pattern of votes is."""
    votes: dict[tuple[int, ...], float] = {}
    for (_, p, _, _), n in rows.items():
        votes[p] = votes.get(p, 0) + n
    likely, whole = reliabilities(votes), sum(rows.values()) or 1
    features = {r: ["one", f"kind {r[0]}", f"size {r[2]}", f"shape {r[3]}", *(f"{n} {v}" for n, v in zip(LABELERS, r[1], strict=True))] for r in rows}
    w = {f: 0.0 for fs in features.values() for f in fs}
    for _ in range(steps):
        step = {f: -decay * x for f, x in w.items()}
        for r, n in rows.items():
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[f] for f in features[r])))))
            for f in features[r]:
                step[f] += (likely[r[1]] - p) * n / whole
        w = {f: w[f] + rate * step[f] for f in w}
    return w


def fit(found: DataFrame, candidates: str = "candidates") -> dict[str, float]:
    """The classifier's weights, from how often each kind, pattern of votes and class of length and characters occurs:
    at most 8 x 81 x 8 x 16 rows, whatever the input. An empty table gives weights of 0."""
    c = found.select(F.explode(candidates).alias("c")).select("c.*")
    by = ("kind", *LABELERS, "size", "shape")
    got = c.groupBy(*by).count().orderBy(*by).collect()
    return classifier({(r["kind"], tuple(r[n] for n in LABELERS), r["size"], r["shape"]): float(r["count"]) for r in got})


def accepted(weights: dict[str, float], base: Column, candidates: Column, least: float) -> Column:
    """Base spans and the candidates whose probability is `least` or more and that no base span holds, sorted, each once.
    Null arrays give null; without weights each candidate is as likely as not."""
    table = F.create_map(*(F.lit(x) for f, w in (weights or {"one": 0.0}).items() for x in (f, float(w))))
    weight = lambda f: F.coalesce(F.try_element_at(table, f), F.lit(0.0))
    order = lambda kind: F.array_position(F.array(*(F.lit(k) for k in KINDS)), kind).cast("int") - 1

    def sure(c: Column) -> Column:
        z = weight(F.lit("one")) + weight(F.concat(F.lit("kind "), c["kind"])) + weight(F.concat(F.lit("size "), c["size"].cast("string"))) + weight(F.concat(F.lit("shape "), c["shape"].cast("string")))
        for n in LABELERS:
            z = z + weight(F.concat(F.lit(f"{n} "), c[n].cast("string")))
        return z >= math.log(least / (1 - least))

    span = lambda c, own: F.struct(c["start"].alias("start"), F.lit(own).alias("own"), (order(c["kind"]) if own else c["order"]).alias("order"), c["stop"].alias("stop"), c["kind"].alias("kind"))
    # By their starts, base spans first: a candidate is held if a base span before it reaches as far.
    spans = F.array_sort(F.concat(F.transform(base, lambda b: span(b, 0)), F.transform(F.filter(candidates, sure), lambda c: span(c, 1))))
    # Each once; array_distinct would compare all structs with all.
    spans = let(spans, lambda both: F.filter(both, lambda s, i: (i == 0) | (s != F.get(both, i - 1))))
    reach = lambda both: running(F.transform(both, lambda s: F.when(s["own"] == 0, s["stop"]).otherwise(0)), F.greatest)
    told = let(spans, lambda both: F.zip_with(both, reach(both), lambda s, r: F.struct(s.alias("s"), ((s["own"] == 0) | (r < s["stop"])).alias("new"))))
    return F.array_sort(F.transform(F.filter(told, lambda x: x["new"]), lambda x: F.struct(x["s"]["start"].alias("start"), x["s"]["order"].alias("order"), x["s"]["stop"].alias("stop"), x["s"]["kind"].alias("kind"))))


def joined(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def masked(text: Column, parts: Column, spans: Column) -> Column:
    """The text with each span, or run of spans that overlap, replaced by its first kind in brackets. parts: parts_of."""
    reach = running(F.transform(spans, lambda s: s["stop"]), F.greatest)

    def whole(reached: Column) -> Column:
        # Where a span begins beyond all before it, the text up to it and its kind; the rest follows.
        before = F.concat(F.array(F.lit(0)), reached)
        pieces = F.zip_with(spans, before, lambda s, r: F.when(s["start"] >= r, F.concat(cut_out(parts, r, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        return F.concat(F.array_join(pieces, ""), cut_out(parts, F.element_at(reached, -1), F.length(text)))

    return F.when(F.size(spans) > 0, let(reach, whole)).otherwise(text)


def redact(docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """docs with the spans found in a text masked there; a null text stays null, other columns stay as they are.

    The spans are found once and stored beside the rows, as the classifier needs them before any is masked."""
    base, candidates = (fresh(f"{x} of {text}", docs.columns) for x in ("base", "candidates"))
    marked = stored(spans(docs, text, (base, candidates)))
    all_ = accepted(fit(marked, candidates), F.col(base), F.col(candidates), least)
    some = F.size(base) > 0
    own = marked.withColumn(base, all_).withColumn(candidates, F.when(some, parts_of(F.col(text))))
    return own.withColumn(text, masked(F.col(text), F.col(candidates), F.col(base))).select(*docs.columns)
