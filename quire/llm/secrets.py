"""Secrets in texts, and the parts of credentials that are only told by what stands beside them.

Exact patterns find base spans, which always stay. Weak candidates are identifiers (logins, key ids), secrets (values
of keys, opaque tokens, passwords in addresses) and endpoints (addresses, hosts), none of which says much alone. Each
has a scope: its paragraph, as far as it reaches. An interval join by document and bins of positions finds which parts
lie in whose scope: a weak secret is reported if an identifier or an endpoint does, an identifier if a secret does, an
endpoint if both do. Base spans serve as parts too: access ids as identifiers, the others as secrets.

Null texts count as empty. Texts are read whole, of any length; equal rows and ids are documents each; a text full of
candidates gives a part's neighbours only, as a bin holds few. An empty table gives no rows. Columns of docs other than
key and text are not read.
"""

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import lean, stored, tidy

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "identifier", "secret", "endpoint")
_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = re.compile(rf"(?ai:password|passwd|secret|token|api_?key){_VALUE}([A-Za-z0-9+/_.=-]+)")
# Runs are maximal, so these find just the matches that are long enough.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
# Names of fields, by the role of what they hold.
IDENTIFIER = re.compile(rf"(?<![A-Za-z])(?ai:user(?:_?name)?|login|client_?id|account(?:_?id)?|access_?key_?id|key_?id|uid){_VALUE}([A-Za-z0-9+_.@-]{{3,}})")
SECRET = re.compile(rf"(?<![A-Za-z])(?ai:pwd|pass|pass_?phrase|credentials?|private_?key|secret_?key|access_?key|auth|sig(?:nature)?|key){_VALUE}([A-Za-z0-9+/_.=-]{{6,}})")
BEARER = re.compile(r"(?<![A-Za-z])[Bb]earer\x20+([A-Za-z0-9._~+/=-]{16,})")
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(rf"(?<![A-Za-z])(?ai:host(?:_?name)?|server|endpoint|url|bucket|database){_VALUE}([A-Za-z0-9][A-Za-z0-9.:/_-]{{2,}})")
ADDRESS = re.compile(r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]*+://(?:([^\s:/@\"'<>]+):([^\s:/@\"'<>]+)@)?([^\s@\"'<>]+)")
#: Bits a character of an opaque token, so that long words and paths are none.
LEAST_BITS = 3.5
#: How far a part's scope reaches beyond it within its paragraph, in code points, and the width of the join's bins.
REACH = 300
_PART = "struct<kind:int,start:int,stop:int,weak:boolean,low:int,high:int>"
_SPAN = "struct<start:int,kind:int,stop:int>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, kind's number and end of each base span, sorted."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def opaque(token: str) -> bool:
    """Whether a token looks drawn by chance: letters of both cases and digits, and many bits a character."""
    if token.isalpha() or token.isdigit() or token.lower() == token or token.upper() == token:
        return False
    counts = Counter(token).values()
    return any(c.isdigit() for c in token) and -sum(n / len(token) * math.log2(n / len(token)) for n in counts) >= LEAST_BITS


def parts(text: str, base: list[tuple[int, int, int]], reach: int = REACH) -> list[tuple]:
    """Parts of credentials: kind's number, start, end, weak, and the ends of the scope. None where no secret is."""
    marked = "=" in text or ":" in text
    address = list(ADDRESS.finditer(text)) if "://" in text else []
    secrets = [m.span() for m in OPAQUE.finditer(text) if opaque(m[0])] + [m.span(2) for m in address if m[2]]
    if marked:
        secrets += [m.span(1) for m in SECRET.finditer(text)]
    if "earer" in text:
        secrets += [m.span(1) for m in BEARER.finditer(text)]
    if not secrets and not base:
        return []
    identifiers = [m.span(1) for m in address if m[1]] + ([m.span(1) for m in IDENTIFIER.finditer(text)] if marked else [])
    endpoints = [m.span(3) for m in address] + ([m.span(1) for m in ENDPOINT.finditer(text)] if marked else [])
    weak = {(3, *s) for s in identifiers} | {(4, *s) for s in secrets} | {(5, *s) for s in endpoints}
    # What a base span covers is reported already.
    taken, free, at, end = sorted((a, z) for a, _, z in base), set(), 0, 0
    for kind, a, z in sorted(weak, key=lambda w: w[1:]):
        while at < len(taken) and taken[at][0] < z:
            end, at = max(end, taken[at][1]), at + 1
        if end <= a:
            free.add((kind, a, z))
    own = [(3 if kind == 1 else 4, a, z, False) for a, kind, z in base] + [(*w, True) for w in free]
    breaks = [m.span() for m in re.finditer(r"\n[\x20\t]*\n", text)]
    out, low, at = [], 0, 0
    for kind, a, z, is_weak in sorted(own, key=lambda p: p[1]):
        while at < len(breaks) and breaks[at][1] <= a:
            low, at = breaks[at][1], at + 1
        high = breaks[at][0] if at < len(breaks) else len(text)
        out.append((kind, a, z, is_weak, max(low, a - reach), min(max(high, z), z + reach)))
    return out


def found(docs: DataFrame, key: str, text: str, reach: int = REACH) -> DataFrame:
    """key, base spans and parts of each row."""

    def run(batches):
        types = [pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "kind", "stop")])), pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("weak", pa.bool_()), ("low", pa.int32()), ("high", pa.int32())]))]
        for batch in batches:
            base, more = [], []
            for value in batch.column(1):
                own = value.as_py() or ""
                spans = base_spans(own)
                base.append([dict(zip(("start", "kind", "stop"), s, strict=True)) for s in spans])
                more.append([dict(zip(("kind", "start", "stop", "weak", "low", "high"), p, strict=True)) for p in parts(own, spans, reach)])
            yield pa.record_batch([batch.column(0), pa.array(base, types[0]), pa.array(more, types[1])], ["key", "base", "parts"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return lean(rows).mapInArrow(tidy(run), f"key {rows.schema['key'].dataType.simpleString()}, base array<{_SPAN}>, parts array<{_PART}>")


def linked(each: DataFrame, width: int = REACH) -> DataFrame:
    """The weak parts, of row, kind, start, stop, weak, low, high, in whose scope complementary parts lie."""
    bins = F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.greatest(F.col("high") - 1, "low") / width))).alias("bin")
    others = each.select("row", F.floor(F.col("start") / width).alias("bin"), F.col("kind").alias("role"), F.col("start").alias("from"), F.col("stop").alias("to"))

    def beside(weak: DataFrame, *roles: int) -> DataFrame:
        """Those in whose scope a part of one of the roles begins and ends."""
        near = others.where(F.col("role").isin(*roles))
        inside = (F.col("w.row") == F.col("o.row")) & (F.col("w.bin") == F.col("o.bin")) & (F.col("o.from") >= F.col("w.low")) & (F.col("o.to") <= F.col("w.high"))
        met = weak.select("*", bins).alias("w").join(near.alias("o"), inside, "left_semi")
        return met.drop("bin").distinct()

    weak = lambda kind: each.where(F.col("weak") & (F.col("kind") == kind))
    return beside(weak(4), 3, 5).union(beside(weak(3), 4)).union(beside(beside(weak(5), 4), 3))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """A row for each of docs: key, base and all spans (start, kind's number in KINDS, stop), sorted."""
    # A row is known by its number in the stored table, as keys may repeat or be null.
    own = stored(found(docs, key, text, reach).withColumn("row", F.monotonically_increasing_id()))
    some = F.exists("parts", lambda p: p["weak"])
    each = own.where(some).select("row", F.explode("parts").alias("p")).select("row", "p.*")
    added = linked(each).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "stop").cast(_SPAN)).alias("added"))
    none = F.array().cast(f"array<{_SPAN}>")
    more = own.where(some).select("row", "key", "base").join(added, "row", "left").select("key", "base", F.array_sort(F.concat("base", F.coalesce("added", none))).alias("all"))
    return more.union(own.where(~some).select("key", "base", F.col("base").alias("all")))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda kind: F.element_at(F.array(*(F.lit(k) for k in KINDS)), kind + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
