"""N-gram Jaccard join by grouped prefixes: which documents' sets of word n-grams overlap by a threshold or more.

An n-gram is the hash of its words. Every set is put in one global order, rare n-grams first, and only a prefix of it
is looked at: two sets that overlap enough share an n-gram of their prefixes. Documents with the same prefix and size
form one group, and groups are joined on their prefixes' n-grams. A pair of groups stays if its sizes are near enough
and if the n-grams that the prefixes share leave enough for the overlap; then its members' whole sets are compared.

Only the classes of linked documents are asked for, so a pair within one class need not be compared. Where very many
groups share an n-gram, each is first compared with one of them, the one made most of frequent n-grams, which for
copies of one text is mostly that text. After that only groups of different classes are paired. The work for a large
group of near copies so grows with its size, not with the square, and no link between different classes is lost.
"""

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, lean, stored, tidy
from quire.llm.words import chunks, drawn, hashes, mixed

#: Frequent n-grams that a Python worker holds at most, n-grams that it counts at once, groups whose prefix it has given.
FREQUENT, COUNTED, GIVEN = 1_000_000, 2_000_000, 200_000
#: An n-gram is frequent if it is counted so often; n-grams shared by more groups than LARGE are first joined with one group.
OFTEN, LARGE = 4, 16
#: Bits, at least and at most, of the filter that tells which documents' sets are to be compared, 16 for each of them;
#: a fuller one lets more pass.
FILTER_BITS = (1 << 20, 1 << 29)


@cache
def draws() -> np.ndarray:
    return drawn(5)


def ngrams(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's distinct word n-grams; with fewer words, of all its words as one; empty without."""
    for c in chunks(texts):
        x = hashes(c.words, draws())[c.index]

        def rolled(x: np.ndarray, size: int) -> np.ndarray:
            out = np.full(len(x) - size + 1, size, np.uint64)
            for k in range(size):
                out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + x[k : len(x) - size + 1 + k]
            return mixed(out)

        whole = rolled(x, n) if len(x) >= n else None
        for a, b in zip(c.bounds.tolist(), c.bounds[1:].tolist(), strict=False):
            yield np.zeros(0, np.uint64) if a == b else rolled(x[a:b], b - a) if b - a < n else np.unique(whole[a : b - n + 1])


def frequent(docs: DataFrame, text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams, at most FREQUENT, sorted, and their counts: of those that a task meets twice, which
    any n-gram does whose share of the documents matters. They only set the order of n-grams, not what is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def count() -> pa.RecordBatch:
            grams, times = np.unique(np.concatenate(held or [np.zeros(0, np.uint64)]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(grams[times > 1].view(np.int64)), pa.array(times[times > 1])], names=["s", "c"])

        for batch in batches:
            for grams in ngrams(batch.column(0), n):
                held.append(grams)
                size += len(grams)
                if size > COUNTED:
                    yield count()
                    held, size = [], 0
        yield count()

    counts = lean(docs.select(F.col(text))).mapInArrow(tidy(run), "s long, c long").groupBy("s").agg(F.sum("c").alias("c")).where(F.col("c") >= OFTEN)
    got = counts.orderBy(F.col("c").desc(), "s").limit(FREQUENT).toArrow()
    grams, times = got["s"].to_numpy().view(np.uint64), got["c"].to_numpy()
    order = np.argsort(grams)
    return grams[order], times[order]


def need(n: Column, parts: int, of: int) -> Column:
    """The least whole number that is parts / of of n or more."""
    return F.floor((n * parts + of - 1) / of)


def prefixes(docs: DataFrame, doc_id: str, text: str, n: int, often: tuple[np.ndarray, np.ndarray], parts: int, of: int, mark: Column) -> DataFrame:
    """(doc_id, mark, n, key, g, prefix): the set's size and digest, and the prefix and its group. A task gives a group's
    prefix once. The high bits of g tell the share of n-grams that aren't frequent, so the least g of some groups is
    the one made most of frequent n-grams. Documents without n-grams have n 0 and nulls."""
    sent = docs.sparkSession.sparkContext.broadcast(often)  # at most FREQUENT pairs of numbers
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int32()), ("key", pa.binary()), ("g", pa.int64()), ("prefix", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, times = sent.value
        given: set[bytes] = set()
        for batch in batches:
            out, held = [], 0
            for i, m, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ngrams(batch.column(2), n), strict=True):
                if not len(s):
                    out.append((i, m, 0, None, None, None))
                    continue
                size = len(s) - -(-parts * len(s) // of) + 1
                place = np.minimum(np.searchsorted(grams, s), max(len(grams) - 1, 0))
                known = grams[place] == s if len(grams) else np.zeros(len(s), bool)
                first = s[~known][:size]
                if len(first) < size:
                    rest = s[known]
                    first = np.concatenate([first, rest[np.lexsort((rest, times[place[known]]))][: size - len(first)]])
                name = xxhash.xxh3_128_digest(first.tobytes() + len(s).to_bytes(8, "little"))
                g = int(127 * (~known).mean()) << 56 | int.from_bytes(name[:7], "little")
                seen = name in given
                if len(given) > GIVEN:
                    given.clear()
                given.add(name)
                out.append((i, m, len(s), xxhash.xxh3_128_digest(s.tobytes()), g, None if seen else first.view(np.int64)))
                held += 0 if seen else len(first)
                if held > COUNTED:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return lean(docs.select(F.col(doc_id).cast("long"), mark.cast("long"), F.col(text))).mapInArrow(tidy(run), "doc_id long, mark long, n int, key binary, g long, prefix array<long>")


def sets_of(docs: DataFrame, doc_id: str, text: str, n: int, wanted: DataFrame) -> DataFrame:
    """(key, grams): the sets of the documents whose ids are in wanted.least, and of some others, without a shuffle of
    texts: a filter goes to the tasks that read them. A null id passes if one is wanted."""
    low, high = FILTER_BITS
    size = min(high, max(low, 1 << (16 * wanted.count()).bit_length()))
    spread = lambda c: F.pmod(F.xxhash64(c), F.lit(size))
    bits = wanted.select(spread("least").alias("b")).groupBy((F.col("b") / 64).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(b % 64 AS INT)))").alias("v")).toArrow()
    words = np.zeros(size // 64, np.uint64)
    words[bits["w"].to_numpy()] = bits["v"].to_numpy().view(np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast(words)  # at most 64 MB
    schema = pa.schema([("key", pa.binary()), ("grams", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.column(1).to_numpy()
            rows = np.flatnonzero(sent.value[b // 64] >> (b % 64).astype(np.uint64) & np.uint64(1))
            for at in range(0, len(rows), 256):
                sets = [s.tobytes() for s in ngrams(batch.column(0).take(pa.array(rows[at : at + 256])), n)]
                yield pa.RecordBatch.from_arrays([pa.array(list(map(xxhash.xxh3_128_digest, sets)), pa.binary()), pa.array(sets, pa.binary())], schema=schema)

    return lean(docs.select(F.col(text), spread(F.col(doc_id).cast("long")).alias("b"))).mapInArrow(tidy(run), "key binary, grams binary")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, doc_id: str, text: str, n: int, parts: int, of: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets overlap enough."""
    pairs = cut(pairs)
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = cut(nodes.join(asked, "node", "left_semi").select("node", "key", "least"))
    found = sets_of(docs, doc_id, text, n, wanted).join(wanted.select("node", "key"), "key").dropDuplicates(["node"]).select("node", "grams")
    both = pairs.join(found.withColumnsRenamed({"node": "a", "grams": "ga"}), "a").join(found.withColumnsRenamed({"node": "b", "grams": "gb"}), "b").select("a", "b", "ga", "gb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(of * common >= parts * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return lean(both).mapInArrow(tidy(run), "a long, b long")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp): the least node that links (a, b) reach, for each node that has a link.

    Each round takes the least label around a node and then its label's label, so paths halve in length."""
    edges = cut(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        around = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        nearer = labels.join(around, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        after = cut(nearer.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("further", "comp")).alias("comp")))
        labels = after.select("node", "comp")
        if after.where("old <> comp").isEmpty():
            return labels


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, parts: int = 4, of: int = 5, mark: Column | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs: the size of its set of word n-grams, and the least
    doc_id that links reach, its own included. With mark, a column of whole numbers, it comes too, and `class`, a number
    of each set of rows that links join, null where a row has no n-gram: ids that repeat don't tell rows apart. Two documents are linked when their overlap is parts / of or more.

    A-Z count as a-z, words are parted by ASCII white space. A text of fewer than n words is one n-gram of all of
    them; null and empty texts have none and no links; long texts are read whole. Every row gets a row, repeated ids
    and null ids too: rows that share an id but not the text may be in different classes, and a row without an id
    links others but names no class. Other columns are dropped; an empty table gives no rows.

    A group is named by 56 bits of its digest; two that share a name count as one group of both, which loses no link."""
    often = frequent(docs, text, n)
    rows = stored(prefixes(docs, doc_id, text, n, often, parts, of, F.lit(None) if mark is None else mark))
    named = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("g").alias("g"))
    nodes = cut(named.withColumn("node", F.monotonically_increasing_id()))
    heads = nodes.groupBy("g").agg(F.min("node").alias("head"), F.count("*").alias("members"))

    near = lambda a, b: (a * of >= b * parts) & (b * of >= a * parts)
    rest = lambda m: need(m, parts, of) - 1  # noqa: E731  what isn't in the prefix
    # Of two linked sets' prefixes so many n-grams are common; the first common one has so many places from it on in both.
    least = lambda a, b, x, y: need(a + b, parts, parts + of) - F.greatest(rest(x), rest(y))
    posts = rows.where(F.col("prefix").isNotNull()).select("g", "n", F.posexplode("prefix").alias("at", "s"))
    posts = posts.select("s", "g", "n", (F.col("n") - rest(F.col("n")) - F.col("at")).cast("int").alias("left"))
    shared = posts.groupBy("s").agg(F.min("g").alias("pivot"), F.max("g").alias("last"), F.count("*").alias("k")).where(F.col("pivot") != F.col("last"))
    met = stored(posts.join(shared.drop("last"), "s").dropDuplicates(["s", "g", "n", "left"]))
    prefix = stored(met.groupBy("g").agg(F.collect_set("s").alias("p")))
    pa_, pb = (prefix.select(F.col("g").alias(f"g{x}"), F.col("p").alias(f"p{x}")) for x in "ab")

    def enough(pairs: DataFrame) -> DataFrame:
        """The pairs (ga, gb, na, nb) of groups whose prefixes have enough in common."""
        common = cut(pairs).join(pa_, "ga").join(pb, "gb")
        return common.where(F.size(F.array_intersect("pa", "pb")) >= least(*(F.col(c) for c in ("na", "nb", "na", "nb")))).select("ga", "gb")

    # Where many groups meet, each with the one made most of frequent n-grams; then the members of a group with its first.
    # A group meets one such other, that which most of its n-grams name, so there are no more of these pairs than groups.
    hubs = met.where((F.col("k") > LARGE) & (F.col("g") != F.col("pivot"))).groupBy(F.col("g").alias("ga"), F.col("pivot").alias("gb"), F.col("n").alias("na")).agg(F.max("left").alias("left"), F.count("*").alias("c"))
    sizes = nodes.select(F.col("g").alias("gb"), F.col("n").alias("nb")).distinct()
    na, nb = F.col("na"), F.col("nb")
    hubs = hubs.join(sizes, "gb").where(near(na, nb) & (F.col("left") >= least(na, nb, na, nb)))
    hubs = hubs.groupBy("ga", "na").agg(F.max(F.struct("c", "gb", "nb")).alias("best")).select("ga", "best.gb", "na", "best.nb")
    hubs = enough(hubs)
    of_a = nodes.select(F.col("g").alias("ga"), F.col("node").alias("a"))
    first = hubs.join(of_a, "ga").join(heads.select(F.col("g").alias("gb"), F.col("head").alias("b")), "gb").select("a", "b")
    own = nodes.join(heads.where("members > 1"), "g").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    links = cut(verified(first.union(own).distinct(), nodes, docs, doc_id, text, n, parts, of))
    labels = components(nodes, links)

    # Then groups of different classes: first classes that meet, then their groups. A group that spans classes stands for itself.
    classes = cut(nodes.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    spans = classes.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("node").alias("head"))
    spans = spans.select("g", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(-1 - F.col("head")).alias("comp"))  # nodes aren't negative
    of_class = met.select("s", "g", "n", "left").join(spans, "g")
    mixed = of_class.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("s")
    of_class = cut(of_class.join(mixed, "s"))
    ranges = of_class.groupBy("s", "comp").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("left").alias("left"))
    ra, rb = (ranges.select("s", *(F.col(c).alias(f"{c}{x}") for c in ("comp", "lo", "hi", "left"))) for x in "ab")
    may = (F.col("hia") * of >= F.col("lob") * parts) & (F.col("hib") * of >= F.col("loa") * parts) & (F.least("lefta", "leftb") >= least(*(F.col(c) for c in ("loa", "lob", "hia", "hib"))))
    meet = ra.join(rb, "s").where((F.col("compa") < F.col("compb")) & may)
    ca, cb = (of_class.select("s", *(F.col(c).alias(f"{c}{x}") for c in ("comp", "g", "n", "left"))) for x in "ab")
    pairs = meet.select("s", "compa", "compb").join(ca, ["s", "compa"]).join(cb, ["s", "compb"]).where(near(na, nb) & (F.least("lefta", "leftb") >= least(na, nb, na, nb)))
    pairs = enough(pairs.select("ga", "gb", "na", "nb").distinct())
    own_a, own_b = (classes.select(F.col("g").alias(f"g{x}"), F.col("node").alias(x), F.col("comp").alias(f"comp{x}")) for x in "ab")
    across = pairs.join(own_a, "ga").join(own_b, "gb").where("compa <> compb").select("a", "b")
    torn = spans.where("comp < 0").select("g")
    within = own_a.join(torn.withColumnRenamed("g", "ga"), "ga", "left_semi").join(own_b.withColumnRenamed("gb", "ga"), "ga").where("compa < compb").select("a", "b")
    more = verified(across.union(within).distinct(), nodes, docs, doc_id, text, n, parts, of)

    links = links.union(labels.select(F.col("node").alias("a"), F.col("comp").alias("b"))).union(more)
    comps = nodes.select("key", "node", "least").join(components(nodes, links), "node", "left").select("key", "least", F.coalesce("comp", "node").alias("comp"))
    least_of = comps.groupBy("comp").agg(F.min("least").alias("component_id"))
    final = comps.join(least_of, "comp").select("key", "component_id", "comp")
    more = [] if mark is None else ["mark", F.col("comp").alias("class")]
    return rows.select("doc_id", "mark", "n", "key").join(final, "key", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *more)
