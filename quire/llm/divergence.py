"""How the sources of each language differ in their words, by mergeable radix tries.

Tasks count the terms of their documents in byte tries, one for each language, whose leaves hold a counter for each source
and one for documents. A trie is cut at prefixes and written, so that Spark deals the parts by ranges of prefixes; a task
merges the parts of a prefix and walks the result in the order of UTF-8, which gives the kept terms. Over these, tasks
add up the divergence of each pair of sources and keep the most telling terms of each source, ties in the order of terms.

Null texts, languages and sources are read as ''. Rows are documents, repeated ones too. A source without terms, and a
language without kept terms, give pairs like others. An empty table gives no rows. Further columns are not read. All
arithmetic is in whole numbers and exact while a count is less than 2^53.
"""

import gc
import heapq
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import lean, stored, tidy
from quire.llm.words import chunks, spelled

#: For each byte of UTF-8 what it counts as: letters as lower-case ones, other characters than ASCII as they are, the rest
#: as space.
LETTERS = np.array([b if b > 127 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256)], np.uint8)
#: Sources in a pass over the kept terms, as blocks of which a pass takes two.
BLOCK = 2048
_DOCS = -1  # a leaf's counter of documents; those of sources have numbers from 0


class Trie:
    """A radix trie of byte strings. A node is [label, counters or None, nodes by their first byte or None]."""

    def __init__(self):
        self.root = [b"", None, None]

    def leaf(self, term: bytes) -> dict[int, int]:
        """The counters of a term, which is put in if it is new."""
        node, at = self.root, 0
        while at < len(term):
            if node[2] is None:
                node[2] = {}
            kid = node[2].get(term[at])
            if kid is None:
                kid = node[2][term[at]] = [term[at:], {}, None]
                return kid[1]
            label = kid[0]
            if not term.startswith(label, at):
                same, most = 1, min(len(label), len(term) - at)
                while same < most and label[same] == term[at + same]:
                    same += 1
                upper = [label[:same], None, {label[same]: kid}]
                kid[0] = label[same:]
                node[2][term[at]] = kid = upper
            node, at = kid, at + len(kid[0])
        if node[1] is None:
            node[1] = {}
        return node[1]

    def walk(self) -> Iterator[tuple[int, bytes, dict[int, int]]]:
        """Each term with its counters, in the order of bytes, and how many bytes it surely shares with the one before."""
        stack, path, shared = [(0, self.root)], b"", 0
        while stack:
            at, node = stack.pop()
            shared, path = min(shared, at), path[:at] + node[0]
            if node[1] is not None:
                yield shared, path, node[1]
                shared = len(path)
            if node[2]:
                stack.extend((len(path), node[2][b]) for b in sorted(node[2], reverse=True))

    def merge(self, part: bytes, number: dict[str, int]) -> None:
        """Adds a part that `parts` has cut from another trie; number: of sources, which grows."""
        names, shared, rest, counters = pickle.loads(part)
        own = {k: number.setdefault(s, len(number)) for k, s in names.items()} | {_DOCS: _DOCS}
        path = b""
        for keep, more, found in zip(shared, rest, counters, strict=True):
            path = path[:keep] + more
            leaf = self.leaf(path)
            for k, n in found.items():
                k = own[k]
                leaf[k] = leaf.get(k, 0) + n

    def parts(self, names: list[str], depth: int) -> Iterator[tuple[bytes, bytes]]:
        """Prefixes of `depth` bytes, in order, each with the terms that begin so as bytes for `merge`."""
        prefix, part = None, None
        for shared, term, leaf in self.walk():
            if term[:depth] != prefix:
                if part:
                    yield prefix, _dumped(part, names)
                prefix, part, shared = term[:depth], ([], [], []), 0
            part[0].append(shared)
            part[1].append(term[shared:])
            part[2].append(leaf)
        if part:
            yield prefix, _dumped(part, names)


def _dumped(part: tuple[list, list, list], names: list[str]) -> bytes:
    used = set().union(*part[2]) - {_DOCS}
    return pickle.dumps(({k: names[k] for k in used}, *part), protocol=5)


_PARTS = "lang string, prefix binary, part binary"
_TERMS = "lang string, term string, docs long, sources array<string>, counts array<long>"


def letters(texts: pa.Array) -> pa.Array:
    """Texts with spaces for all that is in no term, so that their words are their terms."""
    raw, ends = spelled(texts)
    return pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(LETTERS[raw])])


def summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of the values of each."""
    keys, at = np.unique(key, return_inverse=True)
    return keys, *(np.bincount(at, v, len(keys)).astype(np.int64) for v in values)


def counted(docs: DataFrame, depth: int = 3, most: int = 2_000_000) -> DataFrame:
    """The parts of the tries of docs (lang, source, text, none of them null). A task tallies the words of chunks of texts
    by Arrow's kernels; when it has `most` tallies it puts them in tries, writes their parts and starts anew."""

    def run(batches):
        number, pending, size = {}, [], 0
        for batch in batches:
            pairs = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
            group = np.array([number.setdefault(p, len(number)) for p in pairs], np.int64)
            for c in chunks(letters(batch.column("text")), lower=False):
                doc = np.repeat(np.arange(c.first, c.first + len(c.bounds) - 1), np.diff(c.bounds))
                each, n = summed(doc * len(c.words) + c.index, np.ones(len(doc)))
                doc, word = np.divmod(each, max(len(c.words), 1))
                key, n, own = summed(word * len(number) + group[doc], n, np.ones(len(n)))
                pending.append((c.words, *np.divmod(key, max(len(number), 1)), n, own))
                size += len(key)
                if size >= most:
                    yield from flushed(pending, list(number), depth)
                    pending, size = [], 0
        yield from flushed(pending, list(number), depth)

    return lean(docs.select("lang", "source", "text")).mapInArrow(tidy(uncollected(run)), _PARTS)


def uncollected(run: Callable) -> Callable:
    """run without Python's search for cycles, which takes long among a trie's many nodes; they have none."""

    def own(batches):
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()

    return own


def flushed(pending: list[tuple], groups: list[tuple[str, str]], depth: int) -> Iterator[pa.RecordBatch]:
    """The parts of the tries of tallies: distinct words of a chunk, and of each tally the word's place there, the number
    of its language and source, occurrences and documents."""
    if not sum(len(p[1]) for p in pending):
        return
    coded = pa.concat_arrays([p[0] for p in pending]).dictionary_encode()
    code, at, word = coded.indices.to_numpy().astype(np.int64), 0, []
    for words, place, *_ in pending:
        word.append(code[at + place])
        at += len(words)
    # Terms in the order of bytes; langs and sources by numbers.
    order = pc.sort_indices(coded.dictionary).to_numpy()
    terms, place = coded.dictionary.cast(pa.binary()).take(pa.array(order)).to_pylist(), np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    langs, names = sorted({g[0] for g in groups}), sorted({g[1] for g in groups})
    lang_of, name_of = (np.array([own.index(g[i]) for g in groups], np.int64) for i, own in ((0, langs), (1, names)))
    group, n, docs = (np.concatenate([p[k] for p in pending]) for k in (2, 3, 4))
    key, n, docs = summed((lang_of[group] * len(terms) + place[np.concatenate(word)]) * len(names) + name_of[group], n, docs)
    term, name = np.divmod(key, len(names))
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    ends, docs = np.append(starts[1:], len(term)).tolist(), np.add.reduceat(docs, starts).tolist()
    trie, lang, name, n, rows = Trie(), None, name.tolist(), n.tolist(), []
    for a, z, d, (own, t) in zip(starts.tolist(), ends, docs, zip(*(x.tolist() for x in np.divmod(term[starts], len(terms))), strict=True), strict=True):
        if own != lang:
            rows += [(langs[lang], *p) for p in trie.parts(names, depth)] if lang is not None else []  # of the language before
            trie, lang = Trie(), own
        leaf = trie.leaf(terms[t])
        leaf.update(zip(name[a:z], n[a:z], strict=True))
        leaf[_DOCS] = d
    rows += [(langs[lang], *p) for p in trie.parts(names, depth)]
    for at in range(0, len(rows), 1000):
        yield _batch(rows[at : at + 1000])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    lang, prefix, part = zip(*rows, strict=True)
    return pa.record_batch([pa.array(lang, pa.string()), pa.array(prefix, pa.binary()), pa.array(part, pa.binary())], ["lang", "prefix", "part"])


def merged(parts: DataFrame, least: int) -> DataFrame:
    """The terms in at least so many documents of a language, with their counts by source; parts as `counted` gives them."""

    def run(batches):
        key, trie, number, rows = None, Trie(), {}, []

        def kept():
            names = list(number)
            for _, term, leaf in trie.walk():
                if leaf[_DOCS] >= least:
                    own = sorted(k for k in leaf if k != _DOCS)
                    yield key[0], term.decode(), leaf[_DOCS], [names[k] for k in own], [leaf[k] for k in own]

        for batch in batches:
            for lang, prefix, part in zip(*(batch.column(c).to_pylist() for c in ("lang", "prefix", "part")), strict=True):
                if key != (lang, prefix):
                    rows += kept()
                    key, trie, number = (lang, prefix), Trie(), {}
                trie.merge(part, number)
            if rows:
                yield _terms(rows)
                rows = []
        yield _terms([*kept()])

    # Ranges of prefixes: parts of one prefix meet in one task, and tasks follow the order of terms.
    dealt = parts.repartitionByRange("lang", "prefix").sortWithinPartitions("lang", "prefix")
    return lean(dealt).mapInArrow(tidy(uncollected(run)), _TERMS)


def _terms(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()))
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["lang", "term", "docs", "sources", "counts"])


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * count / whole), by long division in steps of three digits, so that nothing overflows."""
    out, rest = np.zeros(np.broadcast(count, whole).shape, np.int64), count
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)) of shares, which are at most 10^9 + 1."""
    return (p - q) ** 2 // (p + q)


def _streamed(groups: list[tuple], blocks: tuple[int, int], best: int):
    """A task's work over kept terms. groups: lang, source, block, terms (its occurrences), kept (the language's kept
    terms), all_terms (their occurrences in it), of two blocks, or of one."""
    langs = {}
    for lang, source, block, n, v, whole in sorted(groups):
        langs.setdefault(lang, []).append((source, block, n, v, whole))

    def run(batches):
        sums, tops = {lang: np.zeros((len(own), len(own)), np.int64) for lang, own in langs.items()}, {}
        for batch in batches:
            own_langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in dict.fromkeys(own_langs):
                if lang not in langs:
                    continue
                rows = batch.filter(pa.array(own_langs == lang))
                rows = rows.take(pc.sort_indices(rows, [("term", "ascending")]))
                step = max(1, 1_000_000 // len(langs[lang]))
                for at in range(0, rows.num_rows, step):
                    chunk(lang, rows.slice(at, step), sums[lang], tops)
        out = []
        for lang, own in langs.items():
            a, b = np.nonzero(sums[lang])
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                n = int(sums[lang][x, y])
                out += [(lang, own[x][0], "pair", own[y][0], n), (lang, own[y][0], "pair", own[x][0], n)]
        out += [(lang, source, "term", term, -n) for (lang, source), top in tops.items() for n, term in top]
        if out:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (*[pa.string()] * 4, pa.int64()), strict=True)], ["lang", "source", "part", "item", "value"])

    def chunk(lang, rows, sums, tops):
        own = langs[lang]
        place = {g[0]: i for i, g in enumerate(own)}
        lists, counts = rows.column("sources"), rows.column("counts")
        coded = lists.flatten().dictionary_encode()
        column = np.array([place.get(s, -1) for s in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        row, n = np.repeat(np.arange(rows.num_rows), pc.list_value_length(lists).to_numpy()), counts.flatten().to_numpy()
        here = column >= 0
        c = np.zeros((rows.num_rows, len(own)), np.int64)
        c[row[here], column[here]] = n[here]
        n_own, v, n_lang, block = (np.array([g[i] for g in own], np.int64) for i in (2, 3, 4, 1))
        p = shares(c + 2, (n_own + 2 * v)[None, :])
        for a in range(len(own)):
            # Of two blocks, only pairs across them; of one, each pair once.
            other = np.flatnonzero(block == blocks[1]) if blocks[0] != blocks[1] else np.arange(a + 1, len(own))
            if len(other) and block[a] == blocks[0]:
                sums[a, other] += apart(p[:, a : a + 1], p[:, other]).sum(axis=0)
        if blocks[0] == blocks[1]:
            total = np.zeros(rows.num_rows, np.int64)
            np.add.at(total, row, n)
            q = shares(total + 2, np.int64(n_lang[0] + 2 * v[0]))[:, None]
            value, terms = np.where((c > 0) & (p > q), apart(p, q), -1), rows.column("term")
            for a, g in enumerate(own):
                first = np.argsort(-value[:, a], kind="stable")[:best]  # terms are in order, so the first of ties come first
                new = [(-int(value[i, a]), terms[int(i)].as_py()) for i in first if value[i, a] >= 0]
                if new:
                    key = (lang, g[0])
                    tops[key] = heapq.nsmallest(best, tops.get(key, []) + new, key=lambda x: (x[0], x[1].encode()))

    return run


def audit(docs: DataFrame, least: int = 10, best: int = 10, text: str = "text", lang: str = "lang", source: str = "source", block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: of each source, its divergence from each other source of its language (part
    `pair`), and the `best` terms that it has more of than its language (part `term`)."""
    empty = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    own = docs.select(empty(lang, "lang"), empty(source, "source"), empty(text, "text"))
    kept = stored(merged(stored(counted(own)), least))
    each = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("terms"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("all_terms"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    groups = own.select("lang", "source").distinct().join(each, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *(none(c) for c in ("terms", "kept", "all_terms")))
    groups = stored(groups)
    blocks = -(-groups.count() // block) or 1
    numbered = groups.withColumn("block", F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int"))
    found = None
    for pair in ((a, b) for b in range(blocks) for a in range(b + 1)):
        # About two blocks of sources go to the driver and along with the tasks, never more.
        here = [tuple(r) for r in numbered.where(F.col("block").isin(*pair)).select("lang", "source", "block", "terms", "kept", "all_terms").collect()]
        one = lean(kept.select("lang", "term", "sources", "counts")).mapInArrow(tidy(_streamed(here, pair, best)), "lang string, source string, part string, item string, value long")
        found = one if found is None else found.union(one)
    found = stored(found)
    return ranked(pairs(groups).union(found.where("part = 'pair'").drop("part")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pair").union(ranked(found.where("part = 'term'").drop("part"), "term", best))


def pairs(groups: DataFrame, lots: int = 16) -> DataFrame:
    """Each ordered pair of sources of a language, with value 0: as many rows as the audit has. A language's sources are
    dealt to lots, so that a large one is no single task's."""
    lot = F.pmod(F.xxhash64("source"), F.lit(lots)).cast("int")
    ours = groups.select("lang", "source", lot.alias("lot"))
    others = groups.select("lang", F.col("source").alias("item"), F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"))
    return ours.join(others, ["lang", "lot"]).where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))


def ranked(rows: DataFrame, part: str, best: int | None = None) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = rows.withColumn("rank", rank)
    if best is not None:
        out = out.where(F.col("rank") <= best)
    return out.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
