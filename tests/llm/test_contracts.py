"""Every query of the subpackage: its columns, its flags, its scores recomputed by plain Python, on the smallest tables."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import lattice, mixing, quality, queries, toxicity
from quire.sources import table

SF = "/root/testdata/sf0.001"
#: The contract's columns; more may follow.
COLUMNS = {
    "op1": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op2": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op3": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op5": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op6": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op7": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op8": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op9": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
}


def crc(i):
    return zlib.crc32(str(i).encode())


@pytest.fixture(scope="module")
def got(spark):
    """Each query's rows, made once."""
    made = {}

    def rows(op):
        if op not in made:
            name = next(n for n in queries.QUERIES if n.startswith(op + "_"))
            df = queries.QUERIES[name](spark, SF)
            types = dict(df.dtypes)
            assert {c: types.get(c) for c in COLUMNS[op]} == COLUMNS[op]
            made[op] = df.collect()
        return made[op]

    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in table(spark, SF, "documents").collect()}


@pytest.fixture(scope="module")
def vectors(spark):
    return {r.vec_id: np.array(r.embedding, float) for r in table(spark, SF, "embeddings").collect()}


def test_personal_data(got, docs):
    from test_edges import base

    kinds = ("email", "ip", "card", "phone")
    assert sorted(r.doc_id for r in got("op1")) == sorted(docs)
    for r in got("op1"):
        own = base(docs[r.doc_id].text)
        text = ",".join(f"{kinds[k]}:{a}:{z}" for a, k, z in own)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for _, k, _ in own) for x in range(4))
        spans = [s for s in r.spans.split(",") if s]
        assert set(text.split(",")) - {""} <= set(spans) and len(spans) == len(set(spans)) == r.n_spans
        starts = [int(s.split(":")[1]) for s in spans]
        assert starts == sorted(starts)
        assert r.n_secret == sum(s.startswith("secret:") for s in spans)


def test_packing(got, docs):
    tokenizer = Tokenizer.from_file(queries.tokenizer_file())
    want = {}
    for i, d in docs.items():
        ids = np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4")
        want.update({(i, n): (a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for n, a in enumerate(range(0, len(ids), 4096))})
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got("op2")} == want and len(got("op2")) == len(want)
    ends = Counter()
    for r in sorted(got("op2"), key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 4096
    # First fit by falling length is a packing too; the method makes no more sequences than it.
    bins = []
    for x in sorted((r.length for r in got("op2")), reverse=True):
        at = next((k for k, b in enumerate(bins) if b + x <= 4096), None)
        if at is None:
            bins.append(x)
        else:
            bins[at] += x
    assert len(ends) <= len(bins)


@pytest.mark.parametrize("op", ["op3", "op9"])
def test_flags_and_thresholds(got, docs, op):
    assert sorted(r.doc_id for r in got(op)) == sorted(docs)
    for r in got(op):
        assert r.held_out == (crc(r.doc_id) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= (0.3 if op == "op9" else 0.5))


def test_labels_of_held_out_documents_are_not_learnt(spark, docs):
    labels = table(spark, SF, "labels")
    flipped = labels.withColumn("quality", F.when(quality.learned(), F.col("quality")).otherwise(1 - F.col("quality")))
    own = table(spark, SF, "documents")
    a, b = (quality.fit(own, x, quality.learned()) for x in (labels, flipped))
    assert np.array_equal(a.w1, b.w1) and a.temperature == b.temperature


def test_quality_as_plain_python(spark):
    """Context sums and scores by loops over words, on a tiny table."""
    import pyarrow as pa

    shape = quality.Shape(letters=64, forms=16)
    rows = [(1, "The cat saw the CAT!!"), (2, None), (3, " one  two\tthree two two "), (4, ""), (5, "x9 (é) Ünder-way 12")]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    words = {w for _, t in rows for w in (t or "").split()}
    letters, forms = quality.letters_and_forms(pa.array(sorted(words)), shape)
    place = {w: (int(a), int(b)) for w, a, b in zip(sorted(words), letters, forms, strict=True)}
    assert place["CAT!!"][0] == place["cat"][0]
    index = np.zeros((shape.rows, quality.DIM))
    places, signs = quality.index_vectors(shape)
    np.put_along_axis(index, places, signs, axis=1)
    sums, tokens = np.zeros((shape.rows, quality.DIM)), {}
    for i, t in rows:
        seen = [place[w] for w in (t or "").split()]
        seen = [(a, shape.rows - 1 if k and seen[k - 1][0] == a else b) for k, (a, b) in enumerate(seen)]
        tokens[i] = seen
        for k in range(len(seen) - 1):
            for side in (0, 1):
                sums[seen[k][side]] += index[seen[k + 1][side]]
                sums[seen[k + 1][side]] += index[seen[k][side]]
    got = {r.row: [r[f"c{k}"] for k in range(quality.DIM)] for r in quality.context_sums(own, "text", shape).collect()}
    assert got == {r: list(map(int, sums[r])) for r in np.flatnonzero(sums.any(axis=1))}
    model = quality.fit(own, spark.createDataFrame([(1, 1), (3, 0), (5, 1)], "doc_id long, quality int"), F.lit(True), shape=shape)
    for r in quality.score(own, model).collect():
        pool = np.zeros(2 * quality.DIM)
        for side in (0, 1):
            if tokens[r.doc_id]:
                pool[side * quality.DIM : (side + 1) * quality.DIM] = np.mean([model.table[t[side]] for t in tokens[r.doc_id]], axis=0)
        h = np.tanh((pool - model.mean) / model.spread @ model.w1 + model.b1)
        assert r.score == pytest.approx(1 / (1 + math.exp(-(h @ model.w2 + model.b2) / model.temperature)), abs=1e-4)


def test_toxicity_as_plain_python(spark):
    """The chain's probabilities from its weights by loops, and what training keeps, on a tiny table."""
    bad, good = "you utter scumbag go away", "a calm note on gardens and rain"
    rows = [(i, f"{bad if i % 2 else good} w{i}") for i in range(60)] + [(100, None), (101, ""), (102, "SCUMBAG, away!")]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2 if i % 4 < 2 else 0) for i in range(60)], "doc_id long, rude int, mild int")
    chain = toxicity.fit(own, labels, ("rude", "mild"), F.lit(True), least=2.0)
    number = {int(f): k for k, f in enumerate(chain.features)}
    assert toxicity.features_of("scumbag")[0] in number or any(f in number for f in toxicity.features_of("scumbag"))
    scored = {r.doc_id: r for r in toxicity.score(own, chain).collect()}
    for i, t in rows:
        found = {number[f] for w in re.findall(r"\w+", (t or "").lower()) for f in toxicity.features_of(w) if f in number}
        ahead = []
        for w in chain.weights:
            dense = [1.0, *(math.log((p + 1e-4) / (1 - p + 1e-4)) / 5 for p in ahead)]
            z = sum(w[f] for f in found) / math.sqrt(max(len(found), 1)) + sum(a * b for a, b in zip(w[-len(dense) :], dense, strict=True))
            ahead.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
        assert (scored[i].p_rude, scored[i].p_mild) == pytest.approx(tuple(ahead), abs=1e-9)
    assert scored[102].p_rude > 0.5 > scored[0].p_rude


def test_exact_search(got, vectors):
    whole = {i: np.floor(64 * x).astype(int) for i, x in vectors.items()}
    want = []
    for q in sorted(i for i in whole if i % 20 == 0):
        best = sorted((-int(whole[q] @ y), i) for i, y in whole.items() if i != q)[:20]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got("op4")) == want


def test_neighbours(got, vectors):
    hits = total = 0
    for q in sorted(i for i in vectors if i % 20 == 0):
        best = {i for _, i in sorted((-float(vectors[q] @ y), i) for i, y in vectors.items() if i != q)[:20]}
        own = sorted((r.rank, r.vec_id, r.score) for r in got("op6") if r.query_id == q)
        assert [r[0] for r in own] == list(range(1, 21)) and [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
        assert all(s == pytest.approx(float(vectors[q] @ vectors[i]), abs=1e-12) for _, i, s in own)
        hits, total = hits + len(best & {i for _, i, _ in own}), total + len(best)
    assert hits >= 0.9 * total


def test_near_duplicates(got, docs):
    from test_jaccard import brute

    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got("op5")) == brute([(i, d.text) for i, d in docs.items()])


def test_language_model(got, docs):
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    counts = Counter(w for i, d in docs.items() if crc(i) % 10 for w in words(d.text))
    n, v = sum(counts.values()), len(counts)
    for r in got("op7"):
        own = words(docs[r.doc_id].text)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(r.doc_id) % 10 == 0, len(own), sum(counts[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def test_lattice_score_by_enumeration(spark):
    """All segmentations of short words, added up one by one."""
    rows = [(1, "aab ba"), (2, "ab Ab xé"), (3, ""), (4, "ba zz\x0bq"), (5, None)]
    learn = {1, 2, 3}
    path = queries.tokenizer_file("piece_bpe_32k.model")
    pieces = lattice.Pieces(path)
    number = {int(k): i for i, k in enumerate(pieces.keys)}
    words = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
    counts = Counter(w for i, t in rows if i in learn for w in words(t))
    table_ = spark.createDataFrame(list(counts.items()), "word string, c long")
    fit = lattice.fitted(table_, len(learn), path, 2)
    total, once = sum(counts.values()) + len(learn), sum(c == 1 for c in counts.values())
    unseen = (once + 1) / (total + 1)

    def weight(piece):
        own = number.get(pieces.hash(piece))
        if own is not None:
            return math.exp(fit[own])
        return math.exp(sum(fit[len(pieces.keys) + b] for b in piece.encode())) if len(piece) == 1 else 0.0

    def all_ways(word):
        text = lattice.SPACE + word
        out = 0.0
        for cuts in itertools.product((0, 1), repeat=len(text) - 1):
            bounds = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(text)]
            out += math.prod(weight(text[a:b]) for a, b in zip(bounds, bounds[1:], strict=False))
        return out

    end = math.exp(fit[-1])
    end /= end + np.exp(fit[:-257][pieces.initial]).sum()
    got = {r.doc_id: r.score for r in lattice.score(spark.createDataFrame(rows, "doc_id long, text string"), path, F.col("doc_id").isin(*learn)).collect()}
    for i, t in rows:
        each = [math.log10((1 - unseen) * counts[w] / total + unseen * all_ways(w)) for w in words(t)]
        assert got[i] == pytest.approx(sum(each) + math.log10((1 - unseen) * len(learn) / total + unseen * end), rel=1e-9)


def test_mix(got, docs):
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for i, d in docs.items()}
    sources = sorted({d.source for d in docs.values() if d.source is not None}) + [None] * any(d.source is None for d in docs.values())
    own = [sum(sizes[i] for i, d in docs.items() if d.source == s) for s in sources]
    wanted = dict(zip(sources, mixing.targets(own, [1 + k % 3 for k in range(len(sources))], 3), strict=True))
    taken = Counter()
    assert sorted(r.doc_id for r in got("op8")) == sorted(docs)
    for r in got("op8"):
        s = docs[r.doc_id].source
        assert (r.size, r.source_size, r.target) == (sizes[r.doc_id], own[sources.index(s)], pytest.approx(wanted[s]))
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in sources:
        assert abs(taken[s] - wanted[s]) <= max(sizes[i] for i, d in docs.items() if d.source == s)


def test_flow_of_overlapping_sources_as_exhaustive_search():
    patterns, times = {("a",): 2, ("b",): 2, ("a", "b"): 3}, 3
    cost = lambda size, amount: sum((k * k - 1) * max(0, min(size, amount - (k - 1) * size)) for k in range(1, times + 1))
    for quotas in ({"a": 4, "b": 6}, {"a": 9, "b": 1}, {"a": 0, "b": 12}, {"a": 20, "b": 20}):
        best = None
        for a, b, x, y in itertools.product(range(7), range(7), range(10), range(10)):
            if a + x <= quotas["a"] and b + y <= quotas["b"] and x + y <= 9:
                now = (-(a + b + x + y), cost(2, a) + cost(2, b) + cost(3, x + y))
                best = now if best is None else min(best, now)
        got = mixing.flow(patterns, quotas, times)
        assert (-sum(got.values()), sum(cost(patterns[p], n) for p, n in got.items())) == best


def test_mix_of_overlapping_sources(spark):
    rows = [(i, "w " * (1 + i % 7), [["a"], ["b"], ["a", "b"], None][i % 4]) for i in range(400)] + [(1, "w ", ["a"])]
    taken, sources = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, belongs array<string>"), F.col("belongs"))
    taken, sources = taken.collect(), {r.source: r for r in sources.collect()}
    assert len(taken) == len(rows) and all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in taken)
    # A shared document serves both sources, so what is taken comes to what all quotas ask for.
    assert abs(sum(r.taken for r in taken) - sum(r.target for r in sources.values())) <= 4 * 7


def test_main_text(got, spark):
    import html

    pages = {r.page_id: r for r in table(spark, SF, "pages").collect()}
    assert sorted(r.page_id for r in got("op10")) == sorted(pages)
    for r in got("op10"):
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text)
        article = re.search(r"<article\b[^>]*>(.*)</article>", pages[r.page_id].html, re.S)
        if article:
            inside = set(re.split(r"\s+", html.unescape(re.sub(r"<[^>]*>", " ", article[1]))))
            assert r.text and set(r.text.split()) <= inside | set(re.split(r"\s+", html.unescape(re.sub(r"<[^>]*>", "", article[1]))))
