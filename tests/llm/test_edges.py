"""Odd rows: nulls in any column, empty and long texts, ties, repeated rows, empty tables, columns with clashing names."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quire.llm import ball_tree, html_text, lattice, mixing, packing, pii, quality, toxicity, vp_tree
from quire.llm.queries import tokenizer_file

DOCS = "doc_id long, text string, score string, base string, size string, vec string"
LONG = "word " * 30_000
ROWS = [(1, None, "x", "x", "x", "x"), (2, "", None, None, None, None), (3, LONG, "x", None, "x", "x"), (4, "mail a.b@c.org, call +49 170 1234567", *"abcd"), (5, "same text", *"abcd"), (5, "same text", *"abcd"), (None, "no id", *"abcd"), (6, "<|endoftext|> é \U0001f600 \t\x0b end.", *"abcd")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


def test_packing_round_trip(spark, docs):
    import numpy as np
    from tokenizers import Tokenizer

    got = packing.pack(docs, tokenizer_file(), capacity=64).collect()
    tokenizer = Tokenizer.from_file(tokenizer_file())
    want = []
    for i, t, *_ in ROWS:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, n, a, len(ids[a : a + 64]), zlib.crc32(np.array(ids[a : a + 64], "<u4").tobytes())) for n, a in enumerate(range(0, len(ids), 64))]
    order = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted([tuple(r[:5]) for r in got], key=order) == sorted(want, key=order)
    at = {}
    for r in got:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in at.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 64
    assert packing.pack(docs.limit(0), tokenizer_file()).count() == 0


def test_best_two_fit_replaces_the_smallest():
    plan = packing.patterns({60: 1, 30: 1, 25: 1, 14: 1}, 100)
    assert ([60, 25, 14], 1) in [(sorted(own, reverse=True), n) for own, n in plan]


def base(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            odd = [int(d) for d in digits[::-1]]
            luhn = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(odd)) % 10 == 0
            good = kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 12 <= len(digits) <= 19 and luhn or kind == "phone" and 9 <= len(digits) <= 15
            if good:
                out.append((m.start(), ("email", "ip", "card", "phone").index(kind), m.end()))
    return sorted(out)


def test_base_spans_as_python(spark):
    draw = random.Random(1)
    parts = ["a@b.c", "x@@y.de", "1.2.3.4", "300.1.1.1.1", "0001.2.3.255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (170) 123-4567", "+1.2", "\U0001f600", "é", " ", "-", ".", "@", "+", "7", "a", "\n"]
    rows = [(i, "".join(draw.choice(parts) for _ in range(draw.randrange(12)))) for i in range(400)] + [(998, None), (999, "")]
    got = pii.spans(spark.createDataFrame(rows, "doc_id long, text string"), "text").collect()
    assert {r.doc_id: [(s.start, s.order, s.stop) for s in r.base] for r in got} == {i: base(t) for i, t in rows}


def test_redaction(docs):
    got = pii.redact(docs)
    assert got.columns == docs.columns
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[1] is None and texts[2] == "" and texts[3] == LONG and texts[4] == "mail [EMAIL], call [PHONE]" and texts[5] == "same text"
    assert pii.redact(docs.limit(0)).count() == 0


def test_quality_edges(spark, docs):
    labels = spark.createDataFrame([(3, 1), (5, 0), (4, None), (None, 1), (5, 0), (77, 1)], "doc_id long, quality int")
    got = quality.score(docs, quality.fit(docs, labels, F.lit(True))).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    nothing = quality.score(docs, quality.fit(docs, labels.limit(0), F.lit(True))).collect()
    assert len(nothing) == len(ROWS)
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels, F.lit(True))).count() == 0


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([(3, 1), (5, 0), (4, None), (None, 1), (5, 0), (77, 1)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        got = toxicity.score(docs, toxicity.fit(docs, known, ("toxic",), F.lit(True))).collect()
        assert len(got) == len(ROWS) and all(0 <= r.p_toxic <= 1 for r in got)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels, ("toxic",), F.lit(True))).count() == 0


def test_mix_takes_whole_documents_near_targets(spark):
    draw = random.Random(3)
    rows = [(i, "w " * draw.randrange(1, 40), draw.choice(["a", "a", "a", "b", "c", None])) for i in range(600)] + [(1000, None, "a"), (1001, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, sources = mixing.mix(docs, F.array("source"))
    taken, sources = taken.collect(), {r.source: r for r in sources.collect()}
    assert len(taken) == len(rows) and all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in taken)
    assert [sources[s].target for s in ("a", "b", "c", None)] == pytest.approx(mixing.targets([sources[s].source_size for s in ("a", "b", "c", None)], [1, 2, 3, 1], 3))
    for s, r in sources.items():
        assert abs(sum(t.taken for t in taken if t.pattern == [s]) - r.target) <= 40
    again = mixing.mix(docs, F.array("source"))[0].collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in taken)
    whole = mixing.mixed(docs, F.array("source"))
    assert whole.columns == docs.columns and whole.count() == sum(r.copies for r in taken)
    assert mixing.mixed(docs.limit(0), F.array("source")).count() == 0


def brute(rows, k, scale):
    out = []
    for q, x in rows:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in rows if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def vectors(spark, draw, n):
    rows = [(i, [draw.choice([-0.5, -0.25, 0.25, 0.5, 1.0]) for _ in range(4)]) for i in range(n)]
    odd = [(5000, None), (5020, [0.1, None, 0.2, 0.3]), (5040, [float("nan"), 0.0, 0.0, 0.0]), (5060, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    return rows, spark.createDataFrame([(i, v, "x") for i, v in rows + odd + rows[:3]], "vec_id long, embedding array<float>, score string")


def test_exact_search_with_ties_as_brute_force(spark):
    rows, df = vectors(spark, random.Random(4), 300)
    whole = [(i, [int(64 * x) for x in v]) for i, v in rows]
    got = ball_tree.top_k(df, F.col("vec_id") % 20 == 0, shard_rows=60, block_rows=7, leaf_rows=8)
    assert sorted(tuple(r) for r in got.collect()) == brute(whole, 20, 64)
    assert ball_tree.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = ball_tree.top_k(df.where("vec_id < 3"), F.col("vec_id") % 20 == 0).collect()
    assert len(few) == 2


def test_vantage_points_with_factor_one_are_exact(spark):
    rows, df = vectors(spark, random.Random(6), 300)
    got = vp_tree.nearest(df, F.col("vec_id") % 20 == 0, factor=1.0, shard_rows=60, block_rows=7, leaf_rows=8)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 20, 1)
    assert vp_tree.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_vantage_points_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    exact, near = ({(r.query_id, r.vec_id) for r in vp_tree.nearest(df, F.col("vec_id") % 20 == 0, factor=f).collect()} for f in (1.0, 2.0))
    assert len(exact & near) >= 0.9 * len(exact)


def test_main_text(spark):
    page = "<html><head><title>t</title></head><body><nav><a href='/'>Home page of all</a></nav><article><h1>The  Title</h1><p>One &amp; two\n words here, many of them.</p><p>And <b>more</b> text in a second paragraph.</p><script>x()</script></article><footer>All rights reserved</footer></body></html>"
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (1, "u", page), (4, "u", "<div" * 5000), (5, "u", "plain words only")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    assert got[1] == "The Title\n\nOne & two words here, many of them.\n\nAnd more text in a second paragraph."
    assert got[2] == got[3] == ""
    assert html_text.main_text(df).count() == len(rows)
    assert html_text.main_text(df.limit(0)).count() == 0


def test_lattice_base_score_as_brute_force(spark, docs):
    import math
    from collections import Counter

    rows = [r[:2] for r in ROWS if r[0] is not None]
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    learn = lambda i: zlib.crc32(str(i).encode()) % 10 != 0
    counts = Counter(w for i, t in rows if learn(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    train = F.crc32(F.col("doc_id").cast("string")) % 10 != 0
    got = lattice.score(docs.where("doc_id IS NOT NULL"), tokenizer_file("piece_bpe_32k.model"), train).collect()
    assert len(got) == len(rows)
    want = {i: sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t)) for i, t in rows}
    for r in got:
        assert r.train_tokens == n and r.base_score == pytest.approx(want[r.doc_id], rel=1e-9) and r.score < 0
        assert r.n_tokens == len(words(dict(rows)[r.doc_id])) and r.n_known == sum(counts[w] > 0 for w in words(dict(rows)[r.doc_id]))
    assert lattice.score(docs.limit(0), tokenizer_file("piece_bpe_32k.model"), train).count() == 0
