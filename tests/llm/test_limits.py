"""What lies beyond the limits that operators work within: very long texts and words, many open tags, names that clash,
settings that split work, which change no result."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quire.llm import ball_tree, html_text, jaccard, lattice, mixing, packing, pii, quality, vp_tree, words
from quire.llm.queries import tokenizer_file

NAMES = ("piece", "start", "length", "offset", "size", "pattern", "copies", "row", "draw", "key", "g", "n", "node", "class", "mark", "base", "spans", "region", "shard", "block", "page of text", "text of score", "found base email", "base of text", "id in the mix")


def clash():
    return {c: F.lit(1) for c in NAMES}


def test_chunks_hold_whole_texts():
    import pyarrow as pa

    texts = ["  A b\x0b c ", None, "", "x" * 50, "É é\x1cé", " \t\n", "a b c " * 20]
    for most in (1, 10, 10_000):
        got = {}
        for c in words.chunks(pa.array(texts), most=most):
            listed = c.words.to_pylist()
            for i in range(len(c.bounds) - 1):
                got[c.first + i] = [listed[k] for k in c.index[c.bounds[i] : c.bounds[i + 1]]]
        assert [got[i] for i in range(len(texts))] == [[w.decode() for w in "".join(ch.lower() if ch.isascii() else ch for ch in t or "").encode().split()] for t in texts]


def test_hashes_are_of_the_whole_word():
    import pyarrow as pa

    table = words.drawn(1)
    own = ["", "a", "b", "ab", "ba", "x" * 64, "x" * 65, "x" * 129, "x" * 128 + "y", "y" + "x" * 128]
    alone = [int(words.hashes(pa.array([w]), table)[0]) for w in own]
    assert list(map(int, words.hashes(pa.array(["skipped", *own]).slice(1), table))) == alone and len(set(alone)) == len(own)


def test_what_a_worker_remembers_changes_nothing():
    made = []
    known = words.Known(lambda ws: made.append(len(ws)) or [w * 2 for w in ws], most=2_000)
    for k in range(60):
        own = [f"{k // 3 % 7}-{i}".encode() for i in range(9)]
        assert known.of(own) == [w * 2 for w in own]
    assert sum(made) < 60 * 9 and len(known.young) + len(known.old) < 60


@pytest.mark.parametrize("limits", [{"FREQUENT": 5}, {"LARGE": 1}, {"FILTER_BITS": (64, 64)}, {"COUNTED": 50, "GIVEN": 2}])
def test_near_duplicates_beyond_each_limit(spark, monkeypatch, limits):
    from test_jaccard import brute, found

    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    draw = random.Random(8)
    vocabulary = [f"w{k}" for k in range(60)]
    rows, passage = [], [draw.choice(vocabulary) for _ in range(30)]
    for family in range(6):
        text = [draw.choice(vocabulary) for _ in range(draw.choice([5, 40, 90]))] + passage * (family % 2)
        for _ in range(12):
            text = list(text)
            text[draw.randrange(len(text))] = draw.choice(vocabulary)
            rows.append((len(rows), " ".join(text)))
    assert found(spark, rows) == brute(rows)


def test_very_long_texts(spark):
    draw = random.Random(9)
    long = " ".join(f"w{draw.randrange(9)}" for _ in range(300_000))
    rows = [(1, long), (2, long + " end"), (3, "w" * 200_000), (4, "a@" * 50_000 + " 1" * 50_000), (5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.link(docs).collect()) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)]
    scores = quality.score(docs, quality.fit(docs, docs.select("doc_id", F.lit(1).alias("quality")), F.lit(True)))
    assert scores.count() == 5
    got = {r.doc_id: r for r in lattice.score(docs.where("doc_id IN (1, 5)").union(spark.createDataFrame([(6, "w" * 3000)], "doc_id long, text string")), tokenizer_file("piece_bpe_32k.model"), F.col("doc_id") == 1).collect()}
    assert got[6].n_tokens == 2 and got[6].score < -100 and got[1].n_tokens == 300_001
    t = time.time()
    found = {r.doc_id: r for r in pii.spans(docs, "text").collect()}
    assert time.time() - t < 120 and found[3].base == [] and found[5].base == []


def test_pages_with_very_many_open_tags(spark):
    t = time.time()
    rows = [(1, "u", "<article><p>" + "<b>word " * 100_000), (2, "u", "<div class=ad>" * 100_000 + "text"), (3, "u", "<body class='page with-sidebar'><main class=has-related><p>One two three.</p></main><p class=ad>Buy now</p></body>"), (4, "u", "<p>" + "y" * 60 + "<" + "z" * 200 + ">some words here</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(clash() | {"text": F.lit("old")})
    got = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    assert time.time() - t < 60 and got[1].count("word") == 100_000 and got[2] == "" and got[3] == "One two three." and "some words here" in got[4]


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(i, f"word{i % 3} and more words " * (1 + i % 4), "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    more = docs.withColumns(clash())
    assert sorted(map(tuple, packing.pack(more, tokenizer_file(), capacity=32).drop("sequence_id", "offset").collect())) == sorted(map(tuple, packing.pack(docs, tokenizer_file(), capacity=32).drop("sequence_id", "offset").collect()))
    own = mixing.mixed(more, F.array("source"))
    assert own.columns == more.columns and own.count() == mixing.mixed(docs, F.array("source")).count()
    assert pii.redact(more).columns == more.columns and sorted(map(tuple, jaccard.link(more).collect())) == sorted(map(tuple, jaccard.link(docs).collect()))


def test_searches_of_long_and_odd_vectors(spark):
    draw = random.Random(3)
    rows = [(i, [draw.choice([-1.0, 0.0, 0.5]) for _ in range(3000)]) for i in range(30)] + [(100 + i, [1.0, float(i)]) for i in range(4)] + [(200, []), (220, [0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(clash())
    got = ball_tree.top_k(vectors, F.col("vec_id") % 20 == 0, k=3, shard_rows=7, block_rows=2, leaf_rows=2).collect()
    whole = {i: [int(64 * x // 1) for x in v] for i, v in rows}
    want = []
    for q in (0, 20, 100, 220):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:3]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    near = vp_tree.nearest(vectors, F.col("vec_id") % 20 == 0, k=3, factor=1.0, shard_rows=7, leaf_rows=2).collect()
    assert {(r.query_id, r.vec_id) for r in near if r.query_id == 100} == {(100, 101), (100, 102), (100, 103)} and not any(r.query_id in (200, 220) for r in near)


def test_factor_is_tuned_on_clusters(spark):
    import numpy as np

    draw = np.random.default_rng(4)
    centres = draw.normal(size=(40, 16))
    x = centres[draw.integers(0, 40, 3000)] + 0.3 * draw.normal(size=(3000, 16))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in vp_tree.nearest(vectors, F.col("vec_id") % 20 == 0, shard_rows=500, leaf_rows=32).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    asked = np.arange(0, 3000, 20)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    true = np.argsort(-score, axis=1)[:, :20]
    assert np.mean([len(set(t) & got[q]) / 20 for q, t in zip(asked.tolist(), true.tolist(), strict=True)]) >= 0.9
    reach = float(np.sqrt((x**2).sum(axis=1).max()))
    recall, leaves = vp_tree.recall_and_leaves(x, asked, 1.25, reach, 20, 32)
    assert vp_tree.recall_and_leaves(x, asked, 1.0, reach, 20, 32)[0] == 1.0 and leaves < 0.55 and recall > 0.95
