"""The audit of sources against plain Python, tries against dictionaries."""

import random
import re
from collections import Counter

import pytest

from quire.llm import divergence, queries
from quire.sources import table

DOCS = "doc_id long, text string, lang string, source string, term string, value long, prefix string"


def brute(rows, least=10, best=10):
    docs, counts, groups = {}, {}, set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for term, n in Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)).items():
            docs[lang, term] = docs.get((lang, term), 0) + 1
            counts.setdefault((lang, source), Counter())[term] += n
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), n in docs.items() if x == lang and n >= least)
        own = {s: counts.get((lang, s), Counter()) for x, s in groups if x == lang}
        own |= {None: sum((own[s] for s in list(own)), Counter())}
        whole = {s: sum(c[t] for t in kept) + 2 * len(kept) for s, c in own.items()}
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // whole[s] for t in kept} for s, c in own.items()}
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in own.keys() - {None}:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own.keys() - {None, s}]
            term = [(-f(p[s][t], p[None][t]), t) for t in kept if own[s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pair, None), ("term", term, best)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode()))[:most], 1):
                    yield lang, s, part, item, -value, rank


@pytest.mark.parametrize("n", [0, 1, 9, 600])
def test_odd_rows(spark, n, monkeypatch):
    """Nulls, empty texts, terms beyond ASCII, prefixes of terms, ties, sources without terms, more sources than a pass
    takes, tries that are written before a task ends."""
    draw = random.Random(n)
    words = ["a", "ab", "abc", "abd", "É", "éa", "日本", "日", "x9y", "THE", "the", "\U0001f600z", "z" * 300, "K", "İ"]
    rows = [(draw.choice([None, "", " ".join(draw.choices(words, k=draw.randrange(30)))]), draw.choice(["en", "en", None, "de"]), draw.choice([None, "", "é", *"abcdefgh"])) for _ in range(n)]
    df = spark.createDataFrame([(1, *r, "t", 1, "p") for r in rows], DOCS)
    plain, want = divergence.counted, sorted(brute(rows))
    assert sorted(tuple(r) for r in divergence.audit(df).collect()) == want
    monkeypatch.setattr(divergence, "counted", lambda docs: plain(docs, depth=1, most=3))
    assert sorted(tuple(r) for r in divergence.audit(df, block=4).collect()) == want


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op12_source_divergence_audit(spark, sf)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    rows = [tuple(r) for r in table(spark, sf, "documents").select("text", "lang", "source").collect()]
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute(rows))


def test_tries_merge_and_walk_as_sorted_dictionaries():
    draw = random.Random(5)
    whole, want = divergence.Trie(), {}
    number = {}
    for task in range(5):
        trie, names = divergence.Trie(), [f"s{task}", "s"]
        for _ in range(400):
            term = bytes(draw.choices(b"ab\xc3", k=draw.randrange(1, 12)))
            leaf, k = trie.leaf(term), draw.randrange(2)
            leaf[k] = leaf.get(k, 0) + 1
            leaf[-1] = leaf.get(-1, 0) + 1
            own = want.setdefault(term, Counter())
            own[names[k]] += 1
            own[None] += 1
        parts = list(trie.parts(names, 2))
        assert [p for p, _ in parts] == sorted({t[:2] for _, t, _ in trie.walk()})
        for _, part in parts:
            whole.merge(part, number)
    names = {k: s for s, k in number.items()} | {-1: None}
    assert [(t, {names[k]: n for k, n in leaf.items()}) for _, t, leaf in whole.walk()] == sorted((t, dict(c)) for t, c in want.items())


def test_shares_of_large_counts_are_exact():
    import numpy as np

    draw = random.Random(1)
    for _ in range(200):
        whole = draw.randrange(1, 2**52)
        count = draw.randrange(whole + 1)
        assert divergence.shares(np.array([count]), np.array([whole])).tolist() == [1 + 10**9 * count // whole]
