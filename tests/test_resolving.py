"""Resolution of a batch of names against a loop that takes them one by one."""

import random

import numpy as np
from pyspark.sql import functions as F

from quire.operators import resolving


def one_by_one(names, concepts, aliases, link, create):
    form = lambda s: " ".join("".join(c if c.isalnum() else " " for c in s.lower()).split())
    known = {}
    for c, name in sorted([(c, n) for c, n, _ in concepts] + aliases):
        known.setdefault(form(name), str(c))
    there = [(str(c), np.array(v, float)) for c, _, v in concepts]
    out = []
    for i, name, v in sorted(names):
        if form(name) in known:
            out.append((i, known[form(name)], "exact", None))
            continue
        v = np.array(v, float)
        score = best = None
        for c, w in there:
            s = round(float(v @ w / np.sqrt((v @ v) * (w @ w))), 6)
            if score is None or s > score:
                score, best = s, c
        if score is not None and score >= link:
            rule = "link"
        elif score is None or score < create:
            rule = "create"
        else:
            rule = "same" if (i + len(best)) % 2 else "different"
        concept = f"new {i}" if rule in ("create", "different") else best
        if concept == f"new {i}":
            there.append((concept, v))
        known[form(name)] = concept
        out.append((i, concept, rule, score))
    return out


def same(name_id, concept):
    return (name_id + F.length(concept)) % 2 == 1


def resolved(spark, names, concepts, aliases, link, create):
    dfs = [spark.createDataFrame(r, s) for r, s in ((names, "name_id long, name string, vector array<double>"), (concepts, "concept_id long, name string, vector array<double>"), (aliases, "concept_id long, alias string"))]
    got = resolving.resolve(*dfs, same, link, create).collect()
    # Scores below `create` of stored concepts count alike: a name then makes a concept whatever is nearest.
    return sorted((r.name_id, r.concept, r.rule, r.score if r.rule in ("link", "same", "different") else None) for r in got)


def plain(rows):
    return sorted((i, c, r, s if r in ("link", "same", "different") else None) for i, c, r, s in rows)


def test_drawn_batches(spark, monkeypatch):
    monkeypatch.setattr(resolving.near_pairs, "__defaults__", (16,))
    draw = random.Random(8)
    for stored in (0, 3):
        vector = lambda: [round(draw.gauss(0, 1), 3) for _ in range(3)]
        concepts = [(100 + k, f"Concept {k}", vector()) for k in range(stored)]
        aliases = [(100, "Black-Scholes")] if stored else []
        names = [(i, draw.choice([f"name {i}", f"Name-{i // 2}", "concept 1", "black scholes"]), vector()) for i in range(60)]
        assert resolved(spark, names, concepts, aliases, 0.97, 0.8) == plain(one_by_one(names, concepts, aliases, 0.97, 0.8))


def test_a_chain_of_names(spark):
    """Each is near the one before only; every other one makes a concept."""
    angle = [0.3 * k for k in range(12)]
    names = [(k, f"n{k}", [float(np.cos(a)), float(np.sin(a))]) for k, a in enumerate(angle)]
    want = one_by_one(names, [], [], 0.95, 0.9)
    assert [r for _, _, r, _ in want] == ["create", "link"] * 6
    assert resolved(spark, names, [], [], 0.95, 0.9) == plain(want)
