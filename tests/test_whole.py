"""Library operators do their whole job: against brute force where their SQL can't tell."""

import hashlib
import os

import numpy as np
from pyspark.sql import functions as F

from quire import registry
from quire.operators import dataset, passages
from quire.plans import caps
from quire.sources import table
from quire.sources.library import library

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def first_copies(rows):
    first, out = {}, []
    for i, text in sorted(rows):
        sha = None if text is None else hashlib.sha256(text.split("\n\n", 1)[-1].encode()).hexdigest()
        out.append((i, first[sha] if sha in first else None))
        first.setdefault(sha, i)
    return sorted(out, key=repr)


def test_duplicates_are_compared_after_the_first_blank_line(spark):
    texts = ["one", "two", "h\nsame", "g\nsame", "h\n\nsame\n\nx", "other\n\nsame\n\nx", "one", "a\n\n\nb", "c\n\n\nb", "a\n\nb", "", "\n\n", None, None, "é\n\nü"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert values(dataset.duplicates(docs)) == first_copies(enumerate(texts))
    scores = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, score int")
    # The first copy fails the first gate, so the second is kept.
    got = dict(values(dataset.verdicts(docs, scores)))
    assert (got[0], got[6], got[5], got[1]) == ("page-score", None, "duplicate", None)


def test_exact_dedup_of_the_table_as_a_loop(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    got = values(registry.QUERIES["exact_dedup"](spark, SF))
    assert got == first_copies(tuple(r) for r in docs.collect())
    assert sum(d is not None for _, d in got) < docs.count() / 10


def id_hash(section):
    return int.from_bytes(hashlib.sha256(str(section).encode()).digest()[:8], "big")


def turns(n):
    return {k: n // 3 + (t < n % 3) for t, k in enumerate(dataset.REPHRASED)}


PICKED = [i for i in range(400) if id_hash(i) % 20 == 0]
FACTORS = [(i, i % 10 == 0, (0.5, 1.0, 1.5, 3.0)[i % 4]) for i in range(400)]
SEEDS = [(i, i + 1, i + 2 + p, "ASSUMES", p) for i in range(400) if i % 10 for p in range(1, i % 13)]
PASSAGES = [(i, i % 3 + 1, i % 2 == 0, []) for i in range(0, 400) if i % 7]


def plan_of(spark):
    factors = spark.createDataFrame(FACTORS, "section long, heldout boolean, factor double")
    seeds = spark.createDataFrame(SEEDS, "section long, from_id long, to_id long, type string, place int")
    cut = spark.createDataFrame(PASSAGES, "section long, passages long, formula boolean, bodies array<string>")
    return dataset.section_plan(factors, seeds, cut), seeds


def plan_as_loop():
    cut, out = {p[0]: p for p in PASSAGES}, []
    for i, heldout, factor in FACTORS:
        n = 0 if heldout else int(3 * factor + 0.5)
        _, own, formula, _ = cut.get(i, (i, 1, False, []))
        row = {"section": i, "heldout": heldout, "factor": factor, "passages": own, **turns(n), "entigraph": min(n, sum(s[0] == i for s in SEEDS))}
        row |= {"notation_variant": int(not heldout and formula and i in PICKED), "exercise": int(not heldout and factor >= 1)}
        out.append(row | {"questions": 2 if heldout else int(2 * factor + 0.5)})
    return out


def size(row, kind):
    return row[kind] * (1 if kind == "entigraph" else row["passages"])


def test_plan_totals_and_drafts_of_all_kinds_and_passages(spark):
    plan, seeds = plan_of(spark)
    want = plan_as_loop()
    assert sorted((r.asDict() for r in plan.collect()), key=lambda r: r["section"]) == want
    total = {k: sum(size(r, k) for r in want) for k in dataset.KINDS}
    questions = sum(r["questions"] for r in want)
    assert min(total.values()) > 0
    assert dataset.plan_totals(plan).first().asDict() == total | {"questions": questions, "model_calls": 2 * sum(total.values()) + 6 * questions}
    got = dataset.drafts(plan, seeds.withColumn("passage", F.lit(1).cast("long"))).collect()
    drafts = []
    for r in want:
        own = [(k, p, v, (p - 1) * r[k] + v, None) for k in dataset.KINDS if k != "entigraph" for p in range(1, r["passages"] + 1) for v in range(1, r[k] + 1)]
        own += [("entigraph", 1, 1, s[4], s[2]) for s in SEEDS if s[0] == r["section"] and s[4] <= r["entigraph"]]
        drafts += [(r["section"], *d, f"{r['section']}:{d[0]}:{d[3]}", n) for n, d in enumerate(own, 1)]
    assert sorted(((r.section, r.kind, r.passage, r.version, r.number, r.to_id, r.id, r.draft) for r in got), key=lambda d: (d[0], d[-1])) == drafts


def test_texts_are_kept_section_by_section(spark):
    plan, _ = plan_of(spark)
    plan = plan.cache()
    rows = sorted((r for r in plan_as_loop() if not r["heldout"]), key=lambda r: (-r["factor"], id_hash(r["section"])))
    for most in (0, 1, 40, 1111, 100_000):
        left, want = most, []
        for r in rows:
            keep = min(left, sum(size(r, k) for k in dataset.KINDS))
            n = min(sum(r[k] for k in dataset.REPHRASED), keep // r["passages"])
            out = turns(n)
            rest = keep - n * r["passages"]
            for k in ("entigraph", "exercise", "notation_variant"):
                one = 1 if k == "entigraph" else r["passages"]
                out[k] = min(r[k], rest // one)
                rest -= out[k] * one
            left -= keep - rest
            want += [(r["section"], k, out[k]) for k in dataset.KINDS]
        assert sorted(tuple(r) for r in caps.keep_texts(plan, most).collect()) == sorted(want)


def test_passages_keep_blocks_whole(spark):
    listing, formula = "```\na\n\nb\n```", "$$\na\n\n```\n$$"
    figure = "[Figure 1 — description (model-written): A line.\n\nIt rises.]"
    assert passages.paragraphs_of("\n\n".join(["# H", figure, "p", listing, formula, "end"])) == ["# H", figure, "p", listing, formula, "end"]
    long = "\n\n".join(["# H", *(f"{c} Word" + c * 5990 for c in "abcd")])
    texts = [(1, "x"), (2, long), (3, "y" * 20_000), (4, "a\n$$\nb\n$$"), (5, None)]
    got = passages.passages(spark.createDataFrame(texts, "section long, text string"))
    assert sorted((r.section, r.passages, r.formula, [b[5] for b in r.bodies]) for r in got.collect()) == [(1, 1, False, []), (2, 4, False, list("abcd")), (3, 1, False, []), (4, 1, True, []), (5, 1, False, [])]
    seeds = spark.createDataFrame([(2, 1, 2), (2, 3, 4), (2, 4, 4), (1, 1, 2)], "section long, from_id long, to_id long")
    concepts = spark.createDataFrame([(1, "B word"), (2, "word"), (3, "zz"), (4, "C WORD")], "concept_id long, name string")
    assert values(dataset.relation_passages(seeds, concepts, got)) == [(1, 1, 2, 1), (2, 1, 2, 2), (2, 3, 4, 3), (2, 4, 4, 3)]


def test_relations_of_training_items_seed_texts(spark):
    plan = registry.QUERIES["section_plan"](spark, SF).where("entigraph > 0")
    assert plan.count() > 0
    assert plan.where("heldout").count() == 0


def test_graph_reads_and_citations_take_whole_tables(spark):
    lib = library(spark, SF)
    chunks = {r.item_id for r in lib.item.where("kind = 'chunk'").collect()}
    mentions, relations = lib.mention.collect(), lib.relation.collect()
    named, ends = {m.concept_id for m in mentions}, {r.from_id for r in relations}
    assert values(registry.QUERIES["relations_among"](spark, SF)) == sorted((tuple(r) for r in relations if r.from_id in named and r.to_id in named), key=repr)
    assert values(registry.QUERIES["mentions_between"](spark, SF)) == sorted((tuple(m) for m in mentions if m.item_id in chunks and m.concept_id in ends), key=repr)
    items, cites = lib.item.collect(), {}
    for i in items:
        for label in i.cites if i.item_id in chunks else ():
            cites[i.doc_id, label] = min(i.item_id, cites.get((i.doc_id, label), i.item_id))
    want = [(i.item_id, i.label, cites[i.doc_id, i.label]) for i in items if i.item_id not in chunks and (i.doc_id, i.label) in cites]
    assert values(registry.QUERIES["cited_pull_in"](spark, SF)) == sorted(want, key=repr)


def test_all_vectors_are_ranked_and_resolved(spark):
    rows = table(spark, SF, "embeddings").select("vec_id", "label", "embedding").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    ranked = dict(values(registry.QUERIES["vector_rank"](spark, SF)))
    assert sorted(ranked) == sorted(ids)
    assert np.allclose([ranked[i] for i in ids], unit @ unit[ids.index(7)], atol=1e-6)
    labels = sorted({r.label for r in rows})
    means = np.array([x[[r.label == k for r in rows]].mean(axis=0) for k in labels])
    scores = unit @ (means / np.linalg.norm(means, axis=1, keepdims=True)).T
    got = {r.item_id: r for r in registry.QUERIES["concept_nearest"](spark, SF).collect()}
    assert sorted(got) == sorted(ids)
    assert np.allclose([got[i].score for i in ids], scores.max(axis=1), atol=1e-6)
    assert np.allclose([scores[n, labels.index(got[i].concept_id)] for n, i in enumerate(ids)], scores.max(axis=1), atol=2e-6)
    assert sorted(r.item_id for r in registry.QUERIES["resolve_rule"](spark, SF).collect()) == sorted(ids)
