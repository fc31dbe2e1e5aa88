"""Merkle trees, proofs and folds against plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quire.llm import merkle, queries
from quire.sources import table

DOCS = "doc_id long, source string, lang string, n_chars int, text string, tree string, index int, key string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return digest(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def sides(tree, i):
    for own in tree[:-1]:
        first = i - i % 3
        yield own[first:i], own[i + 1 : first + 3]
        i //= 3


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    trees = {s: levels([leaf(*r) for r in by[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    for k, s in enumerate(sources):
        for i, (doc_id, source, lang, n_chars, text) in enumerate(by[s]):
            steps = [*sides(trees[s], i), *sides(top, k)]
            changed = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
            x = leaf(doc_id, source, lang, n_chars, text.replace("\n", "") if changed and text else text)
            for left, right in steps:
                x = digest(*left, x, *right)
            proof = digest(*(d for left, right in steps for d in left + right))
            yield doc_id, trees[s][0][i], trees[s][-1][0], top[-1][0], proof, x, x == top[-1][0]


def in_order(rows):
    return sorted(rows, key=lambda r: tuple("" if x is None else str(x) for x in r))


def proved(df):
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    made = merkle.manifest(df, claimed=merkle.leaf([*(F.col(c) for c in merkle.FIELDS[:-1]), text]))
    return made, merkle.proofs(made)


@pytest.mark.parametrize("n", [0, 1, 4, 2000])
def test_odd_rows(spark, n):
    """Nulls in any field, repeated ids and rows, one leaf alone, an empty table, clashing columns, a tree of two tiers."""
    draw = random.Random(n)
    rows = [(draw.choice([None, *range(n)]), draw.choice([None, *"aaaaaaaaa", "é", "B", ""]), draw.choice([None, "en"]), draw.choice([None, 3]), draw.choice([None, "", "x\ny", "é\n" * 50])) for _ in range(n)]
    made, got = proved(spark.createDataFrame([(*r, "t", 1, "k") for r in rows], DOCS))
    assert in_order(tuple(r) for r in got.collect()) == in_order(brute(rows))
    if n == 2000:
        assert len(made.tiers) == 2
        heights = {r.level for r in made.tiers[0].nodes().select("level").distinct().collect()}
        assert heights == set(range(merkle.LEVELS))
    assert [r.root for r in made.root().collect()] == sorted({r[3] for r in brute(rows)})


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op11_merkle_manifest(spark, sf)
    assert dict(got.dtypes) == {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"}
    rows = [tuple(r) for r in table(spark, sf, "documents").select(*merkle.FIELDS).collect()]
    assert in_order(tuple(r) for r in got.collect()) == in_order(brute(rows))


def test_no_node_is_asked_for_by_many(spark):
    """One source of all rows: a node is asked for by the leaves of one block only, whatever the tree's size."""
    df = spark.range(5000).selectExpr("id AS doc_id", "'s' AS source", "'en' AS lang", "1 AS n_chars", "'x' AS text")
    units = merkle.manifest(df).tiers[0].units
    asked = units.select(F.expr(f"explode({merkle.COORDINATES}) AS c")).groupBy("c").count().agg(F.max("count")).head()[0]
    assert asked <= 2 * 3 ** (merkle.LEVELS - 1)
