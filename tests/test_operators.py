"""Operators that SQL doesn't cover, on planted rows."""

import uuid

import pytest
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import catalogue, changes, dataset, graph, retrieval
from quire.plans import caps
from quire.sources.library import Library
from quire.streaming import jobs


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_uuid5_as_python(spark):
    names = ["", "chunk:0", "Itô é"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.uuid5(str(uuid.NAMESPACE_URL), "n")).collect()
    assert {r[0]: r[1] for r in got} == {n: str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names}


def test_texts(spark):
    row = spark.createDataFrame([("a ```` b", "exam-", "ple", "co­ op​er", None)], "f string, a string, b string, w string, z string")
    got = row.select(text.fence("f"), text.joined_cut(F.col("a"), F.col("b")), text.words("w"), text.normalised("z"), text.cost_text(F.lit(0.001)), text.page_text(F.lit(3), F.lit(5))).first()
    assert tuple(got) == ("`````", "example", ["cooper"], None, "under $0.01", "3 to 5")


def shortest(relations, a, b, spark):
    concepts = spark.range(8).withColumnRenamed("id", "concept_id")
    rel = spark.createDataFrame([(x, y, "ASSUMES", None) for x, y in relations], "from_id long, to_id long, type string, item_id long")
    return [[(e.from_id, e.to_id) for e in r.path] for r in graph.shortest_path(Library(None, None, concepts, None, rel), a, b).collect()]


def test_shortest_path_takes_the_least_of_equal_ones_in_any_direction(spark):
    edges = [(0, 2), (2, 3), (1, 0), (1, 3), (3, 4), (4, 5), (5, 6), (6, 7)]
    # Each relation keeps its own direction, and of equal ways the one whose list of relations is least counts.
    assert shortest(edges, 0, 3, spark) == [[(0, 2), (2, 3)]]
    assert shortest(edges, 3, 0, spark) == [[(1, 3), (1, 0)]]
    assert shortest(edges, 0, 5, spark) == [[(0, 2), (2, 3), (3, 4), (4, 5)]]
    assert shortest(edges, 0, 7, spark) == []
    with pytest.raises(ValueError):
        shortest(edges, 3, 3, spark)


def packed(paragraphs, tokens):
    out, chunk, chars = [], 0, -1
    for p in paragraphs:
        joined = chars + 2 + len(p)
        if chars >= 0 and -(-joined // 4) <= tokens:
            chars = joined
        else:
            chunk += chars >= 0
            chars = len(p)
        out.append(chunk)
    return out


def test_packed_paragraphs_as_a_loop(spark):
    lists = [[], ["a" * 30], ["a" * 10, "b" * 9, "c" * 50, "", "d"], ["x"] * 20]
    rows = spark.createDataFrame(list(enumerate(lists)), "i int, p array<string>")
    got = rows.select("i", dataset.packed_paragraphs("p", 6).alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == [packed(p, 6) for p in lists]


def test_upserts_and_additions(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k long, v string")
    assert values(changes.upsert(old, new, "k")) == [(1, "a"), (2, "B"), (3, "C")]
    assert values(changes.insert_absent(old, new, "k")) == [(1, "a"), (2, "b"), (3, "C")]


def test_mentions_and_relations(spark):
    items, concepts = (spark.createDataFrame([(1,), (2,)], f"{c} long") for c in ("item_id", "concept_id"))
    old = spark.createDataFrame([(1, 1, "old"), (2, 2, "stays")], "item_id long, concept_id long, wording string")
    new = spark.createDataFrame([(1, 1, "x", 1), (1, 1, "y", 2), (9, 1, "no item", 3)], "item_id long, concept_id long, wording string, seq int")
    assert values(changes.add_mentions(old, new, items, concepts)) == [(1, 1, "y"), (2, 2, "stays")]
    rel = spark.createDataFrame([(1, 2, "ASSUMES", 5)], "from_id long, to_id long, type string, item_id long")
    more = spark.createDataFrame([(1, 2, "ASSUMES", 6, 1), (2, 1, "ASSUMES", 8, 3), (2, 1, "ASSUMES", 7, 2)], "from_id long, to_id long, type string, item_id long, seq int")
    assert values(changes.add_relations(rel, more)) == [(1, 2, "ASSUMES", 5), (2, 1, "ASSUMES", 7)]


def test_aliases(spark):
    old = spark.createDataFrame([(1, "name", ["a"]), (2, "other", [])], "concept_id long, normalised_name string, aliases array<string>")
    new = spark.createDataFrame([(1, "name", 1), (1, "c", 3), (1, "b", 2), (1, "a", 4)], "concept_id long, alias string, seq int")
    assert values(changes.add_aliases(old, new)) == [(1, "name", ["a", "b", "c"]), (2, "other", [])]


def test_agreement_needs_more_than_half(spark):
    tries = [(1, 1, "0.5"), (1, 2, "$ 0.5004"), (1, 3, "7"), (2, 1, "a"), (2, 2, "b"), (3, 1, " X y"), (3, 2, "xy"), (3, 3, "xy")]
    got = values(dataset.agreement(spark.createDataFrame(tries, "question int, try int, value string")))
    assert got == [(3, 2, 3)]


def test_text_cap_as_a_loop(spark):
    kinds, rows = ("a", "b"), [(i, i, i * 7 % 5 + 1, i % 3, i % 2 + 1) for i in range(1, 30)]
    plan = spark.createDataFrame(rows, "section long, place int, passages int, a int, b int")
    for most in (0, 1, 12, 57, 100, 10_000):
        left, want = most, []
        for at, kind in enumerate(kinds):
            for r in rows:
                rounds = min(r[3 + at], left // r[2])
                left -= rounds * r[2]
                want.append((r[0], kind, rounds))
        assert values(caps.cap_texts(plan, kinds, most)) == sorted(want)


def test_cited_and_claims(spark):
    items = spark.createDataFrame([(1, 7, None, ["figure 1", "table 9"]), (2, 7, "figure 1", []), (3, 8, "figure 1", [])], "item_id long, doc_id long, label string, cites array<string>")
    kept = spark.createDataFrame([(1, 1)], "item_id long, place int")
    assert values(retrieval.cited(items, kept)) == [(2, "figure 1", 1)]
    claims = spark.createDataFrame([(1, [2, 2, 1]), (2, []), (3, [4])], "claim_id int, sources array<int>")
    assert sorted(retrieval.claim_faults(claims, 3).collect()) == [(1, [2, 1], None), (2, [], "no source"), (3, [4], "unknown source")]


def test_cost_is_unknown_without_a_price(spark):
    tally = spark.createDataFrame([("m", 1000, 0, None), ("n", 1, 1, None)], "model string, input long, output long, reported double")
    price = spark.createDataFrame([("m", 2.0, 1.0)], "model string, in_price double, out_price double")
    assert values(catalogue.usage_cost(tally, price)) == [(2, None)]
    assert values(catalogue.usage_cost(tally.where("model = 'm'"), price)) == [(1, 0.002)]
    assert values(catalogue.usage_cost(tally.limit(0), price)) == [(0, 0.0)]


def test_stream_of_job_events(spark, tmp_path):
    rows = spark.sql("SELECT 1L AS event_id, 5L AS job_id, 'a' AS stage, 0.5D AS share, timestamp'2025-01-01 00:00:00' AS ts, 'm' AS model, 10L AS tokens UNION ALL SELECT 2, 5, 'b', 0.1D, timestamp'2025-01-01 00:10:00', 'm', 5")
    rows.write.parquet(str(tmp_path / "in"))
    for name, f in (("latest", jobs.latest), ("spending", jobs.spending)):
        stream = f(jobs.events(spark, str(tmp_path / "in"), rows.schema))
        stream.writeStream.format("memory").queryName(f"q_{name}").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.table("q_latest").collect()] == [(5, 2, "b", 0.1)]
    assert [(r.model, r.tokens) for r in spark.table("q_spending").collect()] == [("m", 15)]


def test_the_shortest_try_is_kept(spark):
    from quire.operators import dataset

    rows = [(1, 1, "4.0", 30), (1, 2, " 4 $", 20), (1, 3, "4", 20), (1, 4, "5", 1), (2, 1, "a", 1), (2, 2, "b", 1), (3, 1, None, 1), (3, 2, "x", 9), (3, 3, "X", 9), (4, 1, "inf", 5), (4, 2, "7", 6)]
    got = dataset.agreement(spark.createDataFrame(rows, "question int, try int, value string, length int"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2, 3), (3, 2, 2), (4, 1, 2)]


def test_nearest_concept_is_the_same_on_both_sides_of_its_limit(spark, monkeypatch):
    from quire.operators import vectors

    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [0.6, 0.8]), (6, [None, 1.0])]
    own = spark.createDataFrame(rows, "item_id long, vector array<double>")
    concepts = spark.createDataFrame([(7, [0.0, 1.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0]), (10, [0.0, 0.0]), (11, None), (12, [3.0])], "concept_id long, vector array<double>")
    found = []
    for limit in (64_000_000, 0):
        monkeypatch.setattr(vectors, "CONCEPT_BYTES", limit)
        found.append(sorted(tuple(r) for r in vectors.nearest_concept(own, concepts).collect()))
    assert found[0] == found[1] == [(1, 8, 1.0), (5, 7, 0.8)]
