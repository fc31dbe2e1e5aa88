"""What holds for tables larger than the small ones: keys beyond those of sf0.1, and what is sent, shuffled or kept."""

import random

import duckdb
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from quire import registry
from quire.operators import cutting, dataset, resolving
from tests.test_queries import SF, TABLES, rows
from tests.test_resolving import one_by_one, plain, same


@pytest.fixture(scope="module")
def far_keys(tmp_path_factory):
    """The small tables with half of the orders behind a million."""
    folder = tmp_path_factory.mktemp("far")
    con = duckdb.connect()
    moved = {"orders": "o_orderkey", "lineitem": "l_orderkey"}
    for t in TABLES:
        key = moved.get(t)
        own = f"* REPLACE (CASE WHEN {key} % 4 < 2 THEN {key} + 1000000 ELSE {key} END AS {key})" if key else "*"
        con.execute(f"COPY (SELECT {own} FROM '{SF}/{t}.parquet') TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


def test_rejected_mentions_of_far_keys(spark, far_keys):
    folder, con = far_keys
    df = registry.QUERIES["rejected_mentions"](spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(registry.ORACLE_SQL["rejected_mentions"])
    assert got == rows([d[0] for d in cursor.description], cursor.fetchall())


def test_vectors_of_a_batch_stay_off_the_driver(spark, monkeypatch):
    """In several runs and blocks, a batch goes as one by one, and no vectors of names are collected."""
    draw = random.Random(3)
    vector = lambda: [round(draw.gauss(0, 1), 3) for _ in range(3)]
    concepts = [(100 + k, f"Concept {k}", vector()) for k in range(2)]
    names = [(i, draw.choice([f"name {i}", f"Name-{i // 3}"]), vector()) for i in range(90)]
    monkeypatch.setattr(resolving, "RUN", 25, raising=False)
    monkeypatch.setattr(resolving.near_pairs, "__defaults__", (16,))
    sent, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: sent.append((df.columns, collect(df))) or sent[-1][1])
    got = resolving.resolve(
        spark.createDataFrame(names, "name_id long, name string, vector array<double>"), spark.createDataFrame(concepts, "concept_id long, name string, vector array<double>"),
        spark.createDataFrame([], "concept_id long, alias string"), same, 0.97, 0.8,
    )
    assert [(c, len(r)) for c, r in sent if "vector" in c and len(r) > len(concepts)] == []
    found = collect(got)
    assert plain((r.name_id, r.concept, r.rule, r.score) for r in found) == plain(one_by_one(names, concepts, [], 0.97, 0.8))


def test_word_match_shuffles_no_row_for_each_word(spark):
    """Bags of words go as one string each; repeated, absent and empty texts count as before."""
    texts = spark.createDataFrame([(1, "A b, b c"), (2, "b B b a­ d"), (3, None), (4, " .. "), (5, "c"), (5, "c b")], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 1, 2), (2, 2, 1), (3, 3, 4), (4, 4, 5), (5, 5, 1), (6, 9, 1)], "id long, a long, b long")
    got = dataset.word_match(texts, pairs)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = [(1, 0.5, 0.5), (2, 0.5, 0.5), (3, 1.0, 1.0), (4, 0.0, 0.0), (5, 0.667, 0.5), (6, 0.0, 0.0)]
    assert sorted(map(tuple, got.collect())) == want


def test_a_cut_calls_python_for_batches_and_records_make_blocks_once(spark):
    rows = [(d, k, [1], 50, False, False) for d in range(3) for k in range(4)]
    cut = cutting.cut(spark.createDataFrame(rows, "doc_id long, position int, path array<int>, tokens long, with_next boolean, lone_note boolean"), 100, 10)
    assert "FlatMapGroups" not in cut._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.doc_id, r.section, r.part, r.place, r.position) for r in cut.collect()) == sorted((d, 0, k // 2, k % 2, k) for d in range(3) for k in range(4))
    records = registry.QUERIES["section_records"](spark, SF)
    plan = records._jdf.queryExecution().optimizedPlan().toString()
    assert "InArrow" not in plan and "orders" not in plan


def test_draft_ids_make_mentions_once(spark):
    plan = registry.QUERIES["draft_ids"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(c in plan for c in ("l_orderkey", "o_orderkey", "InArrow"))
