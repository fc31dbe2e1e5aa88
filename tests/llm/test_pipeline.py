"""The pipeline's stages against plain Python, on a small table with the rows that break things."""

import math
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import mixing, quality
from quire.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(11)
    words = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(120):
        text = " ".join(draw.choice(words) for _ in range(draw.randrange(6, 60))) if i % 3 else " ".join("$$$ buy now !!!".split()[k % 4] for k in range(draw.randrange(6, 60)))
        rows.append((i, text, draw.choice(["en", None]), draw.choice(["a", "a", "a", "b", None]), len(text)))
    rows += [(200 + k, rows[1][1], "en", "a", 1) for k in range(5)]  # copies
    rows += [(300, None, None, None, None), (301, "", "en", "b", 0), (302, "word " * 20_000, "de", "b", 100_000)]
    rows += [(303, "mail me@example.org or call +49 170 1234567 now please friends", "en", "a", 0), (304, "api_key = " + "Ab0" * 120 + " was the value that leaked yesterday", "en", "b", 0)]
    rows += [(305, "same id other text one two three", "en", "a", 0), (305, "another text of the same id entirely here", "en", "a", 0), (None, "a row without any id in it at all", "en", "b", 0)]
    top = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(top / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(120)], "doc_id long, quality int").write.parquet(str(top / "labels.parquet"))
    return str(top)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_are_those_of_the_contract():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mixing", "packing"]


def test_quality_drops_what_scores_low(spark, docs, folder):
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"), quality.learned())
    want = [tuple(r[:-1]) for r in quality.score(docs, model, score_column="of").collect() if r["of"] >= 0.3]
    got = corpus_pipeline.good_documents(spark, docs, folder)
    assert got.columns == docs.columns and plain(got) == sorted(want, key=repr)
    kept = {r.doc_id for r in got.collect()}
    assert not any(i in kept for i in range(0, 120, 3)) and all(i in kept for i in range(120) if i % 3)


def test_one_of_each_group_stays(spark, docs, folder):
    from test_jaccard import brute

    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in (None, 305)]
    heads = {i for i, _, c in brute(rows) if i == c}
    got = corpus_pipeline.one_of_each_group(spark, docs, folder)
    ids = [r.doc_id for r in got.collect()]
    assert got.columns == docs.columns and sorted(i for i in ids if i not in (None, 305)) == sorted(heads)
    # Rows that share an id but not the text are documents of their own, and so is a row without an id.
    assert ids.count(305) == 2 and ids.count(None) == 1


def test_personal_data_is_masked(spark, docs, folder):
    got = {r.doc_id: r for r in corpus_pipeline.without_personal_data(spark, docs.where("doc_id IS NOT NULL AND doc_id <> 305"), folder).collect()}
    before = {r.doc_id: r for r in docs.collect()}
    assert got[303].text == "mail [EMAIL] or call [PHONE] now please friends" and got[303].n_chars == len(got[303].text)
    assert "Ab0Ab0" not in got[304].text and got[304].text.startswith("api_key = [SECRET]")
    assert got[300].text is None and got[301].text == ""
    for i in (k for k in got if k not in (300, 303, 304)):
        assert got[i].text == before[i].text


def test_mix_takes_each_as_often_as_planned(spark, docs, folder):
    own = docs.where("doc_id IS NOT NULL")
    copies = {}
    for r in mixing.mix(own, F.array("source"))[0].collect():
        copies.setdefault((r.doc_id, r.size), []).append(r.copies)
    got = corpus_pipeline.to_target_weights(spark, own, folder)
    seen = {}
    for r in got.collect():
        key = (r.doc_id, len((r.text or "").split()))
        seen[key] = seen.get(key, 0) + 1
    assert got.columns == docs.columns and seen == {k: sum(v) for k, v in copies.items() if sum(v)}


def test_packed_sequences_are_full_and_gapless(spark, docs, folder):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    rows = corpus_pipeline.packed(spark, docs, folder).collect()
    lengths = sorted(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    whole = {}
    for r in rows:
        whole.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in whole.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 4096
    assert sum(r.length for r in rows) == sum(lengths)
    assert len(whole) <= math.ceil(1.3 * sum(lengths) / 4096)


def test_whole_run_and_an_empty_table(spark, docs, folder, tmp_path):
    got = corpus_pipeline.run(spark, folder)
    ids = {r.doc_id for r in got.collect()}
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(got.columns) and ids <= {r.doc_id for r in docs.collect()}
    assert not ids & {200, 201, 202, 203, 204}
    for name, columns in (("documents", SCHEMA), ("labels", "doc_id long, quality int")):
        spark.createDataFrame([], columns).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_other_columns_pass_through(spark, docs, folder):
    more = docs.withColumns({"score": F.lit(1), "copies": F.lit(2), "size": F.lit("x"), "base": F.lit("y"), "row": F.lit(3), "component_id": F.lit(4)})
    for stage in (corpus_pipeline.good_documents, corpus_pipeline.one_of_each_group, corpus_pipeline.without_personal_data, corpus_pipeline.to_target_weights):
        assert stage(spark, more, folder).columns == more.columns
