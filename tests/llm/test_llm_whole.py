"""The training-data operators do their whole job on rows that the small tables don't hold."""

from quire.llm import pii, queries


def test_long_secrets_and_names_are_spanned_to_their_end(spark):
    token, name = "eyJ" + "Ab0_.-" * 3000, "Dr. " + "Xy" + "z" * 40 + " Ü" + "é" * 30
    rows = [(1, f"token={token} end"), (2, f"by {name}, signed"), (3, "secret: " + "a" * 7)]
    got = pii.spans(spark.createDataFrame(rows, "doc_id long, text string"), "text").collect()
    found = {r.doc_id: [(r.text[s.start : s.stop], s.kind) for s in r.candidates if s.kind in ("secret", "name")] for r in got}
    assert found == {1: [(token, "secret")], 2: [(name, "name")], 3: []}


def test_documents_without_a_language_are_trained_on(spark):
    known = spark.createDataFrame([(1, "en", 1), (2, None, 1), (3, "de", 0), (4, None, None)], "doc_id long, lang string, toxic int")
    got = queries.toxic_by_language(known, ("en", "de")).select("doc_id", "toxic_en", "toxic_de", "toxic")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 0, 1), (2, 0, 0, 1), (3, 0, 0, 0), (4, None, None, None)]
