"""Scans of planted chapter folders."""

import json

import pytest
from pyspark.sql import functions as F

from quire.operators import pieces, states
from quire.sources import chapters


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("content")

    def chapter(where, number, name, finished=True):
        (top / where).mkdir(parents=True)
        named = {"chapter": {"number": number, "name": name}} if number else {"title": name}
        (top / where / "chapter.json").write_text(json.dumps({"format-version": 1, "media-title": "A Book", "name": named, "source-file": "x.pdf", "source-sha256": where, "page-count": 2, "finished": finished}))

    def page(where, position, entries, ends=False):
        own = top / where / f"page-num-{position}"
        own.mkdir()
        listed = [{"number": n, "file": f"{n:02}-{kind}.md", "kind": kind, **more} for n, kind, more, _ in entries]
        (own / "page.json").write_text(json.dumps({"format-version": 1, "page-position": position, "printed-page-number": str(position), "starts-mid-sentence": position > 1, "ends-mid-sentence": ends, "pieces": listed, "relationships": []}))
        for n, kind, _, text in entries:
            (own / f"{n:02}-{kind}.md").write_text(text)

    chapter("book/ten", 10, "Tenth")
    chapter("book/two", 2, "Second")
    chapter("book/index", None, "Index", finished=False)
    page("book/two", 1, [(1, "heading", {"rank": 1}, "Top\n"), (2, "text", {"cites": [{"kind": "figure", "label": " 1 "}, {"kind": "footnote", "label": "a"}]}, "a text\n\n"), (3, "heading", {"rank": 2}, "Sub")], ends=True)
    page("book/two", 2, [(1, "text", {}, "goes on"), (1, "formula", {}, "x")])
    (top / "book" / "broken").mkdir()
    (top / "book" / "broken" / "chapter.json").write_text("{")
    (top / "book" / "two" / "insights.json").write_text('{"text": "t"}')
    for name, text in (("good", '{"file": "g.png"}'), ("bad", "nothing")):
        (top / "images" / name).mkdir(parents=True)
        (top / "images" / name / "image.json").write_text(text)
    return str(top)


def test_catalogue(spark, root):
    good, bad = chapters.catalogue(spark, root)
    assert [(r.number, r.title) for r in good.collect()] == [(2, "Second"), (10, "Tenth"), (None, "Index")]
    assert [r.path.rsplit("/", 2)[1] for r in bad.collect()] == ["broken"]
    none, unread = chapters.catalogue(spark, root + "/nowhere")
    assert none.count() == unread.count() == 0


def test_pieces(spark, root):
    pages = chapters.pages(spark, root)
    assert sorted((r.page, r.ends) for r in pages.collect()) == [(1, True), (2, False)]
    rows = chapters.pieces(spark, root, pages)
    assert sorted((r.page, r.number, r.kind, r.content) for r in rows.collect()) == [(1, 1, "heading", "Top"), (1, 2, "text", "a text\n"), (1, 3, "heading", "Sub"), (2, 1, "formula", "x"), (2, 1, "text", "goes on")]
    assert [(r.page, r.number) for r in chapters.repeated_pieces(pages).collect()] == [(2, 1)]
    own = rows.withColumnRenamed("folder", "doc_id").where("kind <> 'formula'")
    marked = pieces.mid_sentence(own, pages.select(F.col("folder").alias("doc_id"), "page", "starts", "ends"))
    assert sorted((r.page, r.number, r.starts, r.ends) for r in marked.collect()) == [(1, 1, False, False), (1, 2, False, True), (1, 3, False, False), (2, 1, True, False)]
    paths = {(r.page, r.number): r.path for r in pieces.sections(own).collect()}
    assert paths == {(1, 1): [], (1, 2): ["Top"], (1, 3): ["Top"], (2, 1): ["Top", "Sub"]}
    assert [r.c for r in own.where("number = 2").select(pieces.kept_cites("cites").alias("c")).collect()] == [["1"]]


def test_files_beside_and_pictures(spark, root):
    got = {r.folder.rsplit("/", 1)[1]: r.x and r.x.text for r in chapters.beside(spark, root, "insights.json", "text string").collect()}
    assert got == {"two": "t", "ten": None, "index": None}
    assert [r.x.file for r in chapters.pictures(spark, root, "file string").collect()] == ["g.png"]
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    kept = spark.createDataFrame([("a", "{}"), ("b", "{")], "key string, value string")
    assert {r.key: r.answer for r in chapters.kept_answers(asked, kept).collect()} == {"a": "{}", "b": None, "c": None}


def test_lines_are_written_whole_and_named_in_the_manifest(spark, tmp_path):
    import hashlib

    path = str(tmp_path / "train")
    for mode in ("overwrite", "overwrite", "append"):
        chapters.write_lines(spark.createDataFrame([(1, "x"), (2, "y")], "n long, t string").coalesce(1), path, mode)
    rows = spark.read.json(path)
    assert rows.count() == 4
    files = spark.read.format("binaryFile").load(f"{path}/part-*").select("path", "content")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.lit(2).alias("n_tokens"))
    got = {r.path: (r.sha256, r.lines, r.n_tokens) for r in states.manifest_files(files, lines).collect()}
    assert len(got) == 2
    for p, (sha, n, tokens) in got.items():
        assert sha == hashlib.sha256(open(p.removeprefix("file:"), "rb").read()).hexdigest() and (n, tokens) == (2, 4)


def test_chapters_are_read_whole_or_named_with_their_faults(spark, root):
    good, bad = chapters.whole_chapters(spark, root)
    assert good.count() == 0
    got = sorted((r.folder.rsplit("/", 1)[1], r.fault) for r in bad.collect())
    assert got == [("index", "not finished"), ("ten", "page 1 is missing or can't be read"), ("ten", "page 2 is missing or can't be read"), ("two", "page 2 has two pieces 1")]


def test_a_missing_piece_file_and_a_page_of_another_version(spark, tmp_path):
    for name, listed, version in (("a", ["01-text.md"], 1), ("b", ["01-text.md", "02-text.md"], 1), ("c", [], 2)):
        own = tmp_path / "m" / name / "page-num-1"
        own.mkdir(parents=True)
        (own.parent / "chapter.json").write_text(json.dumps({"format-version": 1, "media-title": "M", "name": {"title": name}, "source-file": "x", "source-sha256": "s", "page-count": 1, "finished": True}))
        entries = [{"number": int(f[:2]), "file": f, "kind": "text"} for f in listed]
        (own / "page.json").write_text(json.dumps({"format-version": version, "page-position": 1, "pieces": entries, "relationships": []}))
        (own / "01-text.md").write_text("words\r\n")
    good, bad = chapters.whole_chapters(spark, str(tmp_path))
    assert [(r.folder[-1], r.number, r.content) for r in good.collect()] == [("a", 1, "words\r")]
    assert sorted((r.folder[-1], r.fault) for r in bad.collect()) == [("b", "page 1 lacks 02-text.md"), ("c", "page 1 has version 2")]
