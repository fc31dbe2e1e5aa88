"""Texts full of personal data take time in proportion to their length, and spans that a plain version finds too."""

import time

from pyspark.sql import functions as F

from quire.llm import pii
from test_edges import base


def test_a_hundred_thousand_matches(spark):
    rows = [(1, "mail a1.b@cd.org " * 100_000), (2, "10 21 " * 100_000), (3, "x 1.2.3.4, " * 20_000 + "é" * 3000 + " +49 170 1234567")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert time.time() - began < 120
    assert got[1].text == "mail [EMAIL] " * 100_000 and got[2].text == rows[1][1]
    assert got[3].text == "x [IP], " * 20_000 + "é" * 3000 + " [PHONE]"
    found = pii.spans(df.where("doc_id = 3"), "text").select(F.transform("base", lambda s: F.struct(s["start"], s["order"], s["stop"])).alias("b")).head()
    assert [tuple(s) for s in found.b] == base(rows[2][1])


def test_running_totals(spark):
    for n in (0, 1, 255, 256, 257, 70_000):
        values = [(7 * i) % 11 for i in range(n)]
        df = spark.createDataFrame([(values,)], "v array<int>")
        sums, most = df.select(pii.running(F.col("v"), lambda a, b: a + b), pii.running(F.col("v"), F.greatest)).head()
        want, top, total = [], [], 0
        for x in values:
            total += x
            want.append(total)
            top.append(max([x, *top[-1:]]))
        assert (sums, most) == (want, top)


def test_places_in_parts(spark):
    text = "".join(chr(97 + i % 26) if i % 7 else "\U0001f600" for i in range(5000)) + "\n"
    df = spark.createDataFrame([(text, a, z) for a, z in ((0, 0), (0, 1), (1023, 1025), (1024, 1024), (900, 4100), (4999, 5001), (5001, 5001))], "t string, a int, z int")
    assert all(r.x == text[r.a : r.z] for r in df.select("a", "z", pii.cut_out(pii.parts_of(F.col("t")), F.col("a"), F.col("z")).alias("x")).collect())
