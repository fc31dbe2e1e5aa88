"""Streams of job events, replayed from files."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quire.functions import text
from quire.streaming import jobs

SCHEMA = "event_id long, job_id long, overall double, ts timestamp"
START = datetime(2024, 1, 1)


def written(spark, folder, rows):
    spark.createDataFrame([(i, j, o, START + timedelta(seconds=s)) for i, j, o, s in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def collected(spark, stream, mode, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_windows_progress_and_replays(spark, tmp_path):
    folder = str(tmp_path / "events")
    written(spark, folder, [(1, 7, 0.1, 0), (2, 7, 0.4, 30), (3, 7, 0.3, 61), (4, 8, 0.2, 62)])
    read = lambda: jobs.events(spark, folder, spark.read.parquet(folder).schema)
    assert {r.job_id: r.overall for r in collected(spark, jobs.rising(read()), "complete", "rising")} == {7: 0.4, 8: 0.2}
    assert sorted((r.start.second + 60 * r.start.minute, r.job_id, r.events) for r in collected(spark, jobs.recent(read()), "complete", "recent")) == [(0, 7, 2), (60, 7, 1), (60, 8, 1)]
    twice = read().union(read())
    assert sorted(r.event_id for r in collected(spark, jobs.once(twice, "event_id"), "append", "once")) == [1, 2, 3, 4]


def test_log_takes_each_row_once(spark, tmp_path):
    folder, log, at = (str(tmp_path / n) for n in ("events", "log", "at"))
    written(spark, folder, [(1, 7, 0.1, 0)])
    schema = spark.read.parquet(folder).schema
    for more in ([], [(2, 7, 0.2, 1)], []):
        if more:
            written(spark, folder, more)
        jobs.append_log(jobs.events(spark, folder, schema), log, at).awaitTermination(120)
    assert sorted(r.event_id for r in spark.read.json(log).collect()) == [1, 2]


def test_wordings(spark):
    rows = spark.createDataFrame([("T", r"a \(x\) costs $5", "x  \n\ty \n\n"), (" ", "b​c­ d ", "z")], "title string, t string, code string")
    got = rows.select(text.inline_math("t").alias("m"), text.document_wording("title", "t").alias("d"), text.question_wording("t").alias("q"), text.cleaned("t").alias("c"), text.code_lines("code").alias("k")).collect()
    assert got[0].m == r"a $x$ costs \$5" and got[0].d == r"title: T | text: a \(x\) costs $5" and got[1].d.startswith("title: none | text: b")
    assert got[1].q.startswith("task: search result | query: b") and got[1].c == "bcd" and got[0].k == "x\n\ty" and got[1].k == "z"
    assert rows.select(F.lit(1)).count() == 2
