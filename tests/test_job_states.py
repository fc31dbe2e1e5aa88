"""State machines of jobs, with replays and restarts."""

from datetime import datetime, timedelta

from quire.streaming import jobs

START = datetime(2024, 1, 1)


def steps(spark, tmp_path, schema, batches, stream, restart=True):
    """What a stream appends to a folder, batch by batch, each in a query of its own that goes on from the last one's state."""
    folder, out, at = (str(tmp_path / n) for n in ("in", "out", "at"))
    found = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        query = stream(jobs.events(spark, folder, spark.read.parquet(folder).schema)).writeStream.format("parquet").option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start(out)
        assert query.awaitTermination(120)
        rows = sorted((tuple(r) for r in spark.read.parquet(out).collect()), key=str)
        found.append(rows)
    return found


def test_next_value():
    cases = [((None, None, 0, "a"), 0), ((120, "a", 630, "a"), 630), ((730, "a", 730, "b"), 731), ((730, "a", 730, "a"), None), ((731, "b", 730, "c"), None), ((999, "a", 999, "b"), None), ((990, "a", 990, "b"), 991)]
    for given, want in cases:
        assert jobs.next_tenths(*given) == want


def test_notices_rise_through_replays_and_a_restart(spark, tmp_path):
    first = [(7, 1, 100, "read"), (7, 2, 100, "write"), (7, 3, 90, "back"), (8, 4, 999, "x"), (8, 5, 999, "y")]
    got = steps(spark, tmp_path, "job_id long, event_id long, tenths int, message string", [first, [*first, (7, 6, 101, "write"), (7, 7, 101, "done")]], jobs.notices)
    assert got[0] == [(7, 1, 100, "read"), (7, 2, 101, "write"), (8, 4, 999, "x")]
    assert got[1] == [*got[0][:2], (7, 7, 102, "done"), got[0][2]]
    df = spark.createDataFrame([*first, (7, 6, 101, "write"), (7, 7, 101, "done")], "job_id long, event_id long, tenths int, message string")
    assert sorted((tuple(r) for r in jobs.notices_of(df).collect()), key=str) == got[1]


def test_one_job_runs_at_a_time(spark, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    first = [("q", 1, 7, "start", at(0)), ("q", 2, 8, "start", at(1)), ("r", 3, 9, "start", at(1)), ("q", 4, 8, "end", at(2))]
    second = [*first, ("q", 5, 7, "end", at(3)), ("q", 6, 8, "start", at(4)), ("q", 7, 8, "report", at(50)), ("q", 8, 5, "start", at(100)), ("q", 9, 5, "start", at(200))]
    got = steps(spark, tmp_path, "queue string, event_id long, job_id long, change string, ts timestamp", [first, second], lambda s: jobs.admissions(s.withWatermark("ts", "10 minutes"), "1 hour"))
    assert got[0] == sorted([("q", 1, 7, "started", 7), ("q", 2, 8, "refused", 7), ("r", 3, 9, "started", 9), ("q", 4, 8, "unknown", 7)], key=str)
    new = set(got[1]) - set(got[0])
    assert {("q", 5, 7, "ended", None), ("q", 6, 8, "started", 8), ("q", 8, 5, "refused", 8), ("q", None, 8, "lost", None), ("q", 9, 5, "started", 5)} <= new
    # The other queue's job reported nothing while event time went on; its timer lets it go.
    assert new - {("r", None, 9, "lost", None)} == {("q", 5, 7, "ended", None), ("q", 6, 8, "started", 8), ("q", 8, 5, "refused", 8), ("q", None, 8, "lost", None), ("q", 9, 5, "started", 5)}
