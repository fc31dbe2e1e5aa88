"""Job events as a stream: the latest report of each job, spending by model in windows, ingest that survives replays."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

#: A full bar, in tenths of a percent.
FULL = 1000
NOTICE = "job_id long, event_id long, tenths int, message string"
ADMISSION = "queue string, event_id long, job_id long, outcome string, running long"


def events(spark, folder: str, schema: StructType) -> DataFrame:
    """Files of job events as they come, in a schema that the caller states."""
    return spark.readStream.schema(schema).parquet(folder)


def latest(stream: DataFrame) -> DataFrame:
    """Each job's newest report; for output mode complete or update."""
    last = stream.groupBy("job_id").agg(F.max_by(F.struct("event_id", "stage", "share"), F.struct("ts", "event_id")).alias("e"))
    return last.select("job_id", "e.*")


def spending(stream: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Tokens by model in windows of time; rows later than `late` are dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "model").agg(F.sum("tokens").alias("tokens")).select(F.col("w.start").alias("start"), "model", "tokens")


def once(stream: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Rows by content id, replays left out."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def recent(stream: DataFrame, width: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """How many events each job had in each window."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "job_id").agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), "job_id", "events")


def rising(stream: DataFrame) -> DataFrame:
    """(job_id, overall): each job's greatest progress so far; in output mode update a row comes only for jobs with new
    events, and never falls. stream: (job_id, overall, ts)."""
    return stream.groupBy("job_id").agg(F.max("overall").alias("overall"))


def append_log(stream: DataFrame, folder: str, checkpoint: str):
    """Writes each row once to a log of lines of JSON, across restarts with the same checkpoint; takes what is there and ends."""
    return stream.writeStream.format("json").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(folder)


def next_tenths(sent: int | None, message: str | None, tenths: int, words: str) -> int | None:
    """What a notice shows after one of `sent` and `message`, or None to send none: a higher value, or for new words at
    the same value a tenth more. That step never fills the bar."""
    if sent is None or tenths > sent:
        return tenths
    if tenths == sent and words != message and sent + 1 < FULL:
        return sent + 1
    return None


def noticed(events: pd.DataFrame, last: tuple[int | None, str | None, int]) -> tuple[list[tuple], tuple]:
    """Notices for a job's events (event_id, tenths, message), and the last one sent with the last event seen. Events up
    to that one are replays."""
    sent, message, seen = last
    out = []
    for i, t, m in sorted(zip(events["event_id"].tolist(), events["tenths"].tolist(), events["message"].tolist(), strict=True)):
        if i <= seen:
            continue
        seen, value = i, next_tenths(sent, message, t, m)
        if value is not None:
            sent, message = value, m
            out.append((i, value, m))
    return out, (sent, message, seen)


def notices(stream: DataFrame) -> DataFrame:
    """The notices of running jobs: values of one job only rise, and replays send none.
    stream: (job_id, event_id, tenths, message), event ids rising with time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else (None, None, -1)
        out, last = noticed(pd.concat(list(batches)), last)
        state.update(last)
        yield pd.DataFrame([(key[0], *n) for n in out], columns=["job_id", "event_id", "tenths", "message"])

    return stream.groupBy("job_id").applyInPandasWithState(run, NOTICE, "sent int, message string, seen long", "append", GroupStateTimeout.NoTimeout)


def notices_of(events: DataFrame) -> DataFrame:
    """The same of stored events, each job from its first one."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out, _ = noticed(rows, (None, None, -1))
        return pd.DataFrame([(key[0], *n) for n in out], columns=["job_id", "event_id", "tenths", "message"])

    return events.groupBy("job_id").applyInPandas(run, NOTICE)


def admissions(stream: DataFrame, idle: str = "1 hour") -> DataFrame:
    """One job at a time in each queue: a start while another job runs is `refused` with the one that runs, else the job
    is `started`; an end of the running job is `ended`, of another one `unknown`. A job that reports nothing for `idle`
    of event time gives its place up, as `lost`. Replays are left out.
    stream: (queue, event_id, job_id, change `start`, `report` or `end`, ts), event ids rising with time, with a watermark on ts."""
    width = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        running, seen, at = state.get if state.exists else (None, -1, 0)
        out = []

        def give_up(now: int):
            nonlocal running
            if running is not None and now - at >= width:
                out.append((key[0], None, running, "lost", None))
                running = None

        if state.hasTimedOut:
            give_up(at + width)
        else:
            rows = pd.concat(list(batches)).sort_values("event_id")
            for i, job, change, ts in zip(rows["event_id"].tolist(), rows["job_id"].tolist(), rows["change"].tolist(), rows["ts"].tolist(), strict=True):
                if i <= seen:
                    continue
                seen, now = i, int(ts.timestamp() * 1000)
                give_up(now)
                if change == "start" and running is None:
                    running, at = job, now
                    out.append((key[0], i, job, "started", job))
                elif change == "start":
                    out.append((key[0], i, job, "refused", running))
                elif job != running:
                    out.append((key[0], i, job, "unknown", running))
                elif change == "end":
                    running = None
                    out.append((key[0], i, job, "ended", None))
                else:
                    at = now
        state.update((running, seen, at))
        if running is not None:
            state.setTimeoutTimestamp(max(at + width, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["queue", "event_id", "job_id", "outcome", "running"]).astype({"event_id": "Int64", "job_id": "Int64", "running": "Int64"})

    return stream.groupBy("queue").applyInPandasWithState(run, ADMISSION, "running long, seen long, at long", "append", GroupStateTimeout.EventTimeTimeout)
