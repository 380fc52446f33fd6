"""Structured Streaming operators. Those that need no custom state are plain DataFrame functions that run on a batch or a stream alike.

Late data: the watermark is ten minutes on event time; ``late_rows`` shows what
a batch holds beyond it, so that late rows can be kept apart in foreachBatch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from caselake.operators.windows import notified

LATE = "10 minutes"


def timed(df: DataFrame, ts: str = "created_at") -> DataFrame:
    """df with ts as a timestamp with time zone, and a watermark when it is a stream."""
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, LATE) if df.isStreaming else df


def file_stream(spark: SparkSession, path: str, schema: StructType | None = None, fmt: str = "parquet", per_trigger: int = 100) -> DataFrame:
    """New files of a folder, so many per trigger; ``fmt`` binaryFile gives path, time, length and content."""
    reader = spark.readStream.format(fmt).option("maxFilesPerTrigger", per_trigger)
    return (reader if fmt == "binaryFile" else reader.schema(schema)).load(path)


def dedup_stream(df: DataFrame, keys: list[str], within: str = "1 day", ts: str = "created_at") -> DataFrame:
    """First row of each key within a time span. A stream forgets a key that long after its first row; in a batch a row counts as new when the key's row before it is further away than that."""
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    if df.isStreaming:
        return df.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)
    w = Window.partitionBy(*keys).orderBy(ts, F.xxhash64(*df.columns))
    before = F.lag(ts).over(w)
    return df.withColumn("_new", before.isNull() | (F.col(ts) > before + F.expr(f"INTERVAL {within}"))).filter("_new").drop("_new")


def nightly_summary(events: DataFrame) -> DataFrame:
    return timed(events).groupBy("firm_id", F.window("created_at", "1 day")).agg(F.count("*").alias("items"), F.count_if(F.col("status") == "failed").alias("failed"))


def sliding_activity(events: DataFrame) -> DataFrame:
    return timed(events).groupBy("firm_id", F.window("created_at", "1 hour", "15 minutes")).agg(F.count("*").alias("n"))


def step_status(events: DataFrame) -> DataFrame:
    """Start, end and last row of each step: an aggregate for update mode."""
    return events.groupBy("job_id", "status").agg(F.min("created_at").alias("started"), F.max("created_at").alias("ended"), F.expr("max_by(intake_id, struct(created_at, intake_id))").alias("last_id"))


def job_state(events: DataFrame, retries: int = 3) -> DataFrame:
    """Where each job stands after all of its events: the batch twin of ``job_state_stream``."""
    last = F.expr("max_by(status, struct(created_at, intake_id))")
    rows = events.groupBy("job_id").agg(last.alias("last_status"), F.count_if(F.col("status") == "failed").alias("failures"))
    return rows.withColumn("state", F.when(F.col("last_status") != "failed", "ok").when(F.col("failures") <= retries, "retry").otherwise("dead"))


class JobStates(StatefulProcessor):
    """Keeps a job's last status and failures; emits its state whenever events arrive."""

    def __init__(self, retries: int = 3):
        self.retries = retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("job", StructType([StructField("last", StringType()), StructField("at", LongType()), StructField("id", LongType()), StructField("failures", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, at, ident, failures = self.held.get() if self.held.exists() else (None, -(2**62), -1, 0)
        for part in rows:
            failures += int((part["status"] == "failed").sum())
            for status, ts, i in zip(part["status"], part["created_at"].astype("int64"), part["intake_id"], strict=True):
                if (ts, i) > (at, ident):
                    last, at, ident = status, int(ts), int(i)
        self.held.update((last, at, ident, failures))
        state = "ok" if last != "failed" else "retry" if failures <= self.retries else "dead"
        yield pd.DataFrame({"job_id": [key[0]], "last_status": [last], "failures": [failures], "state": [state]})

    def close(self) -> None:
        pass


def job_state_stream(events: DataFrame, retries: int = 3) -> DataFrame:
    out = StructType([StructField("job_id", LongType()), StructField("last_status", StringType()), StructField("failures", LongType()), StructField("state", StringType())])
    rows = timed(events).select("job_id", "status", "created_at", "intake_id")
    return rows.groupBy("job_id").transformWithStateInPandas(JobStates(retries), out, "Update", "None")


class StatusChanges(StatefulProcessor):
    """Keeps a job's last status and where it stands in time, until event time has passed it by ``ttl_ms``; gives the events that change it, none that repeat it."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = StructType([StructField("status", StringType()), StructField("at", LongType()), StructField("id", LongType())])
        self.handle, self.held = handle, handle.getValueState("last", kind)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        part = pd.concat(list(rows))
        part = part.assign(_at=part["created_at"].astype("datetime64[us]").astype("int64")).sort_values(["_at", "intake_id"])
        before, at, ident = self.held.get() if self.held.exists() else (None, -(2**62), -1)
        part = part[(part["_at"] > at) | ((part["_at"] == at) & (part["intake_id"] > ident))]  # later than what was told already
        if part.empty:
            return
        last = part.iloc[-1]
        self.held.update((last["status"], int(last["_at"]), int(last["intake_id"])))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self.handle.registerTimer(int(last["_at"]) // 1000 + self.ttl_ms)
        previous = part["status"].shift(fill_value=before)
        told = part[(part["status"] != previous) & part["kind"].notna()]
        if not told.empty:
            yield told[["intake_id", "job_id", "firm_id", "status", "created_at", "kind"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def notification_stream(events: DataFrame, ttl_days: int = 90) -> DataFrame:
    """Notifications as they happen: (intake_id, job_id, firm_id, status, created_at, kind), each change of a job once, across restarts.

    A window's lag can't run on a stream: the last status is state, kept until the watermark is ``ttl_days`` past a job's last event
    (timers on event time: a time to live in wall-clock time would keep an available-now query from ending). An event
    that is older than one already seen of its job, or than the watermark, changes nothing. ``status_changes`` gives the same rows of a batch in order.
    """
    out = StructType([StructField("intake_id", LongType()), StructField("job_id", LongType()), StructField("firm_id", LongType()), StructField("status", StringType()), StructField("created_at", TimestampType()), StructField("kind", StringType())])
    rows = timed(events).select("intake_id", "job_id", "firm_id", "status", "created_at", notified(F.col("status")).alias("kind"))
    return rows.groupBy("job_id").transformWithStateInPandas(StatusChanges(ttl_days * 86_400_000), out, "Append", "EventTime")


class MessageBuffer(StatefulProcessor):
    """Flushes a conversation's messages at ``n`` of them, or when none came for ``gap`` seconds of event time."""

    def __init__(self, n: int, gap: int):
        self.n, self.gap = n, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", StructType([StructField("id", LongType()), StructField("at", TimestampType())]))

    def _flush(self, key, ids: list[int], why: str) -> pd.DataFrame:
        return pd.DataFrame({"conversation_id": [key[0]], "n": [len(ids)], "first_id": [ids[0]], "last_id": [ids[-1]], "why": [why]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = list(self.rows.get())
        new = [(int(i), t) for part in rows for i, t in zip(part["message_id"], part["ts"], strict=True)]
        for i, t in sorted(new, key=lambda x: (x[1], x[0])):
            if held and (t - held[-1][1]).total_seconds() >= self.gap:
                yield self._flush(key, [h[0] for h in held], "idle")
                held = []
            held.append((i, t))
            if len(held) == self.n:
                yield self._flush(key, [h[0] for h in held], "full")
                held = []
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if held:
            self.rows.put(held)
            self.handle.registerTimer(int(pd.Timestamp(held[-1][1]).timestamp() * 1000) + self.gap * 1000)
        else:
            self.rows.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = list(self.rows.get())
        self.rows.clear()
        if held:
            yield self._flush(key, [h[0] for h in held], "idle")

    def close(self) -> None:
        pass


def message_batches(messages: DataFrame, n: int = 10, gap: int = 30) -> DataFrame:
    """Batches of (conversation_id, message_id, ts) messages."""
    out = StructType([StructField("conversation_id", LongType()), StructField("n", LongType()), StructField("first_id", LongType()), StructField("last_id", LongType()), StructField("why", StringType())])
    rows = timed(messages, "ts").select("conversation_id", "message_id", "ts")
    return rows.groupBy("conversation_id").transformWithStateInPandas(MessageBuffer(n, gap), out, "Append", "EventTime")


def route_stream(items: DataFrame, cases: DataFrame, route: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Stream-static join: the same routing function as for a batch."""
    return route(items, cases)


def late_rows(batch: DataFrame, ts: str, newest: str) -> DataFrame:
    """Rows of a batch that lie beyond the watermark."""
    return batch.filter(F.col(ts).cast("timestamp") < F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {LATE}"))


def refresh_changed(status: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: what is new or changed in a batch goes to the sink."""

    def run(batch: DataFrame, _id: int) -> None:
        sink(status(batch).filter(F.col("status").isin("new", "metadata_changed", "force")))

    return run
