"""Time-based operators: sliding-window limits, sessions, retention; batch forms and Structured Streaming ones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

IDLE_MINUTES, ABSOLUTE_HOURS = 30, 8


#: A key's events are cut into slices of time that are so many windows (or idle times) long.
SLICE = 16


def window_counts(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """events with the number of the key's events in the last `seconds`, its own included.

    A task counts one slice of a key's time, so that a busy key is spread. Events less than a window before the next
    slice also go there, to be counted with its first ones. Events without a time count each other, as one slice.
    """
    span, width = seconds * 1_000_000, SLICE * seconds * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    own, into = at - F.pmod(at, F.lit(width)), F.pmod(at, F.lit(width))
    here = F.struct(own.alias("slice"), F.lit(True).alias("counted"))
    there = F.struct((own + width).alias("slice"), F.lit(False).alias("counted"))
    sent = events.withColumn("_at", at).withColumn("_to", F.explode(F.when(into >= width - span, F.array(here, there)).otherwise(F.array(here))))
    w = Window.partitionBy(key, "_to.slice").orderBy("_at").rangeBetween(-span, 0)
    return sent.withColumn("in_window", F.count("*").over(w)).where("_to.counted").drop("_at", "_to")


def limited_sessions(events: DataFrame, key: str, ts: str, idle_minutes: int = IDLE_MINUTES, absolute_hours: int = ABSOLUTE_HOURS) -> DataFrame:
    """key, session, start_us, end_us, n: as sessions(), but none lasts longer than absolute_hours.

    Whether an event opens a session depends on where the one before began, so sorted partitions are read in order;
    only the open session is held.
    """
    idle, longest = idle_minutes * 60_000_000, absolute_hours * 3_600_000_000
    kind = dict(events.dtypes)[key]

    def cut(batches):
        owner, session, start, end, n = None, 0, 0, 0, 0
        for b in batches:
            out = []
            for k, t in zip(b["key"].tolist(), b["at"].tolist(), strict=True):
                if k == owner and t - end <= idle and t - start <= longest:
                    end, n = t, n + 1
                    continue
                if n:
                    out.append((owner, session, start, end, n))
                session, owner, start, end, n = (session + 1 if k == owner else 1), k, t, t, 1
            yield pd.DataFrame(out, columns=["key", "session", "start_us", "end_us", "n"])
        if n:
            yield pd.DataFrame([(owner, session, start, end, n)], columns=["key", "session", "start_us", "end_us", "n"])

    rows = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    told = rows.repartition("key").sortWithinPartitions("key", "at").mapInPandas(cut, f"key {kind}, session long, start_us long, end_us long, n long")
    return told.withColumnRenamed("key", key)


def sessions(events: DataFrame, key: str, ts: str, idle_minutes: int = IDLE_MINUTES) -> DataFrame:
    """key, session, start, end, n: runs of events no more than the idle time apart.

    Runs are found within slices of a key's time, then those that meet across slices are joined. A slice has no more than
    SLICE + 1 runs, so that the second step sees few rows of even a busy key. Each event without a time is a session.
    """
    idle = idle_minutes * 60_000_000
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    slice_ = micros(F.col(ts)) - F.pmod(micros(F.col(ts)), F.lit(SLICE * idle))
    slim = events.select(F.col(key), F.col(ts).alias("_ts"), slice_.alias("_slice"))

    def opened(before: Column, at: Column) -> Column:
        gap = micros(at) - micros(before)
        return F.when(gap.isNull() | (gap > idle), 1).otherwise(0)

    def numbered(rows: DataFrame, within: list[str], order: list[str], last: str, first: str, name: str) -> DataFrame:
        """rows with the running number of what the gap from `last` of one row to `first` of the next opens."""
        w = Window.partitionBy(*within).orderBy(*order)
        marked = rows.withColumn("_new", opened(F.lag(last).over(w), F.col(first)))
        return marked.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")

    runs = numbered(slim, [key, "_slice"], ["_ts"], "_ts", "_ts", "_run").groupBy(key, "_slice", "_run").agg(F.min("_ts").alias("start"), F.max("_ts").alias("end"), F.count("*").alias("n"))
    whole = numbered(runs, [key], ["start", "_run"], "end", "start", "session")
    return whole.groupBy(key, "session").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))


def retained(rows: DataFrame, ts: str, days: int, now: str) -> DataFrame:
    """Rows younger than the retention period at `now`."""
    return rows.where(F.col(ts).cast("timestamp") >= F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.lit(days)))


def stream_sessions(events: DataFrame, key: str, ts: str, idle_minutes: int = IDLE_MINUTES, late: str = "10 minutes") -> DataFrame:
    """Session windows over a stream; late events are taken up to the watermark."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    per = timed.groupBy(F.session_window("_ts", f"{idle_minutes} minutes"), key).agg(F.count("*").alias("n"))
    return per.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def stream_window_counts(events: DataFrame, key: str, ts: str, size: str, slide: str, late: str = "10 minutes") -> DataFrame:
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", size, slide), key).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def rate_limit(events: DataFrame, key: str, ts: str, seconds: int, limit: int, late: str = "10 minutes") -> DataFrame:
    """key, ts_us, admitted of each event of a stream: admitted while fewer than `limit` admitted ones lie in the window,
    those exactly `seconds` old included.

    What counts are earlier admissions, so the decision is recursive; the state is a key's recent admissions, at most
    `limit` of them. It ends by event time, once the watermark has passed the last event by the window, so a replay
    decides as the first run did.
    """
    kind = dict(events.dtypes)[key]
    width = seconds * 1_000_000

    def step(name: tuple, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        times = sorted(int(t) for f in frames for t in f["ts_us"])
        out = []
        for t in times:
            recent = [r for r in recent if r >= t - width]
            ok = len(recent) < limit
            if ok:
                recent.append(t)
            out.append((name[0], t, ok))
        state.update((recent,))
        state.setTimeoutTimestamp(max(max(times) // 1000, state.getCurrentWatermarkMs()) + seconds * 1000 + 1)
        yield pd.DataFrame(out, columns=["key", "ts_us", "admitted"])

    timed = events.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("at")).withWatermark("at", late)
    rows = timed.withColumn("ts_us", F.unix_micros("at"))
    return rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, ts_us long, admitted boolean", "recent array<long>", "update", GroupStateTimeout.EventTimeTimeout)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Sessions(StatefulProcessor):
    """A key's events wait in a list until the watermark has passed them, so that they are taken in order of time; the
    open session is a value. A timer at each event's time takes it up, one behind the idle time ends the session, and a
    key without either leaves the state."""

    def __init__(self, kind: str, idle_us: int, longest_us: int):
        self.kind, self.idle, self.longest = kind, idle_us, longest_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start_us long, end_us long, n long")
        self.waiting = handle.getListState("waiting", "ts_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = [int(t) for frame in rows for t in frame["ts_us"]]
        self.waiting.appendList([(t,) for t in times])
        for at in {t // 1000 + 1 for t in times}:
            self.handle.registerTimer(max(at, timerValues.getCurrentWatermarkInMs() + 1))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, out = timerValues.getCurrentWatermarkInMs() * 1000, []
        times = sorted(t for (t,) in self.waiting.get())
        session = self.open.get() if self.open.exists() else None
        start, end, n = session if session else (0, 0, 0)
        for t in [t for t in times if t <= passed]:
            if n and t - end <= self.idle and t - start <= self.longest:
                end, n = t, n + 1
                continue
            if n:
                out.append((key[0], start, end, n))
            start, end, n = t, t, 1
        left = [(t,) for t in times if t > passed]
        if len(left) < len(times):
            self.waiting.put(left) if left else self.waiting.clear()
        if n and passed > end + self.idle and not any(t - end <= self.idle for (t,) in left):
            out.append((key[0], start, end, n))
            n = 0
        if n:
            self.open.update((start, end, n))
            self.handle.registerTimer(max((end + self.idle) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        elif self.open.exists():
            self.open.clear()
        yield pd.DataFrame(out, columns=["key", "start_us", "end_us", "n"])

    def close(self) -> None:
        pass


def stream_limited_sessions(events: DataFrame, key: str, ts: str, idle_minutes: int = IDLE_MINUTES, absolute_hours: int = ABSOLUTE_HOURS, late: str = "10 minutes") -> DataFrame:
    """key, start_us, end_us, n of the sessions of a stream: those of limited_sessions(), none longer than absolute_hours.

    A session appears once the watermark has passed its end by the idle time, or once a later event has been taken up;
    then its key's state goes. Events within `late` of the newest may come in any order; rows without key or time are
    left out. All is decided by event time, so a replay gives the same rows. Uses the RocksDB state store, which it sets
    for the session.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kind = dict(events.dtypes)[key]
    timed = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("at")).withWatermark("at", late)
    rows = timed.withColumn("ts_us", F.unix_micros("at"))
    processor = _Sessions(kind, idle_minutes * 60_000_000, absolute_hours * 3_600_000_000)
    told = rows.groupBy("key").transformWithStateInPandas(processor, f"key {kind}, start_us long, end_us long, n long", "Append", "EventTime")
    return told.withColumnRenamed("key", key)


def first_seen(events: DataFrame, key: str, ts: str, keep: str) -> DataFrame:
    """The first event of each key of a stream within the time that state is kept."""
    return events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", keep).dropDuplicatesWithinWatermark([key]).drop("_ts")
