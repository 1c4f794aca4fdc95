"""Throttled runs, bursts as sessions, and token buckets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..sources.snapshots import tree_changes


def watch(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = "1 second", initial: Callable[[], None] | None = None):
    """Run initial(), a full run over everything, and then handler(changes, batch) whenever changes are pending and the interval since the last run has passed; an
    interval of None takes what is there and ends. The checkpoint remembers what was handled; a batch that fails is given
    again under the same number, so that a handler that keeps numbers applies each once. initial() runs each time that the
    watch begins, before the stream does: what changes meanwhile is in the stream."""

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            handler(batch, number)

    if initial:
        initial()
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


class Bursts(StatefulProcessor):
    """For each key, counts what is pending and gives a run out once `interval` has passed since the last run and nothing has
    come for `quiet`, both in milliseconds. What comes meanwhile moves the one timer of the key."""

    def __init__(self, interval: int, quiet: int):
        self.interval, self.quiet = interval, quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("pending", "n long, due long, last_run long, runs long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        new = sum(r["n"] for r in rows)
        if not new:
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        n, due, last_run, runs = self.state.get() if self.state.exists() else (0, 0, 0, 0)
        if n:
            self.handle.deleteTimer(due)
        due = max(last_run + self.interval, now + self.quiet)
        self.handle.registerTimer(due)
        self.state.update((n + new, due, last_run, runs))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        n, _, _, runs = self.state.get()
        now = timerValues.getCurrentProcessingTimeInMs()
        self.state.update((0, 0, now, runs + 1))
        yield Row(watch=key[0], run=runs + 1, n=n, at=now)

    def close(self) -> None:
        pass


def bursts(changes: DataFrame, interval: float, quiet: float = 0.1) -> DataFrame:
    """Rows (watch, run, n, at) of a stream of changes, with a column `watch` if there are several: one for each burst, the
    number of its changes and the time in milliseconds. A burst ends when `interval` seconds have passed since the last run and
    none came for `quiet` seconds. Changes are counted where they are read; one number a partition meets the state of its watch."""
    key = F.col("watch").cast("string") if "watch" in changes.columns else F.lit("")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.groupby("watch", as_index=False, dropna=False).size().rename(columns={"size": "n"})

    few = changes.select(key.alias("watch")).mapInPandas(counted, "watch string, n long")
    processor = Bursts(round(interval * 1000), round(quiet * 1000))
    return few.groupBy("watch").transformWithState(processor, "watch string, run long, n long, at long", "Append", "ProcessingTime")


def watch_tree(spark: SparkSession, root: str, state: str, handler: Callable[[int, int], None], checkpoint: str, interval: float = 1.0, quiet: float = 0.1, every: str = "100 milliseconds", parts: int = 16):
    """Run handler(0, 0), a full run, and then handler(number, changes) for each burst of changes of a mounted tree. The tree is
    listed `every` so often; state and checkpoint are folders that all executors share. What is there at first is the
    first burst of a new checkpoint, so that nothing is lost that changes during the full run; a watch that begins again finds
    what changed while it was down."""

    def run(batch: DataFrame, _: int) -> None:
        for r in batch.orderBy("run").collect():  # one row a burst
            handler(r.run, r.n)

    handler(0, 0)
    runs = bursts(tree_changes(spark, root, state, parts=parts), interval, quiet)
    return runs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def coalesce_events(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Rows (path, start, end, n, kind): events of a path less than a gap apart become one, of the last one's kind. A
    stream needs `late`, the delay after which an event is dropped."""
    if late:
        events = events.withWatermark("ts", late)
    out = events.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max_by("kind", F.struct("ts", "kind")).alias("kind"))
    return out.select("path", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "kind")


def take(level: float, clock: float, at: float, size: float, rate: float) -> tuple[float, float]:
    """(level after, delay) of a bucket that holds one second of the rate."""
    level = min(rate, level + max(0.0, at - clock) * rate)
    return (level - size, 0.0) if level >= size else (0.0, (size - level) / rate)


def token_bucket(df: DataFrame, rate: float) -> DataFrame:
    """Rows (key, seq, delay) for requests (key, seq, seconds, bytes): how long each must wait for its key's bucket, which
    starts full. Requests of a key are taken in the order of seconds and seq; keys run side by side. A key's requests
    stream through as sorted rows, so that none is collected."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, level, clock = None, rate, 0.0
        for pdf in batches:
            delays = []
            for k, at, size in zip(pdf["key"], pdf["seconds"], pdf["bytes"]):
                if k != key:
                    key, level, clock = k, rate, at
                level, delay = take(level, clock, at, size, rate)
                clock = at
                delays.append(delay)
            yield pd.DataFrame({"key": pdf["key"], "seq": pdf["seq"], "delay": delays})

    of = df.select(F.col("key").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), F.col("seconds").cast("double").alias("seconds"), F.col("bytes").cast("double").alias("bytes"))
    return of.repartition("key").sortWithinPartitions("key", "seconds", "seq").mapInPandas(run, "key string, seq long, delay double")


def token_bucket_stream(stream: DataFrame, rate: float) -> DataFrame:
    """token_bucket() for a stream: a key's level and clock are kept as state from batch to batch."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, clock = state.get if state.exists else (rate, None)
        for pdf in pdfs:
            pdf, delays = pdf.sort_values(["seconds", "seq"]), []
            for at, size in zip(pdf["seconds"], pdf["bytes"]):
                level, delay = take(level, at if clock is None else clock, at, size, rate)
                clock = at
                delays.append(delay)
            yield pd.DataFrame({"key": pdf["key"], "seq": pdf["seq"], "delay": delays})
        if clock is not None:
            state.update((float(level), float(clock)))

    of = stream.select(F.col("key").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), F.col("seconds").cast("double").alias("seconds"), F.col("bytes").cast("double").alias("bytes"))
    return of.groupBy("key").applyInPandasWithState(run, "key string, seq long, delay double", "level double, clock double", "append", GroupStateTimeout.NoTimeout)
