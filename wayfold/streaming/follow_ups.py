"""Follow-up timers as a stream.

A send without an answer is due ``days`` after it.  Each key keeps its open sends and a timer per
send; the timer fires when the watermark passes it and the send comes out as DUE.  An answer that comes before
takes the send away silently, one that comes after takes the DUE row back with a RETRACTED row.
A send is forgotten ``kept`` days after it was due: state holds what can still change, not the past.

The change rows folded by their batch equal the batch form, ``outreach.follow_ups_due``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from wayfold import rules
from wayfold.operators.latest import newest_per_key
from wayfold.streaming import sinks

SEND, ANSWER = "SEND", "ANSWER"
DAY_MS = 86_400_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Timers(StatefulProcessor):
    """One key's open sends (id to sending time in microseconds and whether it came out) and its newest answer."""

    def __init__(self, days: int, kept: int):
        self.wait, self.kept = days * DAY_MS, kept * DAY_MS

    def init(self, handle) -> None:
        self.handle = handle
        self.sends = handle.getMapState("sends", "send_id long", "at long, out boolean")
        self.answered = handle.getValueState("answered", "at long")

    def _due_ms(self, at: int) -> int:
        return -(-at // 1000) + self.wait

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        answers = batch.loc[batch["kind"] == ANSWER, "at"]
        last = self.answered.get()[0] if self.answered.exists() else None
        if len(answers) and (last is None or answers.max() > last):
            last = int(answers.max())
            self.answered.update((last,))
            self.handle.registerTimer(self._due_ms(last) + self.kept)
        sent = batch[batch["kind"] == SEND]
        for send, at in zip(sent["send_id"], sent["at"]):
            if last is None or at > last:
                self.sends.updateValue((int(send),), (int(at), False))
                self.handle.registerTimer(max(self._due_ms(int(at)), timerValues.getCurrentWatermarkInMs()))
        if len(answers):
            gone = [(send[0], at, out) for send, (at, out) in self.sends.iterator() if at <= last]
            for send, _, _ in gone:
                self.sends.removeKey((send,))
            yield self._rows(key, [(s, at) for s, at, out in gone if out], "RETRACTED")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        every = [(send[0], at, out) for send, (at, out) in self.sends.iterator()]
        due = [(s, at) for s, at, out in every if not out and self._due_ms(at) <= now]
        for send, at in due:
            self.sends.updateValue((send,), (at, True))
            self.handle.registerTimer(max(self._due_ms(at) + self.kept, now + 1))
        for send, at, out in every:
            if out and self._due_ms(at) + self.kept <= now:
                self.sends.removeKey((send,))
        if self.answered.exists() and self._due_ms(self.answered.get()[0]) + self.kept <= now:
            self.answered.clear()
        yield self._rows(key, due, "DUE")

    def _rows(self, key, sends: list[tuple[int, int]], op: str) -> pd.DataFrame:
        return pd.DataFrame({"key": np.full(len(sends), key[0], dtype=object), "send_id": np.array([s for s, _ in sends], dtype="int64"),
                             "sent_us": np.array([at for _, at in sends], dtype="int64"), "op": np.full(len(sends), op, dtype=object)})

    def close(self) -> None:
        pass


def follow_up_changes(marks: DataFrame, days: int = rules.FOLLOW_UP_DAYS, kept: int = 365, lateness: str = "1 day") -> DataFrame:
    """key, send_id, sent_us and op (DUE or RETRACTED) from ``marks(key string, kind, send_id long, at timestamp)``.

    ``marks`` holds sends and answers in one stream, and may hold marks of other kinds and a null key, which only move the watermark.
    """
    import wayfold.streaming.follow_ups as module  # executors need not have this package: the class travels along
    cloudpickle.register_pickle_by_value(module)
    rows = marks.withWatermark("at", lateness).select(
        "key", "kind", F.coalesce("send_id", F.lit(0).cast("long")).alias("send_id"), F.unix_micros("at").alias("us"), "at")
    return (rows.withColumnRenamed("at", "clock").withColumnRenamed("us", "at").groupBy("key")
            .transformWithStateInPandas(module.Timers(days, kept), "key string, send_id long, sent_us long, op string", "Update", "EventTime"))


def open_follow_ups(spark: SparkSession, path: str) -> DataFrame:
    """Sends that are due and not taken back, from the change rows written so far."""
    changes = spark.read.schema("key string, send_id long, sent_us long, op string, batch int").parquet(path)
    return newest_per_key(changes, ["key", "send_id"], ["batch"]).filter("op = 'DUE'").drop("op", "batch")


@contextmanager
def rocksdb(spark: SparkSession):
    """State in RocksDB, which timers and map state need, for the streams started inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def run_follow_ups(marks: DataFrame, folder: str, **options) -> list[dict]:
    """Bring the change rows under ``folder`` up to date with all marks that have landed; the progress of every batch."""
    with rocksdb(marks.sparkSession):
        return sinks.run_available(follow_up_changes(marks, **options), f"{folder}/checkpoint", sinks.change_log(f"{folder}/rows"), "update")
