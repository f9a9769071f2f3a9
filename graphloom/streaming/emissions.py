"""The outbox as a stream with timers: coalesced writes, emissions under a lease, re-emission when a lease runs out, and dead events.

Messages are (key, at, kind, event_id, version): a write of an event, or an ack of one that was delivered. A key (a collection and its ids) holds one
waiting event, its last write; a write of a smaller version than the last is fenced off. An event is emitted when the coalescing window has passed since its write;
if no ack comes before the lease ends it is emitted again, and after `retries` more emissions it is dead. A message at the very time of a timer comes first.

`emit` keeps this per key in a stream's state, with event-time timers; `emitted` says the same of a whole table, as a plan. They give the same rows, however the stream is cut
into batches, as long as messages of a key arrive in order of time.

Defined results: rows with a null key, time or event, and other kinds, are ignored; null versions are 0; of writes at one time the larger version, then event, counts as later;
an ack of an event that doesn't wait does nothing. Times are whole milliseconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WINDOW, LEASE, RETRIES = 5_000, 30_000, 3
STATE = "event_id string, version long, fence long, due long, attempt int"
OUT = "key string, event_id string, version long, attempt int, status string, at timestamp"


def advanced(state: dict, until: int, lease: int, retries: int) -> Iterator[tuple]:
    """The emissions of a key whose timers come before `until`; state moves on."""
    while state["due"] is not None and state["due"] < until:
        dead = state["attempt"] > retries
        yield state["event_id"], state["version"], state["attempt"], "dead" if dead else "emit", state["due"]
        state.update(due=None if dead else state["due"] + lease, attempt=state["attempt"] + 1)


def heard(state: dict, at: int, kind: str, event_id: str, version: int, window: int) -> None:
    """state after a message."""
    if kind == "write" and version >= state["fence"]:
        state.update(event_id=event_id, version=version, fence=version, due=at + window, attempt=0)
    elif kind == "ack" and event_id == state["event_id"]:
        state.update(due=None)


class _Outbox(StatefulProcessor):
    def __init__(self, window: int, lease: int, retries: int):
        self.window, self.lease, self.retries = window, lease, retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("outbox", STATE)

    def _load(self) -> dict:
        names = ("event_id", "version", "fence", "due", "attempt")
        return dict(zip(names, self.kept.get() if self.kept.exists() else (None, None, -(1 << 62), None, 0), strict=True))

    def _save(self, key: tuple, state: dict, out: list) -> Iterator[pd.DataFrame]:
        self.kept.update(tuple(state[n] for n in ("event_id", "version", "fence", "due", "attempt")))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if state["due"] is not None:
            self.handle.registerTimer(state["due"])
        if out:
            pdf = pd.DataFrame(out, columns=["event_id", "version", "attempt", "status", "at"])
            pdf.insert(0, "key", key[0])
            yield pdf.assign(at=pd.to_datetime(pdf["at"], unit="ms"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, out = self._load(), []
        for r in pd.concat(list(rows)).sort_values(["ms", "kind", "version", "event_id"]).itertuples():
            out += advanced(state, r.ms, self.lease, self.retries)
            heard(state, r.ms, r.kind, r.event_id, r.version, self.window)
        yield from self._save(key, state, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self._load()
        until = max(expiredTimerInfo.getExpiryTimeInMs() + 1, timerValues.getCurrentWatermarkInMs())  # no message before the watermark comes any more
        out = list(advanced(state, until, self.lease, self.retries))
        yield from self._save(key, state, out)


def _messages(df: DataFrame) -> DataFrame:
    kinds = df.where("key is not null and at is not null and event_id is not null and kind in ('write', 'ack')")
    return kinds.select("key", "at", F.unix_millis(F.col("at").cast("timestamp")).alias("ms"), "kind", "event_id", F.coalesce("version", F.lit(0)).cast("long").alias("version"))


def emit(stream: DataFrame, window: int = WINDOW, lease: int = LEASE, retries: int = RETRIES, late: str = "0 seconds") -> DataFrame:
    """(key, event_id, version, attempt, status, at) of a stream of messages; needs the RocksDB state store."""
    own = _messages(stream.withColumn("at", F.col("at").cast("timestamp"))).withWatermark("at", late)
    return own.groupBy("key").transformWithStateInPandas(statefulProcessor=_Outbox(window, lease, retries), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def emitted(messages: DataFrame, until, window: int = WINDOW, lease: int = LEASE, retries: int = RETRIES) -> DataFrame:
    """What `emit` has given of a table of messages when its timers before `until` (a column or a timestamp) have run."""
    m = _messages(messages)
    order = Window.partitionBy("key").orderBy("ms", F.desc("kind"), "version", "event_id")  # acks of a time come before its writes in `emit`, and end what was written before
    writes = m.where("kind = 'write'").withColumn("top", F.max("version").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    writes = writes.where("top is null or version >= top")
    writes = writes.withColumn("next", F.lead("ms").over(order)).withColumn("n", F.row_number().over(order))
    acks = m.where("kind = 'ack'").select("key", "event_id", F.col("ms").alias("ack"))
    ends = writes.alias("w").join(acks.alias("a"), ["key", "event_id"], "left").groupBy("key", "event_id", "version", "n", F.col("ms"), F.col("next")).agg(F.min(F.when(F.col("ack") > F.col("ms"), F.col("ack"))).alias("ack"))
    last = F.least(F.coalesce("next", F.lit(1 << 62)), F.coalesce("ack", F.lit(1 << 62)), F.unix_millis(F.lit(until).cast("timestamp")))
    each = ends.withColumn("last", last).withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(retries + 1))))
    due = F.col("ms") + window + F.col("attempt") * lease
    status = F.when(F.col("attempt") > retries, "dead").otherwise("emit")
    return each.withColumn("due", due).where("due < last").select("key", "event_id", "version", "attempt", status.alias("status"), F.timestamp_millis("due").alias("at"))
