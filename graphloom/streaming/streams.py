"""Structured Streaming operators with batch twins: dedup, coalescing, fences, rate limits, dead letters, windows.

Streams come from any source with the columns named; tests use file and memory sources.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def message_key(df: DataFrame) -> DataFrame:
    """dedup_key = tenant:key, or tenant:topic:partition:offset without a key."""
    place = F.concat_ws(":", "topic", F.col("partition").cast("string"), F.col("offset").cast("string"))
    return df.withColumn("dedup_key", F.concat_ws(":", "tenant_id", F.coalesce(F.nullif(F.col("key"), F.lit("")), place)))


def dedup(df: DataFrame, keys: list[str], ts: str = "ts", horizon: str = "168 hours") -> DataFrame:
    """The first row of each key. A stream forgets a key after the horizon, which bounds its state, so a repeat that comes later passes there; a batch sees all rows and drops it."""
    if df.isStreaming:
        return df.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(keys)
    w = Window.partitionBy(*keys).orderBy(ts)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def coalesce_last(df: DataFrame, keys: list[str], gap: str = "5 seconds", ts: str = "ts", delay: str = "10 seconds") -> DataFrame:
    """One row per key and debounce session (closed after a gap): the last event as a struct, and how many it stands for."""
    rows = df.withWatermark(ts, delay) if df.isStreaming else df
    last = F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.col(ts))
    return rows.groupBy(*keys, F.session_window(ts, gap).alias("session")).agg(last.alias("last"), F.count("*").alias("n_events"))


def version_fence(df: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """Batch: rows below the largest version of their key are dropped, equal ones stay."""
    return df.withColumn("_top", F.max(version).over(Window.partitionBy(*keys))).where(F.col(version) >= F.col("_top")).drop("_top")


def version_fence_stream(df: DataFrame, key: str, version: str = "version") -> DataFrame:
    """Streaming: an event passes unless a larger version of its key has passed before."""

    def run(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top = state.get[0] if state.exists else None
        for pdf in batches:
            pdf = pdf.sort_values(version)
            top = max(pdf[version].max(), top) if top is not None else pdf[version].max()
            state.update((int(top),))
            yield pdf[pdf[version] >= top]

    return df.groupBy(key).applyInPandasWithState(run, df.schema, f"top {dict(df.dtypes)[version]}", "append", GroupStateTimeout.NoTimeout)


def observed_rate(df: DataFrame, keys: list[str], seconds: int = 60, ts: str = "ts") -> DataFrame:
    """rate: events of the key in the last seconds, this one included."""
    w = Window.partitionBy(*keys).orderBy(F.unix_seconds(F.col(ts).cast("timestamp"))).rangeBetween(-seconds, 0)
    return df.withColumn("rate", F.count("*").over(w))


def admit(times: list[float], costs: list[float], limit: float, seconds: float) -> list[bool]:
    """Sliding-window admission in order: an event passes if what passed in the last seconds plus its cost is within the limit; denials cost nothing."""
    out, kept, total, at = [], [], 0.0, 0
    for t, c in zip(times, costs, strict=True):
        while at < len(kept) and kept[at][0] <= t - seconds:
            total -= kept[at][1]
            at += 1
        ok = total + c <= limit
        if ok:
            kept.append((t, c))
            total += c
        out.append(ok)
    return out


def rate_limit(df: DataFrame, key: str, limit: float = 20, seconds: float = 60, ts: str = "ts", cost: str | None = None) -> DataFrame:
    """The rows with `admitted`; works on batches and, with state per key, on streams. Null is a key like others."""

    def judge(pdf: pd.DataFrame, before: list[tuple[float, float]]) -> tuple[pd.DataFrame, list[tuple[float, float]]]:
        pdf = pdf.sort_values(ts, kind="stable")
        t = (pdf[ts].astype("int64") / 1e9 if str(pdf[ts].dtype).endswith("ns]") else pdf[ts].astype("int64") / 1e6).tolist()
        c = pdf[cost].tolist() if cost else [1.0] * len(t)
        ok = admit([x for x, _ in before] + t, [x for _, x in before] + c, limit, seconds)[len(before) :]
        kept = [(a, b) for a, b in before + [(a, b) for a, b, k in zip(t, c, ok, strict=True) if k] if not t or a > t[-1] - seconds]
        return pdf.assign(admitted=ok), kept

    schema = ", ".join(f"`{n}` {k}" for n, k in df.dtypes) + ", admitted boolean"

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, before = object(), []
        for pdf in batches:  # sorted by key and time; only what the last key still holds in its window is kept
            for value, part in pdf.groupby(key, sort=False, dropna=False):
                value = None if pd.isna(value) else value
                out, before = judge(part, before if value == own else [])
                own = value
                yield out

    if not df.isStreaming:
        return df.repartition(key).sortWithinPartitions(key, ts).mapInPandas(replay, schema)

    def run(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = list(zip(*state.get, strict=True)) if state.exists else []
        for pdf in batches:
            out, before = judge(pdf, before)
            state.update(([a for a, _ in before], [b for _, b in before]))
            yield out

    return df.groupBy(key).applyInPandasWithState(run, schema, "times array<double>, costs array<double>", "append", GroupStateTimeout.NoTimeout)


def with_dead_letters(df: DataFrame, sink: Callable[[DataFrame, int], None], dead: Callable[[DataFrame, int], None], attempts: int = 4) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows with an error go to `dead`, the rest to `sink`; a sink that fails `attempts` times sends the batch to `dead`."""
    del df

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        dead(batch.where("error is not null"), epoch)
        good = batch.where("error is null")
        for k in range(attempts):
            try:
                sink(good, epoch)
                break
            except Exception as e:  # noqa: BLE001
                if k == attempts - 1:
                    dead(good.withColumn("error", F.lit(str(e)[:500])), epoch)
        batch.unpersist()

    return write


def dispatch(df: DataFrame) -> DataFrame:
    """action: delete or upsert by the type of mutation; malformed rows are skipped."""
    action = F.when(F.col("mutation_type").isin("edge_tombstone", "node_delete"), "delete").when(F.col("mutation_type").isin("node_upsert", "edge_upsert"), "upsert")
    return df.withColumn("action", action).where("action is not null and size(entity_ids) > 0")


def consumer_lag(consumed: DataFrame, ends: DataFrame) -> DataFrame:
    """lag = high water - last offset - 1, at least 0, for each topic and partition."""
    top = consumed.groupBy("topic", "partition").agg(F.max("offset").alias("last"))
    return ends.join(top, ["topic", "partition"], "left").select("topic", "partition", F.greatest(F.lit(0), F.col("high_water") - F.coalesce("last", F.lit(-1)) - 1).alias("lag"))


def windowed(df: DataFrame, keys: list[str], size: str = "5 minutes", slide: str | None = None, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window, late rows beyond the delay dropped on streams."""
    rows = df.withWatermark(ts, delay) if df.isStreaming else df
    out = rows.groupBy(F.window(ts, size, slide) if slide else F.window(ts, size), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "n", "total")
