"""Outbox tables: what is to be sent, what was sent, and what is to be tried again. Each function gives the table's next state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def written(store: DataFrame, events: DataFrame) -> DataFrame:
    """store and events (event_id, collection, ids, version, status, retry_count): one pending event for each collection and set of ids, the one of the
    largest version; events that a newer version has overtaken are fenced off, and what is claimed or done stays."""
    key = F.sha2(F.concat_ws("|", "collection", F.array_join(F.array_sort("ids"), ",")), 256)
    new = events.withColumns({"status": F.lit("pending"), "retry_count": F.lit(0), "dedup_key": key})
    both = store.withColumn("dedup_key", key).unionByName(new.select(*store.columns, "dedup_key"))
    top = both.groupBy("dedup_key").agg(F.max("version").alias("_top"))
    both = both.join(top, "dedup_key")
    order = Window.partitionBy("dedup_key").orderBy(F.desc("version"), "event_id")
    waiting = both.where((F.col("status") == "pending") & (F.col("version") >= F.col("_top"))).withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return both.where("status <> 'pending'").select(store.columns).union(waiting.select(store.columns))


def claimed(store: DataFrame, limit: int) -> DataFrame:
    """The first pending events, by version and id."""
    return store.where("status = 'pending'").orderBy("version", "event_id").limit(limit)


def settled(store: DataFrame, outcomes: DataFrame, retries: int = 3) -> DataFrame:
    """store after outcomes (event_id, ok): done ones go, failed ones are pending again until their retries are used up, then dead."""
    out = store.join(outcomes.groupBy("event_id").agg(F.bool_and("ok").alias("_ok")), "event_id", "left").where("coalesce(_ok, false) = false")
    n = F.col("retry_count") + F.when(F.col("_ok").isNotNull(), 1).otherwise(0)
    status = F.when(F.col("_ok").isNull(), F.col("status")).when(n >= retries, "dead").otherwise("pending")
    return out.withColumns({"status": status, "retry_count": n}).select(store.columns)


def to_emit(records: DataFrame, now: Column, age: str = "30 seconds") -> DataFrame:
    """Records (written_at, status) that are pending for longer than the age."""
    return records.where((F.col("status") == "pending") & (F.col("written_at") < now - F.expr(f"interval {age}")))


def route(stream_up: bool, strategy: str = "memory") -> str:
    """Where events go: the stream, else memory, or an error if the strategy rejects."""
    if stream_up:
        return "stream"
    if strategy == "reject":
        raise RuntimeError("the stream is down and the strategy rejects")
    return "memory"


def invalidated(cache: DataFrame, messages: DataFrame, most: int = 500) -> DataFrame:
    """cache (key, tags) without entries that any of a message's first `most` node ids tags."""
    ids = messages.select(F.explode(F.slice("node_ids", 1, most)).alias("tag")).distinct()
    hit = cache.select("key", F.explode("tags").alias("tag")).join(ids, "tag", "left_semi").select("key").distinct()
    return cache.join(hit, "key", "left_anti")


def batches(rows: DataFrame, size: int = 2048) -> DataFrame:
    """rows and batch: numbered groups of at most size rows, by id, for a service that takes several at once."""
    from graphloom.operators.context import prefix_sums

    return prefix_sums(rows.withColumn("_one", F.lit(1)), ("id",), "_one", "_n").withColumn("batch", F.floor((F.col("_n") - 1) / size).cast("int")).drop("_one", "_n")
