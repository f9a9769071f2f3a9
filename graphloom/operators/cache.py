"""Semantic cache over DataFrames: entries that are still valid, and the nearest entry of a question's scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import adaptive_threshold, cosine

CAPACITY, BASE = 1024, 0.92


def kept(entries: DataFrame, now: Column, capacity: int = CAPACITY) -> DataFrame:
    """The entries (key, expires_at, used_at, ...) that a bounded cache holds: not expired, and of those the last used, ties to the least key."""
    return entries.where(F.col("expires_at") >= now).orderBy(F.desc("used_at"), "key").limit(capacity)


def lookup(asked: DataFrame, entries: DataFrame, scope: list[str], base: float = BASE, adaptive: bool = False, capacity: int = CAPACITY) -> DataFrame:
    """The rows of asked (embedding, scope columns, ...) with key and similarity of the nearest entry (key, embedding, scope columns) of their scope.

    key is null below the threshold, which depends on the distance to the second best if adaptive; similarities are compared to nine
    decimals, ties go to the least key; a row without entries in its scope, or with a null scope, has neither. A cache is bounded, so its entries are
    broadcast, gathered by scope; more than capacity of them raise. The rows asked aren't shuffled.
    """
    if entries.limit(capacity + 1).count() > capacity:
        raise ValueError(f"more than {capacity} entries; apply kept first")
    near = entries.groupBy(*(F.col(c).alias(f"__{c}") for c in scope)).agg(F.collect_list(F.struct("key", F.col("embedding").alias("v"))).alias("__near"))
    rows = asked.join(F.broadcast(near), [asked[c] == near[f"__{c}"] for c in scope], "left")
    score = lambda e: F.struct((-F.round(F.coalesce(cosine(F.col("embedding"), e["v"]), F.lit(0.0)), 9)).alias("s"), e["key"].alias("key"))
    rows = rows.withColumn("__best", F.slice(F.array_sort(F.transform("__near", score)), 1, 2))
    best, second = (F.get("__best", F.lit(k)) for k in (0, 1))
    threshold = adaptive_threshold(-best["s"], -second["s"], base) if adaptive else F.lit(base)
    return rows.select(*(asked[c] for c in asked.columns), F.when(-best["s"] >= threshold, best["key"]).alias("key"), (-best["s"]).alias("similarity"))
