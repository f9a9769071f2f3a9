"""Answer quality over tables of answers and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import cosine

# Words that are no entities.
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can not no and or but if then else "
    "when where how what which who whom this that these those it its to of in for on with at by from as into through during before after above below "
    "between out off over under again further all each every both few more most other some such only very"
).split()


def entities(text: Column) -> Column:
    """Lower-case words and hyphenated words, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)*)"), F.lit(1)), lambda x: F.lower(x)))


def faithfulness(answer: Column, context: Column) -> Column:
    """Share of the answer's entities (no stop words, over two letters) that the context has; 1 without answer, context or entities."""
    own = F.filter(F.array_except(entities(answer), F.array(*map(F.lit, STOP_WORDS))), lambda x: F.length(x) > 2)
    missing = F.size(F.array_except(own, entities(context)))
    empty = (F.coalesce(answer, F.lit("")) == "") | (F.coalesce(context, F.lit("")) == "") | (F.size(own) == 0)
    return F.when(empty, 1.0).otherwise(1 - missing / F.size(own))


def groundedness(answer: Column, context: Column) -> Column:
    """Share of the answer's entities over two letters that equal, hold or are held by one of the context."""
    own, have = F.filter(entities(answer), lambda x: F.length(x) > 2), entities(context)
    hit = F.size(F.filter(own, lambda x: F.exists(have, lambda c: F.contains(c, x) | F.contains(x, c))))
    empty = (F.coalesce(answer, F.lit("")) == "") | (F.coalesce(context, F.lit("")) == "") | (F.size(own) == 0)
    return F.when(empty, 1.0).otherwise(hit / F.size(own))


def combined(relevance: Column, faithful: Column, grounded: Column) -> Column:
    return 0.3 * relevance + 0.4 * faithful + 0.3 * grounded


def relevance(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The mean cosine of (query, context) vectors for each key."""
    return pairs.groupBy(*keys).agg(F.avg(cosine(F.col("query"), F.col("context"))).alias("relevance"))


def topology_score(claimed: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the share of claimed (src, rel, dst) that are live edges (1 if none is claimed)."""
    real = edges.where("tombstoned_day is null").select("src", "rel", "dst").distinct().withColumn("ok", F.lit(1))
    out = claimed.join(real, ["src", "rel", "dst"], "left").agg(F.sum(F.coalesce("ok", F.lit(0))).alias("k"), F.count("*").alias("n"))
    return out.select(F.when(F.col("n") == 0, 1.0).otherwise(F.col("k") / F.col("n")).alias("edge_ratio"))


def composite(vector: Column, topology: Column, alpha: float = 0.6) -> Column:
    return alpha * vector + (1 - alpha) * topology


def incoherent(answer: Column, context: Column) -> Column:
    """Names with a service-like suffix in the answer that the context lacks."""
    named = lambda t: F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(r"(?i)\b([a-z0-9-]+-(?:svc|service|api|topic|db))\b"), F.lit(1)), lambda x: F.lower(x)))
    return F.array_sort(F.array_except(named(answer), named(context)))


def error_budget(events: DataFrame, keys: list[str], target: float = 0.99) -> DataFrame:
    """Error rate and the share of the error budget that is left, by key."""
    rate = F.avg(F.col("is_error").cast("int"))
    return events.groupBy(*keys).agg(F.count("*").alias("n"), rate.alias("error_rate")).withColumn("budget_left", 1 - F.col("error_rate") / (1 - target))
