"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut_lineage


def heavy_join(rows: DataFrame, facts: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows joined with facts (one row for each value of keys, and n: how many of the total rows have it) without a heavy task.

    Keys that hold more than one in 4 x shuffle partitions of all rows are looked up in a broadcast table, which can have at most
    4 x shuffle partitions of them, whatever the input; the others are shuffled. Column n is left out of the result.
    """
    least = total / (4 * max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    told = [c for c in facts.columns if c not in (*keys, "n")]
    heavy = facts.where(F.col("n") > least).select(*keys, *(F.col(c).alias(f"_{c}") for c in told))
    tagged = rows.join(F.broadcast(heavy), keys, "left")
    out = [*rows.columns, *told]
    hot = tagged.where(F.col(f"_{told[0]}").isNotNull()).select(*rows.columns, *(F.col(f"_{c}").alias(c) for c in told))
    rest = tagged.where(F.col(f"_{told[0]}").isNull()).select(rows.columns)
    return rest.join(facts.where(F.col("n") <= least).drop("n"), keys).select(out).union(hot.select(out))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lows = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    return heavy_join(both, lows, ["u"], 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lows = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = heavy_join(down, lows, ["u"], n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(lows.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id on an edge; component is the least id reached.

    Null ends and self loops are ignored, repeated edges count once, no edges give no rows. Each round costs four
    shuffles of the edge list, which shrinks towards one row per vertex; rounds grow with the logarithm of the diameter.
    The edges of a vertex with very many neighbours stay where they are and look up its least neighbour.
    """
    e = (
        edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    e = cut_lineage(e)
    last = (e.count(),)
    for _ in range(max_rounds):
        e = cut_lineage(_small_star(_large_star(e, last[0]), last[0]))
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
