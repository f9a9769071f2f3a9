"""Pattern matching over node and edge tables.

nodes: id, label, name, tenant_id, ...; edges: src, rel, dst, tenant_id, tombstoned_day (null: live).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import cut_lineage


def live(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("tombstoned_day").isNull())


def tenant_view(nodes: DataFrame, edges: DataFrame, tenant: str | None, acl: list[str] | None = None, admin: bool = False, allow_untagged: bool = False) -> tuple[DataFrame, DataFrame]:
    """Only what a principal may see. None skips the tenant (maintenance only); acl None skips the labels."""
    if tenant is not None:
        nodes, edges = nodes.where(F.col("tenant_id") == tenant), edges.where(F.col("tenant_id") == tenant)
    if acl is not None and not admin:
        nodes = nodes.where(acl_predicate(F.col("acl_label"), acl, allow_untagged))
    return nodes, edges


def acl_predicate(label: Column, acl: list[str], allow_untagged: bool = False) -> Column:
    own = label.isin(acl) if acl else label == "Team_public"
    return F.coalesce(own, F.lit(False)) | (label.isNull() if allow_untagged else F.lit(False))


def hop(nodes: DataFrame, edges: DataFrame, rels: list[str] | None = None) -> DataFrame:
    """Directed source-edge-target rows: s_*, rel, protocol, t_*."""
    e = live(edges) if rels is None else live(edges).where(F.col("rel").isin(rels))
    s = nodes.select([F.col(c).alias(f"s_{c}") for c in nodes.columns])
    t = nodes.select([F.col(c).alias(f"t_{c}") for c in nodes.columns])
    return e.select("src", "rel", "dst", "protocol").join(s, F.col("src") == F.col("s_id")).join(t, F.col("dst") == F.col("t_id")).drop("src", "dst")


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge both ways, self loops once; eid names the edge."""
    e = edges.withColumn("eid", F.xxhash64("src", "rel", "dst"))
    back = e.where("src <> dst").withColumns({"src": F.col("dst"), "dst": F.col("src")})
    return e.unionByName(back)


def degree(nodes: DataFrame, edges: DataFrame, live_only: bool = False) -> DataFrame:
    """id, degree (undirected, dead edges too unless live_only), zeros kept."""
    e = live(edges) if live_only else edges
    ends = e.select(F.explode(F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.array("src", "dst"))).alias("id"))
    return nodes.select("id").join(ends.groupBy("id").agg(F.count("*").alias("degree")), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def reach(seeds: DataFrame, edges: DataFrame, hops: int, keep_parents: bool = False) -> DataFrame:
    """(seed, id, hops): nodes within hops edges of each seed, with the least number; a seed itself only by a cycle.

    A frontier is joined with the edges once a hop; visited pairs are never expanded again.
    """
    e = live(edges).select("src", "dst").distinct()
    frontier = seeds.select(F.col("id").alias("seed"), "id").distinct()
    found: list[DataFrame] = []
    for k in range(1, hops + 1):
        step = frontier.join(e, frontier["id"] == e["src"]).select("seed", F.col("dst").alias("id")).distinct()
        if found:
            step = step.join(reduce(DataFrame.unionByName, found), ["seed", "id"], "left_anti")
        step = step.withColumn("hops", F.lit(k))
        if k > 2:
            step = cut_lineage(step)
        found.append(step)
        frontier = step.drop("hops")
    return reduce(DataFrame.unionByName, found)


def paths(seeds: DataFrame, edges: DataFrame, low: int, high: int) -> DataFrame:
    """(seed, id, hops, rels): one row for each path of low..high edges that repeats no edge. edges need eid."""
    if high > 5:
        raise ValueError("paths are bounded to five hops")
    e = edges.select("src", "rel", "dst", "eid")
    at = seeds.select(F.col("id").alias("seed"), "id", F.array().cast("array<bigint>").alias("eids"), F.array().cast("array<string>").alias("rels"))
    found = []
    for k in range(1, high + 1):
        at = (
            at.join(e, at["id"] == e["src"])
            .where(~F.array_contains("eids", F.col("eid")))
            .select("seed", F.col("dst").alias("id"), F.array_append("eids", F.col("eid")).alias("eids"), F.array_append("rels", F.col("rel")).alias("rels"))
        )
        if k >= low:
            found.append(at.select("seed", "id", F.lit(k).alias("hops"), "rels"))
    return reduce(DataFrame.unionByName, found)


def per_source_top(nodes: DataFrame, edges: DataFrame, k: int, max_degree: int | None = None) -> DataFrame:
    """For each source its k targets of the largest degree, ties to the smaller id."""
    d = degree(nodes, edges).withColumnRenamed("id", "dst")
    rows = live(edges).join(d, "dst")
    if max_degree is not None:
        rows = rows.where(F.col("degree") < max_degree)
    w = Window.partitionBy("src").orderBy(F.desc("degree"), "dst", "rel")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("src", "rank", "rel", "dst", "degree")


def expand_beam(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int = 5, beam: int = 50, per_source: int = 50, degree_cap: int = 500) -> DataFrame:
    """Bounded breadth-first expansion: at each hop the beam best new nodes by degree go on (pagerank absent: degree / 1000)."""
    step_rows = per_source_top(nodes, edges, per_source)
    d = degree(nodes, edges)
    frontier = cut_lineage(seeds.select("id").distinct().join(d, "id").where(F.col("degree") <= degree_cap).select("id"))
    visited, found = seeds.select("id").distinct(), None
    for k in range(1, hops + 1):
        new = step_rows.join(frontier, step_rows["src"] == frontier["id"]).groupBy("dst", "degree").agg(F.min("src").alias("parent"))
        new = new.withColumnRenamed("dst", "id").join(visited, "id", "left_anti")
        new = cut_lineage(new.orderBy(F.desc("degree"), "id").limit(beam).select("id", "parent", "degree", F.lit(k).alias("hop")))
        found = new if found is None else found.unionByName(new)
        visited = visited.union(new.select("id"))
        frontier = new.select("id")
    return found


def cap(df: DataFrame, rows: int = 1000) -> DataFrame:
    """The global result cap; order first to make it deterministic."""
    return df.limit(rows)
