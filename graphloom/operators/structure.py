"""Structure of graphs of any size: blocks and cut vertices.

They are rounds of joins and grouped aggregates over rows of edges; no component meets in one task, and only counts reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.components import connected_components, heavy_join
from graphloom.operators.context import prefix_sums
from graphloom.session import cut_lineage


def simple(edges: DataFrame) -> DataFrame:
    """(a, b): every edge between two different nodes both ways, once."""
    e = edges.where("src is not null and dst is not null and src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return e.union(e.select("b", "a")).distinct()


def spanning_forest(both: DataFrame) -> tuple[DataFrame, int]:
    """((id, parent, level), depth): breadth-first trees from each component's least node, parents being the least possible; roots have no parent."""
    kind = dict(both.dtypes)["a"]
    comp = connected_components(both, "a", "b")
    frontier = cut_lineage(comp.select(F.col("component").alias("id")).distinct().select("id", F.lit(None).cast(kind).alias("parent"), F.lit(0).alias("level")))
    # A neighbour of the frontier is at most one level away, so these levels are all that need be left out, and each is written once.
    tree, level = [frontier], 0
    while True:
        near = reduce(DataFrame.union, tree[-2:]).select(F.col("id").alias("b"))
        new = frontier.select(F.col("id").alias("a")).join(both, "a").join(near, "b", "left_anti").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("parent"))
        new = cut_lineage(new.withColumn("level", F.lit(level + 1)))
        if new.isEmpty():
            return cut_lineage(reduce(DataFrame.union, tree)), level
        tree, frontier, level = [*tree, new], new, level + 1


def _upwards(rows: DataFrame, depth: int, how: dict) -> DataFrame:
    """rows (id, parent, level, ...) with each column of `how` folded over a node's whole subtree, level by level from below. how: column -> (aggregate, of two)."""
    cols, done, below = list(how), None, None
    for level in range(depth, -1, -1):
        own = rows.where(F.col("level") == level)
        if below is not None:
            sums = below.groupBy(F.col("parent").alias("id")).agg(*(how[c][0](c).alias(f"_{c}") for c in cols))
            own = own.join(sums, "id", "left").withColumns({c: F.coalesce(how[c][1](F.col(c), F.col(f"_{c}")), F.col(c)) for c in cols}).drop(*(f"_{c}" for c in cols))
        below = cut_lineage(own.select(rows.columns))
        done = below if done is None else done.union(below)
    return done


def _preorder(sized: DataFrame, depth: int) -> DataFrame:
    """sized (id, parent, level, size) and pre: places in a walk that visits a node before its subtrees, and these by id. What the siblings before hold is a running sum made by ranges."""
    ranked = prefix_sums(sized.withColumn("key", F.coalesce(F.col("parent").cast("string"), F.lit(""))).withColumn("up", F.col("parent").isNotNull()), ("up", "key", "id"), "size", "run")
    firsts = ranked.groupBy("up", "key").agg(F.min(F.col("run") - F.col("size")).alias("base"), F.count("*").alias("n"))
    ahead = heavy_join(ranked, cut_lineage(firsts), ["up", "key"], ranked.count()).select("id", "parent", "level", "size", (F.col("run") - F.col("size") - F.col("base")).alias("ahead"))
    ahead = cut_lineage(ahead)
    last = cut_lineage(ahead.where("level = 0").withColumn("pre", F.col("ahead")))  # roots follow each other
    out = last
    for level in range(1, depth + 1):
        tops = last.select(F.col("id").alias("parent"), F.col("pre").alias("top"))
        last = cut_lineage(ahead.where(F.col("level") == level).join(tops, "parent").select("id", "parent", "level", "size", "ahead", (F.col("top") + 1 + F.col("ahead")).alias("pre")))
        out = out.union(last)
    return out.select("id", "parent", "level", "size", "pre")


def blocks(edges: DataFrame) -> DataFrame:
    """(id, block): the biconnected components that each node belongs to; a block is named after the least of the nodes whose tree edge lies in it.

    Two tree edges lie in one block if an edge outside the tree joins their subtrees, or if the lower one's subtree has an edge that leaves the upper end's: these pairs, of
    which there are at most as many as edges, form a graph whose components are the blocks. Rounds grow with the depth of the breadth-first trees.
    """
    both = cut_lineage(simple(edges))
    tree, depth = spanning_forest(both)
    sized = cut_lineage(_upwards(tree.withColumn("size", F.lit(1).cast("long")), depth, {"size": (F.sum, lambda a, b: a + b)}))
    placed = cut_lineage(_preorder(sized, depth))
    about = placed.select("id", "parent", "pre", "size")
    a, b = about.toDF("a", "pa", "na", "sa"), about.toDF("b", "pb", "nb", "sb")
    ends = cut_lineage(both.join(a, "a").join(b, "b"))
    outside = ends.where(~(F.col("pa").eqNullSafe(F.col("b")) | F.col("pb").eqNullSafe(F.col("a"))))
    reach = outside.groupBy(F.col("a").alias("id")).agg(F.min("nb").alias("lo"), F.max("nb").alias("hi"))
    own = placed.join(reach, "id", "left").select("id", "parent", "level", "pre", "size", F.least("pre", "lo").alias("low"), F.greatest("pre", "hi").alias("high"))
    spans = cut_lineage(_upwards(own, depth, {"low": (F.min, F.least), "high": (F.max, F.greatest)}))
    # A node stands for the tree edge to its parent.
    apart = outside.where((F.col("na") + F.col("sa") <= F.col("nb")) & F.col("pa").isNotNull() & F.col("pb").isNotNull()).select("a", "b")
    up = spans.where("parent is not null").join(placed.select(F.col("id").alias("parent"), F.col("parent").alias("above"), F.col("pre").alias("top"), F.col("size").alias("width")), "parent").where("above is not null")
    leaving = up.where((F.col("low") < F.col("top")) | (F.col("high") >= F.col("top") + F.col("width"))).select(F.col("id").alias("a"), F.col("parent").alias("b"))
    comp = connected_components(apart.union(leaving), "a", "b")
    named = placed.where("parent is not null").select("id", "parent").join(comp, "id", "left").select("id", "parent", F.coalesce("component", "id").alias("block"))
    return named.select("id", "block").union(named.select("parent", "block")).distinct()


def cut_vertices(edges: DataFrame) -> DataFrame:
    """(id): nodes whose removal leaves more components: those that belong to several blocks. Null ends, self loops and repeated edges don't count."""
    return blocks(edges).groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
