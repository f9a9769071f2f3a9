"""Structural embeddings by sparse random projection: vectors as arrays, layers that can be updated, and the guard of a graph's size.

A node's first layer is a row of random signs, a hash of its id and each position; every further layer is the mean of its neighbours' last layer, and the
embedding is a weighted sum of the layers. Vectors meet in Arrow: each task adds up what its own rows give to a node, and the partial sums of a node are added as a stream of
rows in its order, so a hub's neighbours are never held together.

Layers are rows (id, layer, v). After some edges change, layer k of a node can only change within k - 1 hops of a changed edge's end, so an update computes those rows anew from
the stored ones and keeps the rest; the result is that of a full run.

Defined results: edges with a null end are left out, repeated edges count each time, a self loop counts twice, as both of its ends are the node's; nodes that lose their last edge lose their rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut_lineage, remove, shared_folder, stored

DIMS, WEIGHTS = 128, (0.0, 1.0, 1.0, 0.8)
#: So many numbers of a vector travel along the edges at a time.
STEP = 32


def guard(nodes: int, most_nodes: int = 50_000_000, bytes_per_node: int = 8 * DIMS * 4, most_mb: float = 1_000_000) -> None:
    """Refuses a projection of more nodes, or of more estimated memory, than allowed; nothing is cut to fit."""
    if nodes > most_nodes:
        raise ValueError(f"the graph has {nodes} nodes, above the limit of {most_nodes}")
    if nodes * bytes_per_node / 2**20 > most_mb:
        raise ValueError(f"{nodes} nodes of {bytes_per_node} bytes exceed {most_mb} MB")


def signs(node: Column, dims: int = DIMS) -> Column:
    """array<double>: the square root of 3, its negative, or 0, with chances of 1, 1 and 4 in 6."""
    h = lambda k: F.conv(F.substring(F.md5(F.concat(node.cast("string"), F.lit(":"), k.cast("string"))), 1, 8), 16, 10).cast("long") % 6
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.when(h(k) == 0, math.sqrt(3.0)).when(h(k) == 1, -math.sqrt(3.0)).otherwise(0.0))


def _both(edges: DataFrame) -> DataFrame:
    e = edges.where("src is not null and dst is not null").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return e.union(e.select("b", "a")).groupBy("a", "b").agg(F.count("*").alias("m"))


def _added(rows: DataFrame, kind: str, dims: int, mean: bool = True) -> DataFrame:
    """(a, v): the sums of n * v by a, divided by the sum of n if mean; first within tasks, then over all."""

    def fold(batches: Iterator[pa.RecordBatch], weigh: bool, divide: bool) -> Iterator[pa.RecordBatch]:
        """Adds rows of equal a that stand together; a batch's last group is carried to the next."""
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column(2).flatten()).reshape(-1, dims)
            n, own = b.column(1).to_numpy(), b.column(0)
            x = x * n[:, None] if weigh else x
            new = np.concatenate([[True], np.asarray(pc.not_equal(own[1:], own[:-1]))]) if b.num_rows > 1 else np.ones(1, bool)
            first = np.flatnonzero(new)
            ids, counts, total = own.take(pa.array(first)), np.add.reduceat(n, first), np.add.reduceat(x, first, axis=0)
            if held is not None:
                if held[0][0] == ids[0]:
                    counts[0], total[0] = counts[0] + held[1][0], total[0] + held[2][0]
                else:
                    yield made(*held, divide)
            if len(first) > 1:
                yield made(ids[:-1], counts[:-1], total[:-1], divide)
            held = ids[-1:], counts[-1:], total[-1:]
        if held is not None:
            yield made(*held, divide)

    def made(ids, counts, total, divide) -> pa.RecordBatch:
        total = total / counts[:, None] if divide else total
        lists = pa.FixedSizeListArray.from_arrays(pa.array(total.reshape(-1)), dims).cast(pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([ids, pa.array(counts), lists], ["a", "n", "v"])

    schema = f"a {kind}, n long, v array<double>"
    own = rows.select("a", "n", "v").sortWithinPartitions("a").mapInArrow(lambda x: fold(x, True, False), schema)
    return own.repartition("a").sortWithinPartitions("a").mapInArrow(lambda x: fold(x, False, mean), schema).select("a", "v")


def _means(both: DataFrame, vectors: DataFrame, dims: int, signed: bool = False) -> DataFrame:
    """(id, v): the mean of the neighbours' vectors; -0.0 stays what it is only if signed."""
    met = both.join(vectors, both["b"] == vectors["id"]).select("a", F.col("m").alias("n"), "v")
    if dims <= STEP and not signed:  # short vectors are summed as columns, in place, without a sort
        sums = met.groupBy("a").agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * F.col("v")[k]).alias(f"s{k}") for k in range(dims)))
        return sums.select(F.col("a").alias("id"), F.array(*(F.col(f"s{k}") / F.col("n") for k in range(dims))).alias("v"))
    return _added(met, dict(both.dtypes)["a"], dims).select(F.col("a").alias("id"), "v")


def values(edges: DataFrame, dims: int, weights: tuple[float, ...], first: Callable[[Column, int, int], Column], step: int = STEP) -> DataFrame:
    """(id, pos, value): the weighted sum of all layers, of which first(id, from, until) makes layer 0; a value without any term has no row.

    Positions are worked off in groups of `step`, so what travels along the edges at a time is `step` numbers an edge, and no group leaves more than its values.
    A vector's -0.0 stands for "no term": sums, means and positive factors keep it, and a sum with another term loses it, even if it is nought.
    """
    spark, kept = edges.sparkSession, []
    both, folder = stored(_both(edges))
    kind = dict(both.dtypes)["a"]
    out = f"id {kind}, pos int, value double"
    path = f"{shared_folder(spark)}/values-{uuid.uuid4().hex}"

    def told(lo: int, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(1).flatten()).reshape(-1, width)
            row, at = np.nonzero((x != 0) | ~np.signbit(x))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array((at + lo).astype(np.int32)), pa.array(x[row, at])], ["id", "pos", "value"])

    def term(x: Column, w: float) -> Column:
        return F.transform(x, lambda y: F.when((y == 0) & y.cast("string").startswith("-"), y).otherwise(y * w + 0.0))

    for lo in range(0, dims, step):
        width = min(step, dims - lo)
        last = both.select(F.col("a").alias("id")).distinct().withColumn("v", first(F.col("id"), lo, lo + width))
        parts = [last.select("id", term(F.col("v"), weights[0]).alias("v"))]
        for w in weights[1:]:
            last, at = stored(_means(both, last, width, signed=True))
            kept.append(at)
            parts.append(last.select("id", term(F.col("v"), w).alias("v")))
        rows = reduce(DataFrame.union, parts).select(F.col("id").alias("a"), F.lit(1).cast("long").alias("n"), "v")
        stored(_added(rows, kind, width, mean=False).mapInArrow(lambda x, lo=lo, width=width: told(lo, width, x), out), path, "append")
        for at in kept:
            remove(spark, at)
        kept = []
    remove(spark, folder)
    return spark.read.schema(out).parquet(path)


def layers(edges: DataFrame, dims: int = DIMS, depth: int = len(WEIGHTS) - 1) -> DataFrame:
    """(id, layer, v): layers 1 to depth; layer 0 is signs(id)."""
    both = cut_lineage(_both(edges))
    last, out = both.select(F.col("a").alias("id")).distinct().withColumn("v", signs(F.col("id"), dims)), None
    for k in range(1, depth + 1):
        last = cut_lineage(_means(both, last, dims))
        own = last.select("id", F.lit(k).alias("layer"), "v")
        out = own if out is None else out.union(own)
    return out


def updated(stored: DataFrame, edges: DataFrame, changed: DataFrame, dims: int = DIMS, depth: int = len(WEIGHTS) - 1) -> tuple[DataFrame, DataFrame]:
    """(layers of the graph as it is now, ids whose rows were computed anew): stored are the layers before, edges all edges now, and changed those that came or went."""
    both = cut_lineage(_both(edges))
    ends = changed.select(F.explode(F.array("src", "dst")).alias("id")).where("id is not null").distinct()
    near = cut_lineage(ends)
    alive = both.select(F.col("a").alias("id")).distinct()
    last, out = None, None
    for k in range(1, depth + 1):
        own = cut_lineage(both.join(near.withColumnRenamed("id", "a"), "a", "left_semi"))
        asked = own.select(F.col("b").alias("id")).distinct()
        if k == 1:
            below = asked.withColumn("v", signs(F.col("id"), dims))
        else:
            kept = stored.where(F.col("layer") == k - 1).join(asked, "id", "left_semi").join(last.select("id"), "id", "left_anti").select("id", "v")
            below = kept.union(last.join(asked, "id", "left_semi").select("id", "v"))
        last = cut_lineage(_means(own, below, dims))
        old = stored.where(F.col("layer") == k).join(near, "id", "left_anti").select("id", "layer", "v")
        new = old.union(last.select("id", F.lit(k).alias("layer"), "v"))
        out = new if out is None else out.union(new)
        if k < depth:
            near = cut_lineage(near.union(own.select(F.col("b").alias("id"))).distinct())
    return out.join(alive, "id", "left_semi"), near


def embeddings(layer_rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, dims: int = DIMS) -> DataFrame:
    """(id, embedding): the weighted sum of a node's layers, of which there are as many rows as weights but one."""
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), F.col("layer") + 1)
    got = layer_rows.select("id", F.transform("v", lambda x: x * w).alias("v")).groupBy("id").agg(F.collect_list("v").alias("vs"))
    own = F.transform(signs(F.col("id"), dims), lambda x: x * F.lit(float(weights[0]))) if weights[0] else F.array_repeat(F.lit(0.0), dims)
    return got.select("id", F.aggregate("vs", own, lambda s, v: F.zip_with(s, v, lambda a, b: a + b)).alias("embedding"))
