"""A stored inverted file for nearest neighbours by cosine, with an exact mode.

Centroids come from a bounded sample: the SAMPLE rows of the least hash of their id, clustered on the driver. Every row is then given to the list of its
nearest centroid and stored in blocks of at most BLOCK vectors; a list keeps the largest angle of its vectors from its centroid. A question visits
the `probes` lists of the nearest centroids. In exact mode it goes on with every list that can still hold a better vector: by the triangle
inequality of angles none is nearer than its centroid's angle less the list's largest. Questions travel packed by list, so that a stored block
meets many of them at once. An increment is a folder of its own, and running it again under its name replaces it.

Defined results: rows with a null id, vectors that are null, zero, of another length than the first centroid, or hold null or non-finite components take no part, as
questions neither; rows that repeat an id are ranked each; a question's own id isn't left out; ties (of scores rounded to nine digits) go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.session import cut_lineage

SAMPLE, BLOCK, ASKED = 20_000, 4096, 512
#: Visited lists unless told: enough for a recall of 0.9 on vectors without any clusters; clustered ones need far fewer.
SHARE = 0.6


def units(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, x): the rows of a list column that have a direction, and their vectors of length one."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.asarray(pc.fill_null(pc.cast(pc.list_flatten(column), pa.float64()), float("nan")))
    start = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])[:-1]
    rows = np.flatnonzero(sizes == width)
    x = flat[start[rows][:, None] + np.arange(width)[None, :]] if len(rows) else np.zeros((0, width))
    with np.errstate(invalid="ignore", over="ignore"):
        norm = np.sqrt((x * x).sum(axis=1))
        ok = np.isfinite(norm) & (norm > 0)
    return rows[ok], x[ok] / norm[ok][:, None]


def angles(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centroids.T, -1.0, 1.0))


def fit(vectors: DataFrame, lists: int = 64, rounds: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> np.ndarray:
    """Unit centroids of the sample, lists x components; fewer if the sample holds fewer different vectors."""
    v = F.transform(vec_col, lambda x: x.cast("double")).alias("v")
    sample = vectors.where(F.col(id_col).isNotNull() & (F.size(vec_col) > 0)).select(F.xxhash64(id_col).alias("h"), v).orderBy("h", "v").limit(SAMPLE).collect()
    if not sample:
        return np.zeros((0, 0))
    width = len(sample[0]["v"])
    x = units(pa.array([r["v"] for r in sample], pa.list_(pa.float64())), width)[1]
    c = np.unique(x, axis=0)
    c = c[np.linspace(0, len(c) - 1, min(lists, len(c))).astype(int)]
    for _ in range(rounds if len(c) else 0):
        own = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.sqrt((total * total).sum(axis=1))
        c = np.where(norm[:, None] > 0, total / np.maximum(norm, 1e-300)[:, None], c)
    return c


def create(spark: SparkSession, folder: str, centroids: np.ndarray) -> None:
    rows = [(k, [float(x) for x in c]) for k, c in enumerate(centroids)]
    spark.createDataFrame(rows, "list int, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centroids")


def centroids(spark: SparkSession, folder: str) -> np.ndarray:
    rows = spark.read.parquet(f"{folder}/centroids").orderBy("list").collect()  # lists x components, both parameters
    return np.array([r["v"] for r in rows]) if rows else np.zeros((0, 0))


def add(vectors: DataFrame, folder: str, batch: str, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
    """Gives every row to its list and stores the lists in blocks; a list of very many rows is dealt over several tasks."""
    spark = vectors.sparkSession
    c = centroids(spark, folder)
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = units(b.column(1), c.shape[1])
            far = angles(x, c)
            own = np.argmin(far, axis=1) if len(at) else np.zeros(0, np.int64)
            data = [r.tobytes() for r in x.astype(np.float64)]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), b.column(0).take(pa.array(at)), pa.array(data, pa.binary()), pa.array(far[np.arange(len(at)), own])], ["list", "id", "x", "angle"])

    if not len(c):
        return
    given = rows.mapInArrow(assign, "list int, id long, x binary, angle double").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(8)))
    dealt = given.repartition("list", "part").sortWithinPartitions("list")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy()
            cut = np.flatnonzero(np.diff(own, prepend=-1))
            for at, to in zip(cut, np.append(cut[1:], len(own)), strict=True):
                for low in range(at, to, BLOCK):
                    part = b.slice(low, min(BLOCK, to - low))
                    data = b"".join(part.column(2).to_pylist())
                    yield pa.RecordBatch.from_pydict({"ids": [part.column(1).to_numpy().astype(np.int64).tobytes()], "data": [data], "n": pa.array([part.num_rows], pa.int32()), "radius": [float(part.column(3).to_numpy().max())], "list": pa.array([own[at]], pa.int32())})

    stored = dealt.mapInArrow(pack, "ids binary, data binary, n int, radius double, list int")
    stored.write.mode("overwrite").partitionBy("list").parquet(f"{folder}/blocks/batch={batch}")


def _blocks(spark: SparkSession, folder: str) -> DataFrame | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/blocks")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.option("basePath", f"{folder}/blocks").schema("ids binary, data binary, n int, radius double, batch string, list int").parquet(f"{folder}/blocks")


def _score(asked: DataFrame, blocks: DataFrame, k: int, width: int) -> DataFrame:
    """(query_id, id, score): of asked rows (query_id, list, x), the k best of each stored block of their lists."""
    dealt = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(8))).repartition("list", "part").sortWithinPartitions("list")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(1).to_numpy()
            cut = np.flatnonzero(np.diff(own, prepend=-1))
            for at, to in zip(cut, np.append(cut[1:], len(own)), strict=True):
                for low in range(at, to, ASKED):
                    part = b.slice(low, min(ASKED, to - low))
                    yield pa.RecordBatch.from_pydict({"list": pa.array([own[at]], pa.int32()), "q_ids": [part.column(0).to_numpy().astype(np.int64).tobytes()], "q_data": [b"".join(part.column(2).to_pylist())]})

    packed = dealt.mapInArrow(pack, "list int, q_ids binary, q_data binary")
    pairs = blocks.join(packed.hint("shuffle_hash"), "list").select("ids", "data", "q_ids", "q_data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, q_ids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
                score = np.frombuffer(r["q_data"]).reshape(-1, width) @ np.frombuffer(r["data"]).reshape(-1, width).T
                keep = np.argpartition(-score, k - 1, axis=1)[:, :k] if score.shape[1] > k else np.broadcast_to(np.arange(score.shape[1]), score.shape)
                floor = np.take_along_axis(score, keep, 1).min(axis=1, keepdims=True)
                at, to = np.nonzero(score >= floor - 1e-9)  # what ties with the k-th after rounding goes on too
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(ids[to]), pa.array(score[at, to])], ["query_id", "id", "score"])

    return pairs.mapInArrow(run, "query_id long, id long, score double")


def search(queries: DataFrame, folder: str, k: int = 10, probes: int | None = None, exact: bool = False) -> DataFrame:
    """(query_id, rank, id, score): of queries (query_id, v) the k nearest by cosine among the probed lists (if not given, SHARE of all), or with exact among all rows."""
    spark = queries.sparkSession
    c, out = centroids(spark, folder), "query_id long, rank int, id long, score double"
    probes = max(1, round(SHARE * len(c))) if probes is None else probes
    blocks = _blocks(spark, folder) if len(c) else None
    if blocks is None:
        return spark.createDataFrame([], out)
    by_score = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    best = lambda df: df.withColumn("rank", F.row_number().over(by_score).cast("int")).where(F.col("rank") <= k)
    radius = np.full(len(c), -1.0)
    for r in blocks.groupBy("list").agg(F.max("radius").alias("radius")).collect():  # one number for each list
        radius[r["list"]] = r["radius"]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lists of a question: the nearest probes, or with a floor those beyond them that may hold a better vector."""
        for b in batches:
            rows, x = units(b.column(1), c.shape[1])
            far = np.where(radius >= 0, angles(x, c), np.inf)
            place = np.argsort(np.argsort(far, axis=1, kind="stable"), axis=1, kind="stable")
            first = (place < probes) & (far < np.inf)
            if b.num_columns > 2:
                floor = b.column(2).to_numpy(zero_copy_only=False)[rows]
                most = np.arccos(np.clip(np.nan_to_num(floor, nan=-1.0), -1, 1))[:, None] + 1e-7
                first = ~first & (far < np.inf) & (np.maximum(far - radius - 1e-7, 0) <= most)
            at, own = np.nonzero(first)
            data = [r.tobytes() for r in x]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[at])), pa.array(own.astype(np.int32)), pa.array([data[n] for n in at], pa.binary())], ["query_id", "list", "x"])

    asked = queries.where("query_id is not null").select(F.col("query_id").cast("long").alias("query_id"), "v")
    form = "query_id long, list int, x binary"
    found = best(_score(asked.mapInArrow(visit, form), blocks, k, c.shape[1]))
    if exact:
        found = cut_lineage(found)
        floors = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        more = _score(asked.join(floors, "query_id", "left").select("query_id", "v", "floor").mapInArrow(visit, form), blocks, k, c.shape[1])
        found = best(found.select("query_id", "id", "score").union(more))
    return found.select("query_id", "rank", "id", "score")
