"""Exact top-k search by columnar branch-and-bound (operator 3).

Candidates are packed in blocks of vertical layout (one contiguous run for each dimension), queries in blocks of rows;
every query block meets every candidate block in an equi-join on block numbers, and only packed blocks are replicated.
For one query the products of one dimension block at a time are accumulated over a candidate block; what the rest can
still add is bounded by the remaining norms (Cauchy-Schwarz), and candidates whose upper bound is below the k-th best
lower bound are compacted away. A task hands the k-th best score of a query from one candidate block to the next. Scores are exact integers.

Defined results: vectors that are null or hold null or non-finite components, and rows with a null id, take no part;
shorter vectors count as padded with zeros; ties go to the smaller id; all rows of the query's own id are left out, and repeated ids of candidates are
ranked each, and repeated ids of queries share one list of the k best of all their rows; components beyond 2**20 after scaling are summed without pruning in 64-bit integers; empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.session import table

CANDIDATE_BLOCK, QUERY_BLOCK, STEP = 8192, 512, 16
LIMIT = 1 << 20


def quantised(vectors: DataFrame, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, v array<long> = floor(scale * x); only complete finite vectors."""
    whole = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.coalesce(whole, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _pack(rows: DataFrame, size: int, vertical: bool) -> DataFrame:
    """Blocks of at most size rows: ids (i64), dims, data (by dimension if vertical, else by row; 32-bit where all numbers are below LIMIT, else 64-bit)."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                vs = part.column(1)
                lens = np.diff(vs.offsets.to_numpy())
                dims = int(lens.max(initial=0))
                data = np.zeros((part.num_rows, dims), np.int64)
                data[np.arange(dims)[None, :] < lens[:, None]] = vs.flatten().to_numpy(zero_copy_only=False)
                data = data.astype(np.int32) if np.abs(data).max(initial=0) < LIMIT else data
                data = np.ascontiguousarray(data.T) if vertical else data
                yield pa.RecordBatch.from_pydict({"ids": [part.column(0).to_numpy().astype(np.int64).tobytes()], "dims": pa.array([dims], pa.int32()), "data": [data.tobytes()]})

    return rows.select("vec_id", "v").mapInArrow(run, "ids binary, dims int, data binary")


def search_block(q: np.ndarray, own: int, ids: np.ndarray, data: np.ndarray, rest: np.ndarray, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, id) of one candidate block; data is dims x n float64, rest[b] the norms from dimension block b on.
    Candidates that can't reach `least` (a k-th best score known already) may be left out."""
    alive = np.flatnonzero(ids != own)
    total = np.zeros(len(alive))
    dims = len(q)
    for b, at in enumerate(range(0, dims, STEP)):
        to = min(at + STEP, dims)
        total += q[at:to] @ (data[at:to] if len(alive) == data.shape[1] else data[at:to, alive])
        if to < dims and len(alive):
            room = np.sqrt(float(q[to:] @ q[to:])) * rest[b + 1][alive] * (1 + 1e-9) + 1e-6
            floor = max(least, np.partition(total - room, len(alive) - k)[len(alive) - k] if len(alive) > k else -np.inf)
            keep = total + room >= floor
            if not keep.all():
                alive, total = alive[keep], total[keep]
    order = np.lexsort((ids[alive], -total))[:k]
    return total[order].astype(np.int64), ids[alive][order]


def _unpack(block, vertical: bool):
    ids = np.frombuffer(block["ids"], np.int64)
    data = np.frombuffer(block["data"], np.int32 if len(block["data"]) == 4 * block["dims"] * len(ids) else np.int64)
    return ids, data.reshape((block["dims"], len(ids)) if vertical else (len(ids), block["dims"]))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score; both inputs as from quantised()."""
    spark = vectors.sparkSession
    n_query = queries.count()
    parts = max(1, -(-n_query // QUERY_BLOCK))
    blocks = _pack(vectors, CANDIDATE_BLOCK, True).select(F.col("ids").alias("c_ids"), F.col("dims").alias("c_dims"), F.col("data").alias("c_data"), F.xxhash64("ids").alias("h"))
    groups = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = blocks.withColumn("g", F.pmod("h", F.lit(groups)).cast("int")).drop("h")
    asked = _pack(queries.repartition(parts, "vec_id"), QUERY_BLOCK, False).select(F.col("ids").alias("q_ids"), F.col("dims").alias("q_dims"), F.col("data").alias("q_data"))
    asked = asked.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    # As many partitions as groups on both sides, kept apart however few their bytes: the work grows with their product.
    pairs = blocks.repartition(groups, "g").join(asked.repartition(groups, "g").hint("shuffle_hash"), "g").drop("g")

    def run(batches):
        floors: dict[bytes, np.ndarray] = {}
        for b in batches:
            for row in b.to_pylist():
                ids, data = _unpack({"ids": row["c_ids"], "dims": row["c_dims"], "data": row["c_data"]}, True)
                q_ids, qs = _unpack({"ids": row["q_ids"], "dims": row["q_dims"], "data": row["q_data"]}, False)
                dims = min(data.shape[0], qs.shape[1])
                data, qs = data[:dims], qs[:, :dims]
                floor = floors.setdefault(hashlib.sha256(row["q_ids"] + row["q_data"]).digest(), np.full(len(q_ids), -np.inf))
                out_q, out_s, out_v = [], [], []
                if max(np.abs(data).max(initial=0), np.abs(qs).max(initial=0)) < LIMIT and dims <= 4096:
                    wide = data.astype(np.float64)
                    rest = [np.sqrt((wide[at:] ** 2).sum(axis=0)) for at in range(0, max(dims, 1), STEP)]
                    find = lambda q, own, least: search_block(q.astype(np.float64), own, ids, wide, rest, k, least)  # noqa: E731, B023
                else:

                    def find(q, own, least):
                        score = q.astype(np.int64) @ data  # noqa: B023
                        order = np.lexsort((ids, -score))  # noqa: B023
                        order = order[ids[order] != own][:k]  # noqa: B023
                        return score[order], ids[order]  # noqa: B023

                for n, (own, q) in enumerate(zip(q_ids.tolist(), qs, strict=True)):
                    s, v = find(q, own, floor[n])
                    if len(s) == k:
                        floor[n] = max(floor[n], s[-1])
                    out_q.append(np.full(len(s), own))
                    out_s.append(s)
                    out_v.append(v)
                yield pa.RecordBatch.from_pydict({n: np.concatenate(x).astype(np.int64) for n, x in (("query_id", out_q), ("score", out_s), ("vec_id", out_v))})

    best = pairs.mapInArrow(run, "query_id long, score long, vec_id long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # limited within each task before the shuffle
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


OP3_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) v from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id query_id, c.vec_id, list_sum(list_transform(range(1, len(c.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int rank from p)
select query_id, rank, vec_id, score from r where rank <= 10
"""
