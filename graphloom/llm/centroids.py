"""Centroid clustering by annulus search (operator 11).

Centroids are sorted by norm. A vector's distance to the centroid of the nearest norm bounds its nearest distance from above, and only
centroids whose norm differs from the vector's by no more than that bound can be as near: two binary searches find this annulus, and its
members are compared exactly, in integers, from the inside out, while the bound shrinks. The annulus is a little wider than rounding
can err and its ends count in, so ties at its edge are compared too.

Every round reads the vectors once; a task adds up its own vectors by cluster, and the sums meet by (cluster, component). Only the
centroids (their number times their components) are on the driver and sent to tasks. Nothing is carried from round to round but them,
so a lost task reads its own part of the table again.

Defined results: vectors that are null, of another length, or hold null or non-finite components take no part; rows that repeat an id are
vectors of their own; rows with a null id are clustered but never start a centroid; ties in the start order go by components, ties of
distance to the smaller number; fewer vectors than centroids start fewer; without a vector that has an id there are no rows; columns other than the id
and the vector are ignored. Components of so large a size that squared distances leave 64 bits raise (see vectors.limit).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.vectors import group_sums, scaled, totals
from graphloom.session import table

DIMS, CENTROIDS, ROUNDS, SCALE = 64, 8, 10, 1024
OUT = "vec_id long, cluster int, distance long"


class Annulus:
    """Centroids by norm, for exact nearest-centroid searches of whole matrices."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids.astype(np.int64)
        norm = np.sqrt((self.centroids.astype(np.float64) ** 2).sum(axis=1))
        self.order = np.argsort(norm, kind="stable")
        self.norm = norm[self.order]

    def _distance(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        gap = x - self.centroids[self.order[at]]
        return (gap * gap).sum(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) for each row of x, and how many distances that took."""
        k, norm = len(self.norm), np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        right = np.clip(np.searchsorted(self.norm, norm), 0, k - 1)
        left = np.maximum(right - 1, 0)
        guess = np.where(np.abs(self.norm[left] - norm) <= np.abs(self.norm[right] - norm), left, right)
        best, number, count = self._distance(x, guess), self.order[guess], len(x)
        slack = 1e-9 + 1e-11 * (norm + self.norm[-1])  # beyond what square roots and sums of this size can err
        bound = np.sqrt(best.astype(np.float64)) + slack
        low = np.searchsorted(self.norm, norm - bound - slack, side="left")
        high = np.searchsorted(self.norm, norm + bound + slack, side="right")
        rows = np.arange(len(x))
        for step in range(1, k):
            rows = rows[(guess[rows] - step >= low[rows]) | (guess[rows] + step < high[rows])]
            if not len(rows):
                break
            for at, inside in ((guess[rows] - step, guess[rows] - step >= low[rows]), (guess[rows] + step, guess[rows] + step < high[rows])):
                own, there = rows[inside], at[inside]
                near = np.abs(self.norm[there] - norm[own]) <= bound[own] + slack[own]
                own, there = own[near], there[near]
                d, n = self._distance(x[own], there), self.order[there]
                better = (d < best[own]) | ((d == best[own]) & (n < number[own]))
                own = own[better]
                best[own], number[own] = d[better], n[better]
                bound[own] = np.sqrt(best[own].astype(np.float64)) + slack[own]
                count += len(near[near])
        return number, best, count


def _whole(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))


def start(rows: DataFrame, dims: int, k: int, scale: int, seed: int) -> np.ndarray:
    """The k vectors of the least sha256 of `seed:id`, in that order; a k-row sort in each task, then of their results."""
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    kept = rows.where(F.col("vec_id").isNotNull() & (F.size("v") == dims) & F.coalesce(ok, F.lit(False)))
    v = F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")
    first = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256).alias("h"), v).orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in sorted(first, key=lambda r: (r["h"], r["v"]))], np.int64).reshape(len(first), dims)


def sums(rows: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """By centroid: the sums of its vectors' components, their number, and the sum of their distances."""
    k, dims = centroids.shape

    def fold(b: pa.RecordBatch) -> np.ndarray:
        _, x = scaled(b.column(0), scale, dims)
        number, distance, _ = Annulus(centroids).nearest(x)
        return group_sums(number, np.column_stack([x, np.ones(len(x), np.int64), distance]), k)

    return totals(rows.select("v"), fold, (k, dims + 2))


def cluster(vectors: DataFrame, dims: int = DIMS, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = 3, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray, list[int]]:
    """((vec_id, cluster, distance), the final centroids, inertia by cluster). vectors are read rounds + 3 times."""
    rows = _whole(vectors, id_col, vec_col)
    c = start(rows, dims, k, scale, seed)
    if not len(c):
        return vectors.sparkSession.createDataFrame([], OUT), c, []
    for _ in range(rounds):
        got = sums(rows, c, scale)
        c = np.array([[int(s) // int(r[dims]) for s in r[:dims]] if r[dims] else old for r, old in zip(got, c.tolist(), strict=True)], np.int64)
    inertia = [int(r[dims + 1]) for r in sums(rows, c, scale)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annulus(c)
        for b in batches:
            at, x = scaled(b.column(1), scale, dims)
            number, distance, _ = search.nearest(x)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return rows.mapInArrow(run, OUT), c, inertia


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c, inertia = cluster(table(spark, sf_dir, "embeddings"))
    digests = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c.tolist()]
    own = lambda xs, kind: F.get(F.array(*map(F.lit, xs)).cast(f"array<{kind}>"), F.col("cluster"))  # noqa: E731  one value for each centroid
    return rows.select("*", own(inertia, "bigint").alias("cluster_inertia"), F.lit(sum(inertia)).cast("long").alias("inertia"), own(digests, "string").alias("centroid_sha256"))


def _sql() -> str:
    """The rounds one after another, as one chain of tables."""
    far = "list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))::bigint"
    out = [
        f"v as materialized (select row_number() over () rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) v from embeddings "
        f"where len(embedding) = {DIMS} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"c0 as materialized (select row_number() over (order by sha256(concat('3:', vec_id::varchar)), v) - 1 k, v from v where vec_id is not null order by k limit {CENTROIDS})",
    ]
    for n in range(ROUNDS + 1):
        out.append(f"a{n} as materialized (select rid, min({far} * {CENTROIDS} + k) m from v x, c{n} c group by rid)")
        if n < ROUNDS:
            out.append(
                f"c{n + 1} as materialized (select c{n}.k, coalesce(g.v, c{n}.v) v from c{n} left join (select k, list((s - ((s % n) + n) % n) // n order by i) v from "
                f"(select m % {CENTROIDS} k, i, sum(v[i])::bigint s, count(*) n from a{n} join v using (rid), (select unnest(range(1, 65)) i) group by 1, 2) group by k) g on g.k = c{n}.k)"
            )
    at = f"(select rid, (m % {CENTROIDS})::int cluster, (m // {CENTROIDS})::bigint distance from a{ROUNDS})"
    return "with " + ",\n".join(out) + (
        f"\nselect vec_id, cluster, distance, (sum(distance) over (partition by cluster))::bigint cluster_inertia, (sum(distance) over ())::bigint inertia, "
        f"sha256(array_to_string(c{ROUNDS}.v, ',')) centroid_sha256 from {at} a join v using (rid) join c{ROUNDS} on c{ROUNDS}.k = a.cluster"
    )


OP11_SQL = _sql()
