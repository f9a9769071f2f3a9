"""Vector code compression (operator 13): product codes whose nearest entries are found by vantage-point trees.

A vector is cut into equal parts; each part position has a codebook. The entries of a codebook stand in a vantage-point tree: a node holds
one entry, and two halves of the others by distance from it, each with the least and greatest such distance. By the triangle inequality no
entry of a half is nearer to a part than the gap between the part's own distance from the node's entry and that range. Ranges are rounded
outwards, a half is visited unless its bound is above the best distance (equality visits), the nearer half first, and what is visited is
compared in integers, ties to the lower index.

Each round reads the vectors once; tasks add up their own parts by entry, and the sums meet by (part, entry, component). Codebooks
(entries times components) are all that the driver and the tasks hold.

Defined results: vectors that are null or hold null or non-finite components are dropped; shorter ones count as filled with zeros up to the
longest, and that up to a multiple of the number of parts; rows that repeat an id are vectors of their own, in the codebooks' start too (by components); rows
with a null id are coded but don't start an entry; fewer vectors than entries start fewer; without a vector that has an id there are no rows; null labels
share one sum; other columns are ignored. Components of so large a size that squared distances leave 64 bits raise (see vectors.limit).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.vectors import group_sums, scaled, totals
from graphloom.operators.components import heavy_join
from graphloom.session import cut_lineage, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LEAF = 16


class VantageTree:
    """The entries of one part position; nearest() answers for a whole matrix of parts."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        self.root = self._build(np.arange(len(entries)))

    def _build(self, own: np.ndarray):
        if len(own) <= LEAF:
            return np.sort(own)
        x = self.entries[own].astype(np.float64)
        top = int(np.argmax(((x - x.mean(axis=0)) ** 2).sum(axis=1)))  # an outlying entry spreads the distances
        rest = np.delete(own, top)
        gap = self.entries[rest] - self.entries[own[top]]
        d = np.sqrt((gap * gap).sum(axis=1).astype(np.float64))
        order = np.argsort(d, kind="stable")
        halves = np.array_split(order, 2)
        ranges = [(d[h].min() * (1 - 1e-12) - 1e-9, d[h].max() * (1 + 1e-12) + 1e-9) for h in halves]
        return int(own[top]), [(r, self._build(rest[h])) for r, h in zip(ranges, halves, strict=True)]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index, squared distance) for each row of x, and how many distances that took."""
        best, index, count = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), -1, np.int64), 0
        # Whole numbers whose products' sums stay below 2**53 are exact in floats too, in which matrices multiply faster.
        most = max(np.abs(x).max(initial=0), np.abs(self.entries).max(initial=0))
        kind = np.float64 if 4 * x.shape[1] * int(most) ** 2 < 1 << 53 else np.int64
        own, entries = x.astype(kind), self.entries.astype(kind)
        squares, sizes = (own * own).sum(axis=1), (entries * entries).sum(axis=1)

        def compare(rows: np.ndarray, entry: int) -> np.ndarray:
            nonlocal count
            gap = x[rows] - self.entries[entry]
            d = (gap * gap).sum(axis=1)
            won = (d < best[rows]) | ((d == best[rows]) & (entry < index[rows]))
            best[rows[won]], index[rows[won]] = d[won], entry
            count += len(rows)
            return d

        def visit(node, rows: np.ndarray) -> None:
            nonlocal count
            if isinstance(node, np.ndarray):  # its entries in order of index, all at once
                d = (squares[rows][:, None] + sizes[node] - 2 * (own[rows] @ entries[node].T)).astype(np.int64)
                first = d.argmin(axis=1)
                d, entry, count = d[np.arange(len(rows)), first], node[first], count + d.size
                won = (d < best[rows]) | ((d == best[rows]) & (entry < index[rows]))
                best[rows[won]], index[rows[won]] = d[won], entry[won]
                return
            entry, halves = node
            d = np.sqrt(compare(rows, entry).astype(np.float64))
            inner = d <= (halves[0][0][1] + halves[1][0][0]) / 2
            for k, first in ((0, inner), (1, ~inner), (1, inner), (0, ~inner)):
                (low, high), child = halves[k]
                least = np.maximum(np.maximum(d - high, low - d), 0)
                go = first & (least * (1 - 1e-12) - 1e-9 <= np.sqrt(best[rows].astype(np.float64)) * (1 + 1e-12))
                if go.any():
                    visit(child, rows[go])

        if len(x):
            visit(self.root, np.arange(len(x)))
        return index, best, count


def _finite(v: str):
    return F.coalesce(F.col(v).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def start(rows: DataFrame, parts: int, entries: int, scale: int) -> np.ndarray:
    """The first codebooks: parts x entries x components. The sort keeps `entries` rows in each task."""
    dims = rows.where(_finite("v")).agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-dims // parts)
    v = F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")
    first = rows.where(_finite("v") & F.col("vec_id").isNotNull()).select("vec_id", v).orderBy("vec_id", "v").limit(entries).collect()
    x = np.zeros((len(first), parts * width), np.int64)
    for at, r in enumerate(sorted(first, key=lambda r: (r["vec_id"], r["v"]))):
        x[at, : len(r["v"])] = r["v"]
    return x.reshape(len(first), parts, width).transpose(1, 0, 2)


def assigned(x: np.ndarray, trees: list[VantageTree]) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each part's nearest entry: two matrices, vectors x parts."""
    width = x.shape[1] // len(trees)
    found = [t.nearest(x[:, p * width : (p + 1) * width])[:2] for p, t in enumerate(trees)]
    return np.column_stack([f[0] for f in found]), np.column_stack([f[1] for f in found])


def learn(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """The final codebooks: parts x entries x components, of rows (vec_id, v); v is read rounds + 2 times."""
    books = start(rows, parts, entries, scale)
    _, n, width = books.shape
    for _ in range(rounds if n else 0):

        def fold(b: pa.RecordBatch, books: np.ndarray = books) -> np.ndarray:
            _, x = scaled(b.column(0), scale, parts * width, pad=True)
            index, _ = assigned(x, [VantageTree(c) for c in books])
            own = lambda p: np.column_stack([x[:, p * width : (p + 1) * width], np.ones(len(x), np.int64)])
            return np.stack([group_sums(index[:, p], own(p), n) for p in range(parts)])

        got = totals(rows.select("v"), fold, (parts, n, width + 1)).reshape(parts * n, width + 1)
        books = np.array([[int(s) // int(r[width]) for s in r[:width]] if r[width] else old for r, old in zip(got, books.reshape(parts * n, width).tolist(), strict=True)], np.int64).reshape(parts, n, width)
    return books


def encode(rows: DataFrame, books: np.ndarray, scale: int = SCALE, keep: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, the columns of keep, code (two hex digits for each part; at most 256 entries), error."""
    parts, n, width = books.shape
    kept = rows.select("vec_id", *keep, "v")
    schema = ", ".join(f"{c} {t}" for c, t in kept.dtypes if c != "v") + ", code string, error long"
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    if n > 256:
        raise ValueError("two hex digits hold at most 256 entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [VantageTree(c) for c in books]
        for b in batches:
            at, x = scaled(b.column(len(keep) + 1), scale, parts * width, pad=True)
            index, distance = assigned(x, trees)
            code = index.astype(np.uint8).tobytes().hex()
            whole = [b.column(c).take(pa.array(at)) for c in range(len(keep) + 1)]
            cut = pa.array([code[2 * parts * k : 2 * parts * (k + 1)] for k in range(len(at))], pa.string())
            yield pa.RecordBatch.from_arrays([*whole, cut, pa.array(distance.sum(axis=1).astype(np.int64))], ["vec_id", *keep, "code", "error"])

    return kept.mapInArrow(run, schema)


def decode(code: str, books: np.ndarray) -> list[int]:
    """The vector of integers that a code stands for."""
    return [int(x) for p, k in enumerate(bytes.fromhex(code)) for x in books[p, k]]


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("v"))
    books = learn(rows)
    coded = encode(rows, books, keep=("label",))
    coded = cut_lineage(coded.withColumn("own", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))))  # null is a label like others
    by_label = coded.groupBy("own").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    out = heavy_join(coded, cut_lineage(by_label), ["own"], coded.count())
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds one after another, as one chain of tables; vectors of equal length only."""
    far = "list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))::bigint"
    out = [
        f"w as materialized (select row_number() over (order by vec_id, embedding) rid, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) v from embeddings "
        "where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"v as materialized (select rid, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] v from w, (select unnest(range({PARTS})) p))",
        f"s as materialized (select rid, row_number() over (order by vec_id, v) - 1 k from w where vec_id is not null order by k limit {ENTRIES})",
        "c0 as materialized (select p, k, v from v join s using (rid))",
    ]
    for n in range(ROUNDS + 1):
        out.append(f"a{n} as materialized (select rid, x.p, min({far} * {ENTRIES} + k) m from v x join c{n} c on c.p = x.p group by 1, 2)")
        if n < ROUNDS:
            out.append(
                f"c{n + 1} as materialized (select c{n}.p, c{n}.k, coalesce(g.v, c{n}.v) v from c{n} left join (select p, k, list((s - ((s % n) + n) % n) // n order by i) v from "
                f"(select p, m % {ENTRIES} k, i, sum(x)::bigint s, count(*) n from (select a.p, m, unnest(range(len(v))) i, unnest(v) x from a{n} a join v on v.rid = a.rid and v.p = a.p) group by 1, 2, 3) "
                f"group by 1, 2) g on g.p = c{n}.p and g.k = c{n}.k)"
            )
    own = f"(select rid, string_agg(printf('%02x', (m % {ENTRIES})::int), '' order by p) code, sum(m // {ENTRIES})::bigint error from a{ROUNDS} group by 1)"
    digest = f"(select sha256(string_agg(array_to_string(v, ','), ',' order by p, k)) from c{ROUNDS})"
    return "with " + ",\n".join(out) + f"\nselect vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, {digest} codebooks_sha256 from {own} join w using (rid)"


OP13_SQL = _sql()
