"""Biased random walks of second order by rejection sampling, and the hashed structural embedding of nodes made from them.

A step proposes one neighbour at a hashed position of the sorted neighbours, and takes it with a probability that its weight sets: 1 / p for going back, 1
for a neighbour of the node before, 1 / q else. So a step looks at one neighbour and tests one edge, whatever the degree of the node.
Proposals are hashes of (walk, step, attempt): runs repeat exactly, and the two ways of making the walks give the same rows.

Graphs of at most SMALL directed edges are looked up in tasks: the sorted edge list is broadcast, after it was counted. Larger ones stay
distributed: sorted edges lie in blocks, and packed walkers go to the block of the edge that they propose or ask for, one such look a round; only walkers travel.

Defined results: edges with a null end are left out, repeated edges and both directions of one count once, a self loop makes a node its own neighbour;
every node on an edge starts per_node walks, and as every node has a neighbour all walks are whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.components import heavy_join
from graphloom.operators.context import prefix_sums
from graphloom.session import cut_lineage, move, remove, shared_folder, shuffles_dropped, stored, there

SMALL = 2_000_000
#: The steps of distributed walks are put together in so many parts, one after another.
PARTS = 8
#: Above so many directed edges an embedding's steps meet packed, by the node visited, and no walk is put together.
FEW = 500_000
#: Distributed walks: so many directed edges make a block, and so many places in walks a group, at most about.
BLOCK, PLACES = 250_000, 4_000_000
STEP = np.dtype([("w", np.int64), ("step", np.int32)])
LENGTH, PER_NODE, P, Q, DIMS = 80, 10, 1.0, 0.5, 128

# The multipliers of the 64-bit xxHash, with which Spark's function is met in tasks.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def hash64(*columns) -> np.ndarray:
    """xxhash64 of long columns (arrays or numbers), as Spark gives it."""
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    seed = np.uint64(42)
    with np.errstate(over="ignore"):
        for c in columns:
            x = np.asarray(c, np.int64).astype(np.uint64)
            h = (seed + _P5 + np.uint64(8)) ^ (turn(x * _P2, 31) * _P1)
            h = turn(h, 27) * _P1 + _P4
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            seed = h ^ (h >> np.uint64(32))
    return seed.astype(np.int64)


def directed(edges: DataFrame) -> DataFrame:
    """(a, b): every edge both ways, once."""
    e = edges.where("src is not null and dst is not null").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return e.union(e.select("b", "a")).distinct()


def random_walks(edges: DataFrame, length: int = LENGTH, per_node: int = PER_NODE, p: float = P, q: float = Q, seed: int = 0, small: int = SMALL) -> DataFrame:
    """(id, walk_no, walk): per_node walks of `length` nodes from every node."""
    both = cut_lineage(directed(edges))
    walkers = _walkers(both, per_node, seed)
    return _looked_up(both, walkers, length, p, q) if both.count() <= small else _joined(both, walkers, length, p, q)


def _walkers(both: DataFrame, per_node: int, seed: int) -> DataFrame:
    own = both.select(F.col("a").alias("id")).distinct().withColumn("walk_no", F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))))
    return own.withColumn("h", F.xxhash64("id", F.col("walk_no").cast("long"), F.lit(seed).cast("long")))


def _looked_up(both: DataFrame, walkers: DataFrame, length: int, p: float, q: float) -> DataFrame:
    kind = dict(both.dtypes)["a"]
    pairs = both.orderBy("a", "b").toArrow()  # at most SMALL rows
    names, at = np.unique(np.asarray(pairs.column(0)), return_index=True) if pairs.num_rows else (np.zeros(0, object), np.zeros(0, np.int64))
    to = np.searchsorted(names, np.asarray(pairs.column(1))).astype(np.int64) if len(names) else np.zeros(0, np.int64)
    first = np.append(at, pairs.num_rows).astype(np.int64)
    shared = walkers.sparkSession.sparkContext.broadcast((names, first, to))
    most = max(1 / p, 1.0, 1 / q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, first, to = shared.value
        n, degree = len(names), np.diff(first)
        keys = np.repeat(np.arange(n), degree) * n + to  # sorted, as the edges are
        for b in batches:
            now = np.searchsorted(names, np.asarray(b.column(0)))
            h, last = b.column(2).to_numpy(), np.full(len(now), -1)
            walk = np.empty((len(now), length), np.int64)
            walk[:, 0] = now
            for step in range(1, length):
                left, attempt, chosen = np.arange(len(now)), 0, np.empty(len(now), np.int64)
                while len(left):
                    own, before = now[left], last[left]
                    proposal = to[first[own] + hash64(h[left], step, attempt, 0) % degree[own]]
                    key = before * n + proposal
                    met = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
                    weight = np.where(before < 0, most, np.where(proposal == before, 1 / p, np.where(met, 1.0, 1 / q)))
                    taken = (hash64(h[left], step, attempt, 1) % (1 << 30)) / float(1 << 30) * most < weight
                    chosen[left[taken]] = proposal[taken]
                    left, attempt = left[~taken], attempt + 1
                last, now = now, chosen
                walk[:, step] = now
            flat = pa.array(names[walk.reshape(-1)])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, walk.size + 1, length, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["id", "walk_no", "walk"])

    dealt = walkers.repartition("id", "walk_no")
    return dealt.mapInArrow(run, f"id {kind}, walk_no int, walk array<{kind}>")


def _joined(both: DataFrame, walkers: DataFrame, length: int, p: float, q: float) -> DataFrame:
    """The walks of a distributed graph: each group of walkers puts its steps, which came with their names, in order."""
    kind, spark = dict(both.dtypes)["a"], both.sparkSession
    total, nodes, folder, groups = _steps(both, walkers, length, p, q, True)
    out = f"id {kind}, walk_no int, walk array<{kind}>"

    def walk(rows: pa.Table) -> pa.Table:
        each = rows.column("names").combine_chunks()
        names = (pa.concat_arrays(each.chunks) if isinstance(each, pa.ChunkedArray) else each).flatten()
        steps = _read(rows.column("rows"), STEP)
        names = names.take(pa.array(np.lexsort((steps["step"], steps["w"]))))
        own = np.unique(steps["w"])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(steps) + 1, length, dtype=np.int32)), names)
        return pa.Table.from_arrays([names.take(pa.array(np.arange(0, len(steps), length))), pa.array((own // total).astype(np.int32)), lists], ["id", "walk_no", "walk"])

    walks = f"{shared_folder(spark)}/walks-{uuid.uuid4().hex}"
    stored(spark.createDataFrame([], out), walks)
    for rows, path in _parts(spark, folder, kind):  # a part's steps meet, and go when its walks are there
        stored(rows.groupBy("dest").applyInArrow(walk, out), walks, "append")
        remove(spark, path)
    remove(spark, folder)
    return spark.read.schema(out).parquet(walks)


def _read(packed, kind: np.dtype) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), kind) for chunk in packed.chunks for x in chunk]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _sent(rows: np.ndarray, dest: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """(order, ends, dest, packed): rows packed by where they go."""
    order = np.argsort(dest, kind="stable")
    dest, data = dest[order], rows[order].tobytes()
    cut = np.flatnonzero(np.append(True, dest[1:] != dest[:-1])) if len(dest) else np.zeros(0, np.int64)
    ends = np.append(cut, len(dest)).astype(np.int32)
    at = pa.py_buffer(np.ascontiguousarray(ends * rows.dtype.itemsize, np.int32))
    return order, ends, pa.array(dest[cut].astype(np.int64)), pa.Array.from_buffers(pa.binary(), len(cut), [None, at, pa.py_buffer(data)])


def _parts(spark, folder: str, kind: str) -> Iterator[tuple[DataFrame, str]]:
    for k in range(PARTS):
        if there(spark, f"{folder}/part={k}"):  # few steps have fewer parts
            yield spark.read.schema(f"dest long, rows binary, names array<{kind}>").parquet(f"{folder}/part={k}/*"), f"{folder}/part={k}"


def _steps(both: DataFrame, walkers: DataFrame, length: int, p: float, q: float, named: bool) -> tuple[int, DataFrame, str, int]:
    """(edges, nodes, folder, groups): walks in rounds over blocks of edges; folder holds their steps, packed for groups of walkers if named, else of nodes visited.

    Directed edges are numbered in order of (a, b), so a node is known by the place of its first edge, and a proposal is a place. Blocks hold equal stretches of places, whatever
    the degrees. In a round a walker is in the block of the place it proposed, and learns the neighbour; if it depends on an edge between that one and the node before, it
    goes on to the block that would hold it. Walkers travel as packed arrays, a row for each pair of blocks; steps are written when their node makes its first proposal.
    """
    spark, kind = both.sparkSession, dict(both.dtypes)["a"]
    ranked = prefix_sums(both.withColumn("one", F.lit(1)), ("a", "b"), "one", "place").select("a", "b", (F.col("place") - 1).alias("place"))
    nodes = cut_lineage(ranked.groupBy("a").agg(F.min("place").alias("start"), F.count("*").alias("degree")))
    total, = nodes.agg(F.coalesce(F.sum("degree"), F.lit(0))).first()
    parts = 2 * spark.sparkContext.defaultParallelism
    size = max(1, -(-total // max(4 * parts, total // BLOCK)))
    own = nodes.withColumn("n", F.col("degree"))
    near = heavy_join(ranked, own.select("a", "start", "n"), ["a"], total)
    near = heavy_join(near, own.select(F.col("a").alias("b"), F.col("start").alias("to"), F.col("degree").alias("to_degree"), "n"), ["b"], total)

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        start, to, degree = (rows.column(c).to_numpy() for c in ("start", "to", "to_degree"))
        owners, at = np.unique(start, return_index=True)
        names = rows.column("a").take(pa.array(at)).combine_chunks()
        names = pa.concat_arrays(names.chunks) if isinstance(names, pa.ChunkedArray) else names
        data = [pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in (start * total + to, degree, owners)]
        return pa.Table.from_arrays([pa.array([int(rows.column("place")[0].as_py()) // size]), *data, pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)], ["block", "keys", "degrees", "owners", "names"])

    blocks = near.select(F.floor(F.col("place") / size).alias("block"), "place", "a", "start", "to", "to_degree")
    least = blocks.groupBy("block").agg(F.min(F.struct("place", (F.col("start") * total + F.col("to")).alias("key"))).alias("m"))
    graph = cut_lineage(blocks.groupBy("block").applyInArrow(pack, f"block long, keys binary, degrees binary, owners binary, names array<{kind}>").repartition(parts, "block"))
    bounds = np.array([r["m"]["key"] for r in least.orderBy("block").collect()], np.int64)  # one for each block

    small = np.int32 if total < 1 << 31 else np.int64
    state = np.dtype([("h", np.int64), ("w", np.int64), ("step", np.int32), ("attempt", np.int32), ("last", small), ("at", small), ("degree", small), ("b", small), ("b_degree", small)])
    visit = np.dtype([("node", small), ("key", np.int64)])
    n_walkers, most_w = walkers.agg(F.count("*"), F.max("walk_no")).first()
    span = ((most_w or 0) + 1) * max(total, 1)
    groups = max(PARTS, -(-n_walkers * length // PLACES))
    shares = int(min(PARTS, max(1, n_walkers * length // (8 * PLACES))))
    heavy = {} if named else _dealt(nodes, total, groups)
    first_of = np.array(sorted(heavy), np.int64)
    deals = np.array([heavy[v] for v in sorted(heavy)], np.int64).reshape(-1, 2)
    most, least_w, most_in = max(1 / p, 1.0, 1 / q), min(1.0, 1 / q), max(1.0, 1 / q)
    schema = f"part int, dest long, rows binary, names array<{kind}>"

    def block_of(s: np.ndarray) -> np.ndarray:
        place = s["at"] + hash64(s["h"], s["step"], s["attempt"], 0) % s["degree"]
        asked = np.maximum(np.searchsorted(bounds, s["b"].astype(np.int64) * total + s["last"], "right") - 1, 0)
        return np.where(s["b"] < 0, place // size, asked)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.zeros(b.num_rows, state)
            start, degree, no, h = (b.column(k).to_numpy() for k in range(4))
            s["h"], s["w"], s["step"], s["last"], s["at"], s["degree"], s["b"] = h, no * np.int64(total) + start, 1, -1, start, degree, -1
            _, _, dest, rows = _sent(s, block_of(s))
            yield pa.RecordBatch.from_arrays([dest, rows], ["dest", "rows"])

    def hop(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        s = _read(left.column("rows"), state).copy()
        if not len(s):
            return pa.Table.from_arrays([pa.array([], t) for t in (pa.int32(), pa.int64(), pa.binary())] + [right.column("names").combine_chunks()[:0]], ["part", "dest", "rows", "names"])
        keys, degrees, owners = (np.frombuffer(right.column(c)[0].as_buffer(), np.int64) for c in ("keys", "degrees", "owners"))
        names = right.column("names")[0].values
        lo, test = key[0].as_py() * size, s["b"] >= 0
        draw = (hash64(s["h"], s["step"], s["attempt"], 1) % (1 << 30)) / float(1 << 30) * most
        # Those that propose: a node's first attempt writes it down.
        look = np.flatnonzero(~test)
        now = s[look]
        fresh = now[now["attempt"] == 0]
        out = [pa.array([], pa.int32()), None, None, None]
        if len(fresh):
            if named:
                step = np.zeros(len(fresh), STEP)
                step["w"], step["step"], dest = fresh["w"], fresh["step"] - 1, fresh["w"] * groups // span
            else:
                step = np.zeros(len(fresh), visit)
                step["node"], step["key"], dest = fresh["at"], fresh["w"] * length + fresh["step"] - 1, fresh["at"].astype(np.int64) * groups // total
                if len(first_of):
                    k = np.minimum(np.searchsorted(first_of, fresh["at"]), len(first_of) - 1)
                    dest = np.where(first_of[k] == fresh["at"], deals[k, 0] + fresh["w"] * deals[k, 1] // span, dest)
            order, ends, dest, packed = _sent(step, dest)
            told = names.take(pa.array(np.searchsorted(owners, fresh["at"][order]))) if named else names[:0]
            lists = pa.ListArray.from_arrays(pa.array(ends if named else np.zeros(len(ends), np.int32)), told)
            out = [pa.array((dest.to_numpy() % shares).astype(np.int32)), dest, packed, lists]
        goes = now["step"] < length
        look, now = look[goes], now[goes]
        i = now["at"] + hash64(now["h"], now["step"], now["attempt"], 0) % now["degree"] - lo
        to, x = keys[i] % total, draw[look]
        first, back = now["last"] < 0, to == now["last"]
        weight = np.where(first, most, np.where(back, 1 / p, least_w))
        unsure = ~first & ~back & (x >= least_w) & (x < most_in)
        b, b_degree, taken = np.full(len(s), -1, np.int64), np.zeros(len(s), np.int64), np.zeros(len(s), bool)
        b[look], b_degree[look], taken[look] = to, degrees[i], x < weight
        held = np.zeros(len(s), bool)
        held[look[unsure]] = True
        # Those that ask for an edge.
        asked = np.flatnonzero(test)
        wanted = s["b"][asked].astype(np.int64) * total + s["last"][asked]
        met = keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted
        b[asked], b_degree[asked], taken[asked] = s["b"][asked], s["b_degree"][asked], draw[asked] < np.where(met, 1.0, 1 / q)
        s["last"] = np.where(taken, s["at"], s["last"])
        s["at"] = np.where(taken, b, s["at"])
        s["degree"] = np.where(taken, b_degree, s["degree"])
        s["step"] += taken
        s["attempt"] = np.where(taken, 0, s["attempt"] + ~held)
        s["b"], s["b_degree"] = np.where(held, b, -1), np.where(held, b_degree, 0)
        left_over = np.ones(len(s), bool)
        left_over[np.flatnonzero(~test)[~goes]] = False
        s = s[left_over]
        _, _, dest, packed = _sent(s, block_of(s))
        none = pa.ListArray.from_arrays(pa.array(np.zeros(len(dest) + 1, np.int32)), names[:0])
        table = [[pa.array(np.full(len(dest), -1, np.int32)), dest, packed, none]] + ([out] if out[1] is not None else [])
        return pa.concat_tables([pa.Table.from_arrays(x, ["part", "dest", "rows", "names"]) for x in table])

    starts = walkers.join(nodes, F.col("id") == F.col("a")).select("start", "degree", F.col("walk_no").cast("long"), "h")
    rows, old = stored(starts.mapInArrow(begin, "dest long, rows binary"))
    folder, turn = f"{shared_folder(spark)}/steps-{uuid.uuid4().hex}", 0
    while True:
        moved = rows.repartition(parts, "dest").groupBy("dest").cogroup(graph.groupBy("block")).applyInArrow(hop, schema)
        now = f"{shared_folder(spark)}/rows-{uuid.uuid4().hex}"
        with shuffles_dropped(spark):
            moved.write.partitionBy("part").parquet(now)
        remove(spark, old)  # only walkers of this round and the steps so far are kept
        for k in range(shares):
            move(spark, f"{now}/part={k}", f"{folder}/part={k}/{turn}")
        old, turn = now, turn + 1
        if not there(spark, f"{now}/part=-1"):
            break
        rows = spark.read.schema("dest long, rows binary").parquet(f"{now}/part=-1")
    remove(spark, old)
    return total, nodes, folder, groups


def _dealt(nodes: DataFrame, total: int, groups: int) -> dict[int, tuple[int, int]]:
    """node -> (its first group, how many it has): nodes with more than a group's share of the edges, of which there are fewer than groups."""
    out, free = {}, groups
    for r in nodes.where(F.col("degree") * groups > total).select("start", "degree").orderBy("start").collect():
        many = -(-r["degree"] * groups // total)
        out[r["start"]] = (free, many)
        free += many
    return out


def node_embedding(edges: DataFrame, length: int = LENGTH, per_node: int = PER_NODE, p: float = P, q: float = Q, seed: int = 0, small: int = FEW, dims: int = DIMS) -> DataFrame:
    """(id, embedding): hash_embedding of random_walks. Of graphs above `small` directed edges no walk is put together: the steps meet by the node visited."""
    both = cut_lineage(directed(edges))
    if both.count() <= small:
        return hash_embedding(random_walks(edges, length, per_node, p, q, seed), dims)
    spark, kind = both.sparkSession, dict(both.dtypes)["a"]
    total, nodes, folder, groups = _steps(both, _walkers(both, per_node, seed), length, p, q, False)
    visit = np.dtype([("node", np.int32 if total < 1 << 31 else np.int64), ("key", np.int64)])
    heavy = _dealt(nodes, total, groups)
    sizes = {}
    if heavy:
        for rows, _ in _parts(spark, folder, kind):
            sizes |= {r["dest"]: r["n"] for r in rows.where(F.col("dest") >= groups).groupBy("dest").agg((F.sum(F.octet_length("rows")) / visit.itemsize).cast("long").alias("n")).collect()}  # at most two for each group
    before = {}
    for start, many in heavy.values():
        for k in range(start, start + many):
            before[k] = before.get(k - 1, 0) + sizes.get(k - 1, 0) if k > start else 0

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        v = _read(rows.column("rows"), visit)
        v = v[np.lexsort((v["key"], v["node"]))]
        own, at, n = np.unique(v["node"], return_index=True, return_counts=True)
        place = np.arange(len(v)) - np.repeat(at, n) + before.get(key[0].as_py(), 0)
        bucket = hash64(v["key"] % length, place) % dims
        x = np.bincount(np.repeat(np.arange(len(own)), n) * dims + bucket, minlength=len(own) * dims).astype(np.float64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, dims, dtype=np.int32)), pa.array(x))
        return pa.Table.from_arrays([pa.array(own.astype(np.int64)), pa.array(np.full(len(own), key[0].as_py() >= groups)), lists], ["start", "dealt", "x"])

    form = "start long, dealt boolean, x array<double>"
    counts = f"{shared_folder(spark)}/counts-{uuid.uuid4().hex}"
    stored(spark.createDataFrame([], form), counts)
    for rows, path in _parts(spark, folder, kind):
        stored(rows.groupBy("dest").applyInArrow(count, form), counts, "append")
        remove(spark, path)
    remove(spark, folder)
    counts = spark.read.schema(form).parquet(counts)
    whole = F.array(*(F.sum(F.col("x")[k]) for k in range(dims)))  # a dealt node's counts, each a whole number
    counts = counts.where("not dealt").select("start", "x").union(counts.where("dealt").groupBy("start").agg(whole.alias("x")))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, y: s + y * y))
    return counts.withColumn("norm", norm).join(nodes.select("start", F.col("a").alias("id")), "start").select("id", F.transform("x", lambda y: y / F.col("norm")).alias("embedding"))


def hash_embedding(walks: DataFrame, dims: int = DIMS) -> DataFrame:
    """(id, embedding): a node's places in the walks, in order of (walk_no, start), each counted in the bucket that the hash of (place in the walk, how many
    places came before) names, at length one. The running number of a node is made by ranges of the order, so a hub's places need no one task."""
    places = walks.select("walk_no", F.col("id").alias("start"), F.posexplode("walk").alias("place", "node")).withColumn("one", F.lit(1))
    ranked = prefix_sums(places, ("node", "walk_no", "start", "place"), "one", "all")
    firsts = ranked.groupBy("node").agg(F.min("all").alias("least"), F.count("*").alias("n"))
    rows = heavy_join(ranked.select("node", "place", "all"), cut_lineage(firsts), ["node"], ranked.count())
    bucket = F.pmod(F.xxhash64(F.col("place").cast("long"), F.col("all") - F.col("least")), F.lit(dims)).cast("int")
    counts = rows.groupBy("node", bucket.alias("bucket")).agg(F.count("*").cast("double").alias("x"))
    both = counts.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    value = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)) / F.col("norm"))
    return both.select(F.col("node").alias("id"), value.alias("embedding"))

