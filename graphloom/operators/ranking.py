"""Ranking: BM25, fusion, diversity, PageRank, communities, embeddings of structure."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import cosine
from graphloom.functions.text import tokens
from graphloom.session import cut_lineage


def bm25(docs: DataFrame, query: str, k1: float = 1.2, b: float = 0.75, true_idf: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of the documents that hold a query term; idf is ln 2 unless true_idf. Repeated query terms count each time."""
    asked = docs.sparkSession.range(1).select(F.explode(tokens(F.lit(query))).alias("term")).groupBy("term").agg(F.count("*").alias("qn"))
    known = [r["term"] for r in asked.collect()]  # the words of one question
    words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("w"))
    words = words.select("id", F.size("w").alias("dl"), F.filter("w", lambda x: x.isin(known)).alias("w"))  # other words are never made rows
    stats = words.agg(F.avg("dl").alias("avgdl"), F.count("*").alias("n_docs"))
    terms = words.select("id", "dl", F.explode("w").alias("term")).join(F.broadcast(asked), "term").groupBy("id", "dl", "term", "qn").agg(F.count("*").alias("tf"))
    if true_idf:
        df = terms.groupBy("term").agg(F.count("*").alias("df"))
        terms = terms.join(df, "term")
        idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    else:
        idf = F.lit(math.log(2.0))
    part = F.col("qn") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return terms.join(F.broadcast(stats)).groupBy("id").agg(F.sum(part).alias("score"))


def rrf(lists: DataFrame, k: int = 60) -> DataFrame:
    """(id, score) from (list_no, id, score, pos): sum of 1 / (k + rank + 1) with ranks from 0 within each list."""
    w = Window.partitionBy("list_no").orderBy(F.desc("score"), "pos")
    return lists.withColumn("r", F.row_number().over(w)).groupBy("id").agg(F.sum(1 / (k + F.col("r"))).alias("score"), F.min(F.struct("list_no", "pos")).alias("first"))


def linear_fusion(text: DataFrame, structure: DataFrame, w_text: float = 0.7, w_structure: float = 0.3) -> DataFrame:
    """w_text * score + w_structure * max(0, similarity) * edge weight; ids of text stay."""
    s = F.coalesce(F.greatest(F.col("similarity"), F.lit(0.0)) * F.coalesce("weight", F.lit(1.0)), F.lit(0.0))
    return text.join(structure, "id", "left").select("id", (w_text * F.col("score") + w_structure * s).alias("score"))


def noop_scores(rows: DataFrame, pos: str = "pos") -> DataFrame:
    return rows.withColumn("score", 1 - F.col(pos) * 0.001)


def mmr(candidates: DataFrame, lam: float = 0.7) -> DataFrame:
    """(query_id, id, rank): greedy diversity within each query, over at most a result page (id, score, words) per query."""

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        top = pdf["score"].max()
        norm = (pdf["score"] / top if top > 0 else pdf["score"] * 0).to_numpy()
        sets = [set() if w is None else set(w) for w in pdf["words"]]
        left, done, near = list(range(len(pdf))), [], np.zeros(len(pdf))
        if len(pdf) < 3:
            done = left
        else:
            while left:
                best = max(left, key=lambda i: (lam * norm[i] - (1 - lam) * near[i], norm[i], -i))
                left.remove(best)
                done.append(best)
                for i in left:
                    a, b = sets[i], sets[best]
                    near[i] = max(near[i], 1.0 if not a and not b else len(a & b) / len(a | b))
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[done].to_numpy(), "id": pdf["id"].iloc[done].to_numpy(), "rank": range(1, len(pdf) + 1)})

    kind = dict(candidates.dtypes)
    return candidates.select("query_id", "id", "score", "words").groupBy("query_id").applyInPandas(order, f"query_id {kind['query_id']}, id {kind['id']}, rank int")


def pagerank(edges: DataFrame, nodes: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(id, score) over directed edges: (1 - d) / n + d * sum of score / out-degree, without dangling redistribution. No nodes, no rows."""
    nodes = cut_lineage(nodes.select("id"))
    n = max(nodes.count(), 1)
    e = cut_lineage(edges.select("src", "dst").join(edges.groupBy("src").agg(F.count("*").alias("out")), "src"))
    s = nodes.select("id", F.lit(1.0 / n).alias("score"))
    for k in range(rounds):
        got = e.join(s, e["src"] == s["id"]).groupBy("dst").agg(F.sum(F.col("score") / F.col("out")).alias("g"))
        s = nodes.select("id").join(got.withColumnRenamed("dst", "id"), "id", "left").select("id", ((1 - damping) / n + damping * F.coalesce("g", F.lit(0.0))).alias("score"))
        if k % 3 == 2:
            s = cut_lineage(s)
    return s


def personalized_pagerank(edges: DataFrame, seeds: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(id, score) over the undirected multigraph, restarting at the seeds, normalised to sum 1 after each round."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src"))
    deg = both.groupBy("a").agg(F.count("*").alias("deg"))
    e = cut_lineage(both.join(deg, "a"))
    ids = e.select(F.col("a").alias("id")).distinct()
    own = ids.join(seeds.select("id").distinct().withColumn("seed", F.lit(1)), "id", "left")
    n_seed, n_all = own.agg(F.sum(F.coalesce("seed", F.lit(0))), F.count("*")).first()
    start = F.when(F.col("seed") == 1, 1.0 / n_seed).otherwise(0.0) if n_seed else F.lit(1.0 / max(n_all, 1))
    p = cut_lineage(own.select("id", start.alias("p")))
    s = p.select("id", F.col("p").alias("score"))
    for k in range(rounds):
        got = e.join(s, e["a"] == s["id"]).groupBy("b").agg(F.sum(F.col("score") / F.col("deg")).alias("g"))
        s = p.join(got.withColumnRenamed("b", "id"), "id", "left").select("id", ((1 - damping) * F.col("p") + damping * F.coalesce("g", F.lit(0.0))).alias("score"))
        total = s.agg(F.sum("score").alias("t"))
        s = s.join(F.broadcast(total)).select("id", (F.col("score") / F.col("t")).alias("score"))
        if k % 4 == 3:
            s = cut_lineage(s)
    return s


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row (q): undirected, over existing edges of one community, both directions."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src"))
    deg = both.groupBy("a").agg(F.count("*").alias("k"))
    m2 = both.agg(F.count("*").alias("m2"))
    ca, cb = communities.toDF("a", "ca"), communities.toDF("b", "cb")
    inside = both.join(ca, "a").join(cb, "b").where("ca = cb").join(deg, "a").join(deg.toDF("b", "kb"), "b")
    return inside.join(F.broadcast(m2)).agg(F.sum((1 - F.col("k") * F.col("kb") / F.col("m2")) / F.col("m2")).alias("q"))


def louvain_local(pairs: list[tuple], resolution: float = 1.0, sweeps: int = 10, m2: int | None = None) -> dict:
    """Single-level greedy communities of one component; nodes in sorted order, moves only for strict gain. m2 is twice the edges of the
    whole graph (by default, of these pairs). A community is named after the node that it began with, so names differ between components."""
    near: dict = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    order = sorted(near)
    own = {v: k for k, v in enumerate(order)}
    total = {own[v]: len(near[v]) for v in order}
    m2 = m2 or sum(map(len, near.values())) or 1
    for _ in range(sweeps):
        moved = False
        for v in order:
            k, links = len(near[v]), {}
            for u in near[v]:
                links[own[u]] = links.get(own[u], 0) + 1
            best, gain = own[v], 0.0
            for c in sorted(links):
                if c != own[v] and (g := links[c] - resolution * total[c] * k / m2) > gain:
                    best, gain = c, g
            if best != own[v]:
                total[own[v]] -= k
                total[best] = total.get(best, 0) + k
                own[v], moved = best, True
        if not moved:
            break
    return {v: f"community-{order[c]}" for v, c in own.items()}


def articulation_local(pairs: list[tuple]) -> list:
    """Cut vertices of one component, by an iterative depth-first search."""
    near: dict = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    seen, low, cuts, clock = {}, {}, set(), 0
    for root in sorted(near):
        if root in seen:
            continue
        seen[root] = low[root] = clock
        clock += 1
        stack, children = [(root, None, iter(sorted(near[root])))], 0
        while stack:
            v, parent, rest = stack[-1]
            u = next(rest, None)
            if u is None:
                stack.pop()
                if stack:
                    up = stack[-1][0]
                    low[up] = min(low[up], low[v])
                    if up == root:
                        children += 1
                    elif low[v] >= seen[up]:
                        cuts.add(up)
            elif u not in seen:
                seen[u] = low[u] = clock
                clock += 1
                stack.append((u, v, iter(sorted(near[u]))))
            elif u != parent:
                low[v] = min(low[v], seen[u])
        if children > 1:
            cuts.add(root)
    return sorted(cuts)


def by_component(rows: DataFrame, local, column: str, kind: str) -> DataFrame:
    """Run a sequential algorithm on each component of rows (src, dst, component), of which none may be larger than a task can hold."""
    node = dict(rows.dtypes)["src"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(local(list(zip(pdf["src"], pdf["dst"], strict=True))).items(), columns=["id", column])

    return rows.groupBy("component").applyInPandas(run, f"id {node}, {column} {kind}")


def communities(edges: DataFrame, resolution: float = 1.0, sweeps: int = 10, most_edges: int = 500_000) -> DataFrame:
    """(id, community): components don't touch each other, so each is partitioned by itself, with the edge count of the whole graph.

    Components of up to most_edges edges run in one task each; the same sweeps over larger ones are made by louvain_rounds, with the same result.
    Edges with a null end are left out, and so are nodes without an edge to another node.
    """
    from graphloom.operators.components import connected_components, heavy_join

    edges = cut_lineage(edges.select("src", "dst").where("src is not null and dst is not null"))
    n = edges.count()
    comp = connected_components(edges).withColumnRenamed("id", "src")
    out = edges.groupBy("src").agg(F.count("*").alias("n"))  # an edge belongs to its source's component
    rows = cut_lineage(heavy_join(edges, out.join(comp, "src"), ["src"], n))
    large = cut_lineage(rows.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > most_edges).select("component"))  # at most edges / most_edges of them
    own = by_component(rows.join(F.broadcast(large), "component", "left_anti"), lambda p: louvain_local(p, resolution, sweeps, 2 * n), "community", "string")
    return own if large.isEmpty() else own.union(louvain_rounds(rows.join(F.broadcast(large), "component", "left_semi"), resolution, sweeps, 2 * n))


def louvain_rounds(edges: DataFrame, resolution: float = 1.0, sweeps: int = 10, m2: int | None = None) -> DataFrame:
    """(id, community): what louvain_local gives for all edges at once, by rounds of joins and sums over rows of edges.

    In a sweep a node sees the moves of the nodes before it. A round takes the last round's moves for granted and judges all nodes by them, each by its neighbours'
    communities and by what the communities weigh when its turn comes, which is a running sum. The first k nodes are right after k rounds, so the round that changes
    nothing gives the moves of the sweep; as many rounds are needed as moves depend on each other in a chain, 12 to 21 in graphs of 21,000 and 126,000 nodes.
    """
    from graphloom.operators.context import prefix_sums

    spark = edges.sparkSession
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src"))
    both = both.groupBy("a", "b").agg(F.count("*").alias("m"))
    nodes = both.groupBy(F.col("a").alias("id")).agg(F.sum("m").alias("k")).withColumn("one", F.lit(1).cast("long"))
    named = cut_lineage(prefix_sums(nodes, ("id",), "one", "run").select("id", "k", (F.col("run") - 1).alias("v")))  # v: the place in sorted order
    places = named.select("id", "v")
    near = both.join(places.toDF("a", "va"), "a").join(places.toDF("b", "vb"), "b").select(F.col("va").alias("a"), F.col("vb").alias("b"), "m")
    near = cut_lineage(near.repartition("b"))
    n, total = named.agg(F.count("*"), F.sum("k")).first()
    m2 = m2 or total or 1
    share = max(1, (total or 0) // (4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    guess = named.select("v", "k", F.col("v").alias("old"), F.col("v").alias("new"))
    for _ in range(sweeps):
        while True:
            guess = cut_lineage(_judged(near, guess, n, m2, resolution, share))
            if guess.where("new <> last").isEmpty():
                break
            guess = guess.drop("last")
        moved = not guess.where("new <> old").isEmpty()
        guess = guess.select("v", "k", F.col("new").alias("old"), "new")
        if not moved:
            break
    first = named.select(F.col("v").alias("old"), F.concat(F.lit("community-"), F.col("id").cast("string")).alias("community"))
    return guess.join(first, "old").join(named.select("v", "id"), "v").select("id", "community")


def _judged(near: DataFrame, guess: DataFrame, n: int, m2: int, resolution: float, share: int) -> DataFrame:
    """guess (v, k, old, new): communities before a sweep and after it, if new, here called last, is right for all earlier nodes; new is what follows for each node."""
    seen = near.join(guess.select(F.col("v").alias("b"), "old", "new"), "b").select("a", F.when(F.col("b") < F.col("a"), F.col("new")).otherwise(F.col("old")).alias("c"), "m")
    links = seen.repartition("a").groupBy("a", "c").agg(F.sum("m").alias("n"))
    links = links.join(guess.select(F.col("v").alias("a"), "k", "old"), "a").where("c <> old")
    goes = guess.where("new <> old")
    comes = goes.select(F.col("new").alias("c"), F.col("v").alias("at"), F.col("k").alias("d"))
    start = guess.groupBy(F.col("old").alias("c")).agg(F.sum("k").alias("d")).select("c", F.lit(-1).cast("long").alias("at"), "d")
    weights = start.union(comes).union(goes.select("old", "v", -F.col("k")))
    # A community has no more links in a sweep than it ever weighs in it; those that may have many are dealt in stretches of nodes, each with what the ones before sum up to.
    heavy = start.union(comes).groupBy("c").agg(F.sum("d").alias("w")).where(F.col("w") > share).select("c", F.ceil(F.col("w") / share).alias("parts"))
    dealt = lambda rows: rows.join(F.broadcast(heavy), "c", "left").withColumn("part", F.when(F.col("at") < 0, 0).otherwise(F.coalesce((F.col("at") * F.col("parts") / n).cast("int"), F.lit(0))))
    weights = dealt(weights)
    sums = weights.where("parts is not null").groupBy("c", "parts", "part").agg(F.sum("d").alias("d"))
    later = sums.select("c", F.explode(F.sequence(F.col("part") + 1, F.col("parts").cast("int"))).alias("part"), "d").groupBy("c", "part").agg(F.sum("d").alias("d"))
    none = F.lit(None).cast("long")
    # Of one place, what was there comes first, then the question, then the move.
    events = weights.select("c", "part", (2 * F.col("at") + 1).alias("o"), "d", none.alias("a"), none.alias("n"), none.alias("k"))
    events = events.union(later.select("c", "part", F.lit(-2).cast("long"), "d", none, none, none))
    asked = dealt(links.withColumn("at", F.col("a"))).select("c", "part", (2 * F.col("at")).alias("o"), F.lit(0).cast("long").alias("d"), "a", "n", "k")
    weighed = events.union(asked).withColumn("w", F.sum("d").over(Window.partitionBy("c", "part").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)))
    gains = weighed.where("a is not null").select("a", "c", (F.col("n") - F.lit(float(resolution)) * F.col("w") * F.col("k") / F.lit(float(m2))).alias("g")).where("g > 0")
    best = gains.groupBy(F.col("a").alias("v")).agg(F.max(F.struct("g", (-F.col("c")).alias("c"))).alias("best"))
    return guess.withColumnRenamed("new", "last").join(best, "v", "left").select("v", "k", "old", "last", F.coalesce(-F.col("best.c"), F.col("old")).alias("new"))


def articulation_points(edges: DataFrame) -> DataFrame:
    """(id) of the cut vertices, of components of any size."""
    from graphloom.operators.structure import cut_vertices

    return cut_vertices(edges)


def condense(edges: DataFrame, members: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Communities (id, community) of at least `least` become macro nodes, with the sorted pairs that edges join."""
    macro = members.groupBy("community").agg(F.count("*").alias("n_members")).where(F.col("n_members") >= least)
    own = members.join(macro.select("community"), "community", "left_semi")
    e = edges.join(own.toDF("ca", "src") if own.columns[0] == "community" else own.toDF("src", "ca"), "src")
    e = e.join(own.toDF("cb", "dst") if own.columns[0] == "community" else own.toDF("dst", "cb"), "dst").where("ca <> cb")
    return macro, e.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()


def fast_rp(edges: DataFrame, dims: int = 128, weights: tuple[float, ...] = (0.0, 1.0, 1.0, 0.8)) -> DataFrame:
    """(id, pos, value): sparse random projection and weighted iterated neighbour means; random signs are hashes of (id, pos)."""
    from graphloom.operators import projection

    h = lambda node, k: F.pmod(F.xxhash64(node, k), F.lit(6))

    def signs(node: Column, lo: int, until: int) -> Column:
        return F.transform(F.sequence(F.lit(lo), F.lit(until - 1)), lambda k: F.when(h(node, k) == 0, math.sqrt(3.0)).when(h(node, k) == 1, -math.sqrt(3.0)).otherwise(-0.0))

    return projection.values(edges, dims, weights, signs)


def knn(vectors: DataFrame, query: list[float], k: int = 10, tenant: str | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, score) of the k nearest by cosine; native, one pass, limited in each task before the merge."""
    rows = vectors if tenant is None else vectors.where(F.col("tenant_id") == tenant)
    q = F.array(*(F.lit(float(x)) for x in query))
    return rows.select(F.col(id_col).alias("id"), cosine(F.col(vec_col), q).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def centroid(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """(pos, value): the mean of each component."""
    return vectors.select(F.posexplode(vec_col).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("value"))


def per_hop_filter(edges: DataFrame, scores: DataFrame, top: int = 50, pass_above: int = 10_000) -> DataFrame:
    """Edges that touch one of the top nodes. More than pass_above edges pass unfiltered: that is what this operator is defined to do, not a short cut."""
    if edges.limit(pass_above + 1).count() > pass_above:
        return edges
    best = scores.orderBy(F.desc("score"), "id").limit(top).select("id")
    e = edges.withColumn("_k", F.xxhash64("src", "rel", "dst"))
    hit = e.join(best.toDF("src"), "src", "left_semi").select("_k").union(e.join(best.toDF("dst"), "dst", "left_semi").select("_k")).distinct()
    return e.join(hit, "_k", "left_semi").drop("_k")
