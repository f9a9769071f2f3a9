"""Traversals for many questions at once: batched bounded search, reachability of claimed paths, and page rank by forward push.

All state is rows of (question, node), so a round is one plan for all questions. Lineage is cut once a round.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import count_tokens
from graphloom.operators.patterns import degree, live
from graphloom.session import cut_lineage, remove, shared_folder, stored

HOPS, BEAM, PER_SOURCE, LIMIT, VISITED, SUPERNODE = 5, 50, 50, 200, 50, 500
#: A hub's neighbours are dealt in parts of about so many.
PART = 10_000
#: Rounds of at most so many steps along an edge look up what they touch in a broadcast of that size; others are grouped with all that is known.
FEW = 500_000


def ranked_targets(nodes: DataFrame, edges: DataFrame, per_source: int = PER_SOURCE, supernode: int = SUPERNODE) -> DataFrame:
    """(src, rel, dst, score, cost, super): each node's best targets by page rank (absent: 0), degree and id, what they add to a frontier's score and to
    its tokens, and whether the source is a supernode. Tasks keep per_source rows of a source before the shuffle, so a hub's edges don't meet."""
    d = degree(nodes, edges)
    rank = F.coalesce(F.col("pagerank"), F.lit(0.0)) if "pagerank" in nodes.columns else F.lit(0.0)
    about = nodes.select("id", rank.alias("pagerank")).join(d, "id")
    rows = live(edges).select("src", "rel", "dst").distinct().join(about.withColumnRenamed("id", "dst"), "dst")
    order = Window.partitionBy("src").orderBy(F.desc("pagerank"), F.desc("degree"), "dst", "rel")
    top = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_source)
    top = top.join(d.select(F.col("id").alias("src"), (F.col("degree") > supernode).alias("super")), "src")
    cost = count_tokens(F.concat_ws(" ", "src", "rel", "dst"))
    return top.select("src", "rel", "dst", "pagerank", "degree", (F.col("pagerank") + F.col("degree") / 1000).alias("score"), cost.alias("cost"), "super")


def traverse(questions: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int = HOPS, beam: int = BEAM, per_source: int = PER_SOURCE, limit: int = LIMIT, visited: int = VISITED, ceiling: int = 64_000, supernode: int = SUPERNODE) -> DataFrame:
    """(query_id, hop, src, rel, dst, cost): what a batched breadth-first search from each question's starts (query_id, id) collects.

    A hop expands a question's whole frontier: of its plain nodes the `limit` best targets count, of each supernode its per_source best. The `beam` best targets not
    yet visited are the next frontier. A question stops when it has visited `visited` nodes or collected `ceiling` tokens, checked between hops.
    Repeated starts count once; starts that aren't among the nodes collect nothing.
    """
    targets = cut_lineage(ranked_targets(nodes, edges, per_source, supernode))
    frontier = cut_lineage(questions.select("query_id", "id").where("query_id is not null").distinct().join(nodes.select("id"), "id", "left_semi"))
    seen, tokens, found = frontier, None, None
    best = Window.partitionBy("query_id", "super").orderBy(F.desc("pagerank"), F.desc("degree"), "src", "dst", "rel")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    for hop in range(1, hops + 1):
        got = frontier.join(targets, frontier["id"] == targets["src"]).drop("id")
        got = got.withColumn("n", F.row_number().over(best)).where(F.col("super") | (F.col("n") <= limit)).drop("n")
        got = cut_lineage(got.withColumn("hop", F.lit(hop)))
        found = got if found is None else found.union(got)
        if hop == hops:
            break
        used = found.groupBy("query_id").agg(F.sum("cost").alias("used"))
        many = seen.groupBy("query_id").agg(F.count("*").alias("many"))
        goes_on = used.join(many, "query_id").where((F.col("used") < ceiling) & (F.col("many") < visited)).select("query_id")
        new = got.select("query_id", F.col("dst").alias("id"), "score").distinct().join(seen, ["query_id", "id"], "left_anti").join(goes_on, "query_id", "left_semi")
        frontier = cut_lineage(new.withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= beam).select("query_id", "id"))
        if frontier.isEmpty():
            break
        seen = cut_lineage(seen.union(frontier.select(seen.columns)))
    return found.select("query_id", "hop", "src", "rel", "dst", "cost")


def claimed_paths(pairs: DataFrame, edges: DataFrame, hops: int = 5) -> DataFrame:
    """(src, dst, hops): for each different pair the least number of live edges from src to dst, null if that is more than `hops`; a node reaches itself in 0.

    Both ends search towards each other, the side whose turn it is one hop at a time, and only for pairs that haven't met; pairs with a null end have no path.
    Nodes travel as numbers, levels are written once each, and the last hop, which is the widest, isn't written at all. Edges into nodes that nothing leaves
    and nobody asks for are left out.
    """
    ask, ask_at = stored(pairs.select("src", "dst").where("src is not null and dst is not null").distinct())
    e = live(edges).select("src", "dst").where("src is not null and dst is not null").distinct()
    useful = e.select(F.col("src").alias("dst")).union(ask.select("dst")).distinct()
    e, e_at = stored(e.join(useful, "dst", "left_semi"))
    ids = e.select(F.col("src").alias("id")).union(e.select("dst")).union(ask.select("src")).union(ask.select("dst")).distinct()
    named, named_at = stored(ids.select("id", F.monotonically_increasing_id().alias("v")))
    number = lambda rows: rows.join(named.toDF("src", "a"), "src").join(named.toDF("dst", "b"), "dst")
    ask, _ = stored(number(ask))
    edge, edge_at = stored(number(e).select("a", "b"))
    spark, spent = edges.sparkSession, [ask_at, e_at, named_at, edge_at]
    left, at = stored(ask.where("a <> b").select("a", "b"))
    spent.append(at)
    met = [ask.where("a = b").select("a", "b", F.lit(0).alias("hops"))]
    sides = [ask.select(F.col("a").alias("seed")).distinct(), ask.select(F.col("b").alias("seed")).distinct()]
    levels = [[s.select("seed", F.col("seed").alias("id"))] for s in sides]
    for hop in range(1, hops + 1):
        if left.isEmpty():
            break
        k = (hop + 1) % 2  # forward, backward, forward ...
        own, to = ("a", "b") if k == 0 else ("b", "a")
        wanted = left.select(F.col(own).alias("seed")).distinct()
        new = levels[k][-1].join(wanted, "seed", "left_semi").join(edge.select(F.col(own).alias("id"), F.col(to).alias("to")), "id").select("seed", F.col("to").alias("id"))
        if hop < hops:
            new, at = stored(new.distinct().join(reduce(DataFrame.union, levels[k]), ["seed", "id"], "left_anti"))
            levels[k].append(new)
            spent.append(at)
        # the other side's outermost nodes and this side's new ones: any shorter meeting was found before
        both = left.join(new.withColumnRenamed("seed", own), own).join(levels[1 - k][-1].withColumnRenamed("seed", to), [to, "id"], "left_semi")
        found, _ = stored(both.select("a", "b", F.lit(hop).alias("hops")).distinct())
        met.append(found)
        if hop < hops:
            left, at = stored(left.join(found, ["a", "b"], "left_anti"))
            spent.append(at)
    for at in spent:
        remove(spark, at)
    return ask.join(reduce(DataFrame.union, met), ["a", "b"], "left").select("src", "dst", "hops")


def forward_push(seeds: DataFrame, edges: DataFrame, tolerance: float = 1e-6, damping: float = 0.85, most_rounds: int = 500) -> DataFrame:
    """(query_id, id, score): personalised page rank over the undirected multigraph for many seed sets (query_id, id), each restarting evenly at its seeds.

    A node pushes when its residual is above tolerance * degree: 1 - damping of it becomes score, the rest goes to its neighbours. Only such nodes
    meet the edges, so the work depends on the tolerance and not on the graph; a score is below the true one by at most tolerance * degree of the node.
    A hub's neighbours are dealt in parts, and its residual to each. Seeds that are on no edge don't count; a question without others has no rows.

    A round writes only the rows whose residual it changed, each with the round's number, and looks up the last version of these; the state as a whole is never
    written again, and scores are sums over the versions that pushed. Nodes and questions travel as numbers, a node's neighbours as one row for each part.
    """
    spark = edges.sparkSession
    e = live(edges).where("src is not null and dst is not null").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    both, at = stored(e.union(e.select("b", "a")).groupBy("a", "b").agg(F.count("*").alias("m")))
    deg = both.groupBy("a").agg(F.sum("m").alias("deg"), F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    named, _ = stored(deg.select(F.col("a").alias("id"), F.monotonically_increasing_id().alias("v"), "deg", "parts"))
    ends = both.join(named.select(F.col("id").alias("a"), F.col("v").alias("va"), F.col("parts").alias("pa")), "a").join(named.withColumnRenamed("id", "b"), "b")
    part = F.pmod(F.xxhash64("v"), F.col("pa")).cast("int").alias("part")
    near, near_at = stored(ends.select("va", part, F.struct("v", "m", "deg", "parts").alias("to")).groupBy("va", "part").agg(F.collect_list("to").alias("to")))
    remove(spark, at)
    own = seeds.where("query_id is not null").select("query_id", "id").distinct().join(named, "id")
    own = cut_lineage(own.select("query_id", "v", "deg", "parts", (1.0 / F.count("*").over(Window.partitionBy("query_id"))).alias("r")))
    asked, _ = stored(own.select("query_id").distinct().select("query_id", F.monotonically_increasing_id().alias("q")))
    log, form = f"{shared_folder(spark)}/push-{uuid.uuid4().hex}", "q long, v long, deg long, parts int, r double, n int"
    push = F.col("r") > tolerance * F.col("deg")
    touched, _ = stored(own.join(asked, "query_id").select("q", "v", "deg", "parts", "r"), f"{log}/n=0")
    for n in range(1, most_rounds + 1):
        active = touched.where(push)
        volume = active.agg(F.sum("deg")).first()[0]
        if volume is None:
            break
        parted = active.select("q", F.col("v").alias("va"), (damping * F.col("r") / F.col("deg")).alias("x"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        flow = parted.join(near, ["va", "part"]).select("q", "x", F.explode("to").alias("to"))
        flow = flow.select("q", "to.v", "to.deg", "to.parts", (F.col("x") * F.col("to.m")).alias("g"), F.lit(None).cast("double").alias("r"), F.lit(None).cast("int").alias("n"))
        before = spark.read.schema(form).option("basePath", log).parquet(log)
        if volume <= FEW:
            before = before.join(F.broadcast(flow.select("q", "v").distinct()), ["q", "v"], "left_semi")
        none = F.lit(None)
        before = before.select("q", "v", none.cast("long").alias("deg"), none.cast("int").alias("parts"), none.cast("double").alias("g"), F.when(push, 0.0).otherwise(F.col("r")).alias("r"), "n")
        each = flow.union(before).groupBy("q", "v").agg(F.max("deg").alias("deg"), F.max("parts").alias("parts"), F.sum("g").alias("g"), F.max_by("r", "n").alias("r"))
        new = each.where("g is not null").select("q", "v", "deg", "parts", (F.coalesce("r", F.lit(0.0)) + F.col("g")).alias("r"))
        touched, _ = stored(new, f"{log}/n={n}")
    else:
        raise RuntimeError("residuals did not settle")
    remove(spark, near_at)
    pushed = spark.read.schema(form).option("basePath", log).parquet(log).where(push).groupBy("q", "v").agg(F.sum(round(1 - damping, 15) * F.col("r")).alias("score"))
    return pushed.join(named.select("v", "id"), "v").join(asked, "q").select("query_id", "id", "score")


def ranked_filter(edges: DataFrame, scores: DataFrame, top: int = 50) -> DataFrame:
    """Edges that touch one of a question's `top` nodes, with its query_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "id")
    best = scores.withColumn("n", F.row_number().over(order)).where(F.col("n") <= top).select("query_id", "id")
    out = best.join(edges, F.col("id") == F.col("src")).drop("id").union(best.join(edges, F.col("id") == F.col("dst")).drop("id"))
    return out.distinct()
