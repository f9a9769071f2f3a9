"""Contexts of many questions in one plan: routes, candidates, hops and templates, ranking and budgets are joins and windows keyed by the question.

questions: query_id (unique), text, tenant_id, acl (array of access labels; null: all, empty: the public label only), and near_id if several questions share the
nearest rows. No step brings a question to the driver. Questions that ask the same (tenant, labels, text, near_id) are answered once, for the one of least query_id.
What is joined by name or namespace is joined with the tenant, so a question never meets rows of another. Null texts ask nothing.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.functions.scalars import count_tokens
from graphloom.operators import patterns as P
from graphloom.operators import ranking, traversal
from graphloom.plans import retrieval as R
from graphloom.session import cut_lineage

PAGE = 50
NOTICE = "some sources were not reachable"
WRITTEN = ("CALLS", "PRODUCES", "CONSUMES")


def permitted(label: Column, acl: Column) -> Column:
    """Whether a question with these access labels may see a row with this one; rows without a label are hidden from all that carry labels."""
    own = F.when(F.size(acl) > 0, F.array_contains(acl, label)).otherwise(label == "Team_public")
    return acl.isNull() | F.coalesce(own, F.lit(False))


def routed(questions: DataFrame) -> DataFrame:
    """query_id, tenant_id, acl, text, route, intent, and what the template needs: name, topic_name, namespace."""
    m = R.template_match(F.col("text"))
    kept = [c for c in ("query_id", "tenant_id", "acl", "text", "near_id") if c in questions.columns]
    own = questions.where("query_id is not null and text is not null").select(*kept, X.route(X.classify(F.col("text"))).alias("route"), m.alias("m"))
    intent = F.when(F.col("route").isin("cypher", "hybrid"), F.col("m.intent"))
    return own.select(*kept, "route", intent.alias("intent"), "m.name", "m.topic_name", "m.namespace")


def shared(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((query_id, _rep): the question that is answered for it, the rows of those questions)."""
    same = F.sha2(F.to_json(F.struct(*(c for c in ("tenant_id", "acl", "text", "near_id") if c in asked.columns))), 256)
    keyed = asked.withColumn("_key", same)
    least = keyed.groupBy("_key").agg(F.min("query_id").alias("_rep"), F.count("*").alias("_n"))
    members = cut_lineage(keyed.select("_key", "query_id").join(least, "_key").select("query_id", "_rep", "_n").distinct())
    return members, asked.join(members.where("query_id = _rep").select("query_id"), "query_id", "left_semi")


def expanded(out: DataFrame, members: DataFrame, each: int = 1000) -> DataFrame:
    """out for every question; questions that many ask alike are dealt in parts of about `each`, so no task gets all of them."""
    parts = lambda n: F.ceil(n / each).cast("int")
    dealt = members.select("query_id", "_rep", F.pmod(F.xxhash64("query_id"), parts(F.col("_n"))).cast("int").alias("_part"))
    counts = members.where("query_id = _rep").select("_rep", F.explode(F.sequence(F.lit(0), parts(F.col("_n")) - 1)).alias("_part"))
    return out.withColumnRenamed("query_id", "_rep").join(counts, "_rep").join(dealt, ["_rep", "_part"]).select("query_id", "rank", "kind", "text")


def candidates(asked: DataFrame, nodes: DataFrame, edges: DataFrame, near: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((query_id, score, the node's columns), degraded query_ids).

    near (query_id, id, score) are the nearest of all tenants by any index; tenant and labels are applied to them afterwards. A question without rows there is
    degraded: its candidates are the first CANDIDATES nodes by name and id whose name is one of its words. Nodes with a dead edge are hidden.
    """
    scope = asked.select("query_id", "tenant_id", "acl", "text")
    degraded = scope if near is None else scope.join(near.select("query_id").distinct(), "query_id", "left_anti")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z0-9][a-z0-9_-]*)"), F.lit(1)))
    said = degraded.select("query_id", "tenant_id", "acl", F.explode(words).alias("word"))
    dead = edges.where("tombstoned_day is not null").select("tenant_id", F.col("src").alias("id")).distinct()
    named = nodes.withColumn("word", F.lower("name")).join(said, ["tenant_id", "word"]).where(permitted(F.col("acl_label"), F.col("acl")))
    first = Window.partitionBy("query_id").orderBy("name", "id")
    named = named.withColumn("n", F.row_number().over(first)).where(F.col("n") <= R.CANDIDATES)
    columns = ["query_id", "score", *nodes.columns]
    found = named.withColumn("score", F.lit(1.0)).select(columns)
    if near is not None:
        own = near.select("query_id", "id", "score").join(scope.drop("text"), "query_id").join(nodes, ["tenant_id", "id"])
        found = found.union(own.where(permitted(F.col("acl_label"), F.col("acl"))).select(columns))
    return found.join(dead, ["tenant_id", "id"], "left_anti").select(columns), degraded.select("query_id")


def hops_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """tenant_id, src, rel, dst, back (the edge is read against its direction) and both ends' columns as s_* and t_*, of live edges."""
    e = P.live(edges).select("tenant_id", "src", "rel", "dst")
    both = e.withColumn("back", F.lit(False)).union(e.where("src <> dst").select("tenant_id", F.col("dst"), "rel", F.col("src"), F.lit(True)))
    side = lambda p, end: nodes.select("tenant_id", F.col("id").alias(end), *(F.col(c).alias(p + c) for c in nodes.columns if c not in ("tenant_id", "id")))
    return both.join(side("s_", "src"), ["tenant_id", "src"]).join(side("t_", "dst"), ["tenant_id", "dst"])


def _best(rows: DataFrame, order: list, most: int | None) -> DataFrame:
    """The first rows of each question; tasks drop the others before the shuffle."""
    if most is None:
        return rows
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("n") <= most).drop("n")


def neighbours(asked: DataFrame, found: DataFrame, nodes: DataFrame, edges: DataFrame, tolerance: float | None = None, top: int = PAGE) -> DataFrame:
    """(query_id, source, rel, target) for questions of one hop: edges of the candidates' names, targets below the degree cap, the best HOP_LIMIT by degree.

    With a tolerance only edges stay that touch one of the `top` nodes of the page rank pushed from the question's candidates.
    """
    one = asked.where("route = 'single_hop'").select("query_id", "tenant_id", "acl")
    names = found.join(one.select("query_id"), "query_id", "left_semi").select("query_id", F.col("name").alias("s_name")).distinct()
    degree = P.degree(nodes, edges).where(F.col("degree") < R.DEGREE_CAP).withColumnRenamed("id", "dst")
    rows = hops_of(nodes, edges).join(one.join(names, "query_id"), ["tenant_id", "s_name"]).where(permitted(F.col("t_acl_label"), F.col("acl"))).join(degree, "dst")
    if tolerance is not None:
        seeds = found.join(one.select("query_id"), "query_id", "left_semi").select("query_id", "id")
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "id")
        best = traversal.forward_push(seeds, edges, tolerance).withColumn("n", F.row_number().over(order)).where(F.col("n") <= top)
        best = cut_lineage(best.select("query_id", "id"))
        for end in ("src", "dst"):
            rows = rows.join(best.select("query_id", F.col("id").alias(end), F.lit(True).alias(f"near_{end}")), ["query_id", end], "left")
        rows = rows.where("near_src or near_dst")
    rows = _best(rows, [F.desc("degree"), "t_name", "s_name", "rel"], R.HOP_LIMIT)
    return rows.select("query_id", F.col("s_name").alias("source"), "rel", F.col("t_name").alias("target"))


#: intent -> (where, column joined, parameter, values in the order of their names, order, limit, each row once)
ONE_HOP = {
    "service_neighbors": ("s_label = 'Service'", "s_name", "name", ["rel", "s_name", "t_name", "t_label"], ["rel", "t_name"], 10, False),
    "service_deployments": ("rel = 'DEPLOYED_IN' and not back", "s_name", "name", ["t_namespace", "t_replicas", "s_name"], [], None, False),
    "service_databases": ("rel in ('WRITES_TO', 'READS_FROM') and not back", "s_name", "name", ["dst", "t_db_type", "s_name"], [], None, False),
    "topic_consumers": ("rel = 'CONSUMES' and not back", "t_name", "topic_name", ["s_name", "t_name"], ["s_name"], 10, False),
    "topic_producers": ("rel = 'PRODUCES' and not back", "t_name", "topic_name", ["s_name", "t_name"], ["s_name"], 10, False),
    "namespace_services": ("rel = 'DEPLOYED_IN' and not back", "t_namespace", "namespace", ["t_namespace", "s_name"], [], None, True),
}


def _text(values: list) -> Column:
    return F.concat_ws(" ", *(F.col(v).cast("string") if isinstance(v, str) else v for v in values))


def templates(asked: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int = 3, limit: int = 10, without: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, text): the rows of the template that each question asks for, but those of `without`. Questions of equal scope (tenant and labels) share the two counts over all calls."""
    h = cut_lineage(hops_of(nodes, edges))
    visible = lambda rows: rows.where(permitted(F.col("s_acl_label"), F.col("acl")) & permitted(F.col("t_acl_label"), F.col("acl")))
    out = []
    for intent, (where, column, need, values, order, most, once) in ONE_HOP.items():
        if intent in without:
            continue
        q = asked.where(F.col("intent") == intent).select("query_id", "tenant_id", "acl", F.col(need).alias(column))
        rows = visible(h.where(where).join(q, ["tenant_id", column]))
        rows = _best(rows, order, most).select("query_id", _text(values).alias("text"))
        out.append(rows.distinct() if once else rows)

    q = asked.where("intent = 'blast_radius'").select("query_id", "tenant_id", "acl", "name")
    at = nodes.where("label = 'Service'").join(q, ["tenant_id", "name"]).where(permitted(F.col("acl_label"), F.col("acl"))).select("query_id", "acl", F.col("id").alias("seed"))
    met = P.reach(at.select(F.col("seed").alias("id")), edges.where(F.col("rel").isin(*WRITTEN)), hops).select("seed", "id")
    hit = at.join(met, "seed").join(nodes, "id").where(permitted(F.col("acl_label"), F.col("acl")))
    out.append(hit.select("query_id", _text(["name", "label"]).alias("text")).distinct())

    counted = asked.where(F.col("intent").isin("dependency_count", "cross_team_dependencies")).select("query_id", "intent", "tenant_id", F.to_json(F.struct("acl")).alias("scope"), "acl")
    scopes = counted.select("intent", "tenant_id", "scope", "acl").distinct()
    calls = visible(h.where("rel = 'CALLS' and not back").join(scopes, "tenant_id"))
    count = calls.where("intent = 'dependency_count' and s_label = 'Service' and t_label = 'Service'").groupBy("intent", "tenant_id", "scope", "t_name").agg(F.count("*").alias("k"))
    place = Window.partitionBy("intent", "tenant_id", "scope")
    count = count.withColumn("n", F.row_number().over(place.orderBy(F.desc("k"), "t_name"))).select("intent", "tenant_id", "scope", "n", _text(["k", "t_name"]).alias("text"))
    cross = calls.where("intent = 'cross_team_dependencies' and s_team_owner <> t_team_owner")
    cross = cross.withColumn("n", F.row_number().over(place.orderBy("s_team_owner", "t_team_owner", "s_name", "t_name")))
    cross = cross.select("intent", "tenant_id", "scope", "n", _text(["t_name", "t_team_owner", "s_name", "s_team_owner"]).alias("text"))
    best = count.where(F.col("n") <= limit).union(cross.where(F.col("n") <= limit))
    out.append(counted.select("query_id", "intent", "tenant_id", "scope").join(best, ["intent", "tenant_id", "scope"]).select("query_id", "text"))
    return reduce(DataFrame.union, out)


def namespace_rows(asked: DataFrame, nodes: DataFrame, edges: DataFrame, most: int, budget: int) -> tuple[DataFrame, DataFrame]:
    """((query_id, text), (query_id, n, total)): services of a namespace that can have a place within the budget, and how many rows and words the others have.

    Their number grows with the graph for every question, so they are made once for each scope and namespace. For one wording, rows of equal length that hold its words
    equally often have equal scores and stand in the order of their ids; so the rows of such a class after those that fill the budget by themselves, and after the first
    `most`, are never reached. They count in the mean length.
    """
    where, column, _, values, _, _, _ = ONE_HOP["namespace_services"]
    told = asked.where("intent = 'namespace_services'").select("query_id", "tenant_id", F.to_json(F.struct("acl")).alias("scope"), "acl", "text", F.col("namespace").alias(column))
    keys = ["tenant_id", "scope", column]
    scopes = told.select(*keys, "acl").dropDuplicates(keys)
    rows = hops_of(nodes, edges).where(where).join(scopes, ["tenant_id", column])
    rows = rows.where(permitted(F.col("s_acl_label"), F.col("acl")) & permitted(F.col("t_acl_label"), F.col("acl"))).select(*keys, _text(values).alias("row")).distinct()
    rows = rows.withColumn("w", X.tokens(F.col("row"))).join(told.select(*keys, "text").distinct(), keys)
    often = F.transform(F.array_sort(F.array_distinct(X.tokens(F.col("text")))), lambda t: F.size(F.filter("w", lambda x: x == t)))
    rows = cut_lineage(rows.select(*keys, "text", "row", F.size("w").alias("dl"), F.to_json(often).alias("class"), F.sha2("row", 256).alias("id")))
    place = Window.partitionBy(*keys, "text", "dl", "class").orderBy("id")
    kept = rows.withColumn("_k", F.row_number().over(place)).where(F.col("_k") <= max(most, budget + 2))  # only the empty text costs nothing
    spent = F.sum(count_tokens(F.col("row"))).over(place.rowsBetween(Window.unboundedPreceding, 0)) - count_tokens(F.col("row"))  # the row that overflows stays, so none after it fits
    kept = cut_lineage(kept.withColumn("_spent", spent).where((F.col("_spent") <= budget) | (F.col("_k") <= most)))
    size = lambda of, sign: of.groupBy(*keys, "text").agg((sign * F.count("*")).alias("n"), (sign * F.sum("dl")).alias("total"))
    rest = size(rows, 1).union(size(kept, -1)).groupBy(*keys, "text").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    own = told.select(*keys, "text", "query_id")
    return own.join(kept, [*keys, "text"]).select("query_id", F.col("row").alias("text")), own.join(rest, [*keys, "text"]).select("query_id", "n", "total")


def ranked(rows: DataFrame, questions: DataFrame, k1: float = 1.2, b: float = 0.75, lam: float | None = None, others: DataFrame | None = None) -> DataFrame:
    """rows (query_id, id, text, ...) and rank: BM25 of each question's words over its own rows, ties by id. With lam the best PAGE rows are put in order of
    diversity; the others follow as they were. others (query_id, n, total) tells of rows that aren't shown, but count in the mean length."""
    words = rows.select("query_id", "id", X.tokens(F.col("text")).alias("w"))
    lengths = words.select("query_id", F.lit(1).cast("long").alias("n"), F.size("w").cast("long").alias("total"))
    lengths = lengths if others is None else lengths.union(others.select("query_id", "n", "total"))
    mean = lengths.groupBy("query_id").agg((F.sum("total") / F.sum("n")).alias("avgdl"))
    asked = questions.select("query_id", F.explode(X.tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qn"))
    terms = words.select("query_id", "id", F.size("w").alias("dl"), F.explode("w").alias("term")).join(asked, ["query_id", "term"])
    terms = terms.groupBy("query_id", "id", "dl", "term", "qn").agg(F.count("*").alias("tf")).join(mean, "query_id")
    part = F.col("qn") * math.log(2.0) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = rows.join(terms.groupBy("query_id", "id").agg(F.round(F.sum(part), 9).alias("score")), ["query_id", "id"], "left")
    scored = scored.withColumn("score", F.coalesce("score", F.lit(0.0)))
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    if lam is None:
        return out.drop("score")
    out = cut_lineage(out)
    page = ranking.mmr(out.where(F.col("rank") <= PAGE).select("query_id", "id", "score", X.tokens(F.col("text")).alias("words")), lam)
    return out.drop("score").join(page.withColumnRenamed("rank", "_r"), ["query_id", "id"], "left").withColumn("rank", F.coalesce("_r", "rank")).drop("_r")


def contexts(questions: DataFrame, nodes: DataFrame, edges: DataFrame, near: DataFrame | None = None, budget: int = 32_000, lam: float | None = None, tolerance: float | None = None) -> DataFrame:
    """(query_id, rank, kind, text): each question's context within its budget of tokens, best first; the notice of a degraded question is rank 0.

    near is (query_id, id, score), or (near_id, id, score) if the questions have a near_id. kind is notice, candidate or result; equal texts of a kind count once. A question that finds nothing has only its notice, or no row.
    """
    asked = cut_lineage(routed(questions))
    if near is not None and "near_id" not in asked.columns:
        asked = asked.withColumn("near_id", F.col("query_id"))
        near = near.withColumnRenamed("query_id", "near_id")
    members, asked = shared(asked)
    asked = cut_lineage(asked)
    if near is not None:
        near = cut_lineage(near.join(asked.select("query_id", "near_id"), "near_id").select("query_id", "id", "score"))
    found, degraded = candidates(asked, nodes, edges, near)
    found = cut_lineage(found)
    columns = sorted({*nodes.columns, "score"} - {"tenant_id"})
    shown = found.withColumn("score", F.format_string("%.4f", "score")).select("query_id", F.lit("candidate").alias("kind"), _text(columns).alias("text"))
    hop = neighbours(asked, found, nodes, edges, tolerance).select("query_id", F.lit("result"), _text(["rel", "source", "target"]))
    told = templates(asked, nodes, edges, without=("namespace_services",)).select("query_id", F.lit("result"), "text")
    many, others = namespace_rows(asked, nodes, edges, PAGE, budget)
    notice = degraded.select("query_id", F.lit("notice"), F.lit(NOTICE))
    rows = shown.union(hop).union(told).union(many.select("query_id", F.lit("result"), "text")).union(notice).distinct()
    rows = cut_lineage(rows.withColumn("id", F.concat_ws(":", "kind", F.sha2("text", 256))))
    out = ranked(rows, asked, lam=lam, others=others).withColumn("rank", F.when(F.col("kind") == "notice", 0).otherwise(F.col("rank")))
    until = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("_sum", F.sum(count_tokens(F.col("text"))).over(until)).where(F.col("_sum") <= budget)
    return expanded(cut_lineage(out.select("query_id", "rank", "kind", "text")), members)
