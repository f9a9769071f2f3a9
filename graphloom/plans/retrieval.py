"""From a question to the rows that answer it: candidates, hops, ranking, context. Each step is a DataFrame; the driver only picks the route."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.functions.scalars import cosine, count_tokens
from graphloom.operators import context, mutations, ranking
from graphloom.operators import patterns as P
from graphloom.plans import templates as T

# How a question names a service, a topic and a namespace, and what each template needs.
SERVICE = r"(?:of|if|for|from|does|about)\s+(?:the\s+)?([a-zA-Z][\w-]*(?:-[a-zA-Z][\w-]*)*)(?:\s+(?:service|svc))?|(?:is)\s+([a-zA-Z][\w-]*-[a-zA-Z][\w-]*)(?:\s+(?:service|svc))?"
TOPIC = r"(?:from|to|on|the)\s+(?:the\s+)?([a-zA-Z][\w-]*(?:-[a-zA-Z][\w-]*)*)(?:\s*(?:topic|queue))?"
NAMESPACE = r"(?:in|within|namespace)\s+(?:the\s+)?([a-zA-Z][\w-]*)"
NEEDS = {
    "blast_radius": "name", "dependency_count": None, "service_neighbors": "name", "topic_consumers": "topic_name", "topic_producers": "topic_name",
    "service_deployments": "name", "namespace_services": "namespace", "service_databases": "name", "cross_team_dependencies": None,
}
CANDIDATES, HOP_LIMIT, DEGREE_CAP, SAMPLE_MOST = 50, 500, 500, 200


def template_match(query: Column, service: str = SERVICE, topic: str = TOPIC, namespace: str = NAMESPACE) -> Column:
    """struct(intent, name, topic_name, namespace, limit) of the first matching intent; null if a parameter that it needs is missing."""
    take = lambda pattern, *groups: F.coalesce(*(F.nullif(F.regexp_extract(query, "(?i)" + pattern, g), F.lit("")) for g in groups))
    params = {"name": take(service, 1, 2), "topic_name": take(topic, 1), "namespace": take(namespace, 1)}
    own = X.intent(query)
    needed = F.lit(True)
    for intent, need in NEEDS.items():
        if need:
            needed = F.when(own == intent, params[need].isNotNull()).otherwise(needed)
    only = lambda p: F.when(own.isin([i for i, n in NEEDS.items() if n == p]), params[p]).alias(p)
    limit = F.when(own != "blast_radius", F.lit("10")).alias("limit")
    return F.when(own.isNotNull() & needed, F.struct(own.alias("intent"), only("name"), only("topic_name"), only("namespace"), limit))


def candidate_text(columns: dict[str, str], keys: tuple[str, ...] | None = ("name", "id", "source", "target", "result")) -> Column:
    """Values joined by blanks, nulls skipped, maps by their values; keys None takes all columns (name -> type), else the fixed ones that exist."""
    parts = []
    for c, kind in columns.items():
        if keys is None or c in keys:
            parts.append(F.array_join(F.map_values(c), " ") if kind.startswith("map") else F.col(c).cast("string"))
    return F.concat_ws(" ", *parts)


def projection(node: list[str], score: Column) -> Column:
    """All properties of a node and its score as one map of strings, nulls left out."""
    pairs = [x for c in node for x in (F.lit(c), F.col(c).cast("string"))]
    return F.map_filter(F.create_map(*pairs, F.lit("score"), score.cast("string")), lambda k, v: v.isNotNull())


def named_in(nodes: DataFrame, question: str, limit: int = CANDIDATES) -> DataFrame:
    """Full-text fallback: nodes whose name is a word of the question, in order of name and id."""
    words = F.regexp_extract_all(F.lower(F.lit(question)), F.lit(r"([a-z0-9][a-z0-9_-]*)"), F.lit(1))
    return nodes.where(F.array_contains(words, F.lower("name"))).orderBy("name", "id").limit(limit)


def ann_then_acl(vectors: DataFrame, query: list[float], k: int, tenant: str, acl: list[str] | None = None, limit: int = 10, **columns: str) -> DataFrame:
    """The k nearest of all tenants first, then the tenant and the labels, then the limit: rows of others take up room among the k."""
    id_col, vec_col = columns.get("id_col", "vec_id"), columns.get("vec_col", "embedding")
    near = vectors.withColumn("score", cosine(F.col(vec_col), F.array(*(F.lit(float(x)) for x in query)))).orderBy(F.desc("score"), id_col).limit(k)
    own = near.where(F.col("tenant_id") == tenant)
    if acl is not None:
        own = own.where(P.acl_predicate(F.col("acl_label"), acl))
    return own.orderBy(F.desc("score"), id_col).limit(limit).select(F.col(id_col).alias("id"), "score")


def similar(vector: Column, query: list[float] | None, threshold: float = 0.5) -> Column:
    """A predicate: nearer than the threshold; without a query vector nothing is asked."""
    return F.lit(True) if query is None else cosine(vector, F.array(*(F.lit(float(x)) for x in query))) > threshold


def single_hop(nodes: DataFrame, edges: DataFrame, names: DataFrame, tenant: str, degree_cap: int = DEGREE_CAP, limit: int = HOP_LIMIT, acl: list[str] | None = None) -> DataFrame:
    """(source, rel, target) of undirected live edges at the named nodes, targets below the degree cap, by degree, then names."""
    n, e = P.tenant_view(nodes, edges, tenant)
    ends = n if acl is None else n.where(P.acl_predicate(F.col("acl_label"), acl))
    ends = ends.join(P.degree(nodes, edges), "id").where(F.col("degree") < degree_cap)
    s = n.join(names.select("name").distinct(), "name", "left_semi").select(F.col("id").alias("src"), F.col("name").alias("source"))
    t = ends.select(F.col("id").alias("dst"), F.col("name").alias("target"), "degree")
    rows = P.live(P.undirected(e)).join(s, "src").join(t, "dst")
    return rows.orderBy(F.desc("degree"), "target", "source", "rel").limit(limit).select("source", "rel", "target")


def hop_targets(frontier: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 50, degree_cap: int = DEGREE_CAP, sample: int = 50, floor: float = 0.0) -> DataFrame:
    """(src, rank, rel, dst): live edges from the frontier (id) to nodes (id, pagerank, degree) whose page rank (missing: 0) reaches the floor.

    A node above the degree cap gives its `sample` best (1 to SAMPLE_MOST), others their `limit` best, by page rank, degree and id.
    """
    sample = max(1, min(SAMPLE_MOST, sample))
    own = nodes.select("id", F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"), "degree")
    s = frontier.select("id").distinct().join(own, "id").select(F.col("id").alias("src"), F.when(F.col("degree") > degree_cap, sample).otherwise(limit).alias("most"))
    t = own.where(F.col("pagerank") >= floor).withColumnRenamed("id", "dst")
    order = Window.partitionBy("src").orderBy(F.desc("pagerank"), F.desc("degree"), "dst", "rel")
    rows = P.live(edges).select("src", "rel", "dst").join(s, "src").join(t, "dst")
    most = max(limit, sample)  # a bound of the rank lets each task drop the rest before the shuffle
    return rows.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= most) & (F.col("rank") <= F.col("most"))).select("src", "rank", "rel", "dst")


def expand(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int = 2, labels: list[str] | None = None, acl: list[str] | None = None) -> DataFrame:
    """(source_id, target_id, rel_type, target_label): breadth-first over permitted nodes, each met once; edges between all nodes met.
    An empty list of access labels permits nothing but the public label."""
    n = nodes if acl is None else nodes.where(P.acl_predicate(F.col("acl_label"), acl))
    n = n if labels is None else n.where(F.col("label").isin(labels))
    own = n.select("id", "label")
    e = P.live(edges).select("src", "rel", "dst", "tombstoned_day")
    e = e.join(own.select(F.col("id").alias("src")), "src", "left_semi").join(own.select(F.col("id").alias("dst")), "dst", "left_semi")
    start = seeds.select("id").join(own, "id", "left_semi")
    met = P.reach(start, P.undirected(e.select("src", "rel", "dst", "tombstoned_day")), hops).select("id").union(start).distinct()
    inside = e.join(met.withColumnRenamed("id", "src"), "src", "left_semi").join(met.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return inside.join(own.select(F.col("id").alias("dst"), F.col("label").alias("target_label")), "dst").select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), F.col("rel").alias("rel_type"), "target_label").distinct()


def strategy(degree: Column) -> Column:
    """expand from 1,000 edges on or without a hint, bfs from 200 on, else bounded paths."""
    return F.when(degree.isNull() | (degree >= 1000), "expand").when(degree >= 200, "bfs").otherwise("bounded")


def name_batches(candidates: DataFrame, cap: int = CANDIDATES, size: int = 50) -> DataFrame:
    """(pos, name, batch): the cap best candidates (pos, name, score) by score, then place; each name once, in batches."""
    best = candidates.orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "pos").limit(cap)
    first = mutations.first_wins(best, ["name"], "pos")
    place = Window.orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "pos")  # at most cap rows
    return first.withColumn("k", F.row_number().over(place) - 1).select("pos", "name", F.floor(F.col("k") / size).cast("int").alias("batch"))


def stored_rank(edges: DataFrame, top: int = 50) -> DataFrame:
    """(id, score): nodes of edge rows (pos, source, target, source_pagerank, target_pagerank) by the page rank first seen; sources before targets, missing 0."""
    side = lambda k, c: edges.select("pos", F.lit(k).alias("k"), F.col(c).alias("id"), F.coalesce(f"{c}_pagerank", F.lit(0.0)).alias("score"))
    both = side(0, "source").union(side(1, "target")).where("coalesce(id, '') <> ''")
    first = both.groupBy("id").agg(F.min(F.struct("pos", "k", "score")).alias("f"))
    return first.select("id", F.col("f.score").alias("score"), "f").orderBy(F.desc("score"), "f.pos", "f.k").limit(top).select("id", "score")


def neighbourhood_rank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, top: int = 50, rounds: int = 20) -> DataFrame:
    """(id, score): page rank over the edges that touch the seeds' neighbourhood, not personalised."""
    e = P.live(edges).select("src", "rel", "dst")
    s = seeds.select("id").distinct()
    near = e.join(s, e["src"] == s["id"]).select(F.col("dst").alias("id")).union(e.join(s, e["dst"] == s["id"]).select(F.col("src").alias("id"))).union(s).distinct()
    sub = e.join(near.withColumnRenamed("id", "src"), "src", "left_semi").join(near.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return ranking.pagerank(sub, nodes.select("id").join(near, "id", "left_semi"), rounds).orderBy(F.desc("score"), "id").limit(top)


def rerank(candidates: DataFrame, question: str, structure: DataFrame | None = None, lam: float | None = 0.7) -> DataFrame:
    """(id, rank) of candidates (id, text): BM25 over the candidates, mixed with structural similarity if given; unless lam is None the best CANDIDATES are put in
    order of diversity, and the others follow. Ranks are counted in ranges, so that no task sees all rows; equal scores (to nine decimals) go by id.
    """
    scored = ranking.bm25(candidates, question, id_col="id")
    scored = candidates.select("id", "text").join(scored, "id", "left").select("id", "text", F.coalesce("score", F.lit(0.0)).alias("score"))
    if structure is not None:
        scored = ranking.linear_fusion(scored.select("id", "score"), structure).join(candidates.select("id", "text"), "id")
    placed = scored.withColumn("score", F.round("score", 9)).withColumn("_one", F.lit(1))
    placed = context.prefix_sums(placed, (F.desc("score"), F.col("id")), "_one", "rank").withColumn("rank", F.col("rank").cast("int"))
    if lam is None:
        return placed.select("id", "rank")
    page = placed.where(F.col("rank") <= CANDIDATES).select(F.lit(1).alias("query_id"), "id", "score", X.tokens(F.col("text")).alias("words"))
    page = ranking.mmr(page, lam).select("id", F.col("rank").alias("_rank"))
    return placed.join(page, "id", "left").select("id", F.coalesce("_rank", "rank").alias("rank"))


@dataclass
class Question:
    """What a question may see, and what it carries."""

    text: str
    tenant: str
    acl: list[str] | None = None
    vector: list[float] | None = None
    budget: int = 32_000
    extra: dict = field(default_factory=dict)


def retrieve(q: Question, nodes: DataFrame, edges: DataFrame, vectors: DataFrame | None = None) -> tuple[str, DataFrame, DataFrame | None, bool]:
    """(route, candidates (id, fields), results (fields) or None, degraded): vector, single hop, template or both, as the question's class says.

    Without a vector or a vector table the candidates are nodes that the question names, and the answer is marked as degraded.
    """
    spark = nodes.sparkSession
    told = spark.range(1).select(X.route(X.classify(F.lit(q.text))).alias("route"), template_match(F.lit(q.text)).alias("m")).first()
    own, _ = P.tenant_view(nodes, edges, q.tenant, q.acl)
    degraded = q.vector is None or vectors is None
    if degraded:
        found = named_in(own, q.text).withColumn("score", F.lit(1.0))
    else:
        near = ranking.knn(vectors, q.vector, CANDIDATES, q.tenant, id_col=q.extra.get("id_col", "id"))
        found = own.join(near, "id")
    found = mutations.without_tombstoned(found, edges, q.tenant)
    columns = [c for c in nodes.columns if c != "tenant_id"]
    candidates = found.select("id", projection(columns, F.col("score")).alias("fields"))
    results = None
    if told["route"] == "single_hop":
        results = single_hop(nodes, edges, found.select("name"), q.tenant, acl=q.acl)
    elif told["route"] in ("cypher", "hybrid") and told["m"] is not None:
        m = told["m"]
        given = m["name"] or m["topic_name"] or m["namespace"]
        seen = nodes if q.acl is None else nodes.where(P.acl_predicate(F.col("acl_label"), q.acl))
        run = getattr(T, m["intent"])
        results = run(seen, edges, q.tenant, given) if given else run(seen, edges, q.tenant)
    if results is not None:
        pairs = [x for c in results.columns for x in (F.lit(c), F.col(c).cast("string"))]
        results = results.select(F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("fields"))
    return told["route"], candidates, results, degraded


def assemble(candidates: DataFrame, results: DataFrame | None, degraded: bool = False, notice: str = "some sources were not reachable") -> DataFrame:
    """(id, kind, fields, text): a notice if degraded, candidates, then results; repeated rows once."""
    rows = candidates.select(F.lit("candidate").alias("kind"), "fields")
    if results is not None:
        rows = rows.union(results.select(F.lit("result"), "fields"))
    if degraded:
        rows = candidates.sparkSession.createDataFrame([("notice", {"_degradation_notice": notice})], rows.schema).union(rows)
    text = F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: e["value"]), " ")
    rows = rows.withColumn("text", text)
    return rows.withColumn("id", F.concat_ws(":", "kind", F.sha2("text", 256))).dropDuplicates(["id"]).select("id", "kind", "fields", "text")


def answer_context(q: Question, nodes: DataFrame, edges: DataFrame, vectors: DataFrame | None = None, lam: float | None = None) -> DataFrame:
    """(rank, kind, text): the reranked context of a question within its token budget; the notice comes first."""
    _, candidates, results, degraded = retrieve(q, nodes, edges, vectors)
    rows = assemble(candidates, results, degraded)
    ranked = rerank(rows.select("id", "text"), q.text, lam=lam).join(rows, "id")
    first = F.when(F.col("kind") == "notice", 0).otherwise(F.col("rank"))
    return context.prefix_truncate(ranked.select(first.alias("rank"), "kind", "text", count_tokens(F.col("text")).alias("cost")), q.budget, (), ("rank",)).select("rank", "kind", "text")


def compress(rows: DataFrame, threshold: int = 24_000, summarise=None) -> tuple[DataFrame, bool]:
    """rows (id, text) as they are up to the threshold of tokens, else what summarise (by default the token prefix) makes of them."""
    total = rows.agg(F.coalesce(F.sum(count_tokens(F.col("text"))), F.lit(0))).first()[0]
    if total <= threshold:
        return rows, False
    short = summarise or (lambda df: context.truncate(df if "score" in df.columns else df.withColumn("score", F.lit(0.0)), threshold))
    return short(rows), True
