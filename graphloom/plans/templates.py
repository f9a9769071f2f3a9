"""The query catalogue: parameterised patterns over the property graph. Every template sees one tenant's live graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import patterns as P


def blast_radius(nodes: DataFrame, edges: DataFrame, tenant: str, name: str, hops: int = 3) -> DataFrame:
    n, e = P.tenant_view(nodes, edges, tenant)
    seeds = n.where((F.col("name") == name) & (F.col("label") == "Service"))
    hit = P.reach(seeds, e.where(F.col("rel").isin("CALLS", "PRODUCES", "CONSUMES")), hops).select("id").distinct()
    return hit.join(n, "id").select(F.col("name").alias("affected_service"), F.col("label").alias("node_type")).distinct().orderBy("affected_service", "node_type")


def dependency_count(nodes: DataFrame, edges: DataFrame, tenant: str, limit: int = 10) -> DataFrame:
    h = P.hop(*P.tenant_view(nodes, edges, tenant), ["CALLS"]).where("s_label = 'Service' and t_label = 'Service'")
    return h.groupBy(F.col("t_name").alias("service")).agg(F.count("*").alias("inbound_dependency_count")).orderBy(F.desc("inbound_dependency_count"), "service").limit(limit)


def service_neighbors(nodes: DataFrame, edges: DataFrame, tenant: str, name: str, limit: int = 10) -> DataFrame:
    n, e = P.tenant_view(nodes, edges, tenant)
    h = P.hop(n, P.undirected(e)).where((F.col("s_name") == name) & (F.col("s_label") == "Service"))
    return h.select(F.col("s_name").alias("source"), F.col("rel").alias("relationship"), F.col("t_name").alias("target"), F.col("t_label").alias("target_type")).orderBy("relationship", "target").limit(limit)


def _ends(nodes: DataFrame, edges: DataFrame, tenant: str, rels: list[str], where, columns: dict[str, str], order: list[str], limit: int | None = None, distinct: bool = False) -> DataFrame:
    out = P.hop(*P.tenant_view(nodes, edges, tenant), rels).where(where).select([F.col(c).alias(a) for a, c in columns.items()])
    out = (out.distinct() if distinct else out).orderBy(order)
    return out if limit is None else out.limit(limit)


def topic_consumers(nodes, edges, tenant: str, topic_name: str, limit: int = 10) -> DataFrame:
    return _ends(nodes, edges, tenant, ["CONSUMES"], F.col("t_name") == topic_name, {"consumer_service": "s_name", "topic": "t_name"}, ["consumer_service"], limit)


def topic_producers(nodes, edges, tenant: str, topic_name: str, limit: int = 10) -> DataFrame:
    return _ends(nodes, edges, tenant, ["PRODUCES"], F.col("t_name") == topic_name, {"producer_service": "s_name", "topic": "t_name"}, ["producer_service"], limit)


def service_deployments(nodes, edges, tenant: str, name: str) -> DataFrame:
    return _ends(nodes, edges, tenant, ["DEPLOYED_IN"], F.col("s_name") == name, {"service": "s_name", "namespace": "t_namespace", "replicas": "t_replicas"}, ["namespace"])


def namespace_services(nodes, edges, tenant: str, namespace: str) -> DataFrame:
    return _ends(nodes, edges, tenant, ["DEPLOYED_IN"], F.col("t_namespace") == namespace, {"service": "s_name", "namespace": "t_namespace"}, ["service"], distinct=True)


def service_databases(nodes, edges, tenant: str, name: str) -> DataFrame:
    return _ends(nodes, edges, tenant, ["WRITES_TO", "READS_FROM"], F.col("s_name") == name, {"service": "s_name", "database": "t_id", "db_type": "t_db_type"}, ["database"])


def cross_team_dependencies(nodes, edges, tenant: str, limit: int = 10) -> DataFrame:
    columns = {"caller": "s_name", "caller_team": "s_team_owner", "callee": "t_name", "callee_team": "t_team_owner"}
    return _ends(nodes, edges, tenant, ["CALLS"], "s_team_owner <> t_team_owner", columns, ["caller_team", "callee_team", "caller", "callee"], limit)


def acl_single_hop(nodes, edges, tenant: str, source: str, rel: str, acl: list[str], limit: int = 10, admin: bool = False) -> DataFrame:
    if rel not in ("CALLS", "PRODUCES", "CONSUMES", "DEPLOYED_IN"):
        raise ValueError(f"relationship {rel} is not on the allow-list")
    n, e = P.tenant_view(nodes, edges, tenant, acl, admin)
    return P.hop(n, e, [rel]).where(F.col("s_id") == source).select(F.col("t_id").alias("id"), F.col("t_name").alias("name"), F.col("t_label").alias("label")).orderBy("id").limit(limit)


def acl_multi_hop(nodes, edges, tenant: str, source: str, acl: list[str], depth: int = 3, limit: int | None = 10, admin: bool = False) -> DataFrame:
    """(name, hops), one row for each path of calls whose nodes are all visible."""
    n, e = P.tenant_view(nodes, edges, tenant, acl, admin)
    seen = n.select(F.col("id"))
    e = P.live(e).where("rel = 'CALLS'").join(seen.withColumnRenamed("id", "src"), "src", "left_semi").join(seen.withColumnRenamed("id", "dst"), "dst", "left_semi")
    p = P.paths(n.where(F.col("id") == source), e.withColumn("eid", F.xxhash64("src", "rel", "dst")), 1, min(depth, 5))
    out = p.join(n.select("id", "name"), "id").select("name", "hops").orderBy("hops", "name")
    return out if limit is None else out.limit(limit)


def backpressure(nodes, edges, tenant: str) -> DataFrame:
    """Producers and consumers that share a topic: topic, producer, consumers (sorted)."""
    n, e = P.tenant_view(nodes, edges, tenant)
    live = P.live(e)
    made = live.where("rel = 'PRODUCES'").select(F.col("dst").alias("topic"), F.col("src").alias("producer"))
    used = live.where("rel = 'CONSUMES'").groupBy(F.col("dst").alias("topic")).agg(F.array_join(F.array_sort(F.collect_set("src")), ",").alias("consumers"))
    return made.join(used, "topic", "left").select("topic", "producer", F.coalesce("consumers", F.lit("")).alias("consumers"))


def outside_namespace(nodes, edges, tenant: str, namespace: str) -> DataFrame:
    """Services that call services of a namespace without being deployed in it themselves."""
    n, e = P.tenant_view(nodes, edges, tenant)
    inside = P.hop(n, e, ["DEPLOYED_IN"]).where(F.col("t_namespace") == namespace).select(F.col("s_id").alias("id")).distinct()
    calls = P.live(e).where("rel = 'CALLS'")
    return calls.join(inside.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct().join(inside, "id", "left_anti").select(F.col("id").alias("caller"))


def protocol_audit(nodes, edges, tenant: str) -> DataFrame:
    _, e = P.tenant_view(nodes, edges, tenant)
    return P.live(e).where("rel = 'CALLS'").groupBy("protocol").agg(F.count("*").alias("n_calls"), F.count_distinct("src").alias("n_callers"))


def list_entities(nodes, tenant: str, limit: int = 50, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1 to 500 and offset at least 0")
    return nodes.where(F.col("tenant_id") == tenant).orderBy("name", "id").offset(offset).limit(limit).select("id", "name", "label")


def entity_detail(nodes, edges, tenant: str) -> DataFrame:
    """Every entity with its outgoing relationships as one sorted text; entities without any are kept."""
    n, e = P.tenant_view(nodes, edges, tenant)
    rels = P.live(e).groupBy(F.col("src").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(">", "rel", "dst"))), ",").alias("rels"), F.count("*").alias("n_rels"))
    return n.select("id", "label").join(rels, "id", "left").select("id", "label", F.coalesce("rels", F.lit("")).alias("rels"), F.coalesce("n_rels", F.lit(0)).cast("long").alias("n_rels"))


def neighbors(nodes, edges, tenant: str, source: str, hops: int = 2) -> DataFrame:
    """(id, rel) distinct over undirected paths of 1..hops edges, every relationship type on a path; dead edges count here."""
    n, e = P.tenant_view(nodes, edges, tenant)
    p = P.paths(n.where(F.col("id") == source), P.undirected(e), 1, hops)
    return p.select("id", F.explode("rels").alias("rel")).distinct().withColumn("hops", F.lit(hops))


def stats_nodes(nodes, tenant: str, labels: list[str]) -> DataFrame:
    """Counts by label, zeros kept."""
    want = nodes.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    n = nodes.where(F.col("tenant_id") == tenant).groupBy("label").agg(F.count("*").alias("n"))
    return want.join(n, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def stats_edges(edges, tenant: str, rels: list[str]) -> DataFrame:
    want = edges.sparkSession.createDataFrame([(x,) for x in rels], "rel string")
    n = edges.where(F.col("tenant_id") == tenant).groupBy("rel").agg(F.count("*").alias("n"))
    return want.join(n, "rel", "left").select("rel", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
