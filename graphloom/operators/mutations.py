"""Upserts, tombstones, erasure, integrity and reconciliation, as rewrites of whole tables.

Plain Parquet has no row operations: each function returns the new state (or the report), to be written to a new version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.patterns import live


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """One row for each key: a new row replaces the old one whatever its version, and of several new rows the largest version stays; nulls overwrite."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("_side"), F.desc(version))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_side")


def upsert_edges(old: DataFrame, new: DataFrame, nodes: DataFrame, version: str = "version") -> DataFrame:
    """New edges with an unknown end are dropped, the rest upserted by (src, rel, dst)."""
    ends = nodes.select("id", "tenant_id")
    known = new.join(ends.select(F.col("id").alias("src"), "tenant_id"), ["src", "tenant_id"], "left_semi")
    known = known.join(ends.select(F.col("id").alias("dst"), "tenant_id"), ["dst", "tenant_id"], "left_semi")
    return upsert(old, known.select(new.columns), ["src", "rel", "dst"], version)


def first_wins(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Ordered dedup: the first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(position))).where("_n = 1").drop("_n")


def _stale(ingestion_id: str) -> Column:
    return F.col("tombstoned_day").isNull() & F.col("ingestion_id").isNotNull() & (F.col("ingestion_id") != ingestion_id)


def tombstone_stale(edges: DataFrame, tenant: str, ingestion_id: str, day: int) -> DataFrame:
    """Edges of the tenant that another ingestion wrote get a tombstone."""
    hit = (F.col("tenant_id") == tenant) & _stale(ingestion_id)
    return edges.withColumn("tombstoned_day", F.when(hit, F.lit(day).cast("long")).otherwise(F.col("tombstoned_day")))


def stale_report(edges: DataFrame, tenant: str, ingestion_id: str) -> DataFrame:
    return edges.where((F.col("tenant_id") == tenant) & _stale(ingestion_id)).agg(F.count("*").alias("n_tombstoned"), F.count_distinct("src").alias("n_sources"))


def reap(edges: DataFrame, tenant: str, today: int, ttl_days: int = 7) -> DataFrame:
    """Edges of the tenant whose tombstone is older than the ttl are gone."""
    old = (F.col("tenant_id") == tenant) & F.coalesce(F.col("tombstoned_day") < today - ttl_days, F.lit(False))
    return edges.where(~old)


def stamp(edges: DataFrame, ingestion_id: str, seen_at: Column | None = None) -> DataFrame:
    return edges.withColumns({"ingestion_id": F.lit(ingestion_id), "last_seen_at": F.current_timestamp() if seen_at is None else seen_at})


def hot_targets(edges: DataFrame, threshold: int = 10) -> DataFrame:
    return edges.groupBy("dst").agg(F.count("*").alias("n_edges")).where(F.col("n_edges") >= threshold)


def split_hot(edges: DataFrame, threshold: int = 10) -> tuple[DataFrame, DataFrame]:
    """(regular, hot) edges by the number of edges of their target."""
    hot = hot_targets(edges, threshold).select("dst")
    return edges.join(hot, "dst", "left_anti"), edges.join(hot, "dst", "left_semi")


def without_tombstoned(candidates: DataFrame, edges: DataFrame, tenant: str, id_col: str = "id") -> DataFrame:
    """Candidates with any dead outgoing edge are hidden; those without an id stay."""
    dead = edges.where((F.col("tenant_id") == tenant) & F.col("tombstoned_day").isNotNull()).select(F.col("src").alias(id_col)).distinct()
    return candidates.join(dead, id_col, "left_anti")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each edge end without a node: rel, side, id."""
    ids = nodes.select("id").distinct()
    side = lambda c: edges.select("rel", F.lit(c).alias("side"), F.col(c).alias("id")).join(ids, "id", "left_anti").select("rel", "side", "id")
    return side("src").union(side("dst"))


def merge_extractions(parsed: DataFrame, guessed: DataFrame) -> DataFrame:
    """Parsed services win (confidence 1.0); guesses may only switch telemetry on, or add services at 0.7."""
    p, g = parsed.select("id", F.col("otel").alias("p_otel")), guessed.groupBy("id").agg(F.bool_or("otel").alias("g_otel"))
    both = p.join(g, "id", "full_outer")
    otel = F.coalesce("p_otel", F.lit(False)) | F.coalesce("g_otel", F.lit(False))
    return both.select("id", otel.alias("otel"), F.when(F.col("p_otel").isNotNull(), 1.0).otherwise(0.7).alias("confidence"))


def reconcile(graph: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, state): missing, stale (another version token, nulls equal) or orphan, for all ids that differ."""
    g, v = graph.select("id", F.col("version").alias("gv"), F.lit(1).alias("g")), vectors.select("id", F.col("version").alias("vv"), F.lit(1).alias("v"))
    state = F.when(F.col("v").isNull(), "missing").when(F.col("g").isNull(), "orphan").when(~F.col("gv").eqNullSafe(F.col("vv")), "stale")
    return g.join(v, "id", "full_outer").select("id", state.alias("state")).where("state is not null")


def erase_tenant(nodes: DataFrame, edges: DataFrame, tenant: str) -> tuple[DataFrame, DataFrame]:
    return nodes.where(F.coalesce(F.col("tenant_id") != tenant, F.lit(True))), edges.where(F.coalesce(F.col("tenant_id") != tenant, F.lit(True)))


def erase_subject(nodes: DataFrame, subject: str, columns: tuple[str, ...] = ("subject_id", "owner", "team_owner")) -> DataFrame:
    own = [F.coalesce(F.col(c) == subject, F.lit(False)) for c in columns if c in nodes.columns]
    hit = own[0]
    for c in own[1:]:
        hit = hit | c
    return nodes.where(~hit)


def unchanged_filter(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files whose (path, content hash) is not yet done."""
    return files.withColumn("content_hash", F.sha2("content", 256)).join(done.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def degree_refresh(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    from graphloom.operators.patterns import degree

    return nodes.drop("degree").join(degree(nodes, edges), "id", "left")


def change_feed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(mutation_type, src, dst): edges that got a tombstone since."""
    gone = live(old).select("src", "rel", "dst").join(new.where("tombstoned_day is not null").select("src", "rel", "dst"), ["src", "rel", "dst"])
    return gone.select(F.lit("edge_tombstone").alias("mutation_type"), "src", "dst")


def partition_key(namespace_acl: Column, owner: Column) -> Column:
    """What a buffered sink groups nodes by: the first namespace, else the owner, else _default."""
    return F.coalesce(F.try_element_at(namespace_acl, F.lit(1)), owner, F.lit("_default"))
