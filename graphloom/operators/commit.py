"""Commits of a topology to versioned tables, with their checks, outboxes and side tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators import snapshots
from graphloom.operators.context import prefix_sums

# Labels and relationship types of the ontology, what a relationship joins, and the signs that no reference may hold.
NODE_LABELS = ("Service", "Database", "KafkaTopic", "K8sDeployment")
EDGE_ENDS = {"CALLS": ("service", "service"), "PRODUCES": ("service", "topic"), "CONSUMES": ("service", "topic"), "DEPLOYED_IN": ("service", "deployment")}
IDENTIFIER = r"^[a-zA-Z0-9][a-zA-Z0-9._-]{0,252}$"
UNSAFE = r"['\"{};\\`\x00]"
REFERENCE_MOST = 512


def valid_identifier(c: Column) -> Column:
    return F.coalesce(c.rlike(IDENTIFIER), F.lit(False))


def valid_reference(c: Column) -> Column:
    """Not empty, at most REFERENCE_MOST characters, without quotes, braces and the like."""
    return F.coalesce((F.length(c) > 0) & (F.length(c) <= REFERENCE_MOST) & ~c.rlike(UNSAFE), F.lit(False))


def content_hash(columns: list[str], leave_out: tuple[str, ...] = ("content_hash", "rbac_labels")) -> Column:
    """sha256 of the row as JSON, keys sorted, nulls written."""
    own = sorted(c for c in columns if c not in leave_out)
    return F.sha2(F.to_json(F.struct(*own), {"ignoreNullFields": "false"}), 256)


def for_write(entities: DataFrame) -> DataFrame:
    """Rows sorted by (type, identity) within each partition; the first of id, name, source_service_id, service_id names a row."""
    names = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("id", "name", "source_service_id", "service_id") if c in entities.columns]
    return entities.withColumn("identity", F.coalesce(*names, F.lit(""))).sortWithinPartitions("type", "identity")


def chunks(entities: DataFrame, size: int = 100) -> DataFrame:
    """rows and chunk: rows of each type in groups of `size`, in order of identity; ranges of a type are numbered apart and then shifted."""
    one = entities.withColumn("_one", F.lit(1))
    ahead = prefix_sums(one, ("type", "identity"), "_one", "_n")
    first = ahead.groupBy("type").agg(F.min("_n").alias("_first"))
    return ahead.join(F.broadcast(first), "type").withColumn("chunk", F.floor((F.col("_n") - F.col("_first")) / size).cast("int")).drop("_one", "_n", "_first")


def unknown_types(rows: DataFrame, column: str, known: tuple[str, ...]) -> DataFrame:
    return rows.where(~F.coalesce(F.col(column).isin(*known), F.lit(False))).select(column).distinct()


def topology_errors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(error) of every edge end without a node, and of every type outside the ontology, in words."""
    ids = nodes.select("id").distinct()
    out = unknown_types(nodes, "label", NODE_LABELS).select(F.concat(F.lit("Unknown entity type: "), F.coalesce("label", F.lit("null"))).alias("error"))
    known = F.col("rel").isin(*EDGE_ENDS)
    for side, k in (("src", 0), ("dst", 1)):
        lost = edges.where(known).join(ids.withColumnRenamed("id", side), side, "left_anti")
        what = F.lit(None).cast("string")
        for rel, ends in EDGE_ENDS.items():
            both = ends[0] == ends[1]
            what = F.when(F.col("rel") == rel, (("source " if k == 0 else "target ") if both else "") + ends[k]).otherwise(what)
        kind = F.concat(F.replace(F.initcap(F.translate("rel", "_", " ")), F.lit(" "), F.lit("")), F.lit("Edge"))
        out = out.union(lost.select(F.concat(kind, F.lit(" references unknown "), what, F.lit(": "), F.col(side))))
    return out.union(edges.where(~F.coalesce(known, F.lit(False))).select(F.concat(F.lit("Unknown entity type: "), F.coalesce("rel", F.lit("null"))).alias("error")).distinct())


def checked(nodes: DataFrame, edges: DataFrame) -> None:
    """Raises on types outside the ontology."""
    for rows, column, known in ((nodes, "label", (*NODE_LABELS, "MacroNode")), (edges, "rel", (*EDGE_ENDS, "READS_FROM", "WRITES_TO"))):
        bad = [r[0] for r in unknown_types(rows, column, known).limit(5).collect()]
        if bad:
            raise TypeError(f"unknown types {bad}")


def topology_tables(nodes: DataFrame, edges: DataFrame) -> dict:
    """Tables for snapshots.commit: nodes first, then the edges whose ends are among the nodes as merged."""

    def joined(tables: dict) -> tuple[DataFrame, list[str]]:
        rows = edges
        for end in ("src", "dst"):
            rows = snapshots.present(edges.sparkSession, tables.get("nodes"), rows, {"tenant_id": "tenant_id", "id": end})
        return rows, ["tenant_id", "src", "rel", "dst"]

    return {"nodes": (nodes, ["tenant_id", "id"]), "edges": joined}


def commit_topology(spark: SparkSession, folder: str, nodes: DataFrame, edges: DataFrame, outbox: DataFrame | None = None, app: str = "", number: int | None = None) -> int:
    """Merges nodes, then edges, and the outbox events of the same batch if given, in one commit; returns the version.

    Types outside the ontology raise before anything is written; edges without both nodes are left out; rows of unchanged content are left alone.
    """
    checked(nodes, edges)
    return snapshots.commit(spark, folder, topology_tables(nodes, edges), outbox, app, number)


def current(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return snapshots.read(spark, folder, name)


def durable_sink(publish, commit):
    """A foreachBatch function: the batch is published as JSON first, then committed; a failed publish commits nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            publish(batch.select(F.to_json(F.struct(*batch.columns)).alias("value")), epoch)
            commit(batch, epoch)
        finally:
            batch.unpersist()

    return write


def embedding_upsert(nodes: DataFrame, vectors: DataFrame, by_tenant: bool = True) -> DataFrame:
    """nodes with the embedding of (id, tenant_id, embedding) where there is one; vectors of unknown nodes are ignored."""
    keys = ["id", "tenant_id"] if by_tenant else ["id"]
    new = vectors.groupBy(*keys).agg(F.max_by("embedding", F.xxhash64("embedding")).alias("_new"))
    old = F.col("embedding") if "embedding" in nodes.columns else F.lit(None).cast(dict(vectors.dtypes)["embedding"])
    return nodes.join(new, keys, "left").withColumn("embedding", F.coalesce("_new", old)).drop("_new")


#: What of a node is embedded, by label; a property that is missing is left out.
EMBEDDED = {
    "Service": ["{name}", "{language}", "{framework}"],
    "KafkaTopic": ["{name}", "partitions={partitions}", "retention={retention_ms}ms"],
    "Database": ["{id}", "type={db_type}"],
    "K8sDeployment": ["{id}", "namespace={namespace}", "replicas={replicas}"],
}


def embedding_text(columns: list[str]) -> Column:
    """The text that stands for a node, from the columns that exist; null for labels that aren't embedded."""
    out = F.lit(None).cast("string")
    for label, parts in EMBEDDED.items():
        shown = []
        for part in parts:
            head, name, tail = part.replace("}", "{").split("{")
            if name in columns:
                shown.append(F.concat(F.lit(head), F.col(name).cast("string"), F.lit(tail)))
        out = F.when(F.col("label") == label, F.concat_ws(" ", *shown)).otherwise(out)
    return out


def embeddings_due(nodes: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, tenant_id, text, content_hash) of nodes whose text isn't the one that the store (id, tenant_id, content_hash) was made from."""
    own = nodes.withColumn("text", embedding_text(nodes.columns)).where("text is not null").select("id", "tenant_id", "text", F.sha2("text", 256).alias("content_hash"))
    return own.join(stored.select("id", "tenant_id", "content_hash").distinct(), ["id", "tenant_id", "content_hash"], "left_anti").select(own.columns)


def vector_upsert(store: DataFrame, new: DataFrame) -> DataFrame:
    """store (id, tenant_id, embedding, ...) with rows of the same id and tenant replaced."""
    return store.join(new.select("id", "tenant_id"), ["id", "tenant_id"], "left_anti").unionByName(new, allowMissingColumns=True)


def vector_delete(store: DataFrame, ids: DataFrame, tenant: str) -> tuple[DataFrame, DataFrame]:
    """(the store without those ids of the tenant, one row with the number removed); other tenants' rows of the same id stay."""
    gone = store.where(F.col("tenant_id") == tenant).join(ids.select("id").distinct(), "id", "left_semi")
    left = store.join(gone.select("id", "tenant_id").distinct(), ["id", "tenant_id"], "left_anti")
    return left, gone.agg(F.count("*").alias("n_removed"))


def upload_key(tenant: Column, path: Column, prefix: str = "") -> Column:
    return F.concat_ws("/", tenant, *([F.lit(prefix.strip("/"))] if prefix.strip("/") else []), F.ltrim(path, F.lit("/")))


def pending_files(files: DataFrame, status: DataFrame) -> DataFrame:
    """Files (path) that the status table (path, status) knows and has not done; files it doesn't know are left out."""
    return files.join(status.where("status in ('pending', 'failed')").select("path", "status"), "path").drop("status")


def mark(status: DataFrame, done: DataFrame) -> DataFrame:
    """The status table with the outcomes (path, status) of known paths; unknown paths are not added."""
    new = done.groupBy("path").agg(F.max("status").alias("_new"))
    return status.join(new, "path", "left").select("path", F.coalesce("_new", "status").alias("status"))


def retry_failed(status: DataFrame) -> DataFrame:
    return status.withColumn("status", F.when(F.col("status") == "failed", "pending").otherwise(F.col("status")))


def export_tenant(nodes: DataFrame, edges: DataFrame, tenant: str) -> DataFrame:
    """(kind, id, body): every node and edge of a tenant as JSON."""
    own = lambda df, kind, name: df.where(F.col("tenant_id") == tenant).select(F.lit(kind).alias("kind"), name.alias("id"), F.to_json(F.struct(*df.columns)).alias("body"))
    return own(nodes, "node", F.col("id")).union(own(edges, "edge", F.concat_ws("|", "src", "rel", "dst")))


def verify_erasure(nodes: DataFrame, edges: DataFrame, tenant: str) -> DataFrame:
    """One row: what is left of a tenant, and whether that is nothing."""
    left = nodes.where(F.col("tenant_id") == tenant).select(F.lit(1)).union(edges.where(F.col("tenant_id") == tenant).select(F.lit(1)))
    return left.agg(F.count("*").alias("remaining")).withColumn("verified", F.col("remaining") == 0)


def upsert_summaries(store: DataFrame, new: DataFrame) -> DataFrame:
    """The summary table keyed by (tenant_id, community_id), with new rows in place of old."""
    return store.join(new.select("tenant_id", "community_id"), ["tenant_id", "community_id"], "left_anti").unionByName(new)


def macro_text(node: Column, community: Column, members: Column, summary: Column) -> Column:
    return F.concat(F.lit("[MacroNode "), node, F.lit("] (community="), community, F.lit(", members="), members.cast("string"), F.lit("): "), summary)


def first_of_window(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_r = 1").drop("_r")
