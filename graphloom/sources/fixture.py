"""A property graph derived from the driver's relational tables.

One SQL text defines the node and edge tables; Spark runs it with DataFrames bound to the braces, a SQL oracle with table names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from graphloom.session import shared_folder, table

GRAPH_CTES = """
l as (select l_orderkey, l_partkey, max(year(l_shipdate)) y, bool_and(l_returnflag = 'R') dead
      from {lineitem} where l_quantity >= 35 group by l_orderkey, l_partkey),
pairs as (select a.l_partkey p1, b.l_partkey p2, max(greatest(a.y, b.y)) y, bool_and(a.dead and b.dead) dead
          from l a join l b on a.l_orderkey = b.l_orderkey where a.l_partkey < b.l_partkey group by a.l_partkey, b.l_partkey),
calls as (select case when (p1 + p2) % 5 = 0 then p2 else p1 end s, case when (p1 + p2) % 5 = 0 then p1 else p2 end d,
                 case when (p1 + p2) % 3 = 0 then 'grpc' else 'http' end protocol, y, dead, p1 from pairs where p1 % 2 = p2 % 2),
topics as (select l_partkey s, l_suppkey d, l_linestatus st, max(year(l_shipdate)) y, bool_and(l_returnflag = 'R') dead
           from {lineitem} where l_quantity >= 48 and l_partkey % 2 = l_suppkey % 2 group by l_partkey, l_suppkey, l_linestatus),
service as (select p_partkey k, concat('svc-', cast(p_partkey as string)) id, concat('t', cast(p_partkey % 2 as string)) tenant_id,
                   p_type, p_brand, p_partkey % 25 nk from {part}),
nodes as (
  select s.id, 'Service' label, s.id name, s.tenant_id, s.p_brand team_owner, s.p_type language, cast(null as string) namespace,
         cast(null as int) replicas, cast(null as string) db_type, concat('Ns_', lower(r_name)) acl_label
  from service s join {nation} n on s.nk = n_nationkey join {region} r on n_regionkey = r_regionkey
  union all
  select concat('topic-', cast(s_suppkey as string)), 'KafkaTopic', concat('topic-', cast(s_suppkey as string)), concat('t', cast(s_suppkey % 2 as string)),
         null, null, null, null, null, null from {supplier}
  union all
  select concat('dep-', cast(n_nationkey as string), '@', t.tenant_id), 'K8sDeployment', concat('dep-', cast(n_nationkey as string)), t.tenant_id, null, null, lower(r_name),
         cast(n_nationkey % 5 + 1 as int), null, null
  from {nation} n join {region} r on n_regionkey = r_regionkey cross join (select distinct tenant_id from service) t
  union all
  select distinct concat('db-', replace(p_type, ' ', '-'), '@', tenant_id), 'Database', concat('db-', replace(p_type, ' ', '-')), tenant_id, null, null, null, null, p_type, null
  from service),
edges as (
  select concat('svc-', cast(s as string)) src, 'CALLS' rel, concat('svc-', cast(d as string)) dst, concat('t', cast(s % 2 as string)) tenant_id, protocol,
         concat('y', cast(y as string)) ingestion_id, case when dead then cast(10227 + p1 % 28 as bigint) end tombstoned_day from calls
  union all
  select concat('svc-', cast(s as string)), case when st = 'F' then 'PRODUCES' else 'CONSUMES' end, concat('topic-', cast(d as string)), concat('t', cast(s % 2 as string)),
         null, concat('y', cast(y as string)), case when dead then cast(10227 + s % 28 as bigint) end from topics
  union all
  select id, 'DEPLOYED_IN', concat('dep-', cast(nk as string), '@', tenant_id), tenant_id, null, 'y1998', cast(null as bigint) from service
  union all
  select id, 'READS_FROM', concat('db-', replace(p_type, ' ', '-'), '@', tenant_id), tenant_id, null, 'y1998', cast(null as bigint) from service)
"""

TABLES = ("lineitem", "part", "supplier", "nation", "region")


def oracle(select: str, ctes: str = "") -> str:
    """DuckDB SQL: the graph's CTEs, more CTEs, and a select."""
    return "with recursive " + GRAPH_CTES.format(**{t: t for t in TABLES}) + (", " + ctes if ctes else "") + " " + select


def derive(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as a plan over the relational tables."""
    own = {t: table(spark, sf_dir, t) for t in TABLES}
    return tuple(spark.sql("with " + GRAPH_CTES + f" select * from {what}", **own) for what in ("nodes", "edges"))


_written: dict[tuple[str, str], str] = {}


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges), derived once for each application and folder: Parquet in the shared folder, partitioned by tenant.

    The tables of a folder are taken not to change while an application runs.
    """
    plans, key = derive(spark, sf_dir), (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        folder = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
        for name, plan in zip(("nodes", "edges"), plans, strict=True):
            plan.write.partitionBy("tenant_id").parquet(f"{folder}/{name}")
        _written[key] = folder
    return tuple(spark.read.schema(p.schema).parquet(f"{_written[key]}/{name}").select(p.columns) for name, p in zip(("nodes", "edges"), plans, strict=True))
