"""More registered queries: writes, governance, scalar functions and stream helpers, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.functions import text as X
from graphloom.operators import evaluate, mutations
from graphloom.plans.queries import ORACLE_SQL, QUERIES, QUESTIONS, TENANT, on_graph, query
from graphloom.session import table
from graphloom.sources import files
from graphloom.streaming import streams

__all__ = ["ORACLE_SQL", "QUERIES"]  # with those of queries, which share the registry


@on_graph(
    "edge_upsert",
    "select src, rel, dst, max(version) version from (select src, rel, dst, 1 version from edges where rel = 'CALLS' union all select src, rel, dst, 2 from edges e where (protocol = 'grpc' or rel in ('DEPLOYED_IN', 'READS_FROM')) "
    "and exists (select 1 from k where k.id = e.src and k.tenant_id = e.tenant_id) and exists (select 1 from k where k.id = e.dst and k.tenant_id = e.tenant_id)) group by 1, 2, 3",
    "k as (select id, tenant_id from nodes where label <> 'K8sDeployment')",
)
def _(n, e):
    old = e.where("rel = 'CALLS'").withColumn("version", F.lit(1))
    new = e.where("protocol = 'grpc' or rel in ('DEPLOYED_IN', 'READS_FROM')").withColumn("version", F.lit(2))
    return mutations.upsert_edges(old, new, n.where("label <> 'K8sDeployment'")).select("src", "rel", "dst", "version")


@on_graph("hot_split", "select case when k >= 10 then 'hot' else 'regular' end part, rel, count(*) n from edges join (select dst, count(*) k from edges group by 1) using (dst) group by 1, 2")
def _(n, e):
    regular, hot = mutations.split_hot(e)
    both = regular.select(F.lit("regular").alias("part"), "rel").unionByName(hot.select(F.lit("hot").alias("part"), "rel"))
    return both.groupBy("part", "rel").agg(F.count("*").alias("n"))


@on_graph("tenant_erasure", "select 'nodes' kind, tenant_id, count(*) n from nodes where tenant_id <> 't0' group by 2 union all select 'edges', tenant_id, count(*) from edges where tenant_id <> 't0' group by 2")
def _(n, e):
    left = mutations.erase_tenant(n, e, TENANT)
    count = lambda df, kind: df.groupBy("tenant_id").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "tenant_id", "n")
    return count(left[0], "nodes").unionByName(count(left[1], "edges"))


@on_graph("subject_erasure", "select id from nodes where team_owner is distinct from 'Brand#11'")
def _(n, e):
    return mutations.erase_subject(n, "Brand#11").select("id")


@on_graph("degree_refresh", "select nodes.id, label, count(x.id) degree from nodes left join (select src id from edges union all select dst from edges where src <> dst) x on x.id = nodes.id group by 1, 2")
def _(n, e):
    return mutations.degree_refresh(n, e).select("id", "label", "degree")


@on_graph(
    "tombstone_stale",
    "select rel, d tombstoned_day, count(*) n from (select rel, case when tenant_id = 't0' and tombstoned_day is null and ingestion_id <> 'y1998' then 10300 else tombstoned_day end d from edges) group by 1, 2",
)
def _(n, e):
    return mutations.tombstone_stale(e, TENANT, "y1998", 10300).groupBy("rel", "tombstoned_day").agg(F.count("*").alias("n"))


@on_graph("mutation_feed", "select 'edge_tombstone' mutation_type, src, dst from edges where tenant_id = 't0' and tombstoned_day is null and ingestion_id <> 'y1998'")
def _(n, e):
    return mutations.change_feed(e, mutations.tombstone_stale(e, TENANT, "y1998", 10300))


@on_graph("sink_partitions", "select coalesce(acl_label, team_owner, '_default') part, count(*) n from nodes group by 1")
def _(n, e):
    first = F.when(F.col("acl_label").isNotNull(), F.array("acl_label"))
    return n.groupBy(mutations.partition_key(first, F.col("team_owner")).alias("part")).agg(F.count("*").alias("n"))


@on_graph("topology_hash", "select tenant_id, label, substring(sha256(string_agg(id, '|' order by id)), 1, 16) hash from nodes group by 1, 2")
def _(n, e):
    return n.groupBy("tenant_id", "label").agg(F.collect_list("id").alias("ids")).select("tenant_id", "label", S.topology_hash(F.col("ids")).alias("hash"))


@on_graph("schema_scan", "select 'label' kind, label name from nodes union select 'rel', rel from edges")
def _(n, e):
    return n.select(F.lit("label").alias("kind"), F.col("label").alias("name")).union(e.select(F.lit("rel"), "rel")).distinct()


@on_graph("cached_subset", "select team_owner, count(*) = count(t.dst) is_subset from nodes left join (select distinct dst from edges where rel = 'CALLS') t on t.dst = id where team_owner is not null group by 1")
def _(n, e):
    calls = e.where("rel = 'CALLS'").select(F.col("dst").alias("id")).distinct().withColumn("hit", F.col("id"))
    own = n.where("team_owner is not null").join(calls, "id", "left").groupBy("team_owner").agg(F.collect_list("id").alias("a"), F.collect_list("hit").alias("b"))
    return own.select("team_owner", S.is_subset(F.col("a"), F.col("b")).alias("is_subset"))


@on_graph("cross_team_counts", "select rel, count(*) n, coalesce(sum((x.team_owner <> y.team_owner)::int), 0)::bigint n_cross from edges join nodes x on x.id = src join nodes y on y.id = dst group by 1")
def _(n, e):
    x = n.select(F.col("id").alias("src"), F.col("team_owner").alias("a"))
    y = n.select(F.col("id").alias("dst"), F.col("team_owner").alias("b"))
    cross = F.coalesce(F.sum((F.col("a") != F.col("b")).cast("long")), F.lit(0))
    return e.join(x, "src").join(y, "dst").groupBy("rel").agg(F.count("*").alias("n"), cross.alias("n_cross"))


def _hits(phrases: list[str]) -> str:
    return "(" + " + ".join(f"contains(lower(q), '{p}')::int" for p in phrases) + ")"


@query("fusion_weights", f"select event_id, round(case when s + t > 0 then 1 - s / (s + t) end, 6) w_text, round(case when s + t > 0 then s / (s + t) end, 6) w_structure from (select event_id, {_hits(X.STRUCTURAL)} s, {_hits(X.TEXTUAL)} t from (select event_id, {QUESTIONS} q from events))")
def _(spark, d):
    text, structure = X.fusion_weights(F.col("q"))
    return table(spark, d, "events").selectExpr("event_id", f"{QUESTIONS} q").select("event_id", F.round(text, 6).alias("w_text"), F.round(structure, 6).alias("w_structure"))


@query("count_tokens", "select doc_id, case when coalesce(text, '') = '' then 0 else greatest(1, length(text) // 4) end::bigint n_tokens from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", S.count_tokens(F.col("text")).alias("n_tokens"))


@query("scoped_ids", "select p_partkey, case when r = '' and n = '' then name else concat_ws('::', r, n, name) end id from (select p_partkey, lower(trim(p_name)) name, case when p_size % 2 = 0 then p_brand else '' end r, case when p_size % 3 = 0 then p_type else '' end n from part)")
def _(spark, d):
    repository, namespace = F.expr("if(p_size % 2 = 0, p_brand, null)"), F.expr("if(p_size % 3 = 0, p_type, null)")
    return table(spark, d, "part").select("p_partkey", S.scoped_id(S.normalize_name(F.col("p_name")), repository, namespace).alias("id"))


@query("embedding_hash", "select vec_id, substring(sha256(array_to_string(list_transform(embedding, lambda x: printf('%.6f', x::double)), '|')), 1, 16) hash from embeddings")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", S.embedding_hash(F.col("embedding")).alias("hash"))


@query(
    "adaptive_threshold",
    "select label, round(coalesce(greatest(0.85, least(0.98, 0.92 + 0.15 * (0.5 - (b1 - b2)))), 0.92), 6) threshold from (select label, max(case when k = 1 then s end) b1, max(case when k = 2 then s end) b2 from (select *, row_number() over (partition by label order by s desc, vec_id) k from s) group by 1)",
    "s as (select vec_id, label, list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)) s from embeddings where vec_id <> 0)",
)
def _(spark, d):
    v = table(spark, d, "embeddings")
    asked = v.where("vec_id = 0").first()
    q = F.lit([float(x) for x in asked["embedding"]] if asked else [0.0])
    rows = v.where("vec_id <> 0").select("vec_id", "label", S.cosine(F.col("embedding"), q).alias("s"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("s"), "vec_id"))).where("k <= 2")
    two = rows.groupBy("label").agg(F.max(F.when(F.col("k") == 1, F.col("s"))).alias("best"), F.max(F.when(F.col("k") == 2, F.col("s"))).alias("second"))
    return two.select("label", F.round(S.adaptive_threshold(F.col("best"), F.col("second")), 6).alias("threshold"))


@query("quality_bands", "select c_custkey, case when s >= 0.7 then 'high' when s < 0.3 then 'low' else 'adequate' end quality from (select c_custkey, (c_custkey % 11) / 10 s from customer)")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.quality((F.col("c_custkey") % 11) / 10).alias("quality"))


@query("budget_status", "select user_id, case when b <= 0 then 'black' when b < 0.05 then 'red' when b < 0.25 then 'orange' when b <= 0.5 then 'yellow' else 'green' end status from (select user_id, round(1 - avg((event_type = 'error')::int) / 0.25, 6) b from events group by 1)")
def _(spark, d):
    e = table(spark, d, "events").withColumn("is_error", F.col("event_type") == "error")
    left = evaluate.error_budget(e, ["user_id"], 0.75)
    return left.select("user_id", S.budget_status(F.round("budget_left", 6)).alias("status"))


@query("candidate_rank", "select p_partkey, round(case when pr > 0 then 0.7 * pr + 0.3 * p_size else p_size end, 6)::double score from (select *, case when p_partkey % 3 = 0 then 0.0 else p_retailprice / 1000 end pr from part)")
def _(spark, d):
    pr = F.expr("if(p_partkey % 3 = 0, null, p_retailprice / 1000)")
    return table(spark, d, "part").select("p_partkey", F.round(S.candidate_rank(F.col("p_size").cast("double"), pr), 6).alias("score"))


@query("normalised_scores", "select p_partkey, round(case when m > 0 then p_size / m else 0 end, 6) score from (select *, max(p_size) over (partition by p_brand) m from part)")
def _(spark, d):
    return S.normalised_by_max(table(spark, d, "part"), "p_size", ["p_brand"]).select("p_partkey", F.round("normalised", 6).alias("score"))


@query("html_escape", "select page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) digest from pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(X.html_escape(F.col("html"))).alias("digest"))


@query("unchanged_files", "select doc_id::varchar path from documents a where not exists (select 1 from documents b where b.doc_id = a.doc_id and b.doc_id % 3 = 0 and sha256(b.text) = sha256(a.text))")
def _(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    done = files.where("cast(path as long) % 3 = 0").select("path", F.sha2("content", 256).alias("content_hash"))
    return mutations.unchanged_filter(files, done).select("path")


@query("consumer_lag", "select event_type topic, user_id % 4 \"partition\", greatest(0, max(event_id) + 10 - coalesce(max(case when event_id % 2 = 0 then event_id end), -1) - 1)::bigint lag from events group by 1, 2")
def _(spark, d):
    e = table(spark, d, "events").selectExpr("event_type topic", "user_id % 4 partition", "event_id offset")
    ends = e.groupBy("topic", "partition").agg((F.max("offset") + 10).alias("high_water"))
    return streams.consumer_lag(e.where("offset % 2 = 0"), ends)


KINDS = "case event_id % 5 when 0 then 'edge_tombstone' when 1 then 'node_delete' when 2 then 'node_upsert' when 3 then 'edge_upsert' else 'noise' end"


@query("mutation_dispatch", f"select event_id, case when k in ('edge_tombstone', 'node_delete') then 'delete' else 'upsert' end action from (select event_id, {KINDS} k from events) where k <> 'noise' and event_id % 7 <> 0")
def _(spark, d):
    rows = table(spark, d, "events").selectExpr("event_id", f"{KINDS} mutation_type", "if(event_id % 7 = 0, array(), array(cast(user_id as string))) entity_ids")
    return streams.dispatch(rows).select("event_id", "action")


@query(
    "blob_forwarding",
    "select doc_id, case when strlen(text) >= 2000 then concat('ingestion/', coalesce(nullif(source, ''), 'none'), '/no-commit/', replace(concat('a/', source), '/', '_'), '-', substring(sha256(concat('a/', source, ':', doc_id::varchar)), 1, 16)) end blob_key from documents where text is not null",
)
def _(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    path, tenant = F.concat(F.lit("a/"), F.col("source")), F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("none"))
    key = files.blob_key(tenant, F.lit(None).cast("string"), path, F.col("doc_id").cast("string"))
    return docs.select("doc_id", F.when(files.is_blob(F.col("text"), 2000), key).alias("blob_key"))


@query("first_wins", "select event_type, arg_min(event_id, event_id) event_id from events group by event_type")
def _(spark, d):
    return mutations.first_wins(table(spark, d, "events").select("event_type", "event_id"), ["event_type"], "event_id")


@query("sliding_windows", "select w window_start, event_type, count(*) n from (select event_type, unnest([time_bucket(interval 5 minutes, ts), time_bucket(interval 5 minutes, ts) - interval 5 minutes]) w from events) group by 1, 2")
def _(spark, d):
    return streams.windowed(table(spark, d, "events"), ["event_type"], "10 minutes", "5 minutes").drop("total")
