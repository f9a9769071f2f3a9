"""The registered queries and, where SQL can say it, their DuckDB equivalents on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.functions import text as X
from graphloom.operators import components, context, evaluate, mutations, patterns, ranking, walks
from graphloom.plans import templates as T
from graphloom.session import table
from graphloom.sources import files
from graphloom.sources.fixture import graph, oracle
from graphloom.streaming import streams

TENANT = "t0"
LABELS = ["Service", "Database", "KafkaTopic", "K8sDeployment", "MacroNode"]
RELS = ["CALLS", "PRODUCES", "CONSUMES", "DEPLOYED_IN", "READS_FROM", "WRITES_TO"]
ACL = ["Ns_asia", "Ns_europe", "Ns_america"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

BUSIEST = "(select src from edges where rel = 'CALLS' and tombstoned_day is null and tenant_id = 't0' group by src order by count(*) desc, src limit 1)"


def busiest(nodes: DataFrame, edges: DataFrame) -> str:
    """The service with the most live calls of the tenant; one row comes to the driver."""
    own = patterns.live(edges).where((F.col("rel") == "CALLS") & (F.col("tenant_id") == TENANT))
    row = own.groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").first()
    return row["src"] if row else ""


def query(name: str, sql: str | None = None, ctes: str = "", on_graph: bool = False):
    def add(fn):
        QUERIES[name] = (lambda spark, d: fn(*graph(spark, d))) if on_graph else fn
        if sql is not None:
            ORACLE_SQL[name] = oracle(sql, ctes) if on_graph else ("with " + ctes + " " if ctes else "") + sql
        return fn

    return add


def on_graph(name: str, sql: str | None = None, ctes: str = ""):
    return query(name, sql, ctes, True)


LIVE = "live as (select * from edges where tenant_id = 't0' and tombstoned_day is null), n0 as (select * from nodes where tenant_id = 't0')"
HOP = LIVE + """, hop as (select s.id s_id, s.name s_name, s.label s_label, s.team_owner s_team, rel, protocol, t.id t_id, t.name t_name, t.label t_label, t.team_owner t_team,
  t.namespace t_namespace, t.replicas t_replicas, t.db_type t_db from live join n0 s on src = s.id join n0 t on dst = t.id)"""


@on_graph(
    "blast_radius",
    "select distinct name affected_service, label node_type from (select dst from h1 union select dst from h2 union select dst from h3) join n0 on id = dst",
    LIVE + f", e as (select distinct src, dst from live where rel in ('CALLS', 'PRODUCES', 'CONSUMES')), h1 as (select distinct dst from e where src = {BUSIEST}), "
    "h2 as (select distinct e.dst from h1 join e on h1.dst = e.src), h3 as (select distinct e.dst from h2 join e on h2.dst = e.src)",
)
def _(n, e):
    return T.blast_radius(n, e, TENANT, busiest(n, e))


@on_graph("dependency_count", "select t_name service, count(*) inbound_dependency_count from hop where rel = 'CALLS' group by 1 order by 2 desc, 1 limit 10", HOP)
def _(n, e):
    return T.dependency_count(n, e, TENANT)


@on_graph(
    "service_neighbors",
    f"select s_name source, rel relationship, t_name target, t_label target_type from (select s_name, rel, t_name, t_label from hop where s_id = {BUSIEST} union all "
    f"select t_name, rel, s_name, s_label from hop where t_id = {BUSIEST} and s_id <> t_id) order by 2, 3 limit 10",
    HOP,
)
def _(n, e):
    return T.service_neighbors(n, e, TENANT, busiest(n, e))


@on_graph("topic_consumers", "select s_name consumer_service, t_name topic from hop where rel = 'CONSUMES' and t_name = 'topic-2' order by 1 limit 10", HOP)
def _(n, e):
    return T.topic_consumers(n, e, TENANT, "topic-2")


@on_graph("topic_producers", "select s_name producer_service, t_name topic from hop where rel = 'PRODUCES' and t_name = 'topic-2' order by 1 limit 10", HOP)
def _(n, e):
    return T.topic_producers(n, e, TENANT, "topic-2")


@on_graph("service_deployments", f"select s_name service, t_namespace \"namespace\", t_replicas replicas from hop where rel = 'DEPLOYED_IN' and s_id = {BUSIEST}", HOP)
def _(n, e):
    return T.service_deployments(n, e, TENANT, busiest(n, e))


@on_graph("namespace_services", "select distinct s_name service, t_namespace \"namespace\" from hop where rel = 'DEPLOYED_IN' and t_namespace = 'asia'", HOP)
def _(n, e):
    return T.namespace_services(n, e, TENANT, "asia")


@on_graph("service_databases", f"select s_name service, t_id \"database\", t_db db_type from hop where rel in ('READS_FROM', 'WRITES_TO') and s_id = {BUSIEST}", HOP)
def _(n, e):
    return T.service_databases(n, e, TENANT, busiest(n, e))


@on_graph("cross_team_dependencies", "select s_name caller, s_team caller_team, t_name callee, t_team callee_team from hop where rel = 'CALLS' and s_team <> t_team order by 2, 4, 1, 3 limit 10", HOP)
def _(n, e):
    return T.cross_team_dependencies(n, e, TENANT)


SEEN = LIVE + ", seen as (select * from n0 where acl_label in ('Ns_asia', 'Ns_europe', 'Ns_america'))"
SEEN_SOURCE = "(select src from live join seen s on src = s.id join seen t on dst = t.id where rel = 'CALLS' group by src order by count(*) desc, src limit 1)"


def _visible_source(n, e):
    own, live = patterns.tenant_view(n, e, TENANT, ACL)
    rows = patterns.hop(own, live, ["CALLS"]).groupBy("s_id").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "s_id").first()
    return rows["s_id"] if rows else ""


@on_graph("acl_single_hop", f"select t.id, t.name, t.label from live join seen s on src = s.id join seen t on dst = t.id where rel = 'CALLS' and src = {SEEN_SOURCE} order by 1 limit 10", SEEN)
def _(n, e):
    return T.acl_single_hop(n, e, TENANT, _visible_source(n, e), "CALLS", ACL)


@on_graph(
    "multi_hop_paths",
    "select name, hops from (select d id, 1 hops from p1 union all select d, 2 from p2 union all select d, 3 from p3) join seen using (id)",
    SEEN + ", c as (select src, dst from live join seen s on src = s.id join seen t on dst = t.id where rel = 'CALLS'), "
    f"p1 as (select src a, dst d from c where src = {SEEN_SOURCE}), p2 as (select p1.a, p1.d b, c.dst d from p1 join c on c.src = p1.d where not (c.src = p1.a and c.dst = p1.d)), "
    "p3 as (select c.dst d from p2 join c on c.src = p2.d where not (c.src = p2.a and c.dst = p2.b) and not (c.src = p2.b and c.dst = p2.d))",
)
def _(n, e):
    return T.acl_multi_hop(n, e, TENANT, _visible_source(n, e), ACL, 3, None)


@on_graph(
    "backpressure",
    "select m.dst topic, m.src producer, coalesce(u.consumers, '') consumers from live m left join (select dst, string_agg(src, ',' order by src) consumers from live where rel = 'CONSUMES' group by 1) u on u.dst = m.dst where rel = 'PRODUCES'",
    LIVE,
)
def _(n, e):
    return T.backpressure(n, e, TENANT)


@on_graph(
    "namespace_blast",
    "select distinct src caller from live where rel = 'CALLS' and dst in (select id from inside) and src not in (select id from inside)",
    HOP + ", inside as (select distinct s_id id from hop where rel = 'DEPLOYED_IN' and t_namespace = 'asia')",
)
def _(n, e):
    return T.outside_namespace(n, e, TENANT, "asia")


@on_graph("protocol_audit", "select protocol, count(*) n_calls, count(distinct src) n_callers from live where rel = 'CALLS' group by 1", LIVE)
def _(n, e):
    return T.protocol_audit(n, e, TENANT)


@on_graph("list_entities", "select id, name, label from nodes where tenant_id = 't0' order by name, id limit 50 offset 100")
def _(n, e):
    return T.list_entities(n, TENANT, 50, 100)


@on_graph(
    "entity_detail",
    "select id, label, coalesce(rels, '') rels, coalesce(k, 0)::bigint n_rels from n0 left join (select src, string_agg(concat(rel, '>', dst), ',' order by concat(rel, '>', dst)) rels, count(*) k from live group by 1) on src = id",
    LIVE,
)
def _(n, e):
    return T.entity_detail(n, e, TENANT)


@on_graph(
    "neighbors_undirected_2",
    "select distinct id, rel, 2 hops from (select b id, r rel from u1 union all select b, r1 from u2 union all select b, r2 from u2)",
    f"und as (select src a, dst b, rel r, concat(src, rel, dst) k from edges where tenant_id = 't0' union all select dst, src, rel, concat(src, rel, dst) from edges where tenant_id = 't0' and src <> dst), "
    f"u1 as (select * from und where a = {BUSIEST}), u2 as (select y.b, x.r r1, y.r r2 from u1 x join und y on x.b = y.a and x.k <> y.k)",
)
def _(n, e):
    return T.neighbors(n, e, TENANT, busiest(n, e), 2)


@on_graph("stats_nodes", "select x.label, count(nodes.id) n from (select unnest(['Service', 'Database', 'KafkaTopic', 'K8sDeployment', 'MacroNode']) label) x left join nodes on nodes.label = x.label and tenant_id = 't0' group by 1")
def _(n, e):
    return T.stats_nodes(n, TENANT, LABELS)


@on_graph("stats_edges", "select x.rel, count(edges.src) n from (select unnest(['CALLS', 'PRODUCES', 'CONSUMES', 'DEPLOYED_IN', 'READS_FROM', 'WRITES_TO']) rel) x left join edges on edges.rel = x.rel and tenant_id = 't0' group by 1")
def _(n, e):
    return T.stats_edges(e, TENANT, RELS)


ENDS = "ends as (select src id from edges union all select dst from edges where src <> dst), deg as (select nodes.id, count(ends.id) degree from nodes left join ends on ends.id = nodes.id group by 1)"


@on_graph("degree", "select * from deg", ENDS)
def _(n, e):
    return patterns.degree(n, e)


@on_graph("supernode_topk", "select src, rank, rel, dst, degree from (select *, row_number() over (partition by src order by degree desc, dst, rel)::int rank from edges join deg on dst = id where tombstoned_day is null) where rank <= 3", ENDS)
def _(n, e):
    return patterns.per_source_top(n, e, 3)


@on_graph("hot_targets", "select dst, count(*) n_edges from edges group by 1 having count(*) >= 10")
def _(n, e):
    return mutations.hot_targets(e)


@on_graph("tombstone_filter", "select id from nodes where id not in (select src from edges where tenant_id = 't0' and tombstoned_day is not null)")
def _(n, e):
    return mutations.without_tombstoned(n.select("id"), e, TENANT)


@on_graph("stale_tombstone", "select count(*) n_tombstoned, count(distinct src) n_sources from edges where tenant_id = 't0' and tombstoned_day is null and ingestion_id <> 'y1998'")
def _(n, e):
    return mutations.stale_report(e, TENANT, "y1998")


@on_graph("reap", "select rel, count(*) n from edges where not (tenant_id = 't0' and coalesce(tombstoned_day < 10240, false)) group by 1")
def _(n, e):
    return mutations.reap(e, TENANT, 10247).groupBy("rel").agg(F.count("*").alias("n"))


@on_graph("referential_errors", "select rel, 'dst' side, dst id from edges where dst not in (select id from nodes where label <> 'K8sDeployment')")
def _(n, e):
    return mutations.dangling(n.where("label <> 'K8sDeployment'"), e)


@query("upsert_merge", "select id, val, version from (select *, row_number() over (partition by id order by side desc, version desc) k from (select c_custkey % 500 id, c_acctbal val, c_custkey version, 0 side from customer union all select s_suppkey % 500, s_acctbal, s_suppkey, 1 from supplier)) where k = 1")
def _(spark, d):
    old = table(spark, d, "customer").selectExpr("c_custkey % 500 id", "c_acctbal val", "c_custkey version")
    return mutations.upsert(old, table(spark, d, "supplier").selectExpr("s_suppkey % 500 id", "s_acctbal val", "s_suppkey version"), ["id"])


@query("extraction_merge", "select coalesce(a.id, b.id) id, coalesce(a.otel, false) or coalesce(b.otel, false) otel, case when a.id is not null then 1.0 else 0.7 end::double confidence from (select p_partkey id, p_size % 2 = 0 otel from part where p_partkey % 3 <> 0) a full join (select p_partkey id, bool_or(p_size % 5 = 0) otel from part where p_partkey % 2 = 0 group by 1) b on a.id = b.id")
def _(spark, d):
    part = table(spark, d, "part")
    return mutations.merge_extractions(part.where("p_partkey % 3 <> 0").selectExpr("p_partkey id", "p_size % 2 = 0 otel"), part.where("p_partkey % 2 = 0").selectExpr("p_partkey id", "p_size % 5 = 0 otel"))


@query("reconciliation", "select coalesce(a.id, b.id) id, case when b.id is null then 'missing' when a.id is null then 'orphan' else 'stale' end state from (select p_partkey id, p_size v from part where p_partkey % 7 <> 0) a full join (select p_partkey id, case when p_partkey % 5 = 0 then null else p_size end v from part where p_partkey % 3 <> 0) b on a.id = b.id where a.id is null or b.id is null or a.v is distinct from b.v")
def _(spark, d):
    part = table(spark, d, "part")
    return mutations.reconcile(part.where("p_partkey % 7 <> 0").selectExpr("p_partkey id", "p_size version"), part.where("p_partkey % 3 <> 0").selectExpr("p_partkey id", "if(p_partkey % 5 = 0, null, p_size) version"))


KNN = "select vec_id id, round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 6) score from embeddings"


@query("knn_tenant", KNN + " where label % 2 = 0 order by list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)) desc, vec_id limit 10")
def _(spark, d):
    v = table(spark, d, "embeddings").withColumn("tenant_id", F.concat(F.lit("t"), (F.col("label") % 2).cast("string")))
    q = v.where("vec_id = 0").first()
    return ranking.knn(v, q["embedding"] if q else [0.0], 10, TENANT).withColumn("score", F.round("score", 6))


@query("centroid", "select label, pos, round(avg(x), 6) \"value\" from (select label, unnest(range(64)) pos, unnest(embedding)::double x from embeddings) group by 1, 2")
def _(spark, d):
    v = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return v.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("value"))


WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query(
    "bm25",
    "select w.doc_id id, round(sum(q.qn * ln(2.0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (select avg(len(w)) from w)))), 6) score from q join tf using (term) join (select doc_id, len(w) dl from w) w on w.doc_id = tf.doc_id group by 1",
    f"w as (select doc_id, {WORDS} w from documents), q as (select term, count(*) qn from (select unnest(['the', 'tion', 'the', 'idiot']) term) group by 1), tf as (select doc_id, term, count(*) tf from (select doc_id, unnest(w) term from w) group by 1, 2)",
)
def _(spark, d):
    return ranking.bm25(table(spark, d, "documents"), "the tion the idiot").withColumn("score", F.round("score", 6))


@query("rrf", "select id, round(sum(1.0 / (60 + r)), 6) score from (select c_custkey id, row_number() over (order by c_acctbal desc, c_custkey) r from customer union all select c_custkey, row_number() over (order by -c_acctbal desc, c_custkey) from customer where c_custkey % 2 = 0) group by 1")
def _(spark, d):
    c = table(spark, d, "customer")
    lists = c.selectExpr("1 list_no", "c_custkey id", "c_acctbal score", "c_custkey pos").union(c.where("c_custkey % 2 = 0").selectExpr("2", "c_custkey", "-c_acctbal", "c_custkey"))
    return ranking.rrf(lists).select("id", F.round("score", 6).alias("score"))


@query("linear_fusion", "select p_partkey id, round(0.7 * p_size + 0.3 * coalesce(case when p_partkey % 2 = 0 then greatest(p_retailprice / 1000 - 1, 0) * 0.8 end, 0), 6) score from part")
def _(spark, d):
    p = table(spark, d, "part")
    s = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 1000 - 1).alias("similarity"), S.edge_weight(F.lit("PRODUCES")).alias("weight"))
    return ranking.linear_fusion(p.selectExpr("p_partkey id", "cast(p_size as double) score"), s).withColumn("score", F.round("score", 6))


@query("jaccard_pairs", "select a.doc_id, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) jaccard from w a join w b on b.doc_id = a.doc_id + 1", f"w as (select doc_id, list_distinct({WORDS}) w from documents)")
def _(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.array_distinct(X.tokens(F.col("text"))).alias("w"))
    return w.alias("a").join(w.alias("b"), F.expr("b.doc_id = a.doc_id + 1")).select("a.doc_id", F.round(S.jaccard(F.col("a.w"), F.col("b.w")), 6).alias("jaccard"))


CALLS = "ce as (select src, dst from edges where rel = 'CALLS' and tenant_id = 't0' and tombstoned_day is null), sv as (select id from nodes where label = 'Service' and tenant_id = 't0')"


def _calls(n, e):
    return patterns.live(e).where((F.col("rel") == "CALLS") & (F.col("tenant_id") == TENANT)), n.where((F.col("label") == "Service") & (F.col("tenant_id") == TENANT)).select("id")


def _pagerank_sql(rounds: int) -> str:
    steps = "r0 as (select id, 1.0 / (select count(*) from sv) s from sv), o as (select src, count(*) k from ce group by 1)"
    for k in range(rounds):
        steps += f", r{k + 1} as (select sv.id, 0.15 / (select count(*) from sv) + 0.85 * coalesce(g, 0) s from sv left join (select dst, sum(s / k) g from ce join o using (src) join r{k} on r{k}.id = src group by 1) on dst = sv.id)"
    return steps


@on_graph("pagerank_10", "select id, s score from r10", CALLS + ", " + _pagerank_sql(10))
def _(n, e):
    calls, own = _calls(n, e)
    return ranking.pagerank(calls, own, 10)


def _ppr_sql(rounds: int) -> str:
    steps = f"un as (select src a, dst b from ce union all select dst, src from ce), dg as (select a, count(*) k from un group by 1), p as (select a id, case when a = {BUSIEST} then 1.0 else 0.0 end p from dg), t0 as (select id, p s from p)"
    for k in range(rounds):
        steps += f", u{k} as (select p.id, 0.15 * p + 0.85 * coalesce(g, 0) s from p left join (select b, sum(s / k) g from un join dg using (a) join t{k} on t{k}.id = a group by 1) on b = p.id), t{k + 1} as (select id, s / (select sum(s) from u{k}) s from u{k})"
    return steps


@on_graph("ppr_3", "select id, s score from t3", CALLS + ", " + _ppr_sql(3))
def _(n, e):
    calls, _ = _calls(n, e)
    seed = e.sparkSession.createDataFrame([(busiest(n, e),)], "id string")
    return ranking.personalized_pagerank(calls, seed, 3)


@on_graph("modularity", "select round(sum((1 - x.k * y.k / m.m2) / m.m2), 6) q from un join own cx on cx.id = a join own cy on cy.id = b join dg x on x.a = un.a join dg y on y.a = un.b cross join (select count(*)::double m2 from un) m where cx.c = cy.c", CALLS + ", un as (select src a, dst b from ce union all select dst, src from ce), dg as (select a, count(*) k from un group by 1), own as (select id, team_owner c from nodes)")
def _(n, e):
    return ranking.modularity(_calls(n, e)[0], n.where("team_owner is not null").select("id", "team_owner")).select(F.round("q", 6).alias("q"))


@on_graph("inter_community_edges", "select distinct least(x.team_owner, y.team_owner) a, greatest(x.team_owner, y.team_owner) b from ce join nodes x on x.id = src join nodes y on y.id = dst where x.team_owner <> y.team_owner", CALLS)
def _(n, e):
    return ranking.condense(_calls(n, e)[0], n.where((F.col("label") == "Service") & (F.col("tenant_id") == TENANT)).select("id", F.col("team_owner").alias("community")), 1)[1]


@on_graph(
    "connected_components",
    "select id, z component from cc",
    "pe as (select src a, dst b from edges where tombstoned_day is null union select dst, src from edges where tombstoned_day is null), cc(id, z) using key (id) as "
    "(select distinct a, a from pe union select n.id, min(c.z) from cc c join pe on pe.a = c.id join recurring.cc n on n.id = pe.b where c.z < n.z group by n.id)",
)
def _(n, e):
    return components.connected_components(patterns.live(e))


@query("token_prefix_truncate", "select doc_id, source from (select *, sum(greatest(1, length(text) // 4)) over (partition by source order by doc_id) s from documents) where s <= 3000")
def _(spark, d):
    rows = table(spark, d, "documents").withColumn("cost", S.count_tokens(F.col("text")))
    return context.prefix_truncate(rows, 3000, ("source",), ("doc_id",)).select("doc_id", "source")


@query("byte_cap_scan", "select page_id path, strlen(html) bytes from (select *, sum(strlen(html)) over (order by page_id) s from pages) where s <= 100000")
def _(spark, d):
    rows = table(spark, d, "pages").select(F.col("page_id").alias("path"), F.octet_length("html").cast("long").alias("bytes"))
    return context.byte_cap(rows, 100_000)[0]


@query("grep", "select path, line_no, line from (select doc_id::varchar path, unnest(string_split(text, chr(10))) line, unnest(range(1, len(string_split(text, chr(10))) + 1))::int line_no from documents) where contains(line, 'Licen')")
def _(spark, d):
    return files.grep(table(spark, d, "documents").withColumn("path", F.col("doc_id").cast("string")), "Licen", content="text")


QUESTIONS = "concat(case event_id % 8 when 0 then 'What is the blast radius of svc-' when 1 then 'top 5 most connected to svc-' when 2 then 'What topics does it produce to svc-' when 3 then 'Which services are written in go svc-' when 4 then 'please tell me what calls svc-' when 5 then 'if it fails what is downstream of svc-' when 6 then 'where is it deployed svc-' else 'how many calls per svc-' end, cast(user_id as string), '?')"


def _case(items: list[tuple[str, str]], default: str) -> str:
    return "case " + " ".join(f"when regexp_matches(q, '{p}', 'i') then '{n}'" for n, p in items) + f" else {default} end"


@query("classify", "select event_id, case when regexp_matches(q, '" + X.COMPLEXITY[0][1] + "', 'i') then 'aggregate' when regexp_matches(q, '" + X.COMPLEXITY[1][1].replace("|transitive(?!.*count)", "") + "', 'i') then 'multi_hop' when regexp_matches(q, '" + X.COMPLEXITY[2][1] + f"', 'i') then 'single_hop' else 'entity_lookup' end complexity, {_case(X.INTENTS, 'null')} intent from (select event_id, {QUESTIONS} q from events)")
def _(spark, d):
    q = table(spark, d, "events").selectExpr("event_id", f"{QUESTIONS} q")
    return q.select("event_id", X.classify(F.col("q")).alias("complexity"), X.intent(F.col("q")).alias("intent"))


def _normal_sql() -> str:
    out = "regexp_replace(lower(trim(q)), '[?!.,;:]+$', '')"
    for p in X.FILLERS:
        out = f"regexp_replace({out}, '\\b{p}\\b', '', 'g')"
    for p, by in X.SYNONYMS:
        out = f"regexp_replace({out}, '{p.replace('(?<!-)', '').replace('(?!-)', '')}', '{by}', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@query("normalize_query", f"select event_id, {_normal_sql()} q from (select event_id, {QUESTIONS} q from events)")
def _(spark, d):
    return table(spark, d, "events").selectExpr("event_id", f"{QUESTIONS} q").select("event_id", X.normalize_query(F.col("q")).alias("q"))


def _redact_sql(c: str) -> str:
    for p, by in X.SECRETS:
        c = f"regexp_replace({c}, '{p.replace(chr(39), chr(39) * 2)}', '{by}', 'g')"
    return c


@query("secret_redact", f"select doc_id, {_redact_sql('text')} text from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.redact_secrets(F.col("text")).alias("text"))


@query("injection_rules", "select conv_id, turn, round(" + " + ".join(f"case when regexp_matches(text, '{p}') then {w} else 0.0 end" for _, w, p in X.RULES) + ", 6)::double score from conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(X.rule_score(F.col("text")), 6).alias("score"))


@query("relevance_avg", "select a.label, round(avg(list_cosine_similarity(a.embedding::double[], b.embedding::double[])), 6) relevance from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 group by 1")
def _(spark, d):
    v = table(spark, d, "embeddings")
    pairs = v.alias("a").join(v.alias("b"), F.expr("b.vec_id = a.vec_id + 1")).select("a.label", F.col("a.embedding").alias("query"), F.col("b.embedding").alias("context"))
    return evaluate.relevance(pairs, ["label"]).withColumn("relevance", F.round("relevance", 6))


ENT = "list_distinct(list_transform(regexp_extract_all({c}, '[A-Za-z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)*'), lambda x: lower(x)))"


@query(
    "groundedness",
    "select conv_id, turn, round(case when len(own) = 0 then 1 else len(list_filter(own, lambda x: len(list_filter(have, lambda c: contains(c, x) or contains(x, c))) > 0)) / len(own) end, 6) grounded, "
    "round(case when len(mean) = 0 then 1 else 1 - len(list_filter(mean, lambda x: not list_contains(have, x))) / len(mean) end, 6) faithful from (select *, list_filter(own, lambda x: not list_contains(string_split('"
    + " ".join(evaluate.STOP_WORDS)
    + f"', ' '), x)) mean from (select a.conv_id, a.turn, list_filter({ENT.format(c='a.text')}, lambda x: length(x) > 2) own, {ENT.format(c='b.text')} have from conversations a join conversations b on b.conv_id = a.conv_id and b.turn = a.turn - 1 where a.text <> '' and b.text <> ''))",
)
def _(spark, d):
    c = table(spark, d, "conversations")
    both = c.alias("a").join(c.alias("b"), F.expr("b.conv_id = a.conv_id and b.turn = a.turn - 1")).where("a.text <> '' and b.text <> ''")
    a, b = F.col("a.text"), F.col("b.text")
    return both.select("a.conv_id", "a.turn", F.round(evaluate.groundedness(a, b), 6).alias("grounded"), F.round(evaluate.faithfulness(a, b), 6).alias("faithful"))


@query("error_budget", "select user_id, count(*) n, round(avg((event_type = 'error')::int), 6) error_rate, round(1 - avg((event_type = 'error')::int) / 0.25, 6) budget_left from events group by 1")
def _(spark, d):
    e = table(spark, d, "events").withColumn("is_error", F.col("event_type") == "error")
    return evaluate.error_budget(e, ["user_id"], 0.75).select("user_id", "n", F.round("error_rate", 6).alias("error_rate"), F.round("budget_left", 6).alias("budget_left"))


@query("rate_observed_60s", "select event_id, count(*) over (partition by event_type order by floor(epoch(ts))::bigint range between 60 preceding and current row) rate from events")
def _(spark, d):
    return streams.observed_rate(table(spark, d, "events"), ["event_type"]).select("event_id", "rate")


@query("dedup_events", "select event_id, user_id, event_type from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) k from events) where k = 1")
def _(spark, d):
    e = table(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    return streams.dedup(e, ["user_id", "event_type"], "o").select("event_id", "user_id", "event_type")


@query(
    "coalesce_last",
    "select event_type, arg_max(event_id, (ts, event_id)) event_id, count(*) n_events from s group by event_type, g",
    "g as (select *, case when ts >= lag(ts) over w + interval 30 seconds or lag(ts) over w is null then 1 else 0 end f from events window w as (partition by event_type order by ts, event_id)), s as (select *, sum(f) over (partition by event_type order by ts, event_id) g from g)",
)
def _(spark, d):
    e = table(spark, d, "events").groupBy("event_type", F.session_window("ts", "30 seconds").alias("s")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("n_events"))
    return e.select("event_type", "event_id", "n_events")


@query("version_fence", "select event_id, user_id from (select *, max(event_id % 7) over (partition by user_id) m from events) where event_id % 7 >= m")
def _(spark, d):
    return streams.version_fence(table(spark, d, "events").selectExpr("event_id", "user_id", "event_id % 7 version"), ["user_id"]).select("event_id", "user_id")


@query("tumbling_windows", "select time_bucket(interval 5 minutes, ts) window_start, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2")
def _(spark, d):
    return streams.windowed(table(spark, d, "events"), ["event_type"]).withColumn("total", F.round("total", 4))


@on_graph("acl_filter", "select id, label from nodes where tenant_id = 't1' and (acl_label in ('Ns_asia') or acl_label is null)")
def _(n, e):
    return patterns.tenant_view(n, e, "t1", ["Ns_asia"], allow_untagged=True)[0].select("id", "label")


@on_graph("team_label", "select id, concat('Team_', lower(replace(team_owner, '#', '-'))) team from nodes where team_owner is not null")
def _(n, e):
    return n.where("team_owner is not null").select("id", F.concat(F.lit("Team_"), F.lower(F.replace("team_owner", F.lit("#"), F.lit("-")))).alias("team"))


@on_graph(
    "community_summary",
    "select tenant_id, community_id, concat(parts, ': ', names, case when n > 10 then concat(', and ', (n - 10)::varchar, ' more') else '' end) summary from "
    "(select tenant_id, community_id, string_agg(concat(k::varchar, ' ', label, case when k > 1 then 's' else '' end), ', ' order by concat(k::varchar, ' ', label, case when k > 1 then 's' else '' end)) parts, sum(k)::bigint n "
    "from (select tenant_id, community_id, label, count(*) k from m group by all) group by 1, 2) join "
    "(select tenant_id, community_id, string_agg(name, ', ' order by name) names from (select *, row_number() over (partition by tenant_id, community_id order by name) r from m) where r <= 10 group by 1, 2) using (tenant_id, community_id)",
    "m as (select tenant_id, coalesce(team_owner, 'unassigned') community_id, label, name from nodes)",
)
def _(n, e):
    return context.community_summary(n.select("tenant_id", F.col("team_owner").alias("community_id"), "label", "name"))


@on_graph("louvain")
def _(n, e):
    return ranking.communities(patterns.live(e))


@on_graph("articulation_points")
def _(n, e):
    return ranking.articulation_points(patterns.live(e))


@on_graph("fast_rp")
def _(n, e):
    return ranking.fast_rp(patterns.live(e))


@on_graph("node2vec_walks")
def _(n, e):
    return walks.random_walks(patterns.live(e))


@on_graph("node2vec_embedding")
def _(n, e):
    out = walks.node_embedding(patterns.live(e))
    return out.select("id", F.transform("embedding", lambda x: F.round(x, 9)).alias("embedding"))


@on_graph("beam_expansion")
def _(n, e):
    own, live = patterns.tenant_view(n, e, TENANT)
    return patterns.expand_beam(own.where(F.col("id") == busiest(n, e)), own, live, 3)


@query("mmr")
def _(spark, d):
    rows = ranking.bm25(table(spark, d, "documents"), "the tion").orderBy(F.desc("score"), "id").limit(50)
    words = table(spark, d, "documents").select(F.col("doc_id").alias("id"), X.tokens(F.col("text")).alias("words"))
    return ranking.mmr(rows.join(words, "id").withColumn("query_id", F.lit(1)))


#: One source has no name, so that a group without a key takes part too.
COSTS = "d as (select nullif(source, 'src1') g, doc_id pos, case when coalesce(text, '') = '' then 0 else greatest(1, length(text) // 4) end cost, row_number() over (partition by nullif(source, 'src1') order by doc_id) n from documents)"


def _costs(spark, d):
    return table(spark, d, "documents").select(F.expr("nullif(source, 'src1')").alias("group"), F.col("doc_id").alias("pos"), S.count_tokens(F.col("text")).alias("cost"))


@query(
    "greedy_fill",
    "select g \"group\", pos from r where fits",
    "recursive " + COSTS + ", r as (select g, pos, n, cost <= 3000 fits, case when cost <= 3000 then 3000 - cost else 3000 end free from d where n = 1 "
    "union all select d.g, d.pos, d.n, cost <= free, case when cost <= free then free - cost else free end from r join d on d.g is not distinct from r.g and d.n = r.n + 1)",
)
def _(spark, d):
    return context.greedy_fill(_costs(spark, d), 3000)


@query(
    "token_batches",
    "select g \"group\", pos, batch from r",
    "recursive " + COSTS + ", r as (select g, pos, n, cost used, 0 batch from d where n = 1 "
    "union all select d.g, d.pos, d.n, case when used > 0 and used + cost > 3000 then cost else used + cost end, batch + (used > 0 and used + cost > 3000)::int from r join d on d.g is not distinct from r.g and d.n = r.n + 1)",
)
def _(spark, d):
    return context.token_batches(_costs(spark, d), 3000)


@query("injection_score")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(X.injection_score(F.col("text")), 6).alias("score"))


@query(
    "rate_limit",
    "select event_id, u user_id, ts, admitted from r",
    "recursive d as (select event_id, nullif(user_id, 7) u, ts, epoch(ts) t, row_number() over (partition by nullif(user_id, 7) order by ts, event_id) n from events), "
    "r as (select event_id, u, ts, n, true admitted, [t] kept from d where n = 1 union all select event_id, u, ts, n, len(near) < 2, case when len(near) < 2 then list_append(near, t) else near end "
    "from (select d.*, list_filter(r.kept, lambda x: x > d.t - 3600) near from r join d on d.u is not distinct from r.u and d.n = r.n + 1))",
)
def _(spark, d):
    return streams.rate_limit(table(spark, d, "events").selectExpr("event_id", "nullif(user_id, 7) user_id", "ts"), "user_id", 2, 3600)
