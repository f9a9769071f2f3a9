"""Registered queries of retrieval, commits, guards, messages, resolution and outboxes, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.functions import text as X
from graphloom.operators import cache, commit, extraction, firewall, mutations, patterns
from graphloom.plans import retrieval
from graphloom.plans.queries import ENDS, KNN, LIVE, ORACLE_SQL, QUERIES, QUESTIONS, TENANT, WORDS, _case, busiest, on_graph, query
from graphloom.session import table
from graphloom.sources import messages
from graphloom.streaming import outbox

__all__ = ["ORACLE_SQL", "QUERIES"]  # with those of queries, which share the registry

UND = LIVE + ", und as (select src a, rel, dst b from live union all select dst, rel, src from live where src <> dst)"
NAMES = ["svc-2", "svc-10", "svc-36", "topic-2"]
QUESTION = "What topics does svc-2 produce to?"
HOP_SQL = "select s.name source, rel, t.name target from und join n0 s on a = s.id join n0 t on b = t.id join deg on deg.id = t.id where degree < 500 and s.name in ({}) order by degree desc, t.name, s.name, rel limit 500"


@on_graph("single_hop_retrieve", HOP_SQL.format(", ".join(f"'{x}'" for x in NAMES)), UND + ", " + ENDS)
def _(n, e):
    return retrieval.single_hop(n, e, n.sparkSession.createDataFrame([(x,) for x in NAMES], "name string"), TENANT)


def _ranked(n, e):
    rank = e.groupBy(F.col("dst").alias("id")).agg((F.count("*") / 1000).alias("pagerank"))
    return patterns.degree(n, e).join(rank, "id", "left")


RANKED = ENDS + ", ranked as (select deg.id, degree, k / 1000 pagerank from deg left join (select dst, count(*) k from edges group by 1) on dst = deg.id)"


@on_graph(
    "execute_hop",
    "select src, rank, rel, dst from (select src, rel, dst, s.degree d, row_number() over (partition by src order by coalesce(t.pagerank, 0) desc, t.degree desc, dst, rel)::int rank from live join ranked s on s.id = src join n0 on n0.id = src "
    "join ranked t on t.id = dst where coalesce(t.pagerank, 0) >= 0.003) where rank <= case when d > 20 then 2 else 5 end",
    LIVE + ", " + RANKED,
)
def _(n, e):
    own, live = patterns.tenant_view(n, e, TENANT)
    return retrieval.hop_targets(own.select("id"), _ranked(n, e), live, 5, 20, 2, 0.003)


@on_graph(
    "expand_permitted",
    "select distinct src source_id, dst target_id, rel rel_type, label target_label from e0 join own on own.id = dst where src in (select id from met) and dst in (select id from met)",
    LIVE + ", own as (select id, label from n0 where label in ('Service', 'KafkaTopic')), e0 as (select * from live where src in (select id from own) and dst in (select id from own)), "
    "un as (select src a, dst b from e0 union select dst, src from e0), start as (select src id from live where rel = 'CALLS' group by src order by count(*) desc, src limit 1), "
    "h1 as (select b id from un where a in (select id from start)), met as (select id from start union select id from h1 union select b from un where a in (select id from h1))",
)
def _(n, e):
    own, live = patterns.tenant_view(n, e, TENANT)
    return retrieval.expand(own, live, own.where(F.col("id") == busiest(n, e)), 2, ["Service", "KafkaTopic"])


@on_graph("expansion_strategy", "select id, case when degree >= 1000 then 'expand' when degree >= 200 then 'bfs' else 'bounded' end strategy from deg", ENDS)
def _(n, e):
    return patterns.degree(n, e).select("id", retrieval.strategy(F.col("degree")).alias("strategy"))


@query(
    "name_batches",
    "select pos, name, ((row_number() over (order by score desc, pos) - 1) // 10)::int batch from (select name, min(pos) pos, arg_min(score, pos) score from (select c_custkey pos, concat(c_mktsegment, c_nationkey) name, c_acctbal score from customer order by score desc, pos limit 50) group by name)",
)
def _(spark, d):
    rows = table(spark, d, "customer").selectExpr("c_custkey pos", "concat(c_mktsegment, c_nationkey) name", "c_acctbal score")
    return retrieval.name_batches(rows, 50, 10)


@query(
    "stored_rank",
    "select id, score from (select id, arg_min(s, 2 * pos + k) score, min(2 * pos + k) f from (select o_orderkey pos, 0 k, concat('c', o_custkey) id, o_totalprice s from orders union all select o_orderkey, 1, o_orderpriority, 0.0 from orders) group by id) order by score desc, f limit 50",
)
def _(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey pos", "concat('c', o_custkey) source", "o_orderpriority target", "o_totalprice source_pagerank", "cast(null as double) target_pagerank")
    return retrieval.stored_rank(rows)


BM = "w as (select item_id id, {w} w from benchmark), q as (select unnest(['the', 'tion']) term), tf as (select id, term, count(*) tf from (select id, unnest(w) term from w) group by 1, 2), sc as (select tf.id, sum(ln(2.0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w.w) / (select avg(len(w)) from w)))) s from tf join q using (term) join w on w.id = tf.id group by 1)"


@query("rerank_text", "select w.id, row_number() over (order by round(coalesce(s, 0), 9) desc, w.id)::int rank from w left join sc on sc.id = w.id", BM.format(w=WORDS))
def _(spark, d):
    return retrieval.rerank(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), "the tion", lam=None)


COSINE = "list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0))"


@query("ann_post_filter", f"select vec_id id, round(s, 6) score from (select vec_id, label, {COSINE} s from embeddings order by s desc, vec_id limit 50) where label % 2 = 0 order by s desc, vec_id limit 10")
def _(spark, d):
    v = table(spark, d, "embeddings").withColumn("tenant_id", F.concat(F.lit("t"), (F.col("label") % 2).cast("string")))
    asked = v.where("vec_id = 0").first()
    return retrieval.ann_then_acl(v, asked["embedding"] if asked else [0.0], 50, TENANT).withColumn("score", F.round("score", 6))


def _take(pattern: str, *groups: int) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(q, '{pattern}', {g}, 'i'), '')" for g in groups) + ")"


_OF = lambda p: "(" + ", ".join(f"'{i}'" for i, n in retrieval.NEEDS.items() if n == p) + ")"


@query(
    "match_template",
    f"select event_id, intent, case when intent in {_OF('name')} then name end name, case when intent in {_OF('topic_name')} then topic end topic_name, case when intent in {_OF('namespace')} then ns end \"namespace\" from "
    f"(select event_id, {_case(X.INTENTS, 'null')} intent, {_take(retrieval.SERVICE, 1, 2)} name, {_take(retrieval.TOPIC, 1)} topic, {_take(retrieval.NAMESPACE, 1)} ns from (select event_id, {QUESTIONS} q from events)) "
    f"where intent is not null and case when intent in {_OF('name')} then name is not null when intent in {_OF('topic_name')} then topic is not null when intent in {_OF('namespace')} then ns is not null else true end",
)
def _(spark, d):
    q = table(spark, d, "events").selectExpr("event_id", f"{QUESTIONS} q").select("event_id", retrieval.template_match(F.col("q")).alias("m")).where("m is not null")
    return q.select("event_id", "m.intent", "m.name", "m.topic_name", "m.namespace")


@on_graph(
    "question_context",
    "select 'notice' kind, 'some sources were not reachable' \"text\" union all select 'candidate', concat_ws(' ', acl_label, db_type, id, label, language, name, \"namespace\", replicas::varchar, '1.0', team_owner) from c "
    "union all select distinct 'result', concat_ws(' ', rel, source, target) from (" + HOP_SQL.format("select name from c") + ")",
    UND + ", " + ENDS + ", c as (select * from n0 where name = 'svc-2' and id not in (select src from edges where tenant_id = 't0' and tombstoned_day is not null))",
)
def _(n, e):
    route, candidates, results, degraded = retrieval.retrieve(retrieval.Question(QUESTION, TENANT), n, e)
    return retrieval.assemble(candidates, results, degraded).select("kind", "text")


def _threat(p: str) -> str:
    flags, own = (p[2 : p.index(")")], p[p.index(")") + 1 :]) if p.startswith("(?") and p[2] in "im" else ("", p)
    own = own.replace("(?=", "(?:").replace("'", "''")  # whether it matches is the same
    return f"regexp_matches(\"text\", '{'(?' + flags + ')' if flags else ''}{own}')"


@query("content_threats", "select conv_id, turn, case when \"text\" is not null then array_to_string(list_sort(list_distinct([" + ", ".join(f"case when {_threat(p)} then '{c}' end" for c, _, p in firewall.CONTENT_RULES) + "])), ',') end threats from conversations")
def _(spark, d):
    rows = table(spark, d, "conversations")
    return rows.select("conv_id", "turn", F.array_join(firewall.threats(F.col("text")), ",").alias("threats"))


@query("content_blocked")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", firewall.blocked(F.col("text")).alias("text"))


KEY = b"graphloom"
_blob = lambda pad: "'" + "".join(f"\\x{b ^ pad:02X}" for b in KEY.ljust(64, b"\0")) + "'::blob"
NONCE = "concat('n', cast(event_id as string))"


@query("signed_delimiters", f"select event_id, concat('GRAPHCTX_', n, '_', substring(s, 1, 16)) delimiter, event_id % 2 = 0 valid from (select event_id, n, sha256({_blob(0x5C)} || unhex(sha256({_blob(0x36)} || n::blob))) s from (select event_id, {NONCE} n from events))")
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", firewall.delimiter(F.expr(NONCE), KEY).alias("delimiter"))
    shown = F.when(F.col("event_id") % 2 == 0, F.col("delimiter")).otherwise(F.concat("delimiter", F.lit("0")))
    return rows.select("event_id", "delimiter", firewall.is_delimiter(shown, KEY).alias("valid"))


@on_graph("entity_chunks", "select label, id, ((row_number() over (partition by label order by id) - 1) // 100)::int chunk from nodes")
def _(n, e):
    return commit.chunks(commit.for_write(n.withColumn("type", F.col("label")))).select("label", "id", "chunk")


@on_graph("validation_errors", "select concat('DeployedInEdge references unknown deployment: ', dst) error from edges where rel = 'DEPLOYED_IN' union all select 'Unknown entity type: READS_FROM'")
def _(n, e):
    return commit.topology_errors(n.where("label <> 'K8sDeployment'"), e)


@query("embedding_upsert", "select a.vec_id id, coalesce(b.embedding, a.embedding)[1]::double x, substring(sha256(array_to_string(list_transform(coalesce(b.embedding, a.embedding), lambda x: printf('%.6f', x::double)), '|')), 1, 16) hash from embeddings a left join embeddings b on b.vec_id + 7 = a.vec_id and b.label % 2 = a.label % 2")
def _(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 2).alias("tenant_id"), "embedding")
    return commit.embedding_upsert(v, v.withColumn("id", F.col("id") + 7)).select("id", F.col("embedding")[0].cast("double").alias("x"), S.embedding_hash(F.col("embedding")).alias("hash"))


@query("vector_delete", "select count(*) n_removed from embeddings where label % 2 = 0 and label < 5")
def _(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("t"), F.col("label") % 2).alias("tenant_id"), "embedding", "label")
    return commit.vector_delete(v, v.where("label < 5").select("id"), TENANT)[1]


@query("vector_store_left", "select vec_id id, concat('t', label % 2) tenant_id, substring(sha256(array_to_string(list_transform(embedding, lambda x: printf('%.6f', x::double)), '|')), 1, 16) hash from embeddings where vec_id is not null and not (label % 2 = 0 and label < 5)")
def _(spark, d):
    v = table(spark, d, "embeddings").where("vec_id is not null").select(F.col("vec_id").alias("id"), F.concat(F.lit("t"), F.col("label") % 2).alias("tenant_id"), "embedding", "label")
    left = commit.vector_delete(v, v.where("label < 5").select("id"), TENANT)[0]
    return left.select("id", "tenant_id", S.embedding_hash(F.col("embedding")).alias("hash"))


#: The store was made when services had no language and topics were as now.
@on_graph(
    "embeddings_due",
    "select id, tenant_id, t \"text\", sha256(t) content_hash from (select id, tenant_id, label, language, case label when 'Service' then concat_ws(' ', name, language) when 'Database' then concat_ws(' ', id, concat('type=', db_type)) "
    "when 'K8sDeployment' then concat_ws(' ', id, concat('namespace=', \"namespace\"), concat('replicas=', replicas)) end t from nodes) where t is not null and (label <> 'Service' or language is not null)",
)
def _(n, e):
    before = n.where("label in ('Service', 'KafkaTopic')").withColumn("language", F.lit(None).cast("string"))
    stored = before.select("id", "tenant_id", F.sha2(commit.embedding_text(before.columns), 256).alias("content_hash"))
    return commit.embeddings_due(n, stored)


@query("upload_keys", "select doc_id, concat(source, '/raw/a/', doc_id) key from documents where source is not null")
def _(spark, d):
    docs = table(spark, d, "documents").where("source is not null")
    return docs.select("doc_id", commit.upload_key(F.col("source"), F.concat(F.lit("/a/"), F.col("doc_id")), "/raw/").alias("key"))


@query("pending_files", "select doc_id path from documents where doc_id in (select doc_id from labels where quality = 0 or toxic = 1)")
def _(spark, d):
    status = table(spark, d, "labels").select(F.col("doc_id").alias("path"), F.expr("case when quality = 0 then 'failed' when toxic = 1 then 'pending' else 'done' end").alias("status"))
    return commit.pending_files(table(spark, d, "documents").select(F.col("doc_id").alias("path")), status.distinct())


@query("entity_validation", r"select page_id, regexp_matches(url, '^[a-zA-Z0-9][a-zA-Z0-9._-]{0,252}$') is_id, length(url) > 0 and length(url) <= 512 and not regexp_matches(url, '[''""{};\\`\x00]') is_ref from pages where url is not null")
def _(spark, d):
    return table(spark, d, "pages").where("url is not null").select("page_id", commit.valid_identifier(F.col("url")).alias("is_id"), commit.valid_reference(F.col("url")).alias("is_ref"))


@on_graph("tenant_export", "select 'node' kind, id from nodes where tenant_id = 't0' union all select 'edge', concat_ws('|', src, rel, dst) from edges where tenant_id = 't0'")
def _(n, e):
    return commit.export_tenant(n, e, TENANT).select("kind", "id")


#: What is left after a tenant's erasure, and after that of its nodes only.
@on_graph("erasure_verified", "select 'all' erased, 0::bigint remaining, true verified union all select 'nodes', count(*), count(*) = 0 from edges where tenant_id = 't0'")
def _(n, e):
    left = mutations.erase_tenant(n, e, TENANT)
    told = [commit.verify_erasure(left[0], rows, TENANT).select(F.lit(what).alias("erased"), "remaining", "verified") for what, rows in (("all", left[1]), ("nodes", e))]
    return told[0].union(told[1])


@on_graph("macro_texts", "select concat('[MacroNode macro-', team_owner, '] (community=', team_owner, ', members=', count(*), '): ', count(*), ' services') \"text\" from nodes where team_owner is not null group by team_owner")
def _(n, e):
    g = n.where("team_owner is not null").groupBy("team_owner").agg(F.count("*").alias("n"))
    return g.select(commit.macro_text(F.concat(F.lit("macro-"), "team_owner"), F.col("team_owner"), F.col("n"), F.concat(F.col("n").cast("string"), F.lit(" services"))).alias("text"))


@query(
    "parsed_messages",
    "select case when error is null then concat('f', doc_id) end path, case when error is null then source end tenant_id, error, case when error is null then md5(\"text\") end digest from (select *, case when doc_id % 13 = 0 then 'message value is empty' when doc_id % 11 = 0 then 'json decode error' "
    "when doc_id % 5 = 0 or coalesce(source, '') = '' then 'parsed payload missing tenant_id' when doc_id % 7 = 0 or \"text\" is null then 'parsed payload missing content field' end error from documents)",
)
def _(spark, d):
    docs = table(spark, d, "documents")
    body = F.struct(F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("tenant_id"), F.concat(F.lit("f"), "doc_id").alias("file_path"), F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("content"))
    value = F.when(F.col("doc_id") % 13 == 0, None).when(F.col("doc_id") % 11 == 0, "{").otherwise(F.to_json(body))
    return messages.parsed_messages(docs.select(value.cast("binary").alias("value"))).select("path", "tenant_id", "error", F.md5("content").alias("digest"))


@query("staged_files", "select doc_id, case when doc_id % 3 = 0 then 'path outside the staging folder' end error from documents")
def _(spark, d):
    docs = table(spark, d, "documents").withColumn("path", F.expr("case when doc_id % 6 = 0 then concat('a/../', doc_id) when doc_id % 3 = 0 then concat('/etc/', doc_id) when doc_id % 2 = 0 then concat('/stage/b/', doc_id) else concat('b..c/', doc_id) end"))
    return messages.staged(docs, "/stage").select("doc_id", "error")


@query("blob_source", "select concat('x/', doc_id) path, md5(\"text\") digest from documents where source = 'src1' and \"text\" is not null")
def _(spark, d):
    files = table(spark, d, "documents").select(F.concat_ws("/", "source", F.lit("x"), F.col("doc_id").cast("string")).alias("path"), F.col("text").cast("binary").alias("content"))
    return messages.blobs(files, "src1").select("path", F.md5("content").alias("digest"))


@query(
    "entity_resolution",
    "select id, min(pos) pos from (select p_partkey pos, case when p_partkey = min(p_partkey) over (partition by n) then concat('svc-', p_partkey) else n end id from (select p_partkey, case when p_brand = 'Brand#11' then 'core' else p_brand end n from part)) group by id",
)
def _(spark, d):
    rows = table(spark, d, "part").selectExpr("p_partkey pos", "concat('svc-', p_partkey) id", "p_brand name")
    return extraction.resolve(rows, spark.createDataFrame([("Brand#11", "core")], "alias string, canonical string")).select("id", "pos")


@query(
    "outbox_written",
    "select event_id, case when done then 'done' else 'pending' end status from (select *, max(event_id) over (partition by event_type, user_id) top from (select event_id, event_type, user_id, event_id % 10 = 0 done from events)) where done or event_id = top",
)
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("collection"), F.array(F.col("user_id").cast("string")).alias("ids"), F.col("event_id").alias("version"), F.when(F.col("event_id") % 10 == 0, "done").otherwise("pending").alias("status"), F.lit(0).alias("retry_count"))
    return outbox.written(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")).select("event_id", "status")


@query("outbox_reemit", "select event_id from events where event_type = 'error' and ts < (select max(ts) from events) - interval 30 seconds")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").alias("written_at"), F.when(F.col("event_type") == "error", "pending").otherwise("emitted").alias("status"))
    last = e.agg(F.max("written_at")).first()[0]
    return outbox.to_emit(e, F.lit(last).cast(e.schema["written_at"].dataType)).select("event_id")


@query("outbox_settled", "select event_id, case when event_type = 'view' and event_id % 4 >= 2 then 'dead' else 'pending' end status from events where event_type <> 'click'")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", F.lit("pending").alias("status"), (F.col("event_id") % 4).cast("int").alias("retry_count"))
    outcomes = e.where("event_type in ('click', 'view')").select("event_id", (F.col("event_type") == "click").alias("ok"))
    return outbox.settled(e, outcomes).select("event_id", "status")


@query("cache_invalidation", "select p_partkey key from part where p_brand not in (select p_brand from part where p_partkey <= 3)")
def _(spark, d):
    p = table(spark, d, "part")
    return outbox.invalidated(p.select(F.col("p_partkey").alias("key"), F.array("p_brand", "p_type").alias("tags")), p.where("p_partkey <= 3").select(F.array("p_brand").alias("node_ids"))).select("key")


@query("embedding_batches", "select doc_id id, ((row_number() over (order by doc_id) - 1) // 128)::int batch from documents")
def _(spark, d):
    return outbox.batches(table(spark, d, "documents").select(F.col("doc_id").alias("id")), 128).select("id", "batch")


@query(
    "shortened_values",
    "select doc_id, case when length(t) <= 80 then t when b > 38 then concat(substring(t, 1, b), '...') else concat(substring(t, 1, 77), '...') end \"text\" from (select doc_id, \"text\" t, case when contains(substring(\"text\", 1, 78), ' ') then 78 - instr(reverse(substring(\"text\", 1, 78)), ' ') else -1 end b from documents where \"text\" is not null)",
)
def _(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", extraction.shortened(F.col("text"), 80).alias("text"))


@query(
    "semantic_lookup",
    "select vec_id, case when b1 >= coalesce(greatest(0.85, least(0.98, 0.92 + 0.15 * (0.5 - (b1 - b2)))), 0.92) then key end key, round(b1, 6) similarity from "
    "(select vec_id, max(case when k = 1 then key end) key, max(case when k = 1 then s end) b1, max(case when k = 2 then s end) b2 from r group by 1)",
    "live as (select * from embeddings where vec_id + 300 >= 400 order by vec_id desc limit 1024), "
    "s as (select a.vec_id, b.vec_id key, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) s from embeddings a left join live b on a.label = b.label), "
    "r as (select *, row_number() over (partition by vec_id order by s desc, key) k from s)",
)
def _(spark, d):
    v = table(spark, d, "embeddings")
    entries = v.select(F.col("vec_id").alias("key"), "label", "embedding", (F.col("vec_id") + 300).alias("expires_at"), F.col("vec_id").alias("used_at"))
    out = cache.lookup(v.select("vec_id", "label", "embedding"), cache.kept(entries, F.lit(400)), ["label"], adaptive=True)
    return out.select("vec_id", "key", F.round("similarity", 6).alias("similarity"))
