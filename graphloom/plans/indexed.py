"""Registered queries of stored indexes, walks, traversals and commits, with their DuckDB equivalents."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from graphloom.operators import commit, ingest, patterns, projection, search_index, snapshots, structure, traversal, vector_index
from graphloom.plans import questions
from graphloom.plans.more import ORACLE_SQL, QUERIES
from graphloom.plans.queries import ENDS, LIVE, TENANT, WORDS, on_graph, query
from graphloom.session import cut_lineage, shared_folder, table
from graphloom.sources.fixture import graph, oracle
from graphloom.streaming import emissions

__all__ = ["ORACLE_SQL", "QUERIES", "on_graph"]  # with those of the other modules, which share the registry


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: The benchmark's texts as questions, over an index that took the documents in two increments, some of them offered twice.
@query(
    "indexed_search",
    "select query_id, rank, id, round(score, 6) score from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id)::int rank from s) where rank <= 10",
    f"w as (select doc_id, {WORDS} w from documents where doc_id is not null), tf as (select doc_id, term, count(*) tf from (select doc_id, unnest(w) term from w) group by 1, 2), n as (select term, count(*) df from tf group by 1), "
    f"q as (select query_id, term, count(*) qn from (select item_id query_id, unnest({WORDS}) term from benchmark) group by 1, 2), "
    "s as (select query_id, w.doc_id id, sum(qn * ln(1 + ((select count(*) from w) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / (select avg(len(w)) from w)))) score "
    "from q join n using (term) join tf using (term) join w on w.doc_id = tf.doc_id group by 1, 2)",
)
def _(spark, d):
    docs, folder = table(spark, d, "documents"), _folder(spark, "search-index")
    search_index.add(docs.where("doc_id % 3 <> 1"), folder, "1", 32)
    search_index.add(docs, folder, "2", 32)
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search_index.search(questions, folder, true_idf=True, buckets=32).withColumn("score", F.round("score", 6))


@query(
    "indexed_neighbors",
    "select query_id, rank, id, round(s, 6) score from (select *, row_number() over (partition by query_id order by round(s, 9) desc, id)::int rank from s) where rank <= 10",
    "s as (select q.vec_id query_id, c.vec_id id, list_cosine_similarity(q.embedding::double[], c.embedding::double[]) s from embeddings q, embeddings c where q.vec_id % 20 = 0 and c.vec_id is not null)",
)
def _(spark, d):
    v, folder = table(spark, d, "embeddings"), _folder(spark, "vector-index")
    vector_index.create(spark, folder, vector_index.fit(v, 16))
    vector_index.add(v, folder, "1")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    return vector_index.search(asked, folder, exact=True).withColumn("score", F.round("score", 6))


FIRST = "label in ('Service', 'KafkaTopic') and coalesce(team_owner, '') <> 'Brand#11'"
NOW = "label <> 'Database'"
OWNER = "case when team_owner = 'Brand#12' then 'core' else team_owner end"


#: A first commit of some nodes and all edges among them, then one of all nodes but databases, some with another owner, and all edges: each row with
#: the version that wrote it last.
@on_graph(
    "committed_topology",
    "select 'node' kind, id, case when id in (select id from f) and coalesce(team_owner, '') <> 'Brand#12' then 1 else 2 end::bigint \"version\" from s union all "
    "select 'edge', concat_ws('|', src, rel, dst), case when src in (select id from f) and dst in (select id from f) then 1 else 2 end from edges where src in (select id from s) and dst in (select id from s)",
    f"f as (select * from nodes where {FIRST}), s as (select * from nodes where {NOW})",
)
def _(n, e):
    spark, folder = n.sparkSession, _folder(n.sparkSession, "topology")
    commit.commit_topology(spark, folder, n.where(FIRST), e)
    commit.commit_topology(spark, folder, n.where(NOW).withColumn("team_owner", F.expr(OWNER)), e)
    form = "id string, src string, rel string, dst string, _version long"
    own = snapshots.read(spark, folder, "nodes", details=True, schema=form).select(F.lit("node").alias("kind"), "id", F.col("_version").alias("version"))
    return own.union(snapshots.read(spark, folder, "edges", details=True, schema=form).select(F.lit("edge"), F.concat_ws("|", "src", "rel", "dst"), "_version"))


#: Orders as writes of a customer's event, every fifth of them answered by an ack a day later; the window is an hour, a lease 36 hours.
@query(
    "outbox_emissions",
    "select key, event_id, version, a attempt, case when a > 3 then 'dead' else 'emit' end status, ms + 3600000 + a * 129600000 at_ms from e, (select unnest(range(5))::int a) where ms + 3600000 + a * 129600000 < least(coalesce(nxt, 99999999999999), coalesce(ack, 99999999999999), 904608000000)",
    "w0 as (select o_custkey::varchar key, o_orderkey::varchar event_id, o_orderkey version, epoch_ms(o_orderdate) ms, o_orderkey % 5 = 0 acked from orders), "
    "w1 as (select *, max(version) over (partition by key order by ms, version, event_id rows between unbounded preceding and 1 preceding) top from w0), "
    "e as (select *, lead(ms) over (partition by key order by ms, version, event_id) nxt, case when acked then ms + 86400000 end ack from w1 where top is null or version >= top)",
)
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderkey").cast("string").alias("event_id"), F.col("o_orderkey").alias("version"))
    acks = o.where("version % 5 = 0").select("key", (F.col("at") + F.expr("interval 1 day")).alias("at"), F.lit("ack").alias("kind"), "event_id", "version")
    messages = o.select("key", "at", F.lit("write").alias("kind"), "event_id", "version").unionByName(acks)
    out = emissions.emitted(messages, F.timestamp_millis(F.lit(904_608_000_000)), 3_600_000, 129_600_000, 3)
    return out.select("key", "event_id", "version", "attempt", "status", F.unix_millis("at").alias("at_ms"))


def _traversal(hops: int, beam: int, per_source: int, limit: int, visited: int, ceiling: int, supernode: int) -> tuple[str, str]:
    """The hops one after another, as one chain of tables."""
    cost = "greatest(1, length(concat_ws(' ', src, rel, dst)) // 4)::bigint"
    out = [
        ENDS,
        "d0 as (select n0.id, count(e.id) degree from n0 left join (select src id from edges where tenant_id = 't0' union all select dst from edges where tenant_id = 't0' and src <> dst) e on e.id = n0.id group by 1)",
        "t0 as materialized (select * from (select src, rel, dst, t.degree, s.degree > "
        f"{supernode} sup, {cost} c, row_number() over (partition by src order by t.degree desc, dst, rel) n from (select distinct src, rel, dst from live) join d0 t on t.id = dst join d0 s on s.id = src) where n <= {per_source})",
        "f1 as materialized (select id q, id from n0 where label = 'Service' and try_cast(substring(id, 5) as int) % 20 = 0)",
    ]
    for h in range(1, hops + 1):
        out.append(f"x{h} as materialized (select * from (select q, src, rel, dst, degree, c, sup, row_number() over (partition by q, sup order by degree desc, src, dst, rel) k from f{h} join t0 on src = id) where sup or k <= {limit})")
        so_far = " union all ".join(f"select q, c from x{k}" for k in range(1, h + 1))
        seen = " union all ".join(f"select q, id from f{k}" for k in range(1, h + 1))
        out.append(f"g{h} as (select q from ({so_far}) group by q having sum(c) < {ceiling}), m{h} as (select q from ({seen}) group by q having count(*) < {visited})")
        out.append(
            f"f{h + 1} as materialized (select q, id from (select q, id, row_number() over (partition by q order by degree desc, id) k from (select distinct q, dst id, degree from x{h}) n "
            f"where q in (select q from g{h}) and q in (select q from m{h}) and not exists (select 1 from ({seen}) s where s.q = n.q and s.id = n.id)) where k <= {beam})"
        )
    return ", ".join(out), " union all ".join(f"select q query_id, {h} hop, src, rel, dst, c \"cost\" from x{h}" for h in range(1, hops + 1))


_BOUNDS = (5, 8, 6, 30, 40, 1200, 60)
_CTES, _SELECT = _traversal(*_BOUNDS)


#: Every service whose number is divisible by 20 asks at once.
@on_graph("batched_traversal", _SELECT, LIVE + ", " + _CTES)
def _(n, e):
    own, edges = patterns.tenant_view(n, e, TENANT)
    asked = own.where("label = 'Service' and try_cast(substring(id, 5) as int) % 20 = 0").select(F.col("id").alias("query_id"), "id")
    hops, beam, per_source, limit, visited, ceiling, supernode = _BOUNDS
    return traversal.traverse(asked, own, edges, hops, beam, per_source, limit, visited, ceiling, supernode)


#: Of every service: is there a path to the service of the next number, and to the topic of its own?
@on_graph(
    "claimed_paths",
    "select src, dst, min(h)::int hops from p left join r on r.seed = p.src and r.id = p.dst group by 1, 2",
    "lv as materialized (select distinct src, dst from edges where tombstoned_day is null), s as (select id, try_cast(substring(id, 5) as int) k from nodes where label = 'Service'), "
    "p as materialized (select id src, concat('svc-', k + 1) dst from s union select id, concat('svc-', k + 2) from s union select id, concat('topic-', k) from s union select id, id from s where k % 7 = 0), "
    "r as (select distinct src seed, src id, 0 h from p union select seed, lv.dst, h + 1 from r join lv on lv.src = r.id where h < 5)",
)
def _(n, e):
    s = n.where("label = 'Service'").select("id", F.expr("try_cast(substring(id, 5) as int)").alias("k"))
    claim = lambda dst, rows=s: rows.select(F.col("id").alias("src"), F.expr(dst).alias("dst"))
    pairs = claim("concat('svc-', k + 1)").union(claim("concat('svc-', k + 2)")).union(claim("concat('topic-', k)")).union(claim("id", s.where("k % 7 = 0")))
    return traversal.claimed_paths(pairs, e)


#: Page rank from every service whose number is divisible by 20, and the edges that touch the best of each.
@on_graph(
    "push_pagerank",
    "select q query_id, id, round(p, 9) score from st where n = (select max(n) from st) and p > 0",
    "lv as (select src, dst from edges where tombstoned_day is null), nb as materialized (select a, b, count(*) m from (select src a, dst b from lv union all select dst, src from lv) group by 1, 2), dg as materialized (select a, sum(m)::bigint d from nb group by 1), "
    "st as (select 0 n, id q, id, d, 0::double p, 1::double r from nodes join dg on a = id where label = 'Service' and try_cast(substring(id, 5) as int) % 20 = 0 union all "
    "select n + 1, q, id, d, p, r from (select n, q, id, any_value(dg.d) d, sum(p) p, sum(r) r from (select n, q, id, p + case when r > 1e-4 * d then 0.15::double * r else 0 end p, case when r > 1e-4 * d then 0 else r end r from st "
    "union all select n, q, b, 0, 0.85::double * r / d * m from st join nb on nb.a = st.id where r > 1e-4 * d) x join dg on dg.a = x.id group by n, q, id) where exists (select 1 from st where r > 1e-4 * d))",
)
def _(n, e):
    asked = n.where("label = 'Service' and try_cast(substring(id, 5) as int) % 20 = 0").select(F.col("id").alias("query_id"), "id")
    return traversal.forward_push(asked, e, 1e-4).withColumn("score", F.round("score", 9))


#: Two runs over the documents as files; in the first, texts with an address of one kind fail, and their chunks with them.
@query(
    "ingestion_resume",
    "select path, case when max(bad) over (partition by chunk) = 1 then 2 else 1 end run, n n_entities from c",
    "f as (select concat('docs/', lpad(doc_id::varchar, 12, '0')) path, coalesce(text, '') t from documents where doc_id is not null), "
    "c as (select path, (row_number() over (order by path) - 1) // 50 chunk, (contains(t, '@') and contains(t, '+'))::int bad, len(regexp_extract_all(t, '[a-z0-9.]+@[a-z]'))::int n from f)",
)
def _(spark, d):
    files = table(spark, d, "documents").where("doc_id is not null").select(F.concat(F.lit("docs/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"), F.md5("text").alias("version"), F.col("text").alias("content"))
    folder = _folder(spark, "ingestion")

    def addresses(path: str, content: str | None) -> list[str]:
        return re.findall("[a-z0-9.]+@[a-z]", content or "")

    def strict(path: str, content: str | None) -> list[str]:
        if content and "@" in content and "+" in content:
            raise ValueError("an address with a plus")
        return addresses(path, content)

    ingest.run(files, folder, strict)
    ingest.run(files, folder, addresses)
    return ingest.results(spark, folder).select("path", "run", F.size("entities").alias("n_entities"))


_SIGN = "case ('0x' || substring(md5(concat(id, ':', pos)), 1, 8))::bigint % 6 when 0 then sqrt(3.0) when 1 then -sqrt(3.0) else 0 end"
_MEAN = "select a id, pos, sum(m * x) / (select sum(m) from nb n where n.a = nb.a) x from nb join {} on id = b group by a, pos"


#: The embeddings after every fiftieth part's calls went, from the layers of the graph before.
@on_graph(
    "fast_rp_updated",
    "select id, pos, round(h1.x + h2.x + 0.8 * h3.x, 6) x from h1 join h2 using (id, pos) join h3 using (id, pos)",
    "e0 as (select src, dst from edges where tombstoned_day is null and not (rel = 'CALLS' and substring(src, 5)::int % 50 = 0)), nb as materialized (select a, b, count(*) m from (select src a, dst b from e0 union all select dst, src from e0) group by 1, 2), "
    f"h0 as materialized (select id, pos, {_SIGN} x from (select distinct a id from nb), (select unnest(range(16)) pos)), "
    f"h1 as materialized ({_MEAN.format('h0')}), h2 as materialized ({_MEAN.format('h1')}), h3 as materialized ({_MEAN.format('h2')})",
)
def _(n, e):
    now = patterns.live(e)
    goes = "rel = 'CALLS' and try_cast(substring(src, 5) as int) % 50 = 0"
    before = projection.layers(now, 16)
    after, _ = projection.updated(before, now.where(f"not ({goes})"), now.where(goes), 16)
    out = projection.embeddings(after, dims=16).select("id", F.posexplode("embedding").alias("pos", "x"))
    return out.select("id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


#: Of the graph without calls: services hang on topics, deployments and databases.
@on_graph(
    "cut_vertices",
    "select id from (select v id, count(*) n from nb0 group by v) t where n > (select count(*) from r join nb0 on nb0.v = r.v and nb0.u = r.id where r.v = t.id)",
    "lv as (select src, dst from edges where tombstoned_day is null and rel in ('PRODUCES', 'CONSUMES') and src <> dst), nb0 as materialized (select distinct src v, dst u from lv union select distinct dst, src from lv), "
    "r as (select v, min(u) id from nb0 group by v union select r.v, nb0.u from r join nb0 on nb0.v = r.id where nb0.u <> r.v)",
)
def _(n, e):
    return structure.cut_vertices(patterns.live(e).where("rel in ('PRODUCES', 'CONSUMES')"))


#: One question for each part, of eleven kinds; every fourth may see two labels only, every third carries a vector.
ASKED = (
    "case p_partkey % 11 when 0 then concat('What is the blast radius of svc-', p_partkey, ' service?') when 1 then concat('Which services are most critical for svc-', p_partkey, '?') "
    "when 2 then concat('how many calls from svc-', p_partkey, '?') when 3 then concat('count who consumes from topic-', p_partkey % 100) when 4 then concat('rank who produces to topic-', p_partkey % 100) "
    "when 5 then concat('top 5 pods of svc-', p_partkey, ' deployed') when 6 then concat('rank namespace ', case p_partkey % 3 when 0 then 'africa' when 1 then 'asia' else 'europe' end, ' services') "
    "when 7 then concat('count databases of svc-', p_partkey) when 8 then 'how many calls across teams' when 9 then concat('What topics does svc-', p_partkey, ' produce to?') else concat('tell me about svc-', p_partkey) end"
)
SEES = "(not {q}.few or coalesce({n}acl_label in ('Ns_asia', 'Ns_europe'), false))"
_sees = lambda q, n: SEES.format(q=q, n=n)
_both = _sees("q", "s_") + " and " + _sees("q", "t_")
_ONE = lambda k, where, on, values, rest="": f"select query_id, concat_ws(' ', {values}) \"text\" from q join h on h.tenant_id = q.tenant_id and {on} where k = {k} and {where} and {_both}{rest}"
_TOP = lambda rows, order, k=10: f"select query_id, \"text\" from (select *, row_number() over (partition by query_id order by {order}) n from ({rows})) where n <= {k}"
_CALL = f"from q join h on h.tenant_id = q.tenant_id where rel = 'CALLS' and not back and {_both}"


@query(
    "question_contexts",
    oracle(
        "select query_id, rank, kind, \"text\" from (select *, sum(case when \"text\" = '' then 0 else greatest(1, length(\"text\") // 4) end) over (partition by query_id order by rank) used from "
        "(select query_id, kind, \"text\", case when kind = 'notice' then 0 else row_number() over (partition by query_id order by round(coalesce(score, 0), 9) desc, id) end::int rank from r left join sc using (query_id, id))) where used <= 2000",
        f"q as materialized (select p_partkey query_id, {ASKED} \"text\", p_partkey % 11 k, concat('t', p_partkey % 2) tenant_id, p_partkey % 4 = 0 few, p_partkey % 3 = 0 has, concat('svc-', p_partkey) svc, concat('topic-', p_partkey % 100) topic, "
        "case p_partkey % 3 when 0 then 'africa' when 1 then 'asia' else 'europe' end ns from part), "
        + ENDS.replace("ends as", "ends as materialized").replace("deg as", "deg as materialized")
        + ", h0 as (select tenant_id, src, rel, dst, false back from edges where tombstoned_day is null union all select tenant_id, dst, rel, src, true from edges where tombstoned_day is null and src <> dst), "
        "h as materialized (select h0.*, s.name s_name, s.label s_label, s.acl_label s_acl_label, s.team_owner s_team, t.name t_name, t.label t_label, t.acl_label t_acl_label, t.team_owner t_team, t.namespace t_ns, t.replicas t_replicas, t.db_type t_db "
        "from h0 join nodes s on s.id = src and s.tenant_id = h0.tenant_id join nodes t on t.id = dst and t.tenant_id = h0.tenant_id), "
        "nr as materialized (select query_id, concat('svc-', vec_id) id, s score from (select *, row_number() over (partition by query_id order by round(s, 9) desc, vec_id) n from (select query_id, c.vec_id, list_cosine_similarity(v.embedding::double[], c.embedding::double[]) s "
        "from q join embeddings v on has and v.vec_id = query_id % 500 join embeddings c on true)) where n <= 50), "
        "dg as (select query_id from q where query_id not in (select query_id from nr)), "
        f"c0 as (select query_id, id, score from nr union all select query_id, id, 1.0 from (select q.query_id, n.id, row_number() over (partition by q.query_id order by n.name, n.id) n from (select q.*, unnest(list_distinct(regexp_extract_all(lower(\"text\"), '[a-z0-9][a-z0-9_-]*'))) w from q join dg using (query_id)) q "
        f"join nodes n on lower(n.name) = w and n.tenant_id = q.tenant_id where {_sees('q', 'n.')}) where n <= 50), "
        f"c as materialized (select q.query_id, q.k, n.*, score from c0 join q using (query_id) join nodes n on n.id = c0.id and n.tenant_id = q.tenant_id where {_sees('q', 'n.')} and n.id not in (select src from edges where tombstoned_day is not null)), "
        f"b0 as materialized (select distinct q.query_id, q.few, n.id from q join nodes n on n.name = svc and n.tenant_id = q.tenant_id where k = 0 and n.label = 'Service' and {_sees('q', 'n.')}), be as materialized (select distinct src, dst from edges where tombstoned_day is null and rel in ('CALLS', 'PRODUCES', 'CONSUMES')), "
        "b1 as materialized (select distinct query_id, few, dst id from b0 join be on src = id), b2 as materialized (select distinct query_id, few, dst id from b1 join be on src = id), b3 as (select distinct query_id, few, dst id from b2 join be on src = id), "
        "r0 as (select query_id, 'candidate' kind, concat_ws(' ', acl_label, db_type, id, label, language, name, \"namespace\", replicas::varchar, printf('%.4f', score), team_owner) \"text\" from c "
        f"union select query_id, 'notice', '{questions.NOTICE}' from dg "
        "union select query_id, 'result', concat_ws(' ', rel, s_name, t_name) from (select *, row_number() over (partition by query_id order by degree desc, t_name, s_name, rel) n from q join (select distinct query_id, name from c) x using (query_id) "
        f"join h on h.tenant_id = q.tenant_id and s_name = x.name join deg on deg.id = dst where k = 9 and degree < 500 and {_sees('q', 't_')}) where n <= 500 "
        "union select query_id, 'result', \"text\" from ("
        + " union all ".join(
            [
                _TOP(_ONE(2, "s_label = 'Service'", "s_name = svc", "rel, s_name, t_name, t_label").replace("select query_id", "select query_id, rel, t_name", 1), "rel, t_name"),
                _ONE(5, "rel = 'DEPLOYED_IN' and not back", "s_name = svc", "t_ns, t_replicas::varchar, s_name"),
                _ONE(7, "rel in ('READS_FROM', 'WRITES_TO') and not back", "s_name = svc", "dst, t_db, s_name"),
                _TOP(_ONE(3, "rel = 'CONSUMES' and not back", "t_name = topic", "s_name, t_name").replace("select query_id", "select query_id, s_name", 1), "s_name"),
                _TOP(_ONE(4, "rel = 'PRODUCES' and not back", "t_name = topic", "s_name, t_name").replace("select query_id", "select query_id, s_name", 1), "s_name"),
                _ONE(6, "rel = 'DEPLOYED_IN' and not back", "t_ns = ns", "t_ns, s_name"),
                f"select b.query_id, concat_ws(' ', n.name, n.label) from (select * from b1 union select * from b2 union select * from b3) b join nodes n using (id) where {_sees('b', 'n.')}",
                _TOP(f"select query_id, count(*) m, t_name, concat_ws(' ', count(*)::varchar, t_name) \"text\" {_CALL} and k = 1 and s_label = 'Service' and t_label = 'Service' group by query_id, t_name", "m desc, t_name"),
                _TOP(f"select query_id, s_team, t_team, s_name, t_name, concat_ws(' ', t_name, t_team, s_name, s_team) \"text\" {_CALL} and k = 8 and s_team <> t_team", "s_team, t_team, s_name, t_name"),
            ]
        )
        + ")), r as materialized (select *, concat(kind, ':', sha256(\"text\")) id from r0), "
        f"w as materialized (select query_id, id, {WORDS} w from r), qw as (select query_id, term, count(*) qn from (select query_id, unnest({WORDS}) term from q) group by 1, 2), "
        "sc as (select query_id, id, sum(qn * ln(2.0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w.w) / avgdl))) score from (select query_id, id, term, count(*) tf from (select query_id, id, unnest(w) term from w) group by 1, 2, 3) "
        "join qw using (query_id, term) join w using (query_id, id) join (select query_id, avg(len(w)) avgdl from w group by 1) using (query_id) group by 1, 2)",
    ),
)
def _(spark, d):
    n, e = graph(spark, d)
    part, v, folder = table(spark, d, "part"), table(spark, d, "embeddings"), _folder(spark, "question-vectors")
    acl = F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit("Ns_asia"), F.lit("Ns_europe")))
    carried = F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey") % 500)
    asked = part.select(F.col("p_partkey").alias("query_id"), F.expr(ASKED).alias("text"), F.concat(F.lit("t"), F.col("p_partkey") % 2).alias("tenant_id"), acl.alias("acl"), carried.alias("near_id"))
    vector_index.create(spark, folder, vector_index.fit(v, 16))
    vector_index.add(v, folder, "1")
    vectors = v.join(asked.select(F.col("near_id").alias("vec_id")).distinct(), "vec_id", "left_semi")
    near = vector_index.search(vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v")), folder, k=50, exact=True)
    near = near.select(F.col("query_id").alias("near_id"), F.concat(F.lit("svc-"), F.col("id").cast("string")).alias("id"), "score")
    return questions.contexts(asked, n, e, cut_lineage(near), budget=2000)
