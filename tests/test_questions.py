"""Contexts of many questions at once against the plans of a single question."""

import os

import pytest
from pyspark.sql import functions as F

from graphloom.operators import patterns, traversal
from graphloom.plans import questions, retrieval, templates
from graphloom.sources.fixture import graph

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
SCHEMA = "query_id long, text string, tenant_id string, acl array<string>"
SEES = ["Ns_asia", "Ns_europe"]


def values(rows) -> set:
    return {" ".join(str(v) for _, v in sorted(r.asDict().items()) if v is not None) for r in rows.collect()}


@needs_tables
@pytest.mark.parametrize("acl", [None, SEES, []])
def test_templates_give_the_rows_of_their_plans(spark, acl):
    n, e = graph(spark, SF)
    seen = n if acl is None else n.where(patterns.acl_predicate(F.col("acl_label"), acl))
    told = {
        1: ("What is the blast radius of svc-2 service?", lambda: templates.blast_radius(seen, e, "t0", "svc-2")),
        2: ("Which services are most critical for svc-2?", lambda: templates.dependency_count(seen, e, "t0")),
        3: ("how many calls from svc-2?", lambda: templates.service_neighbors(seen, e, "t0", "svc-2")),
        4: ("count who consumes from topic-2", lambda: templates.topic_consumers(seen, e, "t0", "topic-2")),
        5: ("rank who produces to topic-2", lambda: templates.topic_producers(seen, e, "t0", "topic-2")),
        6: ("top 5 pods of svc-2 deployed", lambda: templates.service_deployments(seen, e, "t0", "svc-2")),
        7: ("rank namespace asia services", lambda: templates.namespace_services(seen, e, "t0", "asia")),
        8: ("count databases of svc-2", lambda: templates.service_databases(seen, e, "t0", "svc-2")),
        9: ("how many calls across teams", lambda: templates.cross_team_dependencies(seen, e, "t0")),
    }
    asked = questions.routed(spark.createDataFrame([(k, t, "t0", acl) for k, (t, _) in told.items()], SCHEMA))
    got = questions.templates(asked, n, e).groupBy("query_id").agg(F.collect_set("text").alias("t"))
    got = {r["query_id"]: set(r["t"]) for r in got.collect()}
    for k, (_, plan) in told.items():
        assert got.get(k, set()) == values(plan()), k
    assert acl is not None or set(got) == set(told)


@needs_tables
def test_hops_and_contexts_of_one_question_among_many(spark):
    n, e = graph(spark, SF)
    text = "What topics does svc-2 produce to?"
    rows = [(1, text, "t0", None), (2, text, "t1", None), (3, text, "t0", SEES), (4, None, "t0", None), (5, "nothing known", "t0", None), (6, "tell me about svc-2", "t0", None)]
    asked = spark.createDataFrame(rows, SCHEMA)
    routed = questions.routed(asked)
    found, degraded = questions.candidates(routed, n, e)
    name = spark.createDataFrame([("svc-2",)], "name string")
    dead = e.where("tombstoned_day is not null and src = 'svc-2'").count() > 0
    hop = questions.neighbours(routed, found, n, e)
    want = set() if dead else {tuple(r) for r in retrieval.single_hop(n, e, name, "t0").collect()}
    assert {tuple(r)[1:] for r in hop.where("query_id = 1").collect()} == want
    assert hop.where("query_id in (2, 4, 5, 6)").count() == 0
    out = questions.contexts(asked, n, e)
    one = retrieval.answer_context(retrieval.Question(text, "t0"), n, e)
    cut = lambda df: {(r["kind"], r["text"].replace("1.0000", "1.0")) for r in df.collect()}
    assert cut(out.where("query_id = 1").select("kind", "text")) == cut(one.select("kind", "text"))
    ranks = [r["rank"] for r in out.where("query_id = 1").orderBy("rank").collect()]
    assert ranks == sorted(set(ranks)) and ranks[0] == 0
    assert {r["kind"] for r in out.where("query_id = 5").collect()} == {"notice"} and out.where("query_id = 4").count() == 0
    diverse = questions.contexts(asked, n, e, lam=0.5)
    assert cut(diverse.where("query_id = 1").select("kind", "text")) == cut(out.where("query_id = 1").select("kind", "text"))
    short = questions.contexts(asked, n, e, budget=20)
    assert short.groupBy("query_id").agg(F.sum(F.greatest(F.lit(1), F.floor(F.length("text") / 4))).alias("c")).where("c > 20").count() == 0
    assert questions.contexts(asked.limit(0), n, e).count() == 0 and questions.contexts(asked, n.limit(0), e.limit(0)).where("kind <> 'notice'").count() == 0


@needs_tables
def test_hops_near_pushed_page_rank_only(spark):
    n, e = graph(spark, SF)
    routed = questions.routed(spark.createDataFrame([(1, "What do these call: svc-10 svc-36 topic-2", "t0", None)], SCHEMA))
    assert [r["route"] for r in routed.collect()] == ["single_hop"]
    near = spark.createDataFrame([(1, x, 0.5) for x in ("svc-10", "svc-36", "topic-2", "svc-1")], "query_id long, id string, score double")
    found, degraded = questions.candidates(routed, n, e, near)
    assert degraded.count() == 0 and found.where("tenant_id <> 't0'").count() == 0
    all_rows = questions.hops_of(n, e).where("tenant_id = 't0'")
    best = traversal.forward_push(found.select("query_id", "id"), e, 1e-5).orderBy(F.desc(F.round("score", 12)), "id").limit(3)
    top = {r["id"] for r in best.collect()}
    names = {r["name"] for r in found.collect()}
    want = {(r["s_name"], r["rel"], r["t_name"]) for r in all_rows.collect() if r["s_name"] in names and (r["src"] in top or r["dst"] in top)}
    got = {tuple(r)[1:] for r in questions.neighbours(routed, found, n, e, 1e-5, 3).collect()}
    assert got == want


def test_diverse_pages_and_ties(spark):
    rows = spark.createDataFrame([(q, f"r{k}", t) for q in (1, 2) for k, t in enumerate(["red fox", "red fox", "red hen", "", "blue"])], "query_id int, id string, text string")
    asked = spark.createDataFrame([(1, "red fox"), (2, None)], "query_id int, text string")
    plain = {(r["query_id"], r["id"]): r["rank"] for r in questions.ranked(rows, asked).collect()}
    assert [plain[1, f"r{k}"] for k in range(5)] == [1, 2, 3, 4, 5] and [plain[2, f"r{k}"] for k in range(5)] == [1, 2, 3, 4, 5]
    mixed = {(r["query_id"], r["id"]): r["rank"] for r in questions.ranked(rows, asked, lam=0.3).collect()}
    assert mixed[1, "r0"] == 1 and mixed[1, "r1"] > mixed[1, "r2"] and sorted(mixed.values()) == sorted(plain.values())


def test_equal_questions_are_answered_once_from_the_rows_that_can_count(spark, monkeypatch):
    n, e = graph(spark, SF)
    text, met, real = "rank namespace asia services", [], questions.ranked

    def ranked(rows, *args, **kwargs):
        met.append(rows.count())
        return real(rows, *args, **kwargs)

    monkeypatch.setattr(questions, "ranked", ranked)
    asked = spark.createDataFrame([(k, text, "t0", None) for k in range(40)], SCHEMA)
    whole = [tuple(r) for r in questions.contexts(asked.limit(1), n, e, budget=10**6).orderBy("rank").select("rank", "kind", "text").collect()]
    got: dict = {}
    for r in questions.contexts(asked, n, e, budget=30).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["kind"], r["text"]))
    used, want = 0, []
    for row in whole:
        used += max(1, len(row[2]) // 4)
        want += [row] if used <= 30 else []
    assert set(got) == set(range(40)) and all(sorted(x) == want for x in got.values()) and len(want) < len(whole)
    assert met[1] <= met[0], "rows of one question are ranked, not of forty"
