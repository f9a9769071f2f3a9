"""Every registered query against its SQL, at the smallest scale."""

import os

import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def registry():
    from graphloom.plans import catalogue, indexed

    return catalogue.QUERIES | indexed.QUERIES, catalogue.ORACLE_SQL | indexed.ORACLE_SQL


def names():
    return list(registry()[0])


#: Without SQL: each is held against plain Python below, or by its properties.
PLAIN = {"louvain", "articulation_points", "fast_rp", "node2vec_walks", "node2vec_embedding", "beam_expansion", "mmr", "injection_score", "content_blocked"}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def shown(v):
    """Nulls alike, and whole numbers alike whether or not pandas made them floats."""
    if v is None or v is pd.NA or v != v:
        return None
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() else round(float(v), 5)
    return str(v)


def plain(df):
    cols = sorted(df.columns)
    return cols, sorted(str([shown(v) for v in r]) for r in df[cols].astype(object).itertuples(index=False, name=None))


needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


@needs_tables
@pytest.mark.parametrize("name", [n for n in names() if n not in PLAIN])
def test_query(spark, duck, name):
    queries, sql = registry()
    assert plain(queries[name](spark, SF).toPandas()) == plain(duck.execute(sql[name]).df())


@needs_tables
def test_empty_tables_crash_no_query(spark, tmp_path):
    for t in TABLES:
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    counts = {name: f(spark, str(tmp_path)).count() for name, f in registry()[0].items()}
    told = {"stats_nodes": 5, "stats_edges": 6, "stale_tombstone": 1, "modularity": 1, "vector_delete": 1, "erasure_verified": 2, "question_context": 1}
    assert {k: v for k, v in counts.items() if v} == told


def run(spark, name):
    return registry()[0][name](spark, SF).collect()


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


@pytest.fixture(scope="module")
def live_edges(spark):
    from graphloom.sources.fixture import graph

    nodes, edges = graph(spark, SF)
    return [r["id"] for r in nodes.collect()], [(r["src"], r["dst"]) for r in edges.where("tombstoned_day is null").collect()]


@needs_tables
def test_louvain_equals_one_pass_over_the_whole_graph(spark, live_edges):
    near = {}
    for a, b in live_edges[1]:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    own, m2 = {v: k for k, v in enumerate(sorted(near))}, sum(map(len, near.values()))
    for _ in range(10):
        before = dict(own)
        for v in sorted(near):
            best, most = own[v], 0.0
            for c in sorted({own[u] for u in near[v]} - {own[v]}):
                gain = sum(own[u] == c for u in near[v]) - sum(len(near[u]) for u in near if own[u] == c) * len(near[v]) / m2
                if gain > most:
                    best, most = c, gain
            own[v] = best
        if own == before:
            break
    order = sorted(near)
    assert {r["id"]: r["community"] for r in run(spark, "louvain")} == {v: f"community-{order[c]}" for v, c in own.items()}


def test_unconnected_components_share_no_community(spark):
    from graphloom.operators import ranking

    edges = spark.createDataFrame([("a", "b"), ("x", "y")], "src string, dst string")
    got = {r["id"]: r["community"] for r in ranking.communities(edges).collect()}
    assert got["a"] == got["b"] != got["x"] == got["y"]


@needs_tables
def test_articulation_points_equal_removal(spark, live_edges):
    def parts(nodes, edges):
        label = {v: v for v in nodes}

        def root(v):
            while label[v] != v:
                v = label[v]
            return v

        for a, b in edges:
            if a in label and b in label:
                label[root(a)] = root(b)
        return len({root(v) for v in nodes})

    edges = live_edges[1][::7]  # sparse enough to have cut vertices
    nodes = {v for e in edges for v in e}
    from graphloom.operators.ranking import articulation_points

    want = {v for v in nodes if parts(nodes - {v}, edges) > parts(nodes, edges)}
    assert want and {r["id"] for r in articulation_points(spark.createDataFrame(edges, "src string, dst string")).collect()} == want
    whole = {v for e in live_edges[1] for v in e}
    assert {r["id"] for r in run(spark, "articulation_points")} == {v for v in whole if parts(whole - {v}, live_edges[1]) > parts(whole, live_edges[1])}


@needs_tables
def test_budget_passes_equal_loops(spark):
    cost = lambda t: 0 if not t else max(1, len(t) // 4)
    groups = {}
    for r in sorted(read(spark, "documents"), key=lambda r: r["doc_id"]):
        groups.setdefault(None if r["source"] == "src1" else r["source"], []).append((r["doc_id"], cost(r["text"])))
    filled, batched = set(), set()
    for g, rows in groups.items():
        left, used, batch = 3000, 0, 0
        for p, c in rows:
            if c <= left:
                left -= c
                filled.add((g, p))
            if used and used + c > 3000:
                batch, used = batch + 1, 0
            used += c
            batched.add((g, p, batch))
    assert {tuple(r) for r in run(spark, "greedy_fill")} == filled and {tuple(r) for r in run(spark, "token_batches")} == batched


@needs_tables
def test_rate_limit_equals_a_loop(spark):
    users = {}
    for r in read(spark, "events"):
        users.setdefault(None if r["user_id"] == 7 else r["user_id"], []).append((r["ts"], r["event_id"]))
    want = {}
    for rows in users.values():
        kept = []
        for ts, event in sorted(rows):
            ok = sum((ts - t).total_seconds() < 3600 for t in kept) < 2
            want[event] = ok
            kept += [ts] * ok
    assert {r["event_id"]: r["admitted"] for r in run(spark, "rate_limit")} == want


@needs_tables
def test_mmr_equals_a_greedy_loop(spark):
    import re

    from graphloom.operators import ranking

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    top = ranking.bm25(docs, "the tion").orderBy("score", ascending=False).limit(1000).collect()
    top = sorted(((r["score"], r["id"]) for r in top), key=lambda x: (-x[0], x[1]))[:50]
    words = {r["doc_id"]: set(re.findall(r"\w+", (r["text"] or "").lower())) for r in docs.collect()}
    best, left, done = top[0][0], list(top), []
    while left:
        near = lambda d: max((len(words[d] & words[o]) / len(words[d] | words[o]) for o in done), default=0.0)
        pick = max(left, key=lambda x: (0.7 * x[0] / best - 0.3 * near(x[1]), x[0] / best, -left.index(x)))
        left.remove(pick)
        done.append(pick[1])
    assert [r["id"] for r in sorted(run(spark, "mmr"), key=lambda r: r["rank"])] == done


@needs_tables
def test_text_scores_equal_plain_patterns(spark):
    import re

    from graphloom.functions import text as X
    from graphloom.operators.firewall import CONTENT_RULES

    texts = {(r["conv_id"], r["turn"]): r["text"] for r in read(spark, "conversations")}
    for r in run(spark, "injection_score"):
        t = texts[r["conv_id"], r["turn"]]
        assert abs(r["score"] - min(1.0, sum(w for _, w, p in X.RULES if re.search(p, t)) + 0.3 * X.entropy(t))) < 1e-5
    for r in run(spark, "content_blocked"):
        t = texts[r["conv_id"], r["turn"]]
        for _, by, p in CONTENT_RULES:
            t = re.sub(p, by, t)
        assert r["text"] == t


@needs_tables
def test_beam_equals_a_loop(spark):
    from graphloom.sources.fixture import graph

    nodes, edges = (x.where("tenant_id = 't0'").collect() for x in graph(spark, SF))
    degree = {n["id"]: 0 for n in nodes}
    for e in edges:
        for v in {e["src"], e["dst"]} & set(degree):
            degree[v] += 1
    live = [e for e in edges if e["tombstoned_day"] is None]
    best = {}
    for e in live:
        best.setdefault(e["src"], []).append((-degree[e["dst"]], e["dst"], e["rel"]))
    calls = {}
    for e in live:
        if e["rel"] == "CALLS":
            calls[e["src"]] = calls.get(e["src"], 0) + 1
    frontier = [min(calls, key=lambda v: (-calls[v], v))]
    seen, want = set(frontier), {}
    for k in (1, 2, 3):
        new = {}
        for v in sorted(frontier):
            for _, u, _ in sorted(best.get(v, []))[:50]:
                if u not in seen:
                    new.setdefault(u, v)
        frontier = sorted(new, key=lambda u: (-degree[u], u))[:50]
        want |= {u: (new[u], degree[u], k) for u in frontier}
        seen |= set(frontier)
    assert {r["id"]: (r["parent"], r["degree"], r["hop"]) for r in run(spark, "beam_expansion")} == want


def test_secret_redaction_returns_every_document(spark, tmp_path):
    from graphloom.plans.catalogue import QUERIES

    pem = "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----"
    keys = ["sk-" + "a" * 20, "AKIA" + "A" * 16, "ghp_" + "a" * 36, "ghs_" + "a" * 36, pem, pem.replace("RSA PRIVATE ", "PUBLIC ")]
    rows = [(k, f"x {t} y") for k, t in enumerate(keys)] + [(90, "plain"), (91, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["text"] for r in QUERIES["secret_redact"](spark, str(tmp_path)).collect()}
    assert got == {k: "x [REDACTED_SECRET] y" for k in range(len(keys))} | {90: "plain", 91: None}


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
def test_graph_analytics_read_all_live_edges(spark):
    from graphloom.operators import patterns
    from graphloom.plans.catalogue import QUERIES
    from graphloom.sources.fixture import graph

    live = patterns.live(graph(spark, SF)[1])
    ids = {r["src"] for r in live.select("src").union(live.select("dst")).distinct().collect()}
    for name in ("louvain", "connected_components"):
        assert {r["id"] for r in QUERIES[name](spark, SF).collect()} == ids
    vectors = QUERIES["fast_rp"](spark, SF).select("id", "pos").collect()
    assert {r["id"] for r in vectors} <= ids and {r["pos"] for r in vectors} == set(range(128))
    walks = QUERIES["node2vec_walks"](spark, SF).collect()
    assert len(walks) == 10 * len(ids) and {len(r["walk"]) for r in walks} == {80}


def test_embedding_hash_rounds_ties_to_even(spark):
    import hashlib
    import struct

    from pyspark.sql import functions as F

    from graphloom.functions.scalars import embedding_hash

    floats = [0.0078125, 0.0234375, -0.0078125, -0.0390625, 0.0, -0.0, -1e-9, 1.5, -123456.789, 8388607.5, 8.9e12, float("nan"), float("inf"), float("-inf"), None]
    shown = lambda x: "%.6f" % struct.unpack("f", struct.pack("f", x))[0]
    rows = [(k, [x]) for k, x in enumerate(floats)] + [(98, floats), (99, [])]
    got = {r["k"]: r["h"] for r in spark.createDataFrame(rows, "k int, v array<float>").select("k", embedding_hash(F.col("v")).alias("h")).collect()}
    assert got == {k: hashlib.sha256("|".join(shown(x) for x in v if x is not None).encode()).hexdigest()[:16] for k, v in rows}
