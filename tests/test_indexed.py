"""Stored indexes, walks, commits and traversals beyond what their SQL shows."""

import collections
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import ingest, projection, ranking, search_index, snapshots, structure, traversal, vector_index, walks
from graphloom.session import table

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


def test_index_gives_the_scores_of_a_scan_and_counts_increments_once(spark, tmp_path):
    r = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    data = [(k, " ".join(r.choices(words, [1 / (n + 1) for n in range(40)], k=r.randint(0, 60)))) for k in range(400)] + [(None, "w1"), (400, None)]
    docs, folder = spark.createDataFrame(data, "doc_id long, text string"), str(tmp_path / "i")
    questions = spark.createDataFrame([(1, "w30 w0 w0"), (2, "w39"), (3, "unknown"), (4, None)], "query_id int, text string")
    assert search_index.search(questions, folder).collect() == []
    search_index.add(docs.where("doc_id < 150"), folder, "a", 4)
    search_index.add(docs, folder, "b", 4)
    search_index.add(docs, folder, "b", 4)  # again, under its name
    for idf in (False, True):
        got = search_index.search(questions, folder, 7, idf, buckets=4).collect()
        for q in (1, 2):
            want = ranking.bm25(docs.where("doc_id is not null"), {1: "w30 w0 w0", 2: "w39"}[q], true_idf=idf).orderBy(F.desc(F.round("score", 9)), "id").limit(7).collect()
            mine = sorted((x["rank"], x["id"], round(x["score"], 9)) for x in got if x["query_id"] == q)
            assert mine == [(n + 1, x["id"], round(x["score"], 9)) for n, x in enumerate(want)]
        assert {x["query_id"] for x in got} == {1, 2}


def test_blocks_hold_their_bounds_and_few_words_read_few_of_them(spark, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("hot "), (F.col("id") % 9 + 1).cast("int")), F.lit("rare"), F.col("id").cast("string")).alias("text"))
    folder = str(tmp_path / "i")
    search_index.add(docs, folder, "a", 8)
    blocks = spark.read.parquet(f"{folder}/postings").where("term = 'hot'").collect()
    assert sum(len(b["ids"]) for b in blocks) == 3000 and all(max(b["tfs"]) == b["most_tf"] and min(b["dls"]) == b["least_dl"] and len(b["ids"]) <= search_index.BLOCK for b in blocks)
    assert search_index.block_share(spark.createDataFrame([("rare17",)], "text string"), folder) < 0.01


def test_an_increment_splits_its_texts_once(spark, tmp_path, monkeypatch):
    split, n = search_index.tokens, spark.sparkContext.accumulator(0)

    def told(text):
        n.add(1)
        return text

    monkeypatch.setattr(search_index, "tokens", lambda c: split(F.udf(told, "string")(c)))
    docs, folder = spark.createDataFrame([(k, f"a b{k % 7} a") for k in range(50)] + [(50, None), (3, "a b3 a")], "doc_id long, text string"), str(tmp_path / "i")
    search_index.add(docs, folder, "1", 4)
    assert n.value == 52
    tfs = {(i, t): f for r in spark.read.parquet(f"{folder}/postings").collect() for i, f in zip(r["ids"], r["tfs"], strict=True) for t in [r["term"]]}
    assert tfs[0, "a"] == 2 and tfs[0, "b0"] == 1 and tfs[3, "a"] == 4 and tfs[3, "b3"] == 2 and len(tfs) == 100


def test_neighbours_by_index(spark, tmp_path):
    r = np.random.default_rng(5)
    middle = r.normal(size=(20, 8))
    x = middle[r.integers(0, 20, 1500)] + 0.3 * r.normal(size=(1500, 8))
    data = [(k, v) for k, v in enumerate(x.tolist())] + [(1500, x[3].tolist()), (1501, [0.0] * 8), (1502, None), (1503, [float("nan")] * 8), (1504, [1.0]), (None, x[4].tolist())]
    v, folder = spark.createDataFrame(data, "vec_id long, embedding array<double>"), str(tmp_path / "v")
    c = vector_index.fit(v, 16)
    assert len(c) == 16
    vector_index.create(spark, folder, c)
    asked = v.where("vec_id % 20 = 0 or vec_id > 1499").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    assert vector_index.search(asked, folder).collect() == []
    vector_index.add(v.where("vec_id < 700"), folder, "a")
    vector_index.add(v.where("vec_id >= 700 or vec_id is null"), folder, "b")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    score = np.round(np.vstack([unit, unit[3]]) @ np.vstack([unit, unit[3]]).T, 9)
    want = {(q, n + 1, int(i)) for q in [*range(0, 1500, 20), 1500] for n, i in enumerate(np.lexsort((np.arange(1501), -score[q]))[:10])}
    exact = {(x["query_id"], x["rank"], x["id"]) for x in vector_index.search(asked, folder, exact=True).collect()}
    assert exact == want
    near = {(x["query_id"], x["id"]) for x in vector_index.search(asked, folder).collect()}
    assert len(near & {(q, i) for q, _, i in want}) >= 0.9 * len(want)


GRAPH = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "a"), ("e", "e"), ("f", "a"), ("b", "a"), (None, "a")]


def test_both_ways_of_walking_equal_a_plain_walk(spark):
    e = spark.createDataFrame(GRAPH, "src string, dst string")
    near = collections.defaultdict(set)
    for a, b in GRAPH[:-1]:
        near[a].add(b)
        near[b].add(a)
    seeds = {(r["id"], r["n"]): r["h"] for r in spark.createDataFrame([(x, n) for x in near for n in range(3)], "id string, n long").withColumn("h", F.xxhash64("id", "n", F.lit(0).cast("long"))).collect()}
    want = {}
    for (start, n), h in seeds.items():
        walk = [start]
        for step in range(1, 7):
            for attempt in range(1000):
                own = sorted(near[walk[-1]])
                b = own[int(walks.hash64(h, step, attempt, 0)) % len(own)]
                w = 2.0 if step == 1 else 0.5 if b == walk[-2] else 1.0 if b in near[walk[-2]] else 2.0
                if int(walks.hash64(h, step, attempt, 1)) % (1 << 30) / (1 << 30) * 2.0 < w:
                    break
            walk.append(b)
        want[start, n] = walk
    for small in (10, 0):
        got = walks.random_walks(e, 7, 3, p=2.0, q=0.5, small=small).collect()
        assert {(r["id"], r["walk_no"]): list(r["walk"]) for r in got} == want


def test_steps_follow_their_weights(spark):
    e = spark.createDataFrame(GRAPH[:6], "src string, dst string")
    near = {k: {b for x in GRAPH[:6] for a, b in (x, x[::-1]) if a == k} for k in "abcde"}
    seen = collections.Counter(x for r in walks.random_walks(e, 40, 400, p=0.5, q=2.0).collect() for x in zip(r["walk"], r["walk"][1:], r["walk"][2:]))
    for last, at in {(a, b) for a, b, _ in seen}:
        weight = {b: 2.0 if b == last else 1.0 if b in near[last] else 0.5 for b in near[at]}
        total = sum(seen[last, at, b] for b in weight)
        for b, w in weight.items():
            share = w / sum(weight.values())
            assert abs(seen[last, at, b] / total - share) < 5 * (share * (1 - share) / total) ** 0.5 + 1e-3


def test_hash_embedding_equals_a_loop(spark):
    data = [("a", 0, ["a", "b", "a"]), ("b", 0, ["b", "a", "c"]), ("a", 1, ["a", "c", "c"])]
    got = {r["id"]: r["embedding"] for r in walks.hash_embedding(spark.createDataFrame(data, "id string, walk_no int, walk array<string>"), 8).collect()}
    for node in "abc":
        x, count = [0.0] * 8, 0
        for _, _, walk in sorted(data, key=lambda r: (r[1], r[0])):
            for place, w in enumerate(walk):
                if w == node:
                    x[int(walks.hash64(place, count)) % 8] += 1
                    count += 1
        assert got[node] == pytest.approx([v / sum(y * y for y in x) ** 0.5 for v in x])


@needs_tables
def test_walk_embedding_covers_every_node(spark):
    from graphloom.plans.indexed import QUERIES

    rows = QUERIES["node2vec_embedding"](spark, SF).collect()
    assert rows and {len(r["embedding"]) for r in rows} == {128} and all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-6 for r in rows)
    assert table(spark, SF, "part").count() <= len(rows)


def test_a_merge_shuffles_its_own_rows_only(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("x"))
    assert snapshots.commit(spark, folder, {"t": (rows, ["id"])}, buckets=4) == 1
    assert snapshots.commit(spark, folder, {"t": (rows, ["id"])}, buckets=4) == 1  # nothing new
    some = rows.where("id < 20").withColumn("x", F.when(F.col("id") < 10, F.col("x")).otherwise(99)).withColumn("_gone", F.col("id") == 19)
    assert snapshots.commit(spark, folder, {"t": (some, ["id"])}, buckets=4) == 2
    got = {r["id"]: (r["x"], r["_version"]) for r in snapshots.read(spark, folder, "t", details=True).collect()}
    assert got == {k: (99, 2) if 10 <= k < 19 else (k % 7, 1) for k in range(1000) if k != 19}
    assert snapshots.read(spark, folder, "t", version=1).count() == 1000
    assert sorted((r["id"], r["_gone"]) for r in snapshots.changes(spark, folder, "t", 1).collect()) == [(k, k == 19) for k in range(10, 20)]
    about = snapshots.entry(spark, folder)["tables"]["t"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = snapshots.present(spark, about, some, {"id": "id"})._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
        merge = snapshots.read(spark, folder, "t")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange" not in merge
    many = rows.withColumn("x", F.col("x") + 1)
    assert snapshots.commit(spark, folder, {"t": (many, ["id"])}, buckets=4) == 3 and snapshots.entry(spark, folder)["tables"]["t"]["delta"] is None
    assert snapshots.read(spark, folder, "t").agg(F.sum("x")).first()[0] == sum(k % 7 + 1 for k in range(1000))


def test_a_crash_at_any_step_leaves_the_last_version(spark, tmp_path, monkeypatch):
    folder, rows = str(tmp_path / "t"), spark.range(10).withColumn("x", F.lit(1))
    events = spark.createDataFrame([("e",)], "event string")
    snapshots.commit(spark, folder, {"t": (rows, ["id"])}, events)
    for step in ("_store", "_publish"):
        with monkeypatch.context() as m:
            m.setattr(snapshots, step, lambda *a: (_ for _ in ()).throw(OSError("crash")))
            with pytest.raises(OSError):
                snapshots.commit(spark, folder, {"t": (rows.withColumn("x", F.lit(2)), ["id"])}, events)
        assert snapshots.read(spark, folder, "t").where("x = 1").count() == 10 and snapshots.outbox(spark, folder).count() == 1
    last = snapshots.entry(spark, folder)
    snapshots._publish(spark, folder, {**last, "version": 2})
    with pytest.raises(Exception, match="(?i)exist"):
        snapshots._publish(spark, folder, {**last, "version": 2})  # the other writer of version 2


def test_a_stream_that_dies_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    from graphloom.streaming import loop

    source, folder = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for k in range(5):
        (source / f"{k}.json").write_text("".join(f'{{"id": {10 * k + n}, "x": {n}}}\n' for n in range(10)))
        os.utime(source / f"{k}.json", (k, k))
    tables = lambda batch: {"t": (batch, ["id"])}
    events = lambda batch: batch.select(F.col("id").alias("event"))
    drain = lambda: loop.drain(loop.intake(spark, str(source), "id long, x long", files=1), folder, "app", tables, events, 300, 4)
    real, calls = snapshots._publish, []

    def dies(spark, folder, new):
        calls.append(new["version"])
        if len(calls) == 2:
            raise OSError("before the commit")
        real(spark, folder, new)
        if len(calls) == 4:
            raise OSError("after the commit, before the stream heard of it")

    monkeypatch.setattr(snapshots, "_publish", dies)
    for _ in range(2):
        with pytest.raises(Exception, match="the commit"):
            drain()
    assert drain() and drain()
    assert sorted(r["id"] for r in snapshots.read(spark, folder, "t").collect()) == list(range(50))
    assert sorted(r["event"] for r in snapshots.outbox(spark, folder).collect()) == list(range(50))
    assert calls == [1, 2, 2, 3, 4, 5]  # one file each


MESSAGES = [
    ("a", 0, "write", "1", 1), ("a", 2, "write", "2", 2), ("a", 3, "write", "0", 0), ("a", 30, "ack", "2", 0), ("b", 1, "write", "3", 5), ("b", 45, "write", "4", 5), ("b", 46, "ack", "3", 0), ("c", 7, "write", "5", None),
    ("c", 12, "ack", "5", 0), ("d", 9, "ack", "6", 0), ("d", 10, "write", "6", 1), (None, 11, "write", "7", 1), ("e", 13, "write", "8", 1), ("e", 13, "write", "9", 2), ("e", 14, "other", "9", 2), ("f", 200, "write", "10", 1), ("g", 201, "write", "11", 1),
]


def test_outbox_timers_survive_a_restart_and_equal_the_plan(spark, tmp_path):
    from graphloom.streaming import emissions

    schema = "key string, s long, kind string, event_id string, version long"
    whole = spark.createDataFrame(MESSAGES, schema).withColumn("at", F.timestamp_seconds("s"))
    want = sorted((r["key"], r["event_id"], r["attempt"], r["status"], r["at"]) for r in emissions.emitted(whole, F.timestamp_seconds(F.lit(201))).collect())
    assert [x[:4] for x in want if x[0] == "a"] == [("a", "2", 0, "emit")] and [x[2:4] for x in want if x[0] == "c"] == [(0, "emit")] * 0
    assert [x[1:4] for x in want if x[0] == "b"] == [("3", 0, "emit"), ("3", 1, "emit")] + [("4", k, "emit") for k in range(4)] + [("4", 4, "dead")]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    try:
        m = sorted(MESSAGES, key=lambda r: r[1])
        for k, part in enumerate((m[:5], m[5:12], m[12:16], m[16:])):
            rows = spark.createDataFrame(part, schema).withColumn("at", F.timestamp_seconds("s")).toJSON().collect()
            (source / f"{k}.json").write_text("\n".join(rows))
            stream = spark.readStream.schema(schema + ", at timestamp").json(str(source))
            q = emissions.emit(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()  # a new start each time
            assert q.awaitTermination(120)
        got = sorted((r["key"], r["event_id"], r["attempt"], r["status"], r["at"]) for r in spark.read.parquet(out).collect())
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == want


def test_forward_push_is_within_its_tolerance(spark):
    r = random.Random(1)
    edges = [(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(120)] + [("hub", f"n{k}") for k in range(40)] + [("x", "y")]
    e = spark.createDataFrame([(a, "R", b, None) for a, b in edges], "src string, rel string, dst string, tombstoned_day long")
    seeds = {1: ["n1"], 2: ["hub", "n3", "n3", "nowhere"], 3: ["x"]}
    ids = sorted({v for x in edges for v in x})
    m = np.zeros((len(ids), len(ids)))
    for a, b in edges:
        m[ids.index(a), ids.index(b)] += 1
        m[ids.index(b), ids.index(a)] += 1
    asked = spark.createDataFrame([(q, s) for q, own in seeds.items() for s in own] + [(4, "nowhere")], "query_id int, id string")
    for tolerance, part in ((1e-3, 10_000), (1e-7, 7)):
        traversal.PART = part
        try:
            got = {(x["query_id"], x["id"]): x["score"] for x in traversal.forward_push(asked, e, tolerance).collect()}
        finally:
            traversal.PART = 10_000
        for q, own in seeds.items():
            start = np.array([i in own for i in ids], float)
            p = start = start / start.sum()
            for _ in range(300):
                p = 0.15 * start + 0.85 * (p / m.sum(axis=1)) @ m
            for k, i in enumerate(ids):
                assert -1e-9 <= p[k] - got.get((q, i), 0.0) <= tolerance * m.sum(axis=1)[k] + 1e-9
    assert {q for q, _ in got} == {1, 2, 3} and {i for q, i in got if q == 3} == {"x", "y"}
    near = traversal.ranked_filter(e.select("src", "rel", "dst"), traversal.forward_push(asked, e, 1e-4), 1).where("query_id = 3").collect()
    assert [(x["src"], x["dst"]) for x in near] == [("x", "y")]


def test_a_round_of_pushes_writes_only_what_it_touched(spark, monkeypatch):
    pairs, written, own = [(f"n{k}", f"n{k + 1}") for k in range(6)] + [("n3", f"leaf{k}") for k in range(9)], [], traversal.stored
    near = collections.defaultdict(list)
    for a, b in pairs:
        near[a].append(b)
        near[b].append(a)
    r, p, want = {"n0": 1.0}, collections.Counter(), [1]
    while active := {v: x for v, x in r.items() if x > 0.05 * len(near[v])}:
        gains = collections.Counter()
        for v, x in active.items():
            p[v], r[v] = p[v] + 0.15 * x, 0.0
            for b in near[v]:
                gains[b] += 0.85 * x / len(near[v])
        want.append(len(gains))
        r |= {b: r.get(b, 0.0) + g for b, g in gains.items()}

    def counted(df, path=None, mode="errorifexists"):
        out = own(df, path, mode)
        if "r" in df.columns:
            written.append(out[0].count())
        return out

    monkeypatch.setattr(traversal, "stored", counted)
    monkeypatch.setattr(traversal, "FEW", 0)
    e = spark.createDataFrame([(a, b, None) for a, b in pairs], "src string, dst string, tombstoned_day long")
    got = {x["id"]: x["score"] for x in traversal.forward_push(spark.createDataFrame([(1, "n0")], "query_id int, id string"), e, 0.05).collect()}
    assert got == pytest.approx(dict(p)) and written == want and sum(written) < 0.6 * len(written) * len(r)


def test_claimed_paths_meet_in_the_middle(spark):
    e = spark.createDataFrame([(f"a{k}", f"a{k + 1}", None) for k in range(8)] + [("a3", "a0", None), ("a0", "a8", 5), ("b", "b", None)], "src string, dst string, tombstoned_day long")
    pairs = [(f"a{i}", f"a{j}") for i in range(9) for j in range(9)] + [("b", "b"), ("b", "a0"), (None, "a1"), ("a1", "zz")]
    got = {(r["src"], r["dst"]): r["hops"] for r in traversal.claimed_paths(spark.createDataFrame(pairs + pairs[:9], "src string, dst string"), e).collect()}
    for i in range(9):
        for j in range(9):
            n = j - i if j >= i else 3 - i + 1 + j if i <= 3 else 99
            assert got[f"a{i}", f"a{j}"] == (n if n <= 5 else None), (i, j)
    assert got["b", "b"] == 0 and got["b", "a0"] is None and got["a1", "zz"] is None and (None, "a1") not in got


def test_the_widest_hop_of_claimed_paths_is_not_written(spark, monkeypatch):
    """A node calls 9, these 9 each, and so on; each fourth level is asked for."""
    written, own = [], traversal.stored

    def counted(df, path=None, mode="errorifexists"):
        out = own(df, path, mode)
        written.append((tuple(df.columns), out[0].count()))
        return out

    monkeypatch.setattr(traversal, "stored", counted)
    e = spark.createDataFrame([(f"x{k}", f"x{9 * k + j}", None) for k in range(1, 100) for j in range(9)] + [(f"x{k}", "hub", None) for k in range(1, 900)], "src string, dst string, tombstoned_day long")
    got = {(r["src"], r["dst"]): r["hops"] for r in traversal.claimed_paths(spark.createDataFrame([("x1", "x810"), ("x2", "x170"), ("x2", "x890")], "src string, dst string"), e, 3).collect()}
    assert got == {("x1", "x810"): 3, ("x2", "x170"): 2, ("x2", "x890"): None}
    assert [n for c, n in written if c == ("seed", "id")] == [18, 3] and next(n for c, n in written if set(c) == {"src", "dst"} and n > 3) <= 900


def test_a_forest_writes_each_level_once(spark, monkeypatch):
    written, own = [], structure.cut_lineage

    def counted(df):
        out = own(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(structure, "cut_lineage", counted)
    e = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(8)] + [("n2", "n0")], "src string, dst string")
    tree, depth = structure.spanning_forest(structure.simple(e))
    assert {(r["id"], r["parent"], r["level"]) for r in tree.collect()} == {("n0", None, 0), ("n1", "n0", 1), ("n2", "n0", 1)} | {(f"n{k}", f"n{k - 1}", k - 1) for k in range(3, 9)}
    assert depth == 7 and sum(written) == 2 * 9


def test_short_layers_are_summed_without_a_sort(spark):
    e = spark.createDataFrame([("a", "b"), ("c", "b"), ("a", "b")], "src string, dst string")
    both = projection._both(e)
    v = spark.createDataFrame([("a", [3.0, -1.0]), ("c", [6.0, 1.0]), ("b", [0.5, 0.0])], "id string, v array<double>")
    plan = projection._means(both, v, 2)
    got = {r["id"]: r["v"] for r in plan.collect()}
    assert got == {"b": [4.0, pytest.approx(-1 / 3)], "a": [0.5, 0.0], "c": [0.5, 0.0]}
    assert "MapInArrow" not in plan._jdf.queryExecution().toString()


def test_updated_layers_equal_a_full_run(spark):
    r = random.Random(2)
    pairs = [(f"n{k}", f"n{k + 1}") for k in range(300)] + [(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(60)] + [("hub", f"n{k}") for k in range(0, 300, 3)]
    gone, new = [*pairs[5:7], ("n299", "n300")], [("n5", "n9"), ("new", "n8"), ("n7", None)]
    frame = lambda x: spark.createDataFrame(x, "src string, dst string").repartition(3)
    before = projection.layers(frame(pairs), 8)
    now = frame([p for p in pairs if p not in gone] + new)
    after, near = projection.updated(before, now, frame(gone + new), 8)
    want = {r["id"]: r["embedding"] for r in projection.embeddings(projection.layers(now, 8), dims=8).collect()}
    got = {r["id"]: r["embedding"] for r in projection.embeddings(after, dims=8).collect()}
    assert set(got) == set(want) and "new" in got and "n300" not in got and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert near.count() < 250
    flat = {r["id"]: r["embedding"] for r in projection.embeddings(projection.layers(frame([("a", "b"), ("b", "c")]), 8), dims=8).collect()}
    h = {r["id"]: np.array(r["v"]) for r in spark.createDataFrame([("a",), ("b",), ("c",)], "id string").withColumn("v", projection.signs(F.col("id"), 8)).collect()}
    ends = (h["a"] + h["c"]) / 2  # layer 1 of b; layer 1 of a and c is h(b), and so on
    assert flat["b"] == pytest.approx(list(ends + h["b"] + 0.8 * ends)) and flat["a"] == pytest.approx(list(h["b"] + ends + 0.8 * h["b"]))
    with pytest.raises(ValueError, match="limit"):
        projection.guard(11, most_nodes=10)
    with pytest.raises(ValueError, match="MB"):
        projection.guard(10, most_mb=0.001)


def test_a_second_run_reads_only_what_is_left(spark, tmp_path):
    folder, seen = str(tmp_path / "m"), tmp_path / "seen"
    seen.mkdir()

    def extract(path, content):
        (seen / f"{path}-{len(list(seen.iterdir()))}").write_text("")
        if content == "bad":
            raise ValueError("bad file")
        return [content or "none"]

    files = [(f"f{k:02}", "1", "bad" if k == 7 else None if k == 3 else f"c{k}") for k in range(20)]
    frame = lambda x: spark.createDataFrame([*x, (None, "1", "x")], "path string, version string, content string")
    assert ingest.run(frame(files), folder, extract, 5) == {"done_chunks": 3, "done_files": 15, "failed_chunks": 1, "failed_files": 5}
    told = {r["path"]: (r["status"], r["error"]) for r in ingest.manifest(spark, folder).collect()}
    assert told["f07"] == ("failed", "ValueError: bad file") and told["f06"] == ("failed", None) and told["f04"] == ("done", None)
    for f in seen.iterdir():
        f.unlink()
    files = [(p, "2" if p == "f00" else v, "fixed" if c == "bad" else c) for p, v, c in files]
    assert ingest.run(frame(files), folder, extract, 5) == {"done_chunks": 2, "done_files": 6, "failed_chunks": 0, "failed_files": 0}
    assert {f.name.split("-")[0] for f in seen.iterdir()} == {"f00", "f05", "f06", "f07", "f08", "f09"}
    got = {r["path"]: (r["version"], r["run"], r["entities"]) for r in ingest.results(spark, folder).collect()}
    assert got["f00"] == ("2", 2, ["c0"]) and got["f07"] == ("1", 2, ["fixed"]) and got["f03"] == ("1", 1, ["none"]) and len(got) == 20
    assert ingest.run(frame(files), folder, extract, 5)["done_files"] == 0


def test_a_hub_over_many_blocks_gives_the_walks_of_one_task(spark, monkeypatch):
    """Walkers were rows, joined twice a round; now they are packed, and a hub's edges may lie in several blocks."""
    monkeypatch.setattr(walks, "BLOCK", 3)
    edges = spark.createDataFrame([("hub", f"n{a:02}") for a in range(40)] + [("n01", "n02"), ("n02", "n03"), ("n03", "n01")], "src string, dst string")
    rows = lambda w: {(r["id"], r["walk_no"]): r["walk"] for r in w.collect()}
    assert rows(walks.random_walks(edges, 5, 2, small=0)) == rows(walks.random_walks(edges, 5, 2))


def test_steps_that_meet_by_node_give_the_embedding_of_the_walks(spark, monkeypatch):
    """The walks of a large graph were put together first, and all their places sorted as rows."""
    edges = spark.createDataFrame([(f"n{a:02}", f"n{(a * 7 + 3) % 30:02}") for a in range(30)] + [("n00", f"n{a:02}") for a in range(2, 30)], "src string, dst string")
    want = {r["id"]: r["embedding"] for r in walks.hash_embedding(walks.random_walks(edges, 6, 3), 16).collect()}
    monkeypatch.setattr(walks, "PLACES", 10)  # so the hub's places are dealt over groups
    monkeypatch.setattr(walks, "hash_embedding", lambda *a: pytest.fail("walks as rows"))
    got = {r["id"]: r["embedding"] for r in walks.node_embedding(edges, 6, 3, small=0, dims=16).collect()}
    assert got == want


def test_a_search_in_shares_of_questions_gives_the_same_rows(spark, tmp_path, monkeypatch):
    """The scores of all questions were shuffled at once."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i * k % 11}" for k in range(1, 6))) for i in range(60)], "doc_id long, text string")
    asked = spark.createDataFrame([(q, f"w{q} w{q + 1} w{q * 3 % 11}") for q in range(9)], "query_id long, text string")
    search_index.add(docs, str(tmp_path / "i"), "1", 4)
    found = lambda: sorted(tuple(r) for r in search_index.search(asked, str(tmp_path / "i"), 5, True, buckets=4).withColumn("score", F.round("score", 9)).collect())
    want = found()
    monkeypatch.setattr(search_index, "PAIRS", 40)
    assert found() == want and len(want) > 9
