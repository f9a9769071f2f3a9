import base64

import pandas as pd
from pyspark.sql import functions as F

from graphloom.sources import files
from graphloom.streaming import streams


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_scan_and_grep(spark, tmp_path):
    for name, data in [("svc/main.py", b"import httpx\nhttpx.get('http://b/x')\n"), ("svc/bad.py", b"\xff\xfe"), ("node_modules/a.py", b"x"), ("svc/a.txt", b"x"), ("svc/k.yaml", b"kind: Deployment\nmetadata: {name: pay}\n---\n: bad [")]:
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    got = files.scan(spark, str(tmp_path))
    assert rows(got.select("path")) == [("svc/k.yaml",), ("svc/main.py",)]
    assert rows(files.grep(got, "httpx", "*.py").select("path", "line_no")) == [("svc/main.py", 1), ("svc/main.py", 2)]


def test_manifests(spark):
    good = "kind: Deployment\nmetadata: {name: auth, namespace: production}\nspec: {replicas: 3}\n---\nkind: Deployment\nmetadata: {name: b}\n---\nkind: KafkaTopic\nmetadata: {name: raw}\nspec: {partitions: 6, config: {retention.ms: '604800000'}}\n---\nkind: Service\nmetadata: {name: c}\n"
    f = spark.createDataFrame([("a.yaml", good), ("b.yml", "{bad"), ("c.py", good)], "path string, content string")
    assert rows(files.manifests(f).select("kind", "id", "namespace", "amount", F.coalesce("retention_ms", F.lit(0)))) == [("deployment", "auth", "production", 3, 0), ("deployment", "b", "default", 1, 0), ("topic", "raw", "default", 6, 604800000)]


def test_facts(spark):
    py = "from fastapi import FastAPI\nimport requests\nfrom kafka import KafkaProducer\napp = FastAPI()\nrequests.post(f'http://x/{y}')\np.send('t1')\n"
    go = 'package main\nimport "github.com/gin-gonic/gin"\nfunc main() { r := gin.Default(); http.Get("http://b/c") }\n'
    f = files.source_facts(spark.createDataFrame([("s/a/main.py", py), ("s/b/main.go", go), ("s/c/x.py", "def (")], "path string, content string"))
    assert rows(files.fact_edges(f)) == [("::s::a", "CALLS", "http://x/{...}"), ("::s::a", "PRODUCES", "t1"), ("::s::b", "CALLS", "http://b/c")]
    assert rows(files.services(f)) == [("::s::a", "python", "fastapi", False), ("::s::b", "go", "gin", False)]


def test_decoding(spark):
    b = lambda x: base64.b64encode(x).decode()
    r = spark.createDataFrame([(0, "a", b(b"hello")), (1, "b", "%%%"), (2, "c", b(b"\xff")), (3, "d", b(b"123456"))], "pos int, path string, content string")
    assert [x["error"] for x in files.decode_request(r, 10).orderBy("pos").collect()] == [None, "base64", "utf8", "too large"]
    m = spark.createDataFrame([(None, b(b"x"), {"tenant-id": "t"}), ("k", b(b"y"), {})], "key string, value string, headers map<string,string>")
    assert rows(files.decode_messages(m).select("path", F.coalesce("error", F.lit("")))) == [("k", "no tenant"), ("unknown", "")]


def test_admission():
    assert streams.admit([0, 1, 2, 61], [1, 1, 1, 1], 2, 60) == [True, True, False, True]


def stream(spark, tmp_path, pdf, name):
    src = str(tmp_path / name)
    df = spark.createDataFrame(pdf)
    df.write.parquet(src)
    return spark.readStream.schema(df.schema).parquet(src)


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_streams_match_their_batch_twins(spark, tmp_path):
    pdf = pd.DataFrame({"k": ["a", "a", "b"], "version": [2, 1, 5], "ts": pd.to_datetime(["2024-01-01", "2024-01-01 00:00:01", "2024-01-01"], format="ISO8601")})
    s = stream(spark, tmp_path, pdf, "in")
    assert run(streams.dedup(s, ["k"]), "t_dedup").count() == 2
    assert rows(run(streams.version_fence_stream(s, "k"), "t_fence").select("k", "version")) == [("a", 2), ("b", 5)]
    assert rows(streams.version_fence(spark.createDataFrame(pdf), ["k"]).select("k", "version")) == [("a", 2), ("b", 5)]
    assert run(streams.rate_limit(s, "k", 1, 60), "t_rate").where("admitted").count() == 2


def test_dead_letters(spark):
    df = spark.createDataFrame([("a", None), ("b", "bad")], "x string, error string")
    good, dead, tries = [], [], []
    streams.with_dead_letters(df, lambda b, _: good.extend(b.collect()), lambda b, _: dead.extend(b.collect()))(df, 0)
    assert len(good) == 1 and len(dead) == 1

    def fail(b, e):
        tries.append(1)
        raise OSError("down")

    dead.clear()
    streams.with_dead_letters(df, fail, lambda b, _: dead.extend(b.collect()))(df, 1)
    assert len(tries) == 4 and len(dead) == 2


def test_keys_lag_dispatch(spark):
    m = spark.createDataFrame([("t", "k", "q", 0, 1), ("t", "", "q", 0, 2)], "tenant_id string, key string, topic string, partition int, offset long")
    assert rows(streams.message_key(m).select("dedup_key")) == [("t:k",), ("t:q:0:2",)]
    assert rows(streams.consumer_lag(m, spark.createDataFrame([("q", 0, 5), ("z", 0, 0)], "topic string, partition int, high_water long"))) == [("q", 0, 2), ("z", 0, 0)]
    d = spark.createDataFrame([("node_delete", ["a"]), ("edge_upsert", ["b"]), ("odd", ["c"]), ("node_upsert", [])], "mutation_type string, entity_ids array<string>")
    assert rows(streams.dispatch(d).select("action")) == [("delete",), ("upsert",)]
