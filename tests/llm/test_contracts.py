"""The registered queries against plain Python or their SQL, whole tables of nothing, and texts that would hang a backtracking scan."""

import base64
import hashlib
import itertools
import math
import os
import re
import time

import numpy as np
import pytest

import corpus_pipeline
from graphloom.llm import bpe, decontam, langid, pii, queries, secrets, toxicity, urls
from graphloom.session import table

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
EMAIL, IP, CARD, PHONE = (re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def sha(s) -> str:
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}


def result(spark, name):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, SF).collect()}


@needs_tables
@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.execute(queries.ORACLE_SQL[name])
    cols = [x[0] for x in want.description]
    got = queries.QUERIES[name](spark, SF).select(cols).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


@needs_tables
def test_op1_equals_the_library(spark, texts):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as p

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for k, r in result(spark, "op1_byte_bpe").items():
        ids = enc.encode_ordinary(texts[k])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(texts[k]))


@needs_tables
def test_op2_base_equals_plain_patterns(spark, texts):
    d = lambda s: re.sub("[^0-9]", "", s)
    for k, r in result(spark, "op2_pii").items():
        t = texts[k]
        own = {
            "email": [m.span() for m in EMAIL.finditer(t)],
            "ip": [m.span() for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))],
            "card": [m.span() for m in CARD.finditer(t) if 16 <= len(d(m[0])) <= 19 and pii.luhn(d(m[0]))],
            "phone": [m.span() for m in PHONE.finditer(t) if 8 <= len(d(m[0])) <= 15],
        }
        base = [f"{kind}:{a}:{b}" for kind, spans in own.items() for a, b in spans]
        assert [r[f"n_{kind}"] for kind in own] == [len(x) for x in own.values()] and r["base_sha256"] == sha(",".join(base))
        assert set(base) <= set(r["spans"].split(","))


@needs_tables
def test_op6_base_equals_plain_patterns(spark, texts):
    for k, r in result(spark, "op6_secret_scans").items():
        t = texts[k]
        own = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
        own += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        own += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        base = [f"{('assign', 'access', 'hex')[kind]}:{a}:{b}" for a, kind, b in sorted(own)]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[1] == n for x in own) for n in range(3)] and r["base_sha256"] == sha(",".join(base))


@needs_tables
def test_op7_holds_out_and_predicts_by_its_score(spark, texts):
    import zlib

    got = result(spark, "op7_toxicity")
    assert set(got) == set(texts)
    for k, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def plain_rule(url):
    host = path = ""
    if "://" in (url or ""):
        host, path = re.fullmatch(r"([^/?#]*)([^?#]*).*", url.split("://", 1)[1], re.S).groups()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


@needs_tables
def test_op8_rules_equal_a_plain_search(spark):
    raw = {r["page_id"]: r["url"] for r in table(spark, SF, "pages").collect()}
    got = queries.QUERIES["op8_url_filters"](spark, SF).collect()
    assert len(got) == len(raw) and {r["verdict"] for r in got} <= {"allow", "block"}
    for r in got:
        host, path, rule, verdict = plain_rule(raw[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (verdict is None or r["verdict"] == verdict)


def test_url_model_learns_from_rules_and_is_held_out(spark):
    rows = [(k, f"http://{'shop' if k % 2 else 'wiki'}.example.{'net/es' if k % 2 else 'com/de'}/{k}", "<p>shop wiki</p>" * 20, "x", 0.5) for k in range(200)]
    rows += [(300, "http://shop.example.org/es/1", "", "x", 0.5), (300, "http://shop.example.org/es/1", "", "x", 0.5), (301, "http://wiki.example.org/de/1", None, "x", 0.5), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string, score double")
    judged = urls.judge(df)
    got = {}
    for r in judged.collect():
        got.setdefault(r["page_id"], []).append((r["rule"], r["verdict"]))
    assert got[300] == [(None, "block")] * 2 and got[301] == [(None, "allow")] and got[1] == [("net/es/", "block")] and len(got[None]) == 1
    n, right, blocked = urls.accuracy(judged).first()
    assert n == right > blocked > 0


def test_bayes_equals_the_formula():
    a, b = np.zeros(urls.SLOTS), np.zeros(urls.SLOTS)
    a[urls.slot("foo")], b[urls.slot("bar")], a[urls.slot("both")], b[urls.slot("both")] = 3000, 10, 40, 30
    m = urls.Bayes(a, b, urls.rule_words())
    share = urls.SEED_SHARE * 3080 / (len(urls.BLOCK_WORDS) + len(urls.ALLOW_WORDS))
    n_block, n_allow = 3040 + share * len(urls.BLOCK_WORDS), 40 + share * len(urls.ALLOW_WORDS)
    used = len({urls.slot(w) for w in [*urls.BLOCK_WORDS, *urls.ALLOW_WORDS, "foo", "bar", "both"]})
    size = 0.5 * used
    foo = math.log(3000.5 / (n_block + size)) - math.log(0.5 / (n_allow + size))
    assert share > 1 and math.isclose(m.odds(["foo"]), foo) and math.isclose(m.odds(["foo", "net", "en", "foo"]), 2 * foo)
    rate = math.log(40.5 / (n_block + size)) - math.log(30.5 / (n_allow + size))
    assert (m.odds(["both"]) == 0) == (abs(rate) < 3 * math.sqrt(1 / 40.5 + 1 / 30.5))
    assert m.odds(["neverseenword"]) == 0 and math.isclose(m.start, math.log(0.25))
    assert {"com", "net", "org", "example", "www", "en", "es", "fr"} <= set(urls.rule_words()) and m.odds(["com", "net", "de", "example"]) == 0


def test_splitting_equals_exhaustive_search():
    known = {"the": 9, "then": 5, "here": 7, "no": 4, "hero": 3, "a": 8, "nowhere": 3, "where": 6}
    splitter = urls.Splitter(5000, [])
    for s in ("thenhere", "nowhere", "theaxhero", "xxthe", "a"):
        ways = ([s[i:j] for i, j in itertools.pairwise((0, *cut, len(s)))] for n in range(len(s)) for cut in itertools.combinations(range(1, len(s)), n))
        best = min(sum(splitter.cost(w, known) for w in way) for way in ways)
        own = splitter.split(s, known)
        assert "".join(own) == s and math.isclose(sum(splitter.cost(w, known) for w in own), best)


def test_decoding_equals_exhaustive_reading():
    r = np.random.default_rng(0)
    model = toxicity.char_model(r.integers(0, 50, toxicity.SYMBOLS**3))

    def cost(way):
        s, p, q = 0.0, 0, 0
        for text, price in way:
            s -= price
            for c in text:
                n = int(toxicity._SYMBOL[ord(c)])
                s, p, q = s + float(model[p, q, n]), q, n
        return s + float(model[p, q, 0])

    for token in ("l0s3r", "1d10t", "aabb", "$t!!p", "h*t", "4", "b00k5"):
        ways = {"".join(t for t, _ in way): 0 for way in itertools.product(*toxicity.options(token))}
        for way in itertools.product(*toxicity.options(token)):
            read = "".join(t for t, _ in way)
            ways[read] = max(ways[read] or -1e9, cost(way))
        assert ways[toxicity.decode(token, model)] >= max(ways.values()) - 1e-9


def test_automaton_has_no_more_nodes_than_window_bytes(spark):
    item = " ".join(f"word{k}" for k in range(400))
    bench = spark.createDataFrame([(k, item.replace("word", f"w{k}x")) for k in range(10)] + [(90 + k, "same words") for k in range(40)], "item_id long, text string")
    chunks = list(decontam.window_chunks(bench, "item_id", "text", 10, 20_000))
    assert len(chunks) > 3
    for chunk in chunks:
        shared = type("B", (), {"value": list(chunk.items())})
        used = sum(map(len, chunk)) + decontam.ITEM_BYTES * sum(len(v) - 1 for v in chunk.values())
        assert used <= 20_000 and decontam._automaton(str(id(chunk)), shared).get_stats()["nodes_count"] <= used + 1
    both = {(w, i) for c in chunks for w, own in c.items() for i in own}
    assert both == {(w, str(r["item_id"])) for r in bench.collect() for w in decontam.item_windows(r["text"])}


def test_stored_ledger_scans_only_what_is_new(spark, tmp_path):
    path = str(tmp_path / "ledger")
    first = spark.createDataFrame([(1, "deadbeefdeadbeef"), (2, "deadbeefdeadbeef"), (3, None)], "doc_id long, text string")
    again = first.union(spark.createDataFrame([(4, "0123456789abcdef"), (5, "")], first.schema))
    assert secrets.stored(spark, path) is None
    assert [secrets.increment(spark, path, d).count() for d in (first, again, again)] == [2, 1, 0]
    assert secrets.increment(spark, path, again, "next").count() == 3 and secrets.stored(spark, path).count() == 3
    got = {r["doc_id"]: [x["kind"] for x in r["base"]] for r in secrets.findings_by_path(again, secrets.stored(spark, path)).collect()}
    assert got == {1: ["hex"], 2: ["hex"], 3: [], 4: ["hex"], 5: []}
    assert secrets.findings_by_path(again, secrets.stored(spark, path).limit(0)).where("base is null").count() == 5


def test_mixtures_of_languages_are_foreign(spark):
    en, fr = "the house and the garden of this town with people ", "la maison et le jardin de cette ville avec les gens "
    langs, p = langid.fit(spark.createDataFrame([("en", en * 20), ("fr", fr * 20)], "lang string, text string"))
    asked = spark.createDataFrame([(1, en * 9), (2, en * 5 + fr * 4), (3, None), (4, "12")], "doc_id long, text string")
    got = {r["doc_id"]: r["foreign"] for r in langid.predict(asked, langs, p).collect()}
    assert got[1] < 0.1 and got[2] > 1 / 3 and got[3] == got[4] == 0


@needs_tables
def test_pii_trees_learn_disguised_spans_of_the_corpus(spark):
    own = pii.sampled_windows(table(spark, "/root/testdata/sf0.01", "documents"))
    told, asked = [w for k, w in enumerate(own) if k % 3], own[::3]
    found = pii.quality(asked, *pii.trained(0.995, tuple(told)))
    assert found["planted"] > 10 and found["recall"] >= 0.7 and found["precision"] >= 0.9
    assert pii.sampled_windows(table(spark, SF, "documents").limit(0)) == []


@needs_tables
def test_empty_tables_give_empty_results(spark, tmp_path):
    for t in TABLES:
        table(spark, SF, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, f in (queries.QUERIES | {"pipeline": corpus_pipeline.run}).items():
        assert f(spark, str(tmp_path)).count() == 0, name


HARD = ["x", "<", "<script ", "eyJ-", "a b c ", "1 ", "1.", "a1", "aabb", "a@", "token=", "<!--", "-----BEGIN PRIVATE KEY-----", "a at ", "é"]


@pytest.mark.parametrize("unit", HARD)
def test_long_texts_take_linear_time(unit):
    """A quarter of a megabyte of one pattern; a quadratic pass would take minutes."""
    text = (unit * 250_000)[:250_000]
    model, trees = toxicity.char_model(np.ones(toxicity.SYMBOLS**3, np.int64)), pii.trained()
    size = len(langid.pieces(langid.default_path())[0]) + 1
    passes = {
        "op1": lambda: bpe.encode_texts([text], bpe.default_path()),
        "op2": lambda: pii.all_spans(text, *trees),
        "op4": lambda: langid.Scorer(np.full((size, 2), 1e-4), langid.default_path()).judge([langid.words_of(text)]),
        "op5": lambda: decontam.word_list(text),
        "op6": lambda: (secrets.base_spans(text), secrets.added_spans(text)),
        "op7": lambda: toxicity.restore(text, model),
        "op8": lambda: urls.LETTERS.findall(urls.TAG.sub(" ", text).lower()),
    }
    for name, f in passes.items():
        began = time.perf_counter()
        f()
        assert time.perf_counter() - began < 20, name


@needs_tables
def test_pipeline_equals_plain_steps(spark, texts):
    """Documents that stay: no other has a window of the benchmark, and of two that are near copies one is left."""
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    bad = {w for t in items for w in decontam.item_windows(t)}
    dirty = {k for k, t in texts.items() if any(w in b" " + b" ".join(decontam.word_list(t)) + b" " for w in bad)}
    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    near = lambda a, b: sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    assert not set(out) & dirty and not any(near(a, b) for a, b in itertools.combinations(sorted(out), 2))
    langs, p = langid.fit(langid.training_rows(table(spark, SF, "documents")))
    judged = {r["doc_id"]: r for r in langid.predict(table(spark, SF, "documents"), langs, p).collect()}
    spoken = {k for k, r in judged.items() if r["lang_pred"] != "und" and r["foreign"] < corpus_pipeline.MIXED}
    group = {k: k for k in spoken}
    for a, b in itertools.combinations(sorted(spoken), 2):
        if near(a, b):
            x, y = sorted((group[a], group[b]))
            group = {k: x if g == y else g for k, g in group.items()}
    assert set(out) == {k for k in spoken if group[k] == k} - dirty
    trees = pii.learn(spark.createDataFrame([(k, texts[k]) for k in sorted(out)], "doc_id long, text string"))
    for k, r in out.items():
        clean = pii.masked(texts[k], [s for part in pii.all_spans(texts[k], *trees) for s in part])
        assert bpe.decode_ids(bytes(r["ids"]), bpe.default_path()).decode() == clean and r["decoded_sha256"] == sha(clean)
