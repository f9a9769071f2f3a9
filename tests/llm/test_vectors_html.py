"""Centroid clustering, vector codes and HTML extraction against plain Python, and their edge cases."""

import hashlib
import random
import time

import numpy as np
import pytest

from graphloom.llm import centroids, codes, htmltext
from graphloom.llm.vectors import limit

VECTORS = "other string, vec_id long, embedding array<float>, cluster int, label int"


def nearest(x, entries):
    """(index, squared distance), ties to the lower index."""
    return min(((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(entries)))[::-1]


@pytest.mark.parametrize("spread", [2, 50, 5000])
def test_annulus_and_tree_equal_brute_force_with_ties(spread):
    r = np.random.default_rng(spread)
    for k, width in ((1, 3), (7, 4), (64, 4), (200, 2)):
        entries = r.integers(-spread, spread, (k, width))
        entries[r.integers(0, k, k // 3)] = entries[r.integers(0, k, k // 3)]  # equal entries
        x = np.concatenate([r.integers(-spread, spread, (300, width)), entries, -entries])
        want = [nearest(v, entries.tolist()) for v in x.tolist()]
        for search in (centroids.Annulus(entries), codes.VantageTree(entries)):
            index, distance, count = search.nearest(x)
            assert list(zip(index.tolist(), distance.tolist(), strict=True)) == want
            assert count <= len(x) * k


def test_searches_leave_far_entries_out():
    r = np.random.default_rng(1)
    entries = r.integers(-1000, 1000, (64, 4)) * np.arange(1, 65)[:, None]
    x = entries[r.integers(0, 64, 2000)] + r.integers(-5, 5, (2000, 4))
    for search in (centroids.Annulus(entries), codes.VantageTree(entries)):
        assert search.nearest(x)[2] < 0.5 * len(x) * len(entries)


def rows(dims):
    r = random.Random(dims)
    some = [("x", k, [r.uniform(-1, 1) for _ in range(dims)], 1, k % 3 if k % 5 else None) for k in range(0, 120)]
    twins = [("x", 3, some[7][2], 1, 1), ("x", 8, some[8][2], 2, 2), ("x", None, some[9][2], None, None)] + [("x", 500 + k, some[11][2], 1, 0) for k in range(60)]
    bad = [("x", 900, None, 1, 1), ("x", 901, [None] * dims, 1, 1), ("x", 902, [float("nan")] * dims, 1, 1), ("x", 903, [float("inf")] * dims, 1, None)]
    return some + twins + bad


def floors(v, scale):
    return [int(np.floor(scale * float(np.float32(x)))) for x in v]


def means(own, old):
    return [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if own[k] else e for k, e in enumerate(old)]


def test_clusters_equal_plain_rounds(spark):
    data = [*rows(6), ("x", 904, [0.5] * 5, 1, 1), ("x", 905, [], 1, 1)]
    kept = [(i, floors(v, 1024)) for _, i, v, _, _ in data if v and len(v) == 6 and all(x is not None and abs(x) < 9 for x in v)]
    c = [v for _, v in sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)][:8]
    for _ in range(10):
        own = [[] for _ in c]
        for _, v in kept:
            own[nearest(v, c)[0]].append(v)
        c = means(own, c)
    got, last, inertia = centroids.cluster(spark.createDataFrame(data, VECTORS).repartition(5), dims=6)
    assert last.tolist() == c
    want = [(i, *nearest(v, c)) for i, v in kept]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert inertia == [sum(d for _, k, d in want if k == n) for n in range(8)]


def test_codes_equal_plain_rounds_and_decode(spark):
    data = [*rows(8), ("x", 904, [0.5] * 7, 1, 1), ("x", 905, [], 1, None)]
    kept = [(i, floors(v, 256) + [0] * (8 - len(v)), label) for _, i, v, _, label in data if v is not None and all(x is not None and abs(x) < 9 for x in v)]
    part = lambda v, p: v[2 * p : 2 * p + 2]
    first = [v for _, v in sorted((i, v) for i, v, _ in kept if i is not None)][:16]
    books = [[part(v, p) for v in first] for p in range(4)]
    for _ in range(2):
        for p in range(4):
            own = [[] for _ in first]
            for _, v, _ in kept:
                own[nearest(part(v, p), books[p])[0]].append(part(v, p))
            books[p] = means(own, books[p])
    table = spark.createDataFrame(data, VECTORS).selectExpr("vec_id", "label", "embedding v").repartition(5)
    got = codes.learn(table, parts=4, entries=16)
    assert got.tolist() == books
    want = [(i, label, "".join(f"{nearest(part(v, p), books[p])[0]:02x}" for p in range(4)), sum(nearest(part(v, p), books[p])[1] for p in range(4))) for i, v, label in kept]
    coded = [tuple(r) for r in codes.encode(table, got, keep=("label",)).collect()]
    assert sorted(map(str, coded)) == sorted(map(str, want))
    by_id = {i: v for i, v, _ in kept}
    assert all(sum((a - b) ** 2 for a, b in zip(codes.decode(c, got), by_id[i], strict=True)) == e for i, _, c, e in coded if i not in (3, 8, None))


def test_few_none_and_too_large_vectors(spark):
    few = spark.createDataFrame([("x", 1, [0.5, 1.0], 1, None), ("x", 2, [0.25, 1.0], 1, None)], VECTORS)
    got, c, _ = centroids.cluster(few, dims=2)
    assert len(c) == 2 and sorted(r["distance"] for r in got.collect()) == [0, 0]
    for empty in (few.where("false"), few.withColumn("vec_id", few.vec_id * None)):
        assert centroids.cluster(empty, dims=2)[0].collect() == []
        rows = empty.selectExpr("vec_id", "embedding v")
        assert codes.encode(rows, codes.learn(rows, parts=2)).collect() == []
    only_empty = spark.createDataFrame([(1, []), (2, [])], "vec_id long, v array<float>")
    assert [(r["code"], r["error"]) for r in codes.encode(only_empty, codes.learn(only_empty, parts=2)).collect()] == [("0000", 0)] * 2
    with pytest.raises(Exception, match="64-bit"):
        large = spark.createDataFrame([("x", 1, [float(limit(2)), 1.0], 1, None)], VECTORS)
        centroids.cluster(large, dims=2)


LONG = "This is a paragraph of the article, with plenty of words in it, so that it stands out &amp; is kept."
OUT = LONG.replace("&amp;", "&")
LAYOUTS = {
    "soup": f'<body><div id="header">Site</div><div class="cookie-notice">We use cookies</div><div class="w"><div class="post"><h1>Title</h1><div class="entry"><p>{LONG}</p><p>Short.</p><p>{LONG}</div></div><div class="sidebar"><p>{LONG}</div></div>'
    f'<div id="comments"><h3>2 Comments</h3><p>{LONG}</div><div class="site-footer">f</div>',
    "header in article": f'<header><a href=/>Site</a></header><main><article><header><h1>Title</h1></header><form><p>{LONG}</p></form><p>{LONG}<aside>{LONG}</aside><p>Short.</p><p>{LONG}</article><section><h2>Comments</h2><article><p>{LONG}</article></section></main>',
    "hidden": f'<div><h1>Title</h1><p>{LONG}<span hidden>x</span></p><div style="display: none">{LONG}</div><p>Short.</p><p>{LONG}</p><div role="complementary">{LONG}</div></div>',
    "form around all": f'<body><form action=x><nav>menu</nav><article><h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p><button>Go</button></article></form></body>',
    "layout says": f'<body class="has-sidebar with-comments"><div class="content-with-sidebar"><h2 class="entry-header">Title</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div class="AdSlot">{LONG}</div></body>',
    "cards": f'<div class=x><a href=1><div>one of the other pages</div></a><a href=2><div>two of the other pages</div></a><a href=3><div>three of them</div></a></div><div><h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>',
}


@pytest.mark.parametrize("name", list(LAYOUTS))
def test_layouts(name):
    assert htmltext.main_text(LAYOUTS[name]).split("\n") == ["Title", OUT, "Short.", OUT]


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("", ""), (None, ""), ("just text &amp; more", "just text & more"), ("<p>a\n\t b&nbsp;c<br>d</p>", "a b c d"), ("<body><nav>x</nav></body>", ""), ("a < b <!-- c", "a < b"), ("<p>one<script>var p = '<p>';</p>", "one"),
        ("<article><p>x <b>bo<i>ld</b></i> y<p>z</article>tail", "x bold y\nz"), ("<article><ul><li>one<li>two</ul><table><tr><td>c<td>d</table></article>", "one\ntwo\nc\nd"), ("<article>&#x41;&am; &lt;p&gt; &copy</article>", "A&am; <p> ©"),
        ('<article><p title="a>b">x</p></article>', "x"), ("<article>x</article><p class='unclosed", "x"),
    ],
)
def test_small_pages(source, text):
    assert htmltext.main_text(source) == text


@pytest.mark.parametrize(
    "source", ["<div>" * 60_000, "<p><b " * 60_000, "<!--" * 60_000, '<a href="' * 60_000, "<li><ul>" * 40_000 + "x", "<" * 200_000, "</div>" * 60_000, "<span class=ad>" * 40_000 + "</b>" * 40_000, "<a " + "= " * 90_000 + ">z", "<p><div class=x>" * 40_000 + "</p>" * 40_000]
)
def test_hard_pages_take_linear_time(source):
    began = time.perf_counter()
    htmltext.main_text(source)
    once = time.perf_counter() - began
    began = time.perf_counter()
    htmltext.main_text(source[: len(source) // 4])
    assert once < 12 * (time.perf_counter() - began) + 0.5 and once < 10


def test_pages_keep_nulls_repeats_and_clashing_columns(spark):
    data = [(1, "u", None, "t"), (None, None, "<p>a b</p>", "t"), (1, "u", "<article>x</article>", None), (2, "u", "", "t")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, text string")
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in htmltext.extract(pages).collect()) == [("1", "", 0), ("1", "x", 1), ("2", "", 0), ("None", "a b", 3)]
    assert htmltext.extract(pages.where("false")).collect() == []
