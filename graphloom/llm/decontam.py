"""Benchmark decontamination (operator 5).

One Aho-Corasick automaton holds the normalised windows of all benchmark items; each text is normalised once, scanned
once, and matches are mapped back to word numbers and code points of the original. An automaton has a node for each byte of its windows at most,
of about 50 bytes of memory, so `automaton_bytes` (6 MB of windows) bounds a worker's automaton to about 300 MB. A larger benchmark is scanned
chunk by chunk: one job and one broadcast at a time, each of which leaves the hits of the texts that have any, by the digest of the text.

Defined results: null text or item text has no words; an item of fewer words than a window is one window, an item of none
has no window; items that repeat an id count once; a null item id is the string "null"; empty tables give no rows or no hits; repeated documents
are judged each; only the named columns are read, so other columns can't clash.
"""

from __future__ import annotations

import itertools
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.text import map_batches
from graphloom.session import cut_lineage, table

WINDOW = 10
#: Bytes: letters A-Z become a-z, digits, a-z and all of 0x80 and above stay, the rest becomes a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def word_list(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split()


def item_windows(text: str | None, size: int = WINDOW) -> set[bytes]:
    w = word_list(text)
    return {b" " + b" ".join(w[i : i + size]) + b" " for i in range(max(1, len(w) - size + 1))} if w else set()


#: What one more item of a window is taken to weigh.
ITEM_BYTES = 16


def window_chunks(benchmark: DataFrame, id_col: str, text_col: str, size: int, automaton_bytes: int):
    """Chunks {window: [item ids as text]} of at most automaton_bytes of windows and items each, streamed item by item; a window may be in several."""
    chunk: dict[bytes, set[str]] = {}
    used = 0
    for row in benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text_col).toLocalIterator():
        for w in item_windows(row[1], size):
            more = ITEM_BYTES if w in chunk else len(w)
            if chunk and used + more > automaton_bytes:
                yield chunk
                chunk, used, more = {}, 0, len(w)
            used += more
            chunk.setdefault(w, set()).add(row[0])
    if chunk:
        yield chunk


_built: dict[str, object] = {}


def _automaton(key: str, shared):
    """Built once in each worker."""
    import ahocorasick

    if key not in _built:
        _built.clear()
        a = ahocorasick.Automaton()
        for k, (window, items) in enumerate(shared.value):
            a.add_word(window.decode("latin-1"), (window.count(b" ") - 1, items))
        if len(shared.value):
            a.make_automaton()
        _built[key] = a
    return _built[key]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan_text(words: list[bytes], automaton) -> tuple[list[tuple[int, int]], set[str]]:
    """Word ranges (end exclusive) inside occurrences, and the items met."""
    if not words or not len(automaton):
        return [], set()
    flat = " " + b" ".join(words).decode("latin-1") + " "
    hits, items, ends = [], set(), None
    for at, (n, own) in automaton.iter(flat):
        if ends is None:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)  # the space after each word
        last = int(np.searchsorted(ends, at))
        hits.append((last - n + 1, last + 1))
        items |= own
    return merged(hits), items


RANGES = "array<struct<start:int,stop:int>>"
PAIR = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _finished(own: list[str], at: int, find):
    """Batches of the columns own, n_words, hits, spans and items; find gives the hits and items of row k, its words known."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, hits, spans, items = [], [], [], []
        get = find(batch)
        for k, text in enumerate(batch.column(at).to_pylist()):
            words = word_list(text)
            found, met = get(k, words)
            n.append(len(words))
            hits.append([{"start": a, "stop": b} for a, b in found])
            items.append(sorted(met))
            spans.append(original(text, found) if found else [])
        cols = {c: batch.column(k) for k, c in enumerate([*own, "text"])}
        return pa.RecordBatch.from_pydict(cols | {"hits": pa.array(hits, PAIR), "items": pa.array(items, pa.list_(pa.string())), "n_words": pa.array(n, pa.int64()), "spans": pa.array(spans, PAIR)})

    return run


def chunk_hits(texts: DataFrame, shared) -> DataFrame:
    """(digest, hits, items) of the texts (digest, text) that hold a window of one chunk; each digest once."""
    key = uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton, rows = _automaton(key, shared), []
        for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found, met = scan_text(word_list(text), automaton)
            if found:
                rows.append((digest, [{"start": a, "stop": b} for a, b in found], sorted(met)))
        digests, hits, items = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_pydict({"digest": pa.array(digests, pa.string()), "hits": pa.array(hits, PAIR), "items": pa.array(items, pa.list_(pa.string()))})

    return map_batches(texts, run, f"digest string, hits {RANGES}, items array<string>").dropDuplicates(["digest"])


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, automaton_bytes: int = 6_000_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns in keep, id_col, n_words, hits (word ranges), spans (code points of the ranges in the original text), items (sorted)."""
    context = docs.sparkSession.sparkContext
    own = [c for c in dict.fromkeys((*keep, id_col)) if c != "text"]
    rows = docs.select(*own, F.col(text_col).alias("text"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own) + f", text string, hits {RANGES}, items array<string>, n_words long, spans {RANGES}"
    at = len(own)
    chunks = window_chunks(benchmark, item_col, item_text_col, size, automaton_bytes)
    first, second = next(chunks, {}), next(chunks, None)
    if second is None:
        shared, key = context.broadcast(list(first.items())), uuid.uuid4().hex
        out = map_batches(rows, _finished(own, at, lambda batch: lambda k, words, a=_automaton(key, shared): scan_text(words, a)), schema)
        return out if "text" in keep else out.drop("text")
    rows = rows.withColumn("__digest", F.sha2("text", 256))
    texts, found = rows.where("__digest is not null").select(F.col("__digest").alias("digest"), "text"), None
    for chunk in itertools.chain([first, second], chunks):
        shared = context.broadcast(list(chunk.items()))
        new = chunk_hits(texts, shared)
        found = cut_lineage(new if found is None else found.union(new))  # a chunk's job is over here
        shared.destroy()
    merge = lambda c: F.flatten(F.collect_list(c)).alias(c)
    found = found.groupBy("digest").agg(merge("hits"), merge("items"))
    both = rows.join(found, F.col("__digest") == F.col("digest"), "left").select(*own, "text", "hits", "items")

    def known(batch: pa.RecordBatch):
        hits, items = batch.column(at + 1).to_pylist(), batch.column(at + 2).to_pylist()
        return lambda k, words: (merged([(x["start"], x["stop"]) for x in hits[k] or ()]), set(items[k] or ()))

    out = map_batches(both, _finished(own, at, known), schema)
    return out if "text" in keep else out.drop("text")


def original(text: str, hits: list[tuple[int, int]]) -> list[dict]:
    """Word ranges as code points of the original text, end exclusive."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in WORD.finditer(raw)]
    points = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return [{"start": int(points[at[a][0]]) - 1, "stop": int(points[at[b - 1][1] - 1])} for a, b in hits]


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + (x["stop"] - x["start"]))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP5_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bw as (select distinct item_id, least(10, len(w)) n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') g
       from (select *, unnest(range(1, greatest(1, len(w) - 9) + 1)) i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') g
       from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, sizes where len(w) >= n)),
m as (select doc_id, n, i, item_id from dw join bw using (n, g)),
h as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from m) group by 1),
t as (select doc_id, count(*) n_items, string_agg(s, ',' order by s) l from (select distinct doc_id, item_id::varchar s from m) group by 1)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       sha256(coalesce(l, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join h using (doc_id) left join t using (doc_id)
"""
