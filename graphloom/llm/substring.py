"""Substring dedup by seed and extend (operator 9).

Seeds: every window of `size` words is anchored at its winnowed k-gram, the one of least hash in it (the rightmost of
equals). Equal windows have equal anchors, at the same offset, so joining on anchors meets every repeat. A run of windows
with one anchor travels as one row: the anchor, and a hash of each window in the run, which is the anchor extended
both ways to every offset. Within an anchor's group the rows come by document id, so the first to bring a window
owns it and later documents lose it; maximal repeats are the unions of lost windows.

Before the shuffle each task resolves runs that repeat as a whole within the task: only the one of the least id travels,
the others are already decided. Common passages and copies therefore cost about one row for each task, not each document.

Where a common passage begins or ends, its runs differ by what is around it, so they don't resolve as a whole. A first pass
over all texts counts anchors; the runs of anchors that hold more than one in 4 x shuffle partitions of all runs (so at most
that many anchors) travel window by window, dealt by anchor and window, after those that repeat in the task are resolved.

Defined results: null text has no words; rows that repeat an id never take words from each other; rows with a null id
keep all words and take none; texts shorter than a window keep all; only the named columns are read, so other columns can't clash; empty
tables give no rows. Windows are told apart by 64 bits of hash, besides those of the anchor, which the windows compared share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.text import U64, WHITE, map_batches, slices, texts, utf8, windows, words
from graphloom.session import table

SIZE, GRAM = 50, 12
#: Words are split on the bytes of ASCII white space, nothing else.
SPLIT = bytes(32 if WHITE[b] else b for b in range(256))
RUNS_HELD, COUNTED, WIDE = 400_000, 1_000_000, 8


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """The position of the least of each w neighbours, the rightmost of equals; blocks of prefix and suffix minima."""
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    pad = -len(x) % w
    wide = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, U64)]).reshape(-1, w)
    low_left = np.minimum.accumulate(wide, axis=1)
    where = np.arange(wide.size).reshape(-1, w)
    at_left = np.maximum.accumulate(np.where(wide == low_left, where, -1), axis=1).ravel()
    flipped = wide[:, ::-1]
    low_right = np.minimum.accumulate(flipped, axis=1)
    new = np.ones_like(flipped, bool)
    new[:, 1:] = flipped[:, 1:] < low_right[:, :-1]
    at_right = np.minimum.accumulate(np.where(new, where[:, ::-1], wide.size), axis=1)[:, ::-1].ravel()
    flat, ends = wide.ravel(), np.arange(n) + w - 1
    a, b = at_right[:n], at_left[ends]
    return np.where(flat[b] <= flat[a], b, a)


def anchor_heads(hashed: np.ndarray, at: np.ndarray, size: int = SIZE, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Runs of windows that share an anchor: row, first word (within the row), anchor hash, begin of each window, offset in `begin`."""
    counts = np.diff(at)
    many = np.maximum(counts - size + 1, 0)
    row_of = np.repeat(np.arange(len(counts)), many)
    if not len(row_of):
        none = np.zeros(0, np.int64)
        return {"row": none, "first": none, "anchor": np.zeros(0, U64), "cut": np.zeros(1, np.int64), "begin": none}
    grams = windows(hashed, gram)
    place = sliding_argmin(grams, size - gram + 1)  # by first word of the window
    inside = np.arange(len(row_of)) - np.concatenate([[0], np.cumsum(many)])[row_of]
    begin = at[row_of] + inside
    spot = place[begin]
    new = np.ones(len(begin), bool)
    new[1:] = (spot[1:] != spot[:-1]) | (row_of[1:] != row_of[:-1])
    heads = np.flatnonzero(new)
    return {"row": row_of[heads], "first": inside[heads], "anchor": grams[spot[heads]], "cut": np.append(heads, len(begin)), "begin": begin}


def anchored_runs(hashed: np.ndarray, at: np.ndarray, size: int = SIZE, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The same, with the 64-bit hash of each window as `hashes`."""
    runs = anchor_heads(hashed, at, size, gram)
    whole = windows(hashed, size, 0xD6E8FEB86659FD93)
    return runs | {"hashes": whole[runs["begin"]]}


def pack(hashes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(hashes.astype("<u8"))


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8")


RUN_SCHEMA = "anchor long, doc long, tkey long, first int, hashes binary, lost binary"


def spread(tkey: int, first: int) -> int:
    """Where a decided run is dealt: anywhere but to the task of its anchor, which may be a common one."""
    return (tkey * 2862933555777941757 + first * 3202034522624059733 + 1) % (1 << 64) - (1 << 63)


def _anchor_counts(share: int):
    """(anchor, n) of anchors that hold one in share of the runs counted at a time or more, and (null, n) of all runs."""

    def told(heads: list[np.ndarray]) -> pa.RecordBatch:
        anchors, n = np.unique(np.concatenate(heads), return_counts=True)
        total = int(n.sum())
        some = n * share >= total
        return pa.RecordBatch.from_pydict({"anchor": pa.array([None, *anchors[some].astype(np.int64).tolist()], pa.int64()), "n": pa.array([total, *n[some].tolist()], pa.int64())})

    def run(batches):
        heads, held = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                hashed, at, _ = words(part.column(1))
                heads.append(anchor_heads(hashed, at)["anchor"])
                held += len(heads[-1])
                if held > COUNTED:
                    yield told(heads)
                    heads, held = [], 0
        if held:
            yield told(heads)

    return run


def hot_anchors(rows: DataFrame, share: int) -> set[int]:
    """The anchors that hold more than two in share of all runs, and others that hold one or more; at most share of them."""
    counts = rows.mapInArrow(_anchor_counts(share), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    total = counts.where("anchor is null").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    return {r["anchor"] for r in counts.where(F.col("anchor").isNotNull() & (F.col("n") * share > total)).select("anchor").collect()}


def window_key(anchor: int, window: int) -> int:
    """Where a window of a hot anchor is dealt; different anchors stay apart for the same window."""
    return (anchor * 3202034522624059733 + window * 2862933555777941757) % (1 << 64) - (1 << 63)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [[]] * 6
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["anchor", "doc", "tkey", "first", "hashes", "lost"])


def _by_window(runs: list[tuple]) -> list[tuple]:
    """Runs (key, anchor, doc, tkey, first) of hot anchors as rows: the least document of each window is to be compared, the others have lost it."""
    least: dict[tuple[int, int], tuple[int, int, int]] = {}
    masks, out = [], []
    for r, (key, anchor, doc, tkey, first) in enumerate(runs):
        got = unpack(key[8:]).tolist()
        masks.append(bytearray(len(got)))
        for i, w in enumerate(got):
            have = least.get((anchor, w))
            if have is None:
                least[anchor, w] = (doc, r, i)
            elif doc > have[0]:
                masks[r][i] = 1
            elif doc < have[0]:
                masks[have[1]][have[2]] = 1
                least[anchor, w] = (doc, r, i)
            else:  # the same id again
                out.append((window_key(anchor, w), doc, tkey, first + i, key[8 + 8 * i : 16 + 8 * i], None))
    for (anchor, w), (doc, r, i) in least.items():
        key, _, _, tkey, first = runs[r]
        out.append((window_key(anchor, w), doc, tkey, first + i, key[8 + 8 * i : 16 + 8 * i], None))
    out += [(spread(t, f), d, t, f, None, bytes(m)) for (_, _, d, t, f), m in zip(runs, masks, strict=True) if any(m)]
    return out


def _runs(shared):
    """Rows of RUN_SCHEMA: runs to be compared (lost null), and runs already lost to a smaller id of this task (hashes null).

    shared holds the hot anchors, whose runs come window by window.
    """

    def run(batches):
        hot: set[int] = shared.value
        held: dict[bytes, tuple] = {}
        dealt: list[tuple] = []  # runs of hot anchors that were met before under the same id
        hot_windows = 0

        def flush():
            out = [(a, d, t, f, key[8:], None) for key, (a, d, t, f) in held.items() if a not in hot]
            out += _by_window([(key, *at) for key, at in held.items() if at[0] in hot] + dealt)
            held.clear()
            dealt.clear()
            for k in range(0, len(out), 20_000):
                yield _rows(out[k : k + 20_000])

        for batch in batches:
            for part in slices(batch, "text"):
                ids, keys = part.column(0).to_pylist(), part.column(2).to_pylist()
                hashed, at, _ = words(part.column(1))
                r = anchored_runs(hashed, at)
                raw, lost = pack(r["hashes"]).tobytes(), []
                cut = (r["cut"] * WIDE).tolist()
                anchors = r["anchor"].astype(np.int64)
                heads = anchors.astype("<i8").tobytes()
                for k, (row, first, anchor) in enumerate(zip(r["row"].tolist(), r["first"].tolist(), anchors.tolist(), strict=True)):
                    doc, tkey = ids[row], keys[row]
                    key = heads[8 * k : 8 * k + 8] + raw[cut[k] : cut[k + 1]]
                    have = held.get(key)
                    if have is None:
                        held[key] = (anchor, doc, tkey, first)
                        if anchor in hot:
                            hot_windows += (cut[k + 1] - cut[k]) // WIDE
                    elif doc > have[1]:
                        lost.append((spread(tkey, first), doc, tkey, first, None, b"\1" * ((cut[k + 1] - cut[k]) // WIDE)))
                    elif doc < have[1]:
                        lost.append((spread(have[2], have[3]), have[1], have[2], have[3], None, b"\1" * ((cut[k + 1] - cut[k]) // WIDE)))
                        held[key] = (anchor, doc, tkey, first)
                    elif anchor in hot:  # the same id again: neither takes from the other, both are to be compared
                        dealt.append((key, anchor, doc, tkey, first))
                        hot_windows += (cut[k + 1] - cut[k]) // WIDE
                    else:
                        lost.append((anchor, doc, tkey, first, key[8:], None))
                if lost:
                    yield _rows(lost)
                if len(held) > RUNS_HELD or hot_windows > RUNS_HELD:
                    yield from flush()
                    hot_windows = 0
        yield from flush()

    return run


def _compare(batches):
    """From rows sorted by anchor and doc: the windows that a smaller doc of the same anchor has, as a mask for each run."""
    kinds = pa.schema([("doc", pa.int64()), ("tkey", pa.int64()), ("first", pa.int32()), ("lost", pa.binary())])
    last, owner = None, {}
    for batch in batches:
        out = []
        anchors, docs, keys, firsts, blobs = (batch.column(k) for k in range(5))
        anchors = anchors.to_numpy(zero_copy_only=False)
        same = np.zeros(len(anchors), bool)  # next to a row of the same anchor
        same[1:] |= anchors[1:] == anchors[:-1]
        same[:-1] |= anchors[1:] == anchors[:-1]
        same[[0, -1]] = True
        for k in np.flatnonzero(same).tolist():
            anchor, doc = int(anchors[k]), docs[k].as_py()
            if anchor != last:
                last, owner = anchor, {}
            got = unpack(blobs[k].as_py()).tolist()
            mask = bytes(owner.setdefault(h, doc) < doc for h in got)
            if any(mask):
                out.append((doc, keys[k].as_py(), firsts[k].as_py(), mask))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.types, strict=True)], kinds.names)


def _merge_lost(batches):
    """Per run a mask of lost windows becomes ranges of lost words."""
    for batch in batches:
        starts, stops = [], []
        for first, mask in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            m = np.flatnonzero(np.diff(np.concatenate([[0], np.frombuffer(mask, np.uint8), [0]]).astype(np.int8)))
            starts.append([first + int(a) for a in m[::2]])
            stops.append([first + int(b) - 1 + SIZE for b in m[1::2]])
        yield pa.RecordBatch.from_pydict({"doc": batch.column(0), "tkey": batch.column(1), "starts": pa.array(starts, pa.list_(pa.int32())), "stops": pa.array(stops, pa.list_(pa.int32()))})


def lost_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int | None = None) -> DataFrame:
    """doc, tkey (xxhash64 of the text), starts and stops of the ranges of lost words, one row for each text that loses any.

    Anchors that hold one in share of all runs travel window by window; share is 4 x shuffle partitions if not given.
    """
    spark = docs.sparkSession
    share = 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) if share is None else share
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tkey"))
    shared = spark.sparkContext.broadcast(hot_anchors(rows, share))  # at most share numbers
    runs = rows.mapInArrow(_runs(shared), RUN_SCHEMA)
    # Every run is shuffled once: those that are already decided only pass through.
    dealt = runs.repartition("anchor").sortWithinPartitions("anchor", "doc")
    masks = dealt.mapInArrow(_compare_or_pass, "doc long, tkey long, first int, lost binary")
    ranges = masks.mapInArrow(_merge_lost, "doc long, tkey long, starts array<int>, stops array<int>")
    return ranges.groupBy("doc", "tkey").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("stops")).alias("stops"))


def _compare_or_pass(batches):
    def open_rows():
        for b in batches:
            decided = b.column(4).is_null().to_numpy(zero_copy_only=False)
            if decided.any():
                passed.append(b.filter(pa.array(decided)).select([1, 2, 3, 5]))
                b = b.filter(pa.array(~decided))
            if b.num_rows:
                yield b
            else:
                yield from ()

    passed: list[pa.RecordBatch] = []
    for out in _compare(open_rows()):
        while passed:
            yield passed.pop()
        yield out
    while passed:
        yield passed.pop()


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int | None = None) -> DataFrame:
    """id_col, n_words, n_removed, kept (the kept words joined by one space) for every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    ranges = lost_ranges(docs, id_col, text_col, share).hint("shuffle_hash")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    both = rows.join(ranges, (rows["id"].cast("long") == ranges["doc"]) & (rows["h"] == ranges["tkey"]), "left").select("id", "text", "starts", "stops")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, gone, kept = [], [], []
        for text, starts, stops in zip(texts(batch), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            w = text.encode("utf-8", "surrogatepass").translate(SPLIT).split(b" ")
            w = [x for x in w if x]
            n.append(len(w))
            if starts:
                step = np.zeros(len(w) + 1, np.int32)
                np.add.at(step, starts, 1)
                np.add.at(step, stops, -1)
                keep = np.cumsum(step[:-1]) == 0
                w = [x for x, k in zip(w, keep.tolist(), strict=True) if k]
            gone.append(n[-1] - len(w))
            kept.append(b" ".join(w).decode("utf-8", "surrogatepass"))
        return pa.RecordBatch.from_pydict({id_col: batch.column(0), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept": pa.array(kept, pa.string())})

    return map_batches(both, run, f"`{id_col}` {kind}, n_words long, n_removed long, kept string")


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
g as (select doc_id, i, array_to_string(w[i : i + 49], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 48)) i from d where len(w) >= 50)),
m as (select g, min(doc_id) least_id from g group by 1),
x as (select distinct doc_id, unnest(range(i, i + 50)) p from g join m using (g) where doc_id > least_id),
r as (select doc_id, count(*) n_removed, list(p) ps from x group by 1)
select doc_id, len(w)::bigint n_words, coalesce(n_removed, 0)::bigint n_removed,
       sha256(case when ps is null then array_to_string(w, ' ') else array_to_string(list_filter(w, lambda v, i: not list_contains(ps, i)), ' ') end) kept_sha256
from d left join r using (doc_id)
"""
