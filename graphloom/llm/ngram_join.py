"""N-gram Jaccard join with Bayesian candidate pruning (operator 10).

Texts are sets of five-word shingles (fewer words: the whole text is one shingle); pairs of similarity 0.8 or more link.

1. One pass makes a sequence digest and a MinHash signature (128 values of 16 bits) for each text; rows whose
   words are equal collapse to their least id before anything is paired.
2. The signature's 32 bands of 4 values are the candidate keys. A pair at similarity 0.8 shares none with probability
   (1 - 0.8**4)**32 = 5e-8, and more similar pairs less.
3. Buckets are split in blocks; each pair of blocks is a tile. A pair's values are compared 16 at a time: it is dropped as soon
   as the posterior probability of similarity >= 0.8 (uniform prior) is below `tolerance`. Of the survivors a tile hands on a spanning
   forest, and pairs that are connected already are not compared, so a group of N near copies takes about N comparisons a band.
4. Connected survivors form candidate components; in tiles of these the candidates are found again from the signatures and
   verified exactly on their word tuples, a dense tile by rows of bits. A tile hands on link counts and a
   spanning forest, so no step makes a row for each pair of a large group.

Defined results: null texts and texts without words link to nothing; copies (equal words) are one class and count as
links of each other; rows that repeat an id give a row each, classed by their own words, and in the exact check the least
of the id's texts stands for it; rows with a null id are left out; only the named columns are read, so other columns can't clash; empty tables give no rows.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.text import U64, map_batches, mix, windows, words
from graphloom.operators.components import connected_components, heavy_join
from graphloom.session import cut_lineage, table

GRAM, HASHES, BANDS, STEP = 5, 128, 32, 16
THRESHOLD, TOLERANCE = 0.8, 1e-7
BLOCK, TEXT_BLOCK = 1024, 256
SPLIT = " \t\n\v\f\r"


def _multipliers() -> np.ndarray:
    return mix(np.arange(1, HASHES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def signatures(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words by row, two 64-bit digests of the word sequence by row, signature rows of 128 uint16)."""
    hashed, at, _ = words(column)
    counts = np.diff(at)
    rows = np.flatnonzero(counts > 0)
    digest = np.zeros((len(counts), 2), np.int64)
    sig = np.zeros((len(counts), HASHES), np.uint16)
    if not len(rows):
        return counts, digest, sig
    with np.errstate(over="ignore"):
        place = U64(1) + (np.arange(len(hashed)) - np.repeat(at[:-1], counts)).astype(U64)
        for k, salt in enumerate((0x8CB92BA72F3D8DD7, 0xAEF17502108EF2D9)):
            digest[rows, k] = mix(np.add.reduceat(mix(hashed + place * U64(salt)), at[:-1][rows])).astype(np.int64)
    grams = windows(hashed, GRAM)
    many = np.maximum(counts - GRAM + 1, 1)
    short = (counts < GRAM) & (counts > 0)
    row_of = np.repeat(rows, many[rows])
    begins = np.concatenate([[0], np.cumsum(many[rows])])[:-1]
    inside = np.arange(len(row_of)) - np.repeat(begins, many[rows])
    spot = at[row_of] + inside
    is_short = short[row_of]
    sh = np.empty(len(row_of), U64)
    sh[~is_short] = grams[spot[~is_short]]
    sh[is_short] = mix(digest[row_of[is_short], 0].astype(U64))
    for lo in range(0, len(rows), 64):  # small parts stay in the cache
        hi = min(lo + 64, len(rows))
        a, b = begins[lo], begins[hi] if hi < len(rows) else len(sh)
        part, cuts = sh[a:b], begins[lo:hi] - a
        for k, m in enumerate(_multipliers()):
            with np.errstate(over="ignore"):
                v = ((part * m) >> U64(32)).astype(np.uint32)
            sig[rows[lo:hi], k] = mix(np.minimum.reduceat(v, cuts).astype(U64)).astype(np.uint16)
    return counts, digest, sig


def least_matches(threshold: float, tolerance: float, steps: range) -> dict[int, int]:
    """For n values compared, the fewest matches m at which P(similarity >= threshold | m of n) >= tolerance.

    With a uniform prior that probability is P(Binomial(n + 1, threshold) <= m).
    """
    out = {}
    for n in steps:
        below = 0.0
        for m in range(n + 1):
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                out[n] = m
                break
    return out


def prune(x: np.ndarray, y: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which pairs of signature rows survive the incremental comparison."""
    alive = np.arange(len(x))
    seen = np.zeros(len(x), np.int32)
    for n, m in least.items():
        seen = seen + (x[alive, n - STEP : n] == y[alive, n - STEP : n]).sum(axis=1)
        keep = seen >= m
        alive, seen = alive[keep], seen[keep]
        if not len(alive):
            break
    return alive


def _groups(batches, keys: int):
    """(key values, list of batch parts) for each run of equal key columns in sorted rows."""
    last, parts = None, []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(b.num_rows, bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        heads = np.flatnonzero(new).tolist() + [b.num_rows]
        for a, z in zip(heads[:-1], heads[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if key != last and parts:
                yield last, parts
                parts = []
            last = key
            parts.append(b.slice(a, z - a))
    if parts:
        yield last, parts


def forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least number that each of n nodes is connected to by edges (x, y)."""
    label = np.arange(n)
    while len(x):
        low = label.copy()
        np.minimum.at(low, x, label[y])
        np.minimum.at(low, y, label[x])
        low = low[low]
        if (low == label).all():
            break
        label = low
    return label


def _sides(i: int, j: int, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a tile: within one block, or between two."""
    if i == j:
        return np.triu_indices(len(side), 1)
    return tuple(v.ravel() for v in np.meshgrid(np.flatnonzero(side == i), np.flatnonzero(side == j), indexing="ij"))


def connected(sig: np.ndarray, left: np.ndarray, right: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Labels of the components that surviving pairs of a left and a right row form; a label is a row of its component.

    A row meets one row of each component first, and the others of a component only if that one does not survive.
    """
    label = np.arange(len(sig))

    def join(p: int, rows: np.ndarray) -> None:
        hit = rows[prune(sig[rows], np.broadcast_to(sig[p], (len(rows), HASHES)), least)]
        if len(hit):
            label[np.isin(label, label[hit])] = label[p]

    for p in left.tolist():
        rows = right[label[right] != label[p]]
        if len(rows):
            firsts = rows[np.unique(label[rows], return_index=True)[1]]
            join(p, firsts)
            rows = rows[label[rows] != label[p]]
            if len(rows) > len(firsts):
                join(p, rows)
    return label


def _tile_pairs(least: dict[int, int]):
    def run(batches):
        xs, ys, held = [], [], 0
        for (_, _, i, j), parts in _groups(batches, 4):
            ids = np.concatenate([p.column(4).to_numpy() for p in parts])
            side = np.concatenate([p.column(5).to_numpy() for p in parts])
            sig = np.frombuffer(b"".join(s for p in parts for s in p.column(6).to_pylist()), np.uint16).reshape(-1, HASHES)
            label = connected(sig, np.flatnonzero(side == i), np.flatnonzero(side == j), least)
            joined = np.flatnonzero(ids != ids[label])
            if len(joined):
                xs.append(ids[joined])
                ys.append(ids[label[joined]])
                held += len(joined)
            if held > 10_000:
                yield pa.RecordBatch.from_pydict({"x": np.concatenate(xs), "y": np.concatenate(ys)})
                xs, ys, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"x": np.concatenate(xs), "y": np.concatenate(ys)})

    return run


def shingles(text: str, gram: int = GRAM) -> frozenset:
    w = [x for x in text.translate(_TO_SPACE).split(" ") if x]
    return frozenset(zip(*(w[k:] for k in range(gram)), strict=False)) if len(w) >= gram else frozenset([tuple(w)] if w else [])


_TO_SPACE = {ord(c): " " for c in SPLIT}


def in_common(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many numbers the sets of each pair (x, y) share; many pairs by the common bits of rows, 64 numbers at a time."""
    if len(x) < 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(x.tolist(), y.tolist(), strict=True)], np.int64)
    own, col = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
    shared = np.bincount(col) > 1
    own, col = own[shared[col]], (np.cumsum(shared) - 1)[col[shared[col]]]
    bits = np.zeros((len(sets), -(-int(shared.sum()) // 64)), np.uint64)
    np.bitwise_or.at(bits, (own, col >> 6), U64(1) << (col & 63).astype(U64))
    out, step = np.zeros(len(x), np.int64), max(1, (1 << 20) // max(1, bits.shape[1]))
    for at in range(0, len(x), step):
        part = slice(at, at + step)
        out[part] = np.bitwise_count(bits[x[part]] & bits[y[part]]).sum(axis=1)
    return out


def _verify(threshold: Fraction, least: dict[int, int]):
    def run(batches):
        for (_, i, j), parts in _groups(batches, 3):
            ids, side, copies, sigs, sets, known = {}, [], [], [], [], {}
            for p in parts:
                for x, s, n, sig, text in zip(*(p.column(k).to_pylist() for k in range(3, 8)), strict=True):
                    if x in ids:
                        continue  # rows come by text, so the least text of an id stays
                    ids[x] = len(ids)
                    side.append(s)
                    copies.append(n)
                    sigs.append(sig)
                    sets.append(np.array([known.setdefault(g, len(known)) for g in shingles(text)], np.int64))
            names, side, copies = np.fromiter(ids, np.int64, len(ids)), np.array(side), np.array(copies)
            sig = np.frombuffer(b"".join(sigs), np.uint16).reshape(-1, HASHES)
            bands = sig.view("<u8")
            a, b = _sides(i, j, side)
            xs, ys = [], []
            for at in range(0, len(a), 65_536):
                p, q = a[at : at + 65_536], b[at : at + 65_536]
                met = (bands[p] == bands[q]).any(axis=1)
                p, q = p[met], q[met]
                ok = prune(sig[p], sig[q], least)
                xs.append(p[ok])
                ys.append(q[ok])
            if not xs:
                continue
            x, y = np.concatenate(xs), np.concatenate(ys)
            both, size = in_common(sets, x, y), np.array([len(s) for s in sets])
            ok = both * threshold.denominator >= threshold.numerator * (size[x] + size[y] - both)
            x, y = x[ok], y[ok]
            if len(x):
                linked = np.bincount(x, copies[y], len(names)).astype(np.int64) + np.bincount(y, copies[x], len(names)).astype(np.int64)
                label, some = forest(len(names), x, y), np.flatnonzero(linked)
                yield pa.RecordBatch.from_pydict({"x": names[some], "y": names[label[some]], "n": linked[some]})

    return run


def _deal(tiles: DataFrame, *keys: str) -> DataFrame:
    """Tiles over all shuffle partitions: their work grows faster than their bytes, by which small partitions would be put together."""
    return tiles.repartition(int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, d1, d2 (null without words), sig."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, digest, sig = signatures(batch.column(1))
        none = pa.array(n == 0)
        raw = sig.tobytes()
        d1, d2 = (pc.if_else(none, pa.scalar(None, pa.int64()), pa.array(digest[:, k])) for k in (0, 1))
        return pa.RecordBatch.from_pydict({"doc": batch.column(0), "d1": d1, "d2": d2, "sig": pa.array([raw[k * 2 * HASHES : (k + 1) * 2 * HASHES] for k in range(len(n))], pa.binary())})

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return map_batches(rows, run, "doc long, d1 long, d2 long, sig binary")


def candidate_pairs(reps: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """A spanning forest (x, y) of the pairs of reps (doc, sig) that survive the pruning."""

    def keys(batches):
        for b in batches:
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, HASHES).view("<u8")
            for k in range(BANDS):
                yield pa.RecordBatch.from_pydict({"key": mix(sig[:, k] + U64(k + 1)).astype(np.int64), "band": np.full(len(sig), k, np.int32), "doc": b.column(0)})

    banded = reps.select("doc", "sig").mapInArrow(keys, "key long, band int, doc long")
    full = banded.groupBy("key", "band").agg(F.count("*").alias("n")).where("n > 1")
    # Only members of buckets with company go on; those of large buckets are dealt over blocks.
    full = full.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    members = heavy_join(banded, full, ["key", "band"], BANDS * reps.count())
    members = members.withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")).select("key", "band", "blocks", "own", "doc")
    tiles = (
        members.join(reps.select("doc", "sig"), "doc")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "doc", "own", "sig")
    )
    dealt = _deal(tiles, "key", "band", "i", "j").sortWithinPartitions("key", "band", "i", "j")
    return dealt.mapInArrow(_tile_pairs(least_matches(threshold, tolerance, range(STEP, HASHES + 1, STEP))), "x long, y long")


def verified_links(docs: DataFrame, reps: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(x, y, n): for each tile of a candidate component the documents with exact links in it, the least document of the
    tile that links connect them to, and how many documents they link to in the tile (copies of reps too)."""
    comp = connected_components(pairs, "x", "y")
    comp = cut_lineage(comp)
    sizes = comp.groupBy("component").agg(F.count("*").alias("n"), F.ceil(F.count("*") / TEXT_BLOCK).cast("int").alias("blocks"))
    placed = heavy_join(comp, sizes, ["component"], comp.count()).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = cut_lineage(placed.join(reps.select(F.col("doc").alias("id"), "copies", "sig"), "id"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null").join(placed.hint("shuffle_hash"), "id")
    tiles = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "own", "copies", "sig", "text"
    )
    dealt = _deal(tiles, "component", "i", "j").sortWithinPartitions("component", "i", "j", "text")
    least = least_matches(threshold, tolerance, range(STEP, HASHES + 1, STEP))
    return dealt.mapInArrow(_verify(Fraction(str(threshold)), least), "x long, y long, n long")


def join_classes(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, class_id (least id of the documents connected by links), n_links (documents linked to it, copies too)."""
    sketched = cut_lineage(sketch(docs, id_col, text_col))
    copies = sketched.where("d1 is not null").groupBy("d1", "d2").agg(F.min(F.struct("doc", "sig")).alias("r"), F.count_distinct("doc").alias("copies"))
    reps = cut_lineage(copies.select("d1", "d2", "r.doc", "r.sig", "copies"))
    pairs = candidate_pairs(reps, threshold, tolerance)
    links = cut_lineage(verified_links(docs, reps, pairs, threshold, tolerance, id_col, text_col))
    comp = connected_components(links, "x", "y")
    n = links.groupBy("x").agg(F.sum("n").alias("linked")).withColumnRenamed("x", "doc")
    told = (
        reps.drop("sig")
        .join(n, "doc", "left")
        .join(comp.withColumnRenamed("id", "doc"), "doc", "left")
        .select("d1", "d2", F.coalesce("component", "doc").alias("class_id"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    )
    out = sketched.select("doc", "d1", "d2").join(told, ["d1", "d2"], "left")
    return out.select("doc", F.coalesce("class_id", "doc").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_classes(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


OP10_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents where doc_id is not null),
s as (select distinct doc_id, hash(array_to_string(w[i : i + least(5, len(w)) - 1], ' ')) g
      from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) i from d where len(w) > 0)),
c as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id x, b.doc_id y, count(*) k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select x, y from p join c cx on cx.doc_id = x join c cy on cy.doc_id = y where k * 5 >= 4 * (cx.n + cy.n - k)),
r as (select x id, y reach from l union select r.id, l.y from r join l on r.reach = l.x)
select d.doc_id, least(d.doc_id, coalesce((select min(reach) from r where r.id = d.doc_id), d.doc_id)) class_id,
       coalesce((select count(*) from l where l.x = d.doc_id), 0)::bigint n_links
from d
"""
