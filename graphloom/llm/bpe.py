"""Byte-level BPE encoding and decoding (operator 1).

Pre-tokenisation uses no regex. Each code point has a class; classes with one or two code points of look-ahead become the
symbols of a small automaton; a symbol is a function from state to state, functions compose associatively, and a blocked
scan over the compositions gives the state before every code point of a whole batch at once. A (state, symbol) pair says
whether a piece starts there. Pieces are merged by rank through a bounded cache.

Defined results: null text is empty text (no ids, empty decoding); repeated rows are encoded each; only the named columns
are read, so other columns can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.text import map_batches, texts
from graphloom.session import table

LETTER, NUMBER, OTHER, SPACE, BLANK, RESET = range(6)
#: Symbols: classes with look-ahead. An apostrophe that opens a contraction of one or two more letters; white space before
#: white space or the end; a space, or another white space, before something else; the end of a text.
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_BLANKS, S_SPACE, S_BLANK, S_END = range(9)
#: States: a piece has ended; in letters; in numbers; in others; after a space that may join; in white space; one or two
#: letters of a contraction are to come.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOINING, IN_BLANKS, ONE_MORE, TWO_MORE = range(8)
#: White space by the Unicode property White_Space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CACHE_PIECES = 400_000
BLOCK = 512


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class by code point, from the Unicode general category."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[WHITE_SPACE] = BLANK
    out[32] = SPACE
    return out


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a piece starts at the symbol."""
    if symbol == S_END:
        return FRESH, True
    if state == TWO_MORE:
        return ONE_MORE, False
    if state == ONE_MORE:
        return FRESH, False
    if symbol in (S_SHORT, S_LONG):
        if state in (IN_OTHERS, JOINING):
            return IN_OTHERS, False
        return (ONE_MORE if symbol == S_SHORT else TWO_MORE), True
    if symbol in (S_LETTER, S_NUMBER, S_OTHER):
        to = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHERS}[symbol]
        return to, state not in (to, JOINING)
    if symbol == S_BLANKS:
        return IN_BLANKS, state != IN_BLANKS
    return (JOINING if symbol == S_SPACE else FRESH), True


@lru_cache(maxsize=1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element of each symbol, composition table, element x state -> state, state x symbol -> piece starts).

    Elements are the transition functions reachable by composition; element 0 is the identity.
    """
    moves = [tuple(_step(s, y)[0] for s in range(8)) for y in range(9)]
    elements = {tuple(range(8)): 0}
    queue = [tuple(range(8))]
    for f in queue:
        for g in moves:
            h = tuple(g[s] for s in f)
            if h not in elements:
                elements[h] = len(elements)
                queue.append(h)
    size = len(queue)
    compose = np.zeros((size, size), np.uint16)
    for i, f in enumerate(queue):
        for j, g in enumerate(queue):
            compose[i, j] = elements[tuple(g[s] for s in f)]
    starts = np.array([[_step(s, y)[1] for y in range(9)] for s in range(8)])
    return np.array([elements[m] for m in moves], np.uint16), compose, np.array(queue, np.uint8), starts


def symbols(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The symbol of each code point; ends are the positions of the separators after each text."""
    kind = class_table()[codes]
    kind[ends] = RESET
    after = np.append(kind[1:], RESET)
    solid_next = after <= OTHER
    out = kind.copy()
    blank = (kind == SPACE) | (kind == BLANK)
    out[blank] = S_BLANKS
    out[(kind == SPACE) & solid_next] = S_SPACE
    out[(kind == BLANK) & solid_next] = S_BLANK
    out[kind == RESET] = S_END
    quote = np.flatnonzero(codes == 39)
    if len(quote):
        padded = np.append(codes, [0, 0])
        one, two = padded[quote + 1], padded[quote + 2]
        has = lambda x, letters: np.isin(x, [ord(c) for c in letters])
        out[quote[has(one, "stmd")]] = S_SHORT
        long = (has(one, "r") & has(two, "e")) | (has(one, "v") & has(two, "e")) | (has(one, "l") & has(two, "l"))
        out[quote[long]] = S_LONG
    return out


def piece_starts(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions where pieces start, with the separators themselves, in order."""
    element, compose, apply, starts = automaton()
    symbol = symbols(codes, ends)
    n, size = len(symbol), compose.shape[0]
    blocks = -(-n // BLOCK)
    lanes = np.zeros(blocks * BLOCK, np.uint16)
    lanes[:n] = element[symbol]
    lanes = np.ascontiguousarray(lanes.reshape(blocks, BLOCK).T)
    flat = compose.ravel()
    for j in range(1, BLOCK):  # inclusive scan inside all blocks at once
        lanes[j] = flat[lanes[j - 1].astype(np.int64) * size + lanes[j]]
    state, entry = FRESH, np.zeros(blocks, np.uint8)
    for b, f in enumerate(lanes[-1].tolist()):  # the blocks' totals
        entry[b] = state
        state = apply[f, state]
    after = apply.ravel()[lanes.T.astype(np.int64) * 8 + entry[:, None]].ravel()[:n]
    before = np.empty(n, np.uint8)
    before[0], before[1:] = FRESH, after[:-1]
    return np.flatnonzero(starts[before, symbol])


def pieces(batch: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(pieces of all texts, offsets of texts in pieces, first code point of each piece within its text)."""
    joined = "\n".join(batch) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, batch), np.int64, len(batch))
    ends = np.cumsum(lengths + 1) - 1
    starts = piece_starts(codes, ends)
    is_end = np.zeros(len(codes), bool)
    is_end[ends] = True
    separator = is_end[starts]
    stops = np.append(starts[1:], len(codes))
    keep = ~separator
    first, last = starts[keep], stops[keep]
    at = np.concatenate([[0], np.cumsum(keep)[separator]])
    text_of = np.searchsorted(ends, first)
    return [joined[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)], at, first - (ends - lengths)[text_of]


def merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge adjacent parts by least rank, leftmost first; quadratic, and fast for short pieces."""
    if piece in ranks:
        return [ranks[piece]]
    get, none = ranks.get, 1 << 60
    part = [piece[i : i + 1] for i in range(len(piece))]
    rank = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while rank:
        least = min(rank)
        if least == none:
            break
        i = rank.index(least)
        part[i] += part.pop(i + 1)
        del rank[i]
        if i < len(rank):
            rank[i] = get(part[i] + part[i + 1], none)
        if i:
            rank[i - 1] = get(part[i - 1] + part[i], none)
    return [ranks[p] for p in part]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same in n log n steps."""
    if len(piece) <= 48 or piece in ranks:
        return merge_short(piece, ranks)
    n = len(piece)
    part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, length = heapq.heappop(heap)
        j = right[i] if part[i] is not None else n
        if j >= n or len(part[i]) + len(part[j]) != length:
            continue
        part[i] += part[j]
        part[j] = None
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
            if (r := ranks.get(part[i] + part[right[i]])) is not None:
                heapq.heappush(heap, (r, i, len(part[i]) + len(part[right[i]])))
        if left[i] >= 0:
            h = left[i]
            if (r := ranks.get(part[h] + part[i])) is not None:
                heapq.heappush(heap, (r, h, len(part[h]) + len(part[i])))
    return [ranks[p] for p in part if p is not None]


class Cache(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers; emptied when full."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        out = np.array(merge(piece.encode("utf-8", "surrogatepass"), self.ranks), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = out
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[Cache, list[bytes]]:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    back = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        back[rank] = token
    return Cache(ranks), back


def encode_texts(batch: list[str], path: str) -> tuple[list[bytes], list[bytes]]:
    """For each text its ids, and the first code point of the piece that each id comes from, both as packed u32."""
    cache, _ = vocabulary(path)
    parts, at, first = pieces(batch)
    found = list(map(cache.__getitem__, parts))
    ids = [b"".join(found[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    spread = np.repeat(first.astype("<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4)
    cuts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).tolist()
    return ids, [spread[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def decode_ids(ids: bytes, path: str) -> bytes:
    _, back = vocabulary(path)
    return b"".join(map(back.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """id_col, ids binary (u32), piece_at binary (u32 per id), and with decode=True decoded binary, for each row.

    path: the rank file, at the same place on all nodes.
    """
    path = path or default_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, at = encode_texts(texts(batch), path)
        out = {id_col: batch.column(0), "ids": pa.array(ids, pa.binary()), "piece_at": pa.array(at, pa.binary())}
        if decode:
            out["decoded"] = pa.array([decode_ids(x, path) for x in ids], pa.binary())
        return pa.RecordBatch.from_pydict(out)

    return map_batches(
        docs.select(F.col(id_col), F.col(text_col).alias("text")),
        run,
        f"`{id_col}` {kind}, ids binary, piece_at binary" + ", decoded binary" * decode,
    )


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """id_col, decoded binary for each row of (id_col, ids); null ids decode to nothing."""
    path = path or default_path()
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({id_col: b.column(0), "decoded": pa.array([decode_ids(x or b"", path) for x in b.column(1).to_pylist()], pa.binary())})

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, decoded binary")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(table(spark, sf_dir, "documents"), decode=True)
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
