"""Toxicity by noisy-channel deobfuscation (operator 7).

Tokens that may be disguised (symbols or digits next to letters, letters doubled or drawn out, single letters spaced out) become character lattices, which
Viterbi decodes under a character trigram model of the whole corpus; the restored text is then scored. Features are word beginnings
and whole words; each has the lower bound of its share of toxic texts, and a text's evidence is their noisy-or, calibrated by a logistic curve.
A beginning counts only if the words that have it, but for those that count by themselves, aren't mostly in clean texts.

The classifier is fitted on at most `SAMPLE` labelled texts of each class, chosen by hash; near copies (connected by
shared bands of MinHash values of word pairs) count once in each class. The character model counts all texts, in a table of fixed size.

Defined results: null and empty texts have no evidence and get the curve's floor; null labels are not learnt from; repeated rows
are scored each; texts of any length are read whole; without labelled rows the score is 0 for all; only the named columns are read, so other
columns can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.text import U64, map_batches, mix, slices, texts
from graphloom.session import table

SAMPLE = 4000
COPY_BANDS, COPY_ROWS = 12, 3
#: Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou", "€": "e", "£": "l", "#": "h"}
SYMBOLS = 64
SIGN = "[0-9@$!|+*€£#]"
#: What the model may be asked about: a sign next to a letter on either side, a letter doubled, single letters apart.
DISGUISED = re.compile(rf"[^\W\d_]{SIGN}|{SIGN}[^\W\d_]|([^\W\d_])\1|(?<![^\W_])[^\W\d_](?:[ .*_-]+[^\W\d_]){{2,}}(?![^\W_])")
SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .*_-]+[^\W\d_]){2,}(?![^\W_])")
#: Tokens read whole; those that only double letters keep their other signs, and each run of letters is read by itself.
SIGNED = re.compile(rf"[^\W\d_]{SIGN}|{SIGN}[^\W\d_]|([^\W\d_])\1\1")
LETTER_RUN = re.compile(r"[^\W\d_]{3,}")
TOKEN = re.compile(r"\S+")
#: What it costs to leave a sign out, at an end where it is mostly punctuation, and to read a doubled letter as one.
DROPPED, ENDING, HALVED = 6.0, 1.0, 6.0
WORD = re.compile(r"[^\W\d_]{3,}")
SEEN_HELD = 200_000


def _symbol_table() -> np.ndarray:
    """Code point -> one of SYMBOLS classes: a-z, other letters by hash, 0 for the rest."""
    out = np.zeros(0x3000, np.int64)
    for c in range(0x3000):
        ch = chr(c).lower()[:1]
        if len(ch) == 1 and "a" <= ch <= "z":
            out[c] = 1 + ord(ch) - 97
        elif ch.isalpha():
            out[c] = 27 + ord(ch[0]) % (SYMBOLS - 27)
    return out


_SYMBOL = _symbol_table()


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 0x3000, _SYMBOL[np.minimum(codes, 0x2FFF)], 0)


def char_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts over all texts, SYMBOLS cubed numbers; each task sends its sums only."""

    def run(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for b in batches:
            for part in slices(b, "text"):
                s = symbols(" " + "  ".join(texts(part)) + " ")
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"gram": used.astype(np.int32), "n": total[used]})

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SYMBOLS**3, np.int64)
    out[rows["gram"].to_numpy()] = rows["n"].to_numpy()
    return out


def char_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of a symbol after two others, smoothed by those after one."""
    c = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    two = c.sum(axis=0) + 0.01
    back = two / two.sum(axis=1, keepdims=True)
    return np.log((c + 5 * back[None]) / (c.sum(axis=2, keepdims=True) + 5))


def options(token: str) -> list[list[tuple[str, float]]]:
    """The lattice of one token: for each run of equal signs the strings that it may stand for, each with its cost."""
    out, i = [], 0
    while i < len(token):
        j = i
        while j < len(token) and token[j] == token[i]:
            j += 1
        c, n = token[i], j - i
        if c.isalpha():
            out.append([(c, HALVED * (n == 2)), (c * 2, 0.0)] if n > 1 else [(c, 0.0)])
        elif c in LEET:
            end = i == 0 or j == len(token)
            out.append([(x * k, 0.0) for x in LEET[c] for k in ((1,) if n == 1 else (1, 2))] + [("", ENDING if c in "!*#" and j == len(token) else DROPPED)] * end)
        else:
            out.append([("", DROPPED)])
        i = j
    return out


def decode(token: str, model: np.ndarray) -> str:
    """The likeliest reading of a token under the character model; states are the last two symbols."""
    paths: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for choices in options(token):
        best: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, read) in paths.items():
            for text, cost in choices:
                p, q, s = a, b, score - cost
                for c in text:
                    r = int(_SYMBOL[ord(c)]) if ord(c) < 0x3000 else 0
                    s += float(model[p, q, r])
                    p, q = q, r
                if (p, q) not in best or s > best[p, q][0]:
                    best[p, q] = (s, (read, text))  # readings share their beginnings, so long tokens stay linear
        paths = best
    read = max(((s + float(model[a, b, 0]), read) for (a, b), (s, read) in paths.items()), key=lambda x: x[0])[1]
    out = []
    while read:
        read, text = read
        out.append(text)
    return "".join(out[::-1])


def reading(token: str, model: np.ndarray) -> str:
    """A token as it is, or decoded if it may be disguised."""
    if not DISGUISED.search(token):
        return token
    return decode(token, model) if SIGNED.search(token) else LETTER_RUN.sub(lambda w: decode(w[0], model), token)


def _together(low: str) -> str:
    """Lower-case text with single letters that stand apart joined."""
    return SPACED.sub(lambda m: m[0][0] + re.sub(r"[ .*_-]+", "", m[0][1:]), low) if DISGUISED.search(low) else low


def restore(text: str, model: np.ndarray, cache: dict[str, str] | None = None) -> str:
    """Lower-case text with disguised tokens decoded; other tokens stay. The cache holds readings of short tokens under this model."""
    low = text.lower()
    if not DISGUISED.search(low):
        return low
    cache = {} if cache is None else cache

    def read(m: re.Match) -> str:
        token = m[0]
        out = cache.get(token)
        if out is None:
            out = reading(token, model)
            if len(token) <= 40:
                if len(cache) > SEEN_HELD:
                    cache.clear()
                cache[token] = out
        return out

    return TOKEN.sub(read, _together(low))


class Reader:
    """The different words of restored texts; each different token is read once while it is held."""

    def __init__(self, model: np.ndarray) -> None:
        self.model, self.words, self.decoded = model, {}, set()

    def __call__(self, text: str) -> tuple[set[str], bool]:
        """The words that WORD finds in restore(text), and whether that differs from the lower-case text."""
        low = text.lower()
        clear = _together(low)
        tokens = set(clear.split())
        if len(self.words) > SEEN_HELD:
            self.words, self.decoded = {}, set()
        long = []
        for t in tokens.difference(self.words):
            r = reading(t, self.model)
            if len(t) > 40:
                long.append((t, r))
                continue
            self.words[t] = WORD.findall(r)
            if r != t:
                self.decoded.add(t)
        tokens.difference_update(t for t, _ in long)
        words = set().union(*map(self.words.__getitem__, tokens), *(WORD.findall(r) for _, r in long))
        return words, clear != low or not self.decoded.isdisjoint(tokens) or any(t != r for t, r in long)


def features(word: str) -> list[str]:
    """Beginnings of 4 to 6 letters, and the word itself, marked."""
    return [word[:k] + "-" for k in (4, 5, 6, 7, 8) if len(word) > k] + [word]


def evidence(words: set[str], weight: dict[str, float], cache: dict[str, float]) -> float:
    """Minus the log of the chance that no word is toxic."""
    if len(cache) > SEEN_HELD:
        cache.clear()
    for w in words.difference(cache):
        cache[w] = max(map(weight.get, features(w), repeat(0.0)))
    return math.fsum(map(cache.__getitem__, words))


def sample_labelled(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> DataFrame:
    """text, toxic of at most about per_class labelled rows of each class, chosen by a hash of the id; rows of mod 5 = 0 are left out."""
    own = labels.where("toxic in (0, 1) and coalesce(crc32(cast(doc_id as string)) % 5, 0) <> 0").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    few = own.where(" or ".join(f"toxic = {k} and pmod(xxhash64(doc_id), {1 << 20}) < {min(1 << 20, int(per_class / v * (1 << 20)))}" for k, v in n.items()) or "false")
    return docs.select("doc_id", "text").join(few.hint("shuffle_hash"), "doc_id").select("text", "toxic")


def copy_keys(words: list[str]) -> list[int]:
    """COPY_BANDS keys of COPY_ROWS MinHash values of word pairs each; near copies share at least one."""
    joined = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)] or [" ".join(words)]
    pairs = np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in set(joined)], U64)
    with np.errstate(over="ignore"):
        values = [int(mix(pairs + U64(k << 32)).min()) for k in range(COPY_BANDS * COPY_ROWS)]
    return [hash((k, *values[k * COPY_ROWS : (k + 1) * COPY_ROWS])) for k in range(COPY_BANDS)]


def near_copies(docs: list[list[str]]) -> list[int]:
    """For each text the first of those that it is connected to by shared keys."""
    label, first = list(range(len(docs))), {}

    def root(k: int) -> int:
        while label[k] != k:
            label[k] = label[label[k]]
            k = label[k]
        return k

    for k, words in enumerate(docs):
        for key in copy_keys(words):
            a, b = root(first.setdefault(key, k)), root(k)
            label[max(a, b)] = min(a, b)
    return [root(k) for k in range(len(docs))]


def fit(rows: list[tuple[str, int]], model: np.ndarray) -> dict:
    """Feature weights and the curve, from (text, toxic) rows."""
    seen: dict[tuple[int, int], set[str]] = {}
    readings: dict[str, str] = {}
    rows = sorted((t or "", y) for t, y in rows)
    found = [WORD.findall(restore(text, model, readings)) for text, _ in rows]
    for group, words, (_, toxic) in zip(near_copies(found), found, rows, strict=True):
        seen.setdefault((group, toxic), set(words))
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for (_, toxic), words in seen.items():
        for f in {f for w in words for f in features(w)}:
            counts[f][toxic] += 1
    n = Counter(y for _, y in seen)
    if not n[1] or not n[0]:
        return {"weight": {}, "curve": (-30.0, 0.0) if not n[1] else (30.0, 0.0)}
    prior = n[1] / (n[0] + n[1])
    weight = {}
    for f, (clean, toxic) in counts.items():
        k = clean + toxic
        share = toxic / k
        z = 2.6
        low = (share + z * z / (2 * k) - z * np.sqrt(share * (1 - share) / k + z * z / (4 * k * k))) / (1 + z * z / k)
        if toxic >= 3 and low > max(0.5, prior + 0.4 * (1 - prior)):
            weight[f] = float(-np.log(1 - min(low, 0.999)))
    # A beginning may have all its evidence from a toxic word; where its other words are mostly clean, only that word counts.
    apart: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for (_, toxic), words in seen.items():
        for f in {f for w in words if w not in weight for f in features(w)[:-1] if f in weight}:
            apart[f][toxic] += 1
    for f, (clean, toxic) in apart.items():
        if clean > toxic:
            del weight[f]
    if not weight:
        return {"weight": {}, "curve": (float(np.log(min(prior, 0.49) / (1 - min(prior, 0.49)))), 0.0)}
    cache: dict[str, float] = {}
    x = np.array([evidence(words, weight, cache) for words in seen.values()])
    y = np.array([k[1] for k in seen], float)
    a, b = float(np.log(prior / (1 - prior))), 1.0
    w = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)  # classes weigh the same
    for _ in range(60):  # Newton steps, lightly held
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([(w * (y - p)).sum() - 1e-2 * a, (w * (y - p) * x).sum() - 1e-2 * (b - 1)])
        s = w * p * (1 - p)
        h = np.array([[s.sum() + 1e-2, (s * x).sum()], [(s * x).sum(), (s * x * x).sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
    return {"weight": weight, "curve": (a, b)}


def score(docs: DataFrame, model: np.ndarray, fitted: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, restored_changed (whether anything was decoded), score."""
    shared = docs.sparkSession.sparkContext.broadcast((model, fitted))  # a fixed table, and the features of a bounded sample
    kind = docs.schema[id_col].dataType.simpleString()
    cache: dict[str, float] = {}
    held: dict[str, Reader] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        chars, own = shared.value
        read = held.setdefault("it", Reader(chars))
        a, b = own["curve"]
        scores, changed = [], []
        for text in texts(batch):
            words, decoded = read(text)
            scores.append(1 / (1 + np.exp(-np.clip(a + b * evidence(words, own["weight"], cache), -30, 30))))
            changed.append(decoded)
        return pa.RecordBatch.from_pydict({id_col: batch.column(0), "restored_changed": pa.array(changed, pa.bool_()), "score": pa.array(scores, pa.float64())})

    return map_batches(docs.select(F.col(id_col), F.col(text_col).alias("text")), run, f"`{id_col}` {kind}, restored_changed boolean, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = char_model(char_counts(docs))
    rows = [(r["text"], r["toxic"]) for r in sample_labelled(docs, labels).toLocalIterator()]
    out = score(docs, model, fit(rows, model))
    held = (F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5, F.lit(-1)) == 0).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "restored_changed")
