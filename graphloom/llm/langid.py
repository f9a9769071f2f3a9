"""Language ID by segmentation-marginalised unigrams (operator 4).

Each language has a probability for every piece of a fixed public vocabulary. A word's likelihood in a language is summed
over all its segmentations into pieces by the forward algorithm; a text's is the product over its words, which are whole runs of letters of any
length: runs above LONGEST_SHORT letters are summed in logarithms, in parts that hand on the sums of their last positions. The probabilities come from
one expectation step: piece counts under all segmentations (forward-backward, equal piece weights), summed over every training
text. Counts are at most vocabulary x languages; more than MOST_LANGUAGES languages raise before anything is gathered, so the model is at most
MOST_LANGUAGES * 8 bytes for each piece (130 MB for 32,000), whatever the corpus.

The posterior of a whole text is near 1 for all but the shortest, whatever it holds; `foreign` doesn't saturate: it is the share of the
text's letters that stand in words for which another language is at least e**STRONG times likelier than the one predicted.

Defined results: null text, and text without a letter, is `und` with score 0 and nothing foreign; a tie goes to the language that sorts first;
without training rows every text is `und`; repeated rows count and are judged each; whole texts of any length are used; only the named columns are read, so
other columns can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.text import U64, WORD_BASE, map_batches, mix, powers, slices, sums, texts
from graphloom.session import table

WORD = re.compile(r"[^\W\d_]+")
START = "▁"
LONGEST_SHORT = 48  # letters; longer runs are summed in logarithms
PART = 65_536  # letters of a long run at a time
CELLS = 1 << 19  # positions of long runs at a time
MOST_LANGUAGES = 512
WORDS_HELD = 400_000
LETTERS_HELD = 16_000_000  # of long runs
ALPHA = 0.05
STRONG = 3.0


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[dict[str, int], int]:
    """(piece -> number, longest piece); number 0 stands for any code point that is no piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = [sp.id_to_piece(k) for k in range(sp.get_piece_size()) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k))]
    return {p: k + 1 for k, p in enumerate(found)}, max(map(len, found))


def words_of(text: str) -> list[str]:
    """Lower-case letter runs, whole."""
    return WORD.findall(text.lower())


@lru_cache(maxsize=2)
def piece_hashes(path: str) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, sorted hashes, numbers) of the pieces of each length."""
    vocab, _ = pieces(path)
    by: dict[int, list[str]] = {}
    for x in vocab:
        by.setdefault(len(x), []).append(x)
    out = []
    for n, own in sorted(by.items()):
        codes = np.array([[ord(c) for c in x] for x in own], U64)
        with np.errstate(over="ignore"):
            h = mix((codes * powers(WORD_BASE, n)[0]).sum(axis=1, dtype=U64))
        order = np.argsort(h)
        out.append((n, h[order], np.array([vocab[x] for x in own], np.int64)[order]))
    return out


class Lattice:
    """The edges (word, start, stop, piece) of all segmentations of many words, sorted by stop, then word.

    Each word follows the mark; of parts of words, which have none, only edges that stop after the lead are kept.
    """

    def __init__(self, words: list[str], path: str, mark: str = START, lead: int = 0) -> None:
        self.sizes = np.fromiter(map(len, words), np.int64, len(words)) + len(mark)
        codes = np.frombuffer((mark + mark.join(words)).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.concatenate([[0], np.cumsum(self.sizes)])
        word = np.repeat(np.arange(len(words)), self.sizes)
        place = np.arange(len(codes)) - at[word]
        room = self.sizes[word] - place
        up, down = powers(WORD_BASE, len(codes))
        owner, begin, end, piece = [], [], [], []
        with np.errstate(over="ignore"):
            total = sums(codes.astype(U64) * up)
            for n, hashes, numbers in piece_hashes(path):
                i = np.flatnonzero(room >= n)
                h = mix((total[i + n] - total[i]) * down[i])
                k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = hashes[k] == h
                if n == 1:  # a code point that is no piece
                    number = np.where(hit, numbers[k], 0)
                else:
                    i, number = i[hit], numbers[k[hit]]
                owner.append(word[i])
                begin.append(place[i])
                end.append(place[i] + n)
                piece.append(number)
        self.owner, self.begin, self.end, self.piece = (np.concatenate(x) for x in (owner, begin, end, piece))
        order = np.argsort(self.end * len(words) + self.owner, kind="stable")
        order = order[np.searchsorted(self.end[order], lead, side="right") :]
        for name in ("owner", "begin", "end", "piece"):
            setattr(self, name, getattr(self, name)[order])

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Sums over segmentations: words x positions x languages, for p of pieces x languages."""
        out = np.zeros((len(self.sizes), int(self.sizes.max(initial=0)) + 1, p.shape[1]))
        out[:, 0] = 1
        cuts = np.searchsorted(self.end, np.arange(out.shape[1] + 1))
        for j in range(1, out.shape[1]):
            e = slice(cuts[j], cuts[j + 1])
            if cuts[j] < cuts[j + 1]:
                own = self.owner[e]
                heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                out[own[heads], j] = np.add.reduceat(out[own, self.begin[e]] * p[self.piece[e]], heads, axis=0)
        return out

    def log_likelihood(self, p: np.ndarray) -> np.ndarray:
        f = self.forward(p)
        return np.log(f[np.arange(len(self.sizes)), self.sizes] + 1e-300)

    def expected(self, weight: float = 1e-3) -> np.ndarray:
        """The posterior of each edge when all pieces weigh the same."""
        size = int(self.piece.max(initial=0)) + 1
        f = self.forward(np.full((size, 1), weight))[:, :, 0]
        back = np.zeros_like(f)
        back[np.arange(len(self.sizes)), self.sizes] = 1
        order = np.argsort((self.begin.max(initial=0) - self.begin) * len(self.sizes) + self.owner, kind="stable")
        own, begin, end = self.owner[order], self.begin[order], self.end[order]
        cuts = np.searchsorted(-begin, -np.arange(f.shape[1])[::-1], side="left")
        cuts = np.append(cuts, len(own))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                o = own[a:b]
                heads = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
                back[o[heads], begin[a]] += np.add.reduceat(back[o, end[a:b]] * weight, heads)
        z = f[np.arange(len(self.sizes)), self.sizes]
        return f[self.owner, self.begin] * weight * back[self.owner, self.end] / z[self.owner]


def long_batches(words: list[str]) -> Iterable[list[str]]:
    """Long runs by falling length, in batches of at most CELLS positions; a longer run is alone."""
    words = sorted(words, key=len, reverse=True)
    at = 0
    while at < len(words):
        n = max(1, CELLS // (len(words[at]) + 2))
        yield words[at : at + n]
        at += n


class LongLattice:
    """Forward sums and edge posteriors of runs of falling length, as logarithms, part by part of the positions.

    A part's edges start at most one piece before it, so that the sums of those positions are all that it needs of what comes before.
    """

    def __init__(self, words: list[str], path: str) -> None:
        self.words, self.path, self.back = [START + w for w in words], path, pieces(path)[1]
        self.sizes = np.fromiter(map(len, self.words), np.int64, len(words))

    def part(self, at: int) -> tuple[int, Lattice]:
        """(lead, lattice) of the runs longer than at, from lead positions before it on."""
        lead = min(at, self.back)
        n = int((self.sizes > at).sum())
        return lead, Lattice([w[at - lead : at + PART] for w in self.words[:n]], self.path, "", lead)

    def starts(self) -> range:
        return range(0, int(self.sizes.max(initial=0)), PART)

    def forward(self, p: np.ndarray) -> Iterable[tuple[int, int, Lattice, np.ndarray]]:
        """(start of the part, lead, lattice, log sums of runs x positions from start - lead x languages)."""
        carry = np.zeros((len(self.words), 1, p.shape[1]))
        for at in self.starts():
            lead, lattice = self.part(at)
            n, width = len(lattice.sizes), int(lattice.sizes.max()) + 1
            out = np.zeros((n, width, p.shape[1]))
            out[:, : lead + 1] = carry[:n, -lead - 1 :]
            cuts = np.searchsorted(lattice.end, np.arange(width + 1))
            for j in range(lead + 1, width):
                e = slice(cuts[j], cuts[j + 1])
                own = lattice.owner[e]
                heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                last = out[own, j - 1]
                total = np.add.reduceat(np.exp(out[own, lattice.begin[e]] - last) * p[lattice.piece[e]], heads, axis=0)
                out[own[heads], j] = last[heads] + np.log(total)
            yield at, lead, lattice, out
            carry = out[:, max(0, width - 1 - self.back) :]

    def log_likelihood(self, p: np.ndarray) -> np.ndarray:
        """Runs x languages."""
        found = np.zeros((len(self.words), p.shape[1]))
        for at, lead, lattice, out in self.forward(p):
            n = len(lattice.sizes)
            found[:n] = out[np.arange(n), lattice.sizes]
        return found

    def expected(self, weight: float = 1e-3) -> Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(run, piece, posterior) of each edge when all pieces weigh the same, part by part.

        A posterior is that of its stop as a boundary, times the share of the forward sum there that came over this edge; so it needs no backward
        sums, whose scale would differ along a run.
        """
        size = len(pieces(self.path)[0]) + 1
        logs = np.zeros((len(self.words), int(self.sizes.max(initial=0)) + 1))
        for at, lead, _, out in self.forward(np.full((size, 1), weight)):
            logs[: len(out), at - lead : at - lead + out.shape[1]] = out[:, :, 0]
        bound = np.zeros_like(logs)
        bound[np.arange(len(logs)), self.sizes] = 1
        for at in reversed(self.starts()):
            lead, lattice = self.part(at)
            own, begin, end = lattice.owner, lattice.begin + at - lead, lattice.end + at - lead
            share = np.exp(logs[own, begin] - logs[own, end]) * weight
            cuts = np.searchsorted(end, np.arange(at + 1, int(end.max()) + 2))
            for a, b in zip(cuts[-2::-1], cuts[:0:-1], strict=True):
                share[a:b] *= bound[own[a:b], end[a]]
                bound[own[a:b], begin[a:b]] += share[a:b]  # edges of one run and stop have different starts
            yield own, lattice.piece, share


def gather(rows: DataFrame, path: str) -> DataFrame:
    """lang, piece, n: expected piece counts over all rows of (lang, text); each task sends its sums only."""
    size = len(pieces(path)[0]) + 1

    def run(batches):
        langs: dict[str, int] = {}
        sums: list[np.ndarray] = []
        held: dict[str, Counter[str]] = {}

        def take(words, own, piece, share):
            for lang, c in held.items():
                n = np.array([c.get(w, 0) for w in words], float)
                sums[langs[lang]] += np.bincount(piece, share * n[own], size)

        def flush():
            distinct = list({w: None for c in held.values() for w in c})
            short = [w for w in distinct if len(w) <= LONGEST_SHORT]
            for at in range(0, len(short), 8000):
                part = short[at : at + 8000]
                lattice = Lattice(part, path)
                take(part, lattice.owner, lattice.piece, lattice.expected())
            for part in long_batches([w for w in distinct if len(w) > LONGEST_SHORT]):
                for found in LongLattice(part, path).expected():
                    take(part, *found)
            held.clear()

        long = 0
        for batch in batches:
            for part in slices(batch, "text"):
                for lang, text in zip(part.column(0).to_pylist(), texts(part), strict=True):
                    if lang not in langs:
                        langs[lang] = len(langs)
                        sums.append(np.zeros(size))
                    found = words_of(text)
                    held.setdefault(lang, Counter()).update(found)
                    long += sum(n for n in map(len, found) if n > LONGEST_SHORT)
                if sum(map(len, held.values())) > WORDS_HELD or long > LETTERS_HELD:
                    flush()
                    long = 0
        flush()
        for lang, k in langs.items():
            used = np.flatnonzero(sums[k])
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(used), "piece": used.astype(np.int32), "n": sums[k][used]}, schema=pa.schema([("lang", pa.string()), ("piece", pa.int32()), ("n", pa.float64())]))

    return rows.select("lang", "text").mapInArrow(run, "lang string, piece int, n double")


def fit(rows: DataFrame, path: str | None = None) -> tuple[list[str], np.ndarray]:
    """(languages in order, pieces x languages probabilities) from rows of (lang, text) with lang not null."""
    path = path or default_path()
    size = len(pieces(path)[0]) + 1
    if rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    # Counts are rounded before they are summed, so that the order of tasks doesn't matter.
    counts = gather(rows, path).groupBy("lang", "piece").agg(F.sum(F.round(F.col("n") * 1000).cast("long")).alias("n")).toPandas()
    langs = sorted(counts["lang"].unique().tolist())
    p = np.full((size, len(langs)), ALPHA)
    place = counts["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(dtype=np.int64)
    p[counts["piece"].to_numpy(), place] += counts["n"].to_numpy() / 1000
    return langs, p / p.sum(axis=0) if langs else p


class Scorer:
    """Log-likelihoods of words by language, cached; the cache is emptied when full."""

    def __init__(self, p: np.ndarray, path: str) -> None:
        self.p, self.path = p, path
        self.place: dict[str, int] = {}
        self.rows = np.zeros((0, p.shape[1]))
        self.room, self.letters = WORDS_HELD * 8 // max(8, p.shape[1]), 0

    def learn(self, words: Iterable[str]) -> None:
        if len(self.place) > self.room or self.letters > LETTERS_HELD:
            self.place, self.rows, self.letters = {}, self.rows[:0], 0
        new = [w for w in dict.fromkeys(words) if w not in self.place]
        short, long = [w for w in new if len(w) <= LONGEST_SHORT], list(long_batches([w for w in new if len(w) > LONGEST_SHORT]))
        step = max(1, 64_000 // max(8, self.p.shape[1]))
        more = [Lattice(short[k : k + step], self.path).log_likelihood(self.p) for k in range(0, len(short), step)]
        more += [LongLattice(part, self.path).log_likelihood(self.p) for part in long]
        for w in (w for part in (short, *long) for w in part):
            self.place[w] = len(self.place)
        self.letters += sum(len(w) for part in long for w in part)
        self.rows = np.concatenate([self.rows, *more])

    def judge(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihoods by document and language, share of letters in words that strongly speak for another language than the best)."""
        self.learn(w for d in docs for w in d)
        at = np.fromiter((self.place[w] for d in docs for w in d), np.int64)
        lens = np.array([len(d) for d in docs], np.int64)
        out, foreign = np.zeros((len(docs), self.p.shape[1])), np.zeros(len(docs))
        some = np.flatnonzero(lens)
        if len(some):
            cuts, rows = np.concatenate([[0], np.cumsum(lens[some])])[:-1], self.rows[at]
            out[some] = np.add.reduceat(rows, cuts, axis=0)
            best = np.repeat(out[some].argmax(axis=1), lens[some])
            letters = np.fromiter((len(w) for d in docs for w in d), np.int64)
            strong = rows.max(axis=1) - rows[np.arange(len(rows)), best] >= STRONG
            foreign[some] = np.add.reduceat(letters * strong, cuts) / np.add.reduceat(letters, cuts)
        return out, foreign


def predict(docs: DataFrame, langs: list[str], p: np.ndarray, path: str | None = None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns in keep, lang_pred, score (the posterior of lang_pred with equal priors), foreign (the share of letters that strongly speak for another language)."""
    path = path or default_path()
    shared = docs.sparkSession.sparkContext.broadcast((langs, p))  # vocabulary x languages
    kinds = [(c, docs.schema[c].dataType.simpleString()) for c in keep]
    scorers: dict[str, Scorer] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, probs = shared.value
        if "it" not in scorers:
            scorers["it"] = Scorer(probs, path)
        raw = texts(batch, batch.schema.names[-1])
        found = [words_of(t) for t in raw]
        letters = np.array([any(any(map(str.isalpha, w)) for w in d) for d in found], bool)
        pred, score, foreign = ["und"] * len(raw), np.zeros(len(raw)), np.zeros(len(raw))
        if names and len(raw):
            total, foreign = scorers["it"].judge(found)
            total -= total.max(axis=1, keepdims=True)
            post = np.exp(total)
            post /= post.sum(axis=1, keepdims=True)
            best = post.argmax(axis=1)
            pred = [names[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
            score = np.where(letters, post[np.arange(len(raw)), best], 0.0)
        return pa.RecordBatch.from_pydict({c: batch.column(k) for k, (c, _) in enumerate(kinds)} | {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score), "foreign": pa.array(foreign)})

    names = [c for c, _ in kinds]
    text = "text" if "text" not in names else "__text"
    return map_batches(docs.select(*names, F.col(text_col).alias(text)), run, ", ".join(f"`{c}` {t}" for c, t in kinds) + ", lang_pred string, score double, foreign double", text)


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows with a language whose crc32(doc_id as text) mod 3 is not 1."""
    return docs.where("lang is not null and text is not null and coalesce(crc32(cast(doc_id as string)) % 3, 1) <> 1").select("lang", "text")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, p = fit(training_rows(docs))
    out = predict(docs.select("doc_id", "text"), langs, p)
    return out.select("doc_id", (F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3, F.lit(-1)) == 1).alias("held_out"), "lang_pred", "score", "foreign")
