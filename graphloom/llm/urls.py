"""URL filters by host word segmentation (operator 8).

Rules decide first: the longest rule whose host is the url's host or a parent of it, and whose path starts the url's path. For the
rest, host labels and path segments are split into words by a unigram Viterbi (exact corpus counts of all pages, looked up by
word for the substrings of urls; a hashed table of fixed size only spares look-ups of unknown ones), and multinomial naive Bayes scores the words.

Naive Bayes learns from the pages that a rule decides: the rule's verdict is the label, the words of their urls are counted by class in
SLOTS hashed counters. Two short lists of words speak for a class from the start and weigh SEED_SHARE of what is counted. Pages whose
crc32(id as text) mod HELD_OUT is 0 are never learnt from, so accuracy can be measured on those that a rule decides. Words that the rules are made of, endings of hosts, and words of one or two letters
(language folders) are left out of the model: labels follow from them, and it would learn nothing else. Words whose rates differ by less than CERTAIN standard errors say nothing.

Defined results: a null url, or one without "://", has empty host and path and no rule; it has no words, so the prior decides;
without any page that a rule decides the lists alone are the model; words never seen say nothing; a score of
exactly 0.5 blocks; an unclosed script or style hides the rest of its page; repeated rows are judged each; only the named columns are read, so
other columns can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.text import slices, texts
from graphloom.operators.components import heavy_join
from graphloom.session import cut_lineage, table

#: Fixed values: (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Words of hosts and paths that speak for a class before anything is learnt.
BLOCK_WORDS = "adult bet bets bonus buy casino cheap cialis click coupon crack credit deal dating diet escort farm fast free gambling hack hot jackpot keygen loan loans lottery lucky meds money nude offer pharma pharmacy pill pills poker porn promo replica rich scam sex slots spam torrent viagra warez win winner xxx".split()
ALLOW_WORDS = "about academy archive article blog book books city club college community contact docs education encyclopedia forum garden gallery guide health help history home journal lab learn library local magazine map media museum music news online paper press project radio recipe research review school science shop sport store story support team travel university weather wiki world".split()
SLOTS, LONGEST, LONGEST_RUN = 1 << 18, 20, 400
HELD = 200_000
SEED_SHARE, SMOOTHING, HELD_OUT = 0.05, 0.5, 5
#: Linear: a script that isn't closed reaches to the end, and a tag stops at the next one.
TAG = re.compile(r"<(script|style)\b.*?(?:</\1>|\Z)|<[^<>]*>", re.S | re.I)
LETTERS = re.compile(r"[a-z]{1,20}")


def slot(word: str) -> int:
    return zlib.crc32(word.encode()) % SLOTS


def exact_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(word, n) of all words of all pages' text; tasks add up what they hold before the shuffle."""

    def run(batches):
        seen: Counter[str] = Counter()
        told = lambda: pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
        for b in batches:
            for part in slices(b, "html"):
                for html in texts(part, "html"):
                    seen.update(LETTERS.findall(TAG.sub(" ", html).lower()))
                    if len(seen) > HELD:
                        yield told()
                        seen.clear()
        yield told()

    return pages.select(F.col(html_col).alias("html")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def slot_counts(words: DataFrame) -> np.ndarray:
    """Counts of (word, n) by hash slot, at least those of each word in it; each task sends one row for each slot it used."""

    def run(batches):
        total = np.zeros(SLOTS, np.int64)
        for b in batches:
            np.add.at(total, [slot(w) for w in b.column(0).to_pylist()], b.column(1).to_numpy(zero_copy_only=False))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"slot": used.astype(np.int32), "n": total[used]})

    out = np.zeros(SLOTS, np.int64)
    rows = words.select("word", "n").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return out


def word_counts(pages: DataFrame, html_col: str = "html") -> np.ndarray:
    return slot_counts(exact_counts(pages, html_col))


class Splitter:
    """Unigram Viterbi over letters, from the counts of the known substrings; unknown words cost more the longer they are."""

    def __init__(self, corpus: int, words: list[str]) -> None:
        boost = max(50, corpus // 20_000)
        self.own = Counter({w: boost * n for w, n in Counter(words).items()})
        self.total = math.log(float(corpus + sum(self.own.values())) + 1)

    def cost(self, w: str, known: dict[str, int]) -> float:
        n = known.get(w, 0) + self.own[w]
        return (self.total - math.log(n) + 0.5) if n > 2 and (len(w) > 1 or w == "a") else self.total + 2.3 * len(w)

    def split(self, s: str, known: dict[str, int]) -> list[str]:
        best, back = [0.0] + [math.inf] * len(s), [0] * (len(s) + 1)
        for j in range(1, len(s) + 1):
            for i in range(max(0, j - LONGEST), j):
                c = best[i] + self.cost(s[i:j], known)
                if c < best[j]:
                    best[j], back[j] = c, i
        out, j = [], len(s)
        while j:
            out.append(s[back[j] : j])
            j = back[j]
        return out[::-1]


def tokens(host: str, path: str) -> list[str]:
    """The runs of letters of an url, in parts of at most LONGEST_RUN."""
    return [t[k : k + LONGEST_RUN] for t in LETTERS_RUN.findall(host + " " + path.lower()) for k in range(0, len(t), LONGEST_RUN)]


def segmented(runs: DataFrame, words: DataFrame, slots: np.ndarray) -> DataFrame:
    """(token, own, n, n_block, n_allow) of each different token of runs (token, label): its words, how many rows have it, and how many of either label.

    Substrings are looked up by word; those whose slot holds too little for any word are left out before that.
    """
    spark = runs.sparkSession
    shared = spark.sparkContext.broadcast(slots)  # SLOTS numbers, whatever the input
    corpus = int(slots.sum())
    of = lambda label: F.count(F.when(F.col("label") == label, 1)).alias(f"n_{label}")
    runs = cut_lineage(runs.groupBy("token").agg(F.count("*").alias("n"), of("block"), of("allow")))

    def parts(batches):
        full = shared.value
        listed = set(BLOCK_WORDS + ALLOW_WORDS)
        for b in batches:
            for small in (b.slice(k, 1000) for k in range(0, b.num_rows, 1000)):
                own, of = [], []
                for t in small.column(0).to_pylist():
                    got = {t[i:j] for i in range(len(t)) for j in range(i + 1, min(len(t), i + LONGEST) + 1)}
                    got = [w for w in got if (len(w) > 1 or w == "a") and (full[slot(w)] > 2 or w in listed and full[slot(w)])]
                    own += got
                    of += [t] * len(got)
                yield pa.RecordBatch.from_pydict({"word": pa.array(own, pa.string()), "token": pa.array(of, pa.string())})

    pairs = cut_lineage(runs.select("token").mapInArrow(parts, "word string, token string"))
    counts = words.select("word", F.col("n").alias("k")).join(pairs.groupBy("word").agg(F.count("*").alias("n")), "word").select("word", "k", "n")
    found = heavy_join(pairs, cut_lineage(counts), ["word"], pairs.count())
    known = found.groupBy("token").agg(F.collect_list("word").alias("words"), F.collect_list("k").alias("ks"))

    def split(batches):
        splitter = Splitter(corpus, BLOCK_WORDS + ALLOW_WORDS)
        for b in batches:
            own = [splitter.split(t, dict(zip(w or [], k or [], strict=True))) for t, w, k in zip(*(b.column(c).to_pylist() for c in (0, 4, 5)), strict=True)]
            yield pa.RecordBatch.from_pydict({"token": b.column(0), "own": pa.array(own, pa.list_(pa.string()))} | {c: b.column(k) for k, c in ((1, "n"), (2, "n_block"), (3, "n_allow"))})

    return runs.join(known, "token", "left").select("token", "n", "n_block", "n_allow", "words", "ks").mapInArrow(split, "token string, own array<string>, n long, n_block long, n_allow long")


#: By how many standard errors the rates of a word must differ between the classes before it counts.
CERTAIN = 3.0
#: The share of pages to block, before any word is seen. What rules block of the pages that they decide says nothing about the others.
PRIOR = 0.2
#: Endings of hosts, which rules decide on, as they do on languages, whose folders have two letters.
ENDINGS = ("com", "net", "org", "edu", "gov", "info", "biz")


def rule_words(rules=None) -> list[str]:
    """The words that labels are made of: those of the rules, and endings of hosts. A model that saw them would only learn the rules again."""
    return sorted({w for _, h, p in (RULES if rules is None else rules) for w in LETTERS_RUN.findall(h + p)} | set(ENDINGS))


class Bayes:
    """Multinomial naive Bayes over hashed words: log odds of block for each slot, 0 for slots that were never counted, for words of
    one or two letters (languages), and for left_out words."""

    def __init__(self, blocked: np.ndarray, allowed: np.ndarray, left_out: list[str] | None = None) -> None:
        own = [blocked.astype(float), allowed.astype(float)]
        self.left_out = set(left_out or ())
        for counts, words in zip(own, (BLOCK_WORDS, ALLOW_WORDS), strict=True):
            share = max(1.0, SEED_SHARE * float(blocked.sum() + allowed.sum()) / (len(BLOCK_WORDS) + len(ALLOW_WORDS)))
            np.add.at(counts, [slot(w) for w in words], share)
        used = (own[0] + own[1]) > 0
        rate = [(c + SMOOTHING) / (c.sum() + SMOOTHING * used.sum()) for c in own]
        self.weight = np.where(used, np.log(rate[0]) - np.log(rate[1]), 0.0)
        chance = CERTAIN * np.sqrt(1 / (own[0] + SMOOTHING) + 1 / (own[1] + SMOOTHING))
        told = np.zeros(len(chance), bool)
        told[[slot(w) for w in BLOCK_WORDS + ALLOW_WORDS]] = True
        self.weight[(np.abs(self.weight) < chance) & ~told] = 0.0  # what chance explains says nothing
        self.start = math.log(PRIOR / (1 - PRIOR))

    def odds(self, words: list[str]) -> float:
        return float(sum(self.weight[slot(w)] for w in words if self.heard(w)))

    def heard(self, w: str) -> bool:
        return len(w) > 2 and w not in self.left_out


def learnt(facts: DataFrame, rules=None) -> Bayes:
    """The model of the labelled words of facts, without those that make the labels; SLOTS rows at most come to the driver."""
    left_out = rule_words(rules)
    words = facts.where("n_block + n_allow > 0").select(F.explode("own").alias("word"), "n_block", "n_allow")
    words = words.where((F.length("word") > 2) & ~F.col("word").isin(left_out))
    rows = words.groupBy((F.crc32("word") % SLOTS).cast("int").alias("slot")).agg(F.sum("n_block").alias("b"), F.sum("n_allow").alias("a")).toPandas()
    blocked, allowed = np.zeros(SLOTS), np.zeros(SLOTS)
    blocked[rows["slot"].to_numpy()], allowed[rows["slot"].to_numpy()] = rows["b"].to_numpy(), rows["a"].to_numpy()
    return Bayes(blocked, allowed, left_out)


def host_path(url):
    """Native columns (host, path)."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lower, path


def rule_columns(host, path, rules=None):
    """Native columns (rule, verdict) of the longest rule that fits, else null."""
    rules = sorted(RULES if rules is None else rules, key=lambda r: -len(r[1] + r[2]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in reversed(rules):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, rules=None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", counts: np.ndarray | None = None) -> DataFrame:
    """id_col, host, path, rule, words (segmented), score (of block by the model), verdict. counts are slot_counts, if known."""
    spark = pages.sparkSession
    vocabulary = cut_lineage(exact_counts(pages, html_col))
    counts = slot_counts(vocabulary) if counts is None else counts
    host, path = host_path(url_col)
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    base = pages.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col).alias("__id"), host.alias("host"), path.alias("path"))
    taught = F.coalesce(F.crc32(F.col("__id").cast("string")) % HELD_OUT, F.lit(0)) != 0
    base = cut_lineage(base.withColumns({"rule": rule, "told": verdict}).withColumn("label", F.when(taught, F.col("told"))))

    def cut(batches):
        for b in batches:
            for small in (b.slice(k, 2000) for k in range(0, b.num_rows, 2000)):
                own = [tokens(h, p) for h, p in zip(small.column(1).to_pylist(), small.column(2).to_pylist(), strict=True)]
                n = [len(x) for x in own]
                at = np.concatenate([np.arange(k) for k in n]).astype(np.int32) if n else np.zeros(0, np.int32)
                row = np.repeat(np.arange(small.num_rows), n)
                yield pa.RecordBatch.from_pydict({"row": small.column(0).take(pa.array(row)), "at": at, "token": pa.array([t for x in own for t in x], pa.string()), "label": small.column(3).take(pa.array(row))})

    runs = cut_lineage(base.select("__row", "host", "path", "label").mapInArrow(cut, "row long, at int, token string, label string"))
    facts = cut_lineage(segmented(runs, vocabulary, counts))
    bayes = learnt(facts, rules)
    shared = spark.sparkContext.broadcast(bayes)  # SLOTS numbers, whatever the input

    def weigh(batches):
        model = shared.value
        for b in batches:
            odds = [round(model.odds(w) * 1e6) for w in b.column(1).to_pylist()]  # whole numbers, so that the order of sums doesn't matter
            yield pa.RecordBatch.from_pydict({"token": b.column(0), "own": b.column(1), "odds": pa.array(odds, pa.int64()), "n": b.column(2)})

    weighed = cut_lineage(facts.select("token", "own", "n").mapInArrow(weigh, "token string, own array<string>, odds long, n long"))
    own = heavy_join(runs.select("row", "at", "token"), weighed, ["token"], runs.count()).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "own"))).alias("parts"), F.sum("odds").alias("odds"))
    split = own.select("row", F.flatten(F.col("parts.own")).alias("words"), "odds")
    score = 1 / (1 + F.exp(-(F.lit(bayes.start) + F.coalesce("odds", F.lit(0)) / 1e6)))
    words = F.coalesce("words", F.array().cast("array<string>")).alias("words")
    out = base.join(split, F.col("__row") == F.col("row"), "left").select(F.col("__id").alias(id_col), "host", "path", "rule", words, score.alias("score"), "told")
    return out.withColumn("verdict", F.coalesce("told", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))).drop("told")


def accuracy(judged: DataFrame, rules=None, id_col: str = "page_id") -> DataFrame:
    """One row (n, right, blocked): pages with a rule that were not learnt from, how many the model judges as the rule does, and how many the rule blocks."""
    _, told = rule_columns(F.col("host"), F.col("path"), rules)
    rows = judged.where(f"rule is not null and coalesce(crc32(cast(`{id_col}` as string)) % {HELD_OUT}, 0) = 0").select(told.alias("told"), F.when(F.col("score") >= 0.5, "block").otherwise("allow").alias("own"))
    return rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("told") == F.col("own"), 1)).alias("right"), F.count(F.when(F.col("told") == "block", 1)).alias("blocked"))


LETTERS_RUN = re.compile(r"[a-z]+")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))
