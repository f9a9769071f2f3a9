"""Corpus preparation: documents through five stages, each of them written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Defined results: an empty table passes every stage empty; null and empty texts have no language and go in the first stage; rows that repeat an id
are judged each by their own text, but for the near-duplicate stage (see there); columns beyond those of documents are dropped; the parts
that stages hand on are deleted when the next one is written, only the last stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontam, langid, ngram_join, pii
from graphloom.session import cut_lineage, remove, shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: From this share of letters in words of another language on, a text has no main language: that one holds less than two thirds of it.
MIXED = 1 / 3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of one recognised language, with that as their lang: rejects are those without a letter, and mixtures of languages."""
    langs, p = langid.fit(langid.training_rows(docs))
    out = langid.predict(docs.select(COLUMNS), langs, p, keep=tuple(COLUMNS))
    return out.where(f"lang_pred <> 'und' and foreign < {MIXED}").withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group connected by five-word shingle similarity of 0.8 or more: the document of the least id, and if rows repeat
    that id, the one that comes first by text, language, source and size. Rows with a null id all stay.
    """
    gone = ngram_join.join_classes(docs).where("class_id < doc").select("doc").distinct()
    kept = docs.select(COLUMNS).join(gone.hint("shuffle_hash"), F.col("doc_id") == F.col("doc"), "left_anti")
    again = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("again")).count().where("count > 1").select("again")
    again = cut_lineage(again)
    if again.isEmpty():
        return kept
    again = again.hint("shuffle_hash")
    once = kept.join(again, F.col("doc_id") == F.col("again"), "left_anti")
    order = Window.partitionBy("doc_id").orderBy("text", "lang", "source", "n_chars")
    first = kept.join(again, F.col("doc_id") == F.col("again"), "left_semi").withColumn("__k", F.row_number().over(order)).where("__k = 1")
    return once.select(COLUMNS).union(first.select(COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    out = decontam.scan(docs, table(spark, sf_dir, "benchmark"), keep=tuple(COLUMNS))
    return out.where(F.size("hits") == 0).select(COLUMNS)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each span of personal data replaced by its kind."""
    out = pii.find(docs, keep=("doc_id", "lang", "source"), redact=True, learnt=pii.learn(docs))
    return out.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.char_length("redacted").cast("long").alias("n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), and whether decoding them gives the text's bytes."""
    out = bpe.encode(docs, decode=True)
    digest = F.sha2("decoded", 256).alias("decoded_sha256")
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", digest)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("pii", redact_pii),
    ("byte_bpe", encode),
]

#: The learned stages have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/corpus_pipeline-{uuid.uuid4().hex}"
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs
