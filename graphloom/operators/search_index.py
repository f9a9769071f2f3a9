"""A stored inverted index for full-text search, with block bounds.

The postings of a term are kept in blocks of at most BLOCK, by falling weight, each with its largest term frequency and least document length; from
these the largest score that the block can give follows for any average length, so the bounds stay valid when documents are added.
Rows are dealt by ranges of (term bucket, term, weight), which spreads the postings of a very frequent term over as many tasks as they need. A question
reads only the buckets and row groups of its terms; it scores each term's best block first, and then leaves out blocks whose bound, together with the
bounds of the question's other terms, stays below the k-th best score found so far. A document in a left-out block can't be among the best, so the result is exact.

An increment is a folder of its own that counts from when its statistics are written, last; running it again under its name replaces it. Readers see whole increments.

Defined results: rows with a null id are not indexed; null texts count as documents without length; documents whose id an earlier increment holds are left
out, rows that repeat an id within an increment are scored each by its own length; ties (of scores rounded to nine digits) go to the smaller id; questions without a known word have no rows.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import tokens
from graphloom.session import cut_lineage, remove, shared_folder, shuffles_dropped, stored

BLOCK = 128
#: A search takes its questions in shares that can give about so many scores of a document for a word, one share after another.
PAIRS = 5_000_000
K1, B = 1.2, 0.75


def weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What a term of this frequency adds to a document of this length, before its idf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def increments(spark: SparkSession, folder: str) -> DataFrame | None:
    """(batch, n_docs, n_long, total): one row for each whole increment; n_long documents have a length, total is their sum."""
    if not _there(spark, f"{folder}/stats"):
        return None
    return spark.read.option("basePath", f"{folder}/stats").schema("n_docs long, n_long long, total long, batch string").parquet(f"{folder}/stats")


def _whole(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    rows = spark.read.option("basePath", f"{folder}/{name}").schema(schema).parquet(f"{folder}/{name}")
    return rows.join(F.broadcast(increments(spark, folder).select("batch")), "batch", "left_semi")  # one short row for each increment


def _counted(batches):
    """Rows (id, w) become (id, dl, terms, tfs): a row's different words and how often it has each; dl is null for null."""
    for b in batches:
        w = b.column(1)
        dl = pc.list_value_length(w)
        n = dl.fill_null(0).to_numpy()
        words = w.flatten().dictionary_encode()
        many = max(len(words.dictionary), 1)
        key, tf = np.unique(np.repeat(np.arange(b.num_rows), n) * many + words.indices.to_numpy(), return_counts=True)
        ends = pa.array(np.searchsorted(key, np.arange(b.num_rows + 1) * many).astype(np.int32))
        terms = pa.ListArray.from_arrays(ends, words.dictionary.take(pa.array(key % many)))
        yield pa.RecordBatch.from_arrays([b.column(0), dl, terms, pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))], ["id", "dl", "terms", "tfs"])


def _blocks(batches):
    """Rows sorted by term and falling weight become blocks; a block ends where the term or the Arrow batch does, or after BLOCK rows."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        term = b.column(1)
        fresh = np.concatenate([[True], np.asarray(pc.not_equal(term[1:], term[:-1]))]) if n > 1 else np.ones(1, bool)
        first = np.flatnonzero(fresh)
        at = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
        cut = np.flatnonzero(at % BLOCK == 0)
        ends = pa.array(np.append(cut, n).astype(np.int32))
        tf, dl = b.column(3).to_numpy(), b.column(4).to_numpy()
        lists = [pa.ListArray.from_arrays(ends, b.column(k)) for k in (2, 3, 4)]
        most, least = np.maximum.reduceat(tf, cut), np.minimum.reduceat(dl, cut)
        rows = pa.array(cut)
        yield pa.RecordBatch.from_arrays([b.column(0).take(rows), term.take(rows), pa.array(most), pa.array(least), *lists], ["bucket", "term", "most_tf", "least_dl", "ids", "tfs", "dls"])


def add(docs: DataFrame, folder: str, batch: str, buckets: int = 256, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Indexes the documents that no earlier increment holds. Texts are split once: each row's terms are stored with their counts, and all else is read from there."""
    spark = docs.sparkSession
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    if increments(spark, folder) is not None:
        before = _whole(spark, folder, "docs", f"id {kind}, batch string").where(F.col("batch") != batch)
        rows = rows.join(before.select("id"), "id", "left_anti")
    form = f"id {kind}, dl int, terms array<string>, tfs array<int>"
    rows, at = stored(rows.select("id", tokens(F.col("text")).alias("w")).mapInArrow(_counted, form))
    with shuffles_dropped(spark):
        rows.select("id").distinct().write.mode("overwrite").parquet(f"{folder}/docs/batch={batch}")
    counts = rows.select("id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("id", "dl", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))
    if not rows.groupBy("id", "dl").count().where("count > 1").isEmpty():  # rows of one id and length count as one
        counts = counts.groupBy("id", "dl", "term").agg(F.sum("tf").cast("int").alias("tf"))
    dealt = counts.select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"), "term", "id", "tf", "dl")
    order = ("bucket", "term", F.desc(F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / 100))), "id")  # any length serves for the order: bounds hold whatever it is
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = f"bucket int, term string, most_tf int, least_dl int, ids array<{kind}>, tfs array<int>, dls array<int>"
    with shuffles_dropped(spark):
        dealt.mapInArrow(_blocks, schema).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings/batch={batch}")
    stats = rows.agg(F.count("*").alias("n_docs"), F.count("dl").alias("n_long"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("total"))
    stats.coalesce(1).write.mode("overwrite").parquet(f"{folder}/stats/batch={batch}")  # now the increment counts
    remove(spark, at)


def search(questions: DataFrame, folder: str, k: int = 10, true_idf: bool = False, id_type: str = "long", buckets: int = 256, few: int = 1000) -> DataFrame:
    """(query_id, rank, id, score): the k best documents of each question (query_id, text) by BM25; idf is ln 2 unless true_idf.

    If all questions together hold at most `few` different words, these are pushed down to the scan; else they meet the postings in a join.
    """
    spark = questions.sparkSession
    asked = questions.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qn"))
    out = f"query_id {dict(questions.dtypes)['query_id']}, rank int, id {id_type}, score double"
    if increments(spark, folder) is None:
        return spark.createDataFrame([], out)
    asked = cut_lineage(asked)
    known = [r["term"] for r in asked.select("term").distinct().limit(few + 1).collect()]
    blocks = _whole(spark, folder, "postings", f"bucket int, term string, most_tf int, least_dl int, ids array<{id_type}>, tfs array<int>, dls array<int>, batch string")
    if len(known) <= few:
        at = spark.createDataFrame([(t,) for t in known], "term string").select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("b")).distinct().collect()
        blocks = blocks.where(F.col("bucket").isin([r["b"] for r in at]) & F.col("term").isin(known))
    size = increments(spark, folder).agg(F.try_divide(F.sum("total"), F.sum("n_long")).alias("avgdl"), F.sum("n_docs").alias("n")).first()
    avgdl = F.lit(float(size["avgdl"] or 1.0))
    bound = F.max(weight(F.col("most_tf"), F.col("least_dl"), avgdl))
    # By term: its bound, its best block, and in how many documents it is. The lists of a block aren't read for this but in the best one.
    top = blocks.select("term", "most_tf", "least_dl", F.size("ids").alias("n")).groupBy("term").agg(bound.alias("bound"), F.sum("n").alias("df"))
    idf = F.log(1 + (F.lit(size["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5)) if true_idf else F.lit(math.log(2.0))
    asked = asked.join(top, "term").withColumn("factor", F.col("qn") * idf)
    asked = cut_lineage(asked.withColumn("rest", F.sum(F.col("bound") * F.col("factor")).over(Window.partitionBy("query_id")) - F.col("bound") * F.col("factor")))

    def scored(rows: DataFrame) -> DataFrame:
        """(query_id, id, dl, score) summed over the terms of the rows' blocks."""
        each = rows.select("query_id", "factor", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p")).select("query_id", "factor", "p.*")
        part = F.col("factor") * weight(F.col("tfs"), F.col("dls"), avgdl)
        return each.groupBy("query_id", F.col("ids").alias("id"), F.col("dls").alias("dl")).agg(F.sum(part).alias("score"))

    own = F.expr("struct(ids, tfs, dls)")
    best = blocks.groupBy("term").agg(F.max_by(own, weight(F.col("most_tf"), F.col("least_dl"), avgdl)).alias("b")).select("term", "b.*")
    by_score = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    floors = scored(asked.join(best, "term")).withColumn("r", F.row_number().over(by_score)).where(F.col("r") == k).select("query_id", F.col("score").alias("floor"))
    asked = asked.join(floors, "query_id", "left").select("query_id", "term", "factor", "rest", "df", F.coalesce("floor", F.lit(0.0)).alias("floor"))
    may = F.col("factor") * weight(F.col("most_tf"), F.col("least_dl"), avgdl) + F.col("rest") >= F.col("floor") * (1 - 1e-9) - 1e-12
    asked = cut_lineage(asked)
    pairs, = asked.agg(F.coalesce(F.sum("df"), F.lit(0))).first()
    shares = -(-pairs // PAIRS)

    def found(asked: DataFrame, blocks: DataFrame) -> DataFrame:
        best = scored(blocks.join(asked, "term").where(may)).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
        return best.select("query_id", "rank", "id", "score")

    if shares <= 1:
        return found(asked, blocks)
    path = f"{shared_folder(spark)}/found-{uuid.uuid4().hex}"
    stored(spark.createDataFrame([], out), path)
    for share in range(shares):  # what a share shuffles goes before the next one's is written
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(shares)) == share)
        words = [r["term"] for r in own.select("term").distinct().limit(few + 1).collect()]
        if words:
            near = blocks.where(F.col("term").isin(words)) if len(words) <= few else blocks
            stored(found(F.broadcast(own) if len(words) <= few and own.count() <= 10 * few else own, near), path, "append")
    return spark.read.schema(out).parquet(path)


def block_share(questions: DataFrame, folder: str) -> float:
    """The share of a folder's blocks that hold a word of the questions, for reports."""
    spark = questions.sparkSession
    words = questions.select(F.explode(tokens(F.col("text"))).alias("term")).distinct()
    blocks = _whole(spark, folder, "postings", "bucket int, term string, batch string")
    return blocks.join(words, "term", "left_semi").count() / max(blocks.count(), 1)
