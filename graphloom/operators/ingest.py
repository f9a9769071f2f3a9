"""Chunked ingestion that can be resumed: a manifest of what is done, failures that stay within their chunk, and runs that read only what is left.

A run numbers the files that the manifest doesn't hold in chunks, in order of path, and calls an extractor for each. A file that fails makes its chunk fail, and no other; the other
chunks' files are done. Results are written before the manifest's own part, so a run that dies in between has done nothing, and results count only if
the manifest holds their run and file. A file counts as known by path and version, which can be a content hash or what a listing tells.

Defined results: rows with a null path are left out, of rows that repeat a path the greatest version is read; null contents reach the extractor as None; a changed version is
a new file, whose results replace the old one's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.context import prefix_sums
from graphloom.session import cut_lineage

CHUNK = 50
MANIFEST = "path string, version string, chunk long, status string, error string, run int"
RESULTS = "path string, version string, entities array<string>, run int"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.option("basePath", path).schema(schema).parquet(path)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, version, chunk, status, error, run): what each run did, done or failed."""
    return _stored(spark, f"{folder}/manifest", MANIFEST)


def left(files: DataFrame, folder: str) -> DataFrame:
    """The files (path, version, content) that no run has done."""
    newest = files.where("path is not null").groupBy("path").agg(F.max_by("content", F.col("version")).alias("content"), F.max("version").alias("version"))
    done = manifest(files.sparkSession, folder).where("status = 'done'").select("path", F.col("version").alias("was"))
    return newest.join(done, (newest["path"] == done["path"]) & newest["version"].eqNullSafe(done["was"]), "left_anti")


def run(files: DataFrame, folder: str, extract: Callable[[str, str | None], list[str]], size: int = CHUNK) -> dict[str, int]:
    """Extracts what is left and returns the numbers of done and failed chunks and files."""
    spark = files.sparkSession
    number = (manifest(spark, folder).agg(F.max("run")).first()[0] or 0) + 1
    counted = prefix_sums(left(files, folder).withColumn("one", F.lit(1)), ("path",), "one", "place")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            entities, errors = [], []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    entities.append(extract(path, None if content is None or content != content else content))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  the extractor's own failures belong to the file
                    entities.append([])
                    errors.append(f"{type(e).__name__}: {e}"[:500])
            yield pdf[["path", "version", "chunk"]].assign(entities=entities, error=errors)

    todo = counted.select("path", F.col("version").cast("string").alias("version"), "content", F.floor((F.col("place") - 1) / size).alias("chunk"))
    got = cut_lineage(todo.mapInPandas(work, "path string, version string, chunk long, entities array<string>, error string"))
    chunks = got.groupBy("chunk").agg(F.count("error").alias("failures"))
    status = F.when(F.col("failures") > 0, "failed").otherwise("done")
    told = cut_lineage(got.join(chunks, "chunk").select("path", "version", "chunk", status.alias("status"), "error"))
    got.join(chunks.where("failures = 0"), "chunk", "left_semi").select("path", "version", "entities").write.mode("overwrite").parquet(f"{folder}/results/run={number}")
    if not told.isEmpty():
        told.write.mode("overwrite").parquet(f"{folder}/manifest/run={number}")
    out = {f"{s}_{w}": 0 for s in ("done", "failed") for w in ("chunks", "files")}
    for r in told.groupBy("status").agg(F.count_distinct("chunk").alias("chunks"), F.count("*").alias("files")).collect():
        out |= {f"{r['status']}_{w}": r[w] for w in ("chunks", "files")}
    return out


def results(spark: SparkSession, folder: str) -> DataFrame:
    """(path, version, entities, run) of the last version that is done of every file."""
    done = manifest(spark, folder).where("status = 'done'").select("path", "run")
    last = done.groupBy("path").agg(F.max("run").alias("run"))
    return _stored(spark, f"{folder}/results", RESULTS).join(last, ["path", "run"], "left_semi")
