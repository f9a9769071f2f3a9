"""Versioned tables of one folder: merging commits under an atomic pointer.

A table is a base and a delta, both bucketed and sorted by its key, so that a merge shuffles the rows of the commit and not the table: they look their
keys up in both. Rows whose content is unchanged are left alone; the others go to a new delta, which holds the old one's rest; when that has grown to a quarter of the
base, both become a new base. A commit of several tables and its outbox events is one log entry: a file named after the version, written elsewhere and then renamed,
which fails if that version exists. Nothing that readers see is ever overwritten, so a crash at any step leaves the last version as it was; of two
writers of one version one fails and may commit again. Entries hold the last number of each app (a stream and its batch), and a number that is not above it commits nothing.

Defined results: of rows that repeat a key within a commit the one of the greatest content hash counts, a deletion before others; rows with a null in the key
are left out; a deletion of an unknown key does nothing; an empty commit makes no version.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS, COMPACT = 16, 0.25
HASH, GONE, VERSION = "_hash", "_gone", "_version"


def _files(spark: SparkSession, folder: str):
    """(file system, path constructor) of a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, folder: str) -> list[int]:
    fs, path = _files(spark, folder)
    log = path(f"{folder}/log")
    return sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(log) if s.getPath().getName().endswith(".json")) if fs.exists(log) else []


def entry(spark: SparkSession, folder: str, version: int | None = None) -> dict:
    """The log entry of a version, or of the last one; before the first commit an entry without tables."""
    if version is None:
        version = max(versions(spark, folder), default=0)
    if not version:
        return {"version": 0, "tables": {}, "apps": {}, "outbox": None}
    fs, path = _files(spark, folder)
    stream = fs.open(path(f"{folder}/log/{version:020d}.json"))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _publish(spark: SparkSession, folder: str, new: dict) -> None:
    fs, path = _files(spark, folder)
    draft, final = path(f"{folder}/drafts/{uuid.uuid4().hex}"), path(f"{folder}/log/{new['version']:020d}.json")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(new).encode()))
    out.close()
    fs.mkdirs(final.getParent())
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(final).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(draft), fs.makeQualified(final), spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))


def _bucketed(spark: SparkSession, path: str, about: dict) -> DataFrame:
    """A folder that _store wrote, with its buckets known to the planner."""
    name = "bucketed_" + hashlib.sha256(path.encode()).hexdigest()[:32]
    if not spark.catalog.tableExists(name):
        keys = ", ".join(f"`{k}`" for k in about["keys"])
        spark.sql(f"create table {name} ({about['schema']}) using parquet clustered by ({keys}) sorted by ({keys}) into {about['buckets']} buckets location '{path}'")
    return spark.table(name)


def _store(rows: DataFrame, path: str, about: dict) -> None:
    """One sorted file for each bucket."""
    keys = about["keys"]
    name = "written_" + uuid.uuid4().hex
    rows.repartition(about["buckets"], *keys).write.bucketBy(about["buckets"], *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    rows.sparkSession.sql(f"drop table {name}")  # the files stay


def _parts(spark: SparkSession, about: dict | None) -> list[DataFrame]:
    """The delta and the base of a table, as far as there are any."""
    return [_bucketed(spark, about[k], about) for k in ("delta", "base") if about and about.get(k)]


def _view(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    if len(parts) > 1:
        delta, base = parts
        return delta.where(f"not {GONE}").unionByName(base.join(delta.select(*keys), keys, "left_anti"))
    return parts[0].where(f"not {GONE}")


def read(spark: SparkSession, folder: str, name: str, version: int | None = None, details: bool = False, schema: str | None = None) -> DataFrame:
    """A table as of a version (the last one if not given); with details also _version, in which a row was last written. A table without rows
    so far is empty, of the schema given, or else raises KeyError."""
    tables = entry(spark, folder, version)["tables"]
    if schema and name not in tables:
        return spark.createDataFrame([], schema)
    about = tables[name]
    out = _view(_parts(spark, about), about["keys"])
    return out.drop(HASH, GONE, *(() if details else (VERSION,)))


def changes(spark: SparkSession, folder: str, name: str, after: int, version: int | None = None) -> DataFrame:
    """Rows written (_gone: deleted) after a version, up to another, each as it last was: the mutation feed of a table."""
    about = entry(spark, folder, version)["tables"][name]
    out, parts = None, _parts(spark, about)
    for n, p in enumerate(parts):
        new = p.where(F.col(VERSION) > after)
        new = new.join(parts[0].select(*about["keys"]), about["keys"], "left_anti") if n else new
        out = new if out is None else out.unionByName(new)
    return out.drop(HASH)


def outbox(spark: SparkSession, folder: str, after: int = 0) -> DataFrame | None:
    """The events that versions above `after` committed, with their _version."""
    paths = [p for p in (entry(spark, folder, v).get("outbox") for v in versions(spark, folder) if v > after) if p]
    return spark.read.parquet(*paths) if paths else None


def present(spark: SparkSession, about: dict | None, rows: DataFrame, keys: dict[str, str]) -> DataFrame:
    """The rows whose columns (values of keys) name a live row of the table, whose own columns are the keys of keys. Only the rows are shuffled."""
    parts = _parts(spark, about)
    if not parts:
        return rows.limit(0)
    out, met = rows, F.lit(None).cast("boolean")
    for n, p in enumerate(parts):
        own = p.select(*(F.col(k).alias(f"_k{n}_{k}") for k in keys), (~F.col(GONE)).alias(f"_live{n}"))
        out = out.join(own, [F.col(c) == F.col(f"_k{n}_{k}") for k, c in keys.items()], "left")
        met = F.coalesce(met, F.col(f"_live{n}"))
    return out.where(F.coalesce(met, F.lit(False))).select(rows.columns)


def _merged(spark: SparkSession, at: str, about: dict | None, rows: DataFrame, keys: list[str], version: int, buckets: int) -> dict | None:
    """The table with the rows merged in, as a description for the log; the same description if nothing changes, None while it has no rows."""
    columns = [c for c in rows.columns if c != GONE]
    if about and (about["columns"] != columns or about["keys"] != keys):
        raise ValueError(f"the table has columns {about['columns']} and keys {about['keys']}")
    digest = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    gone = F.coalesce(F.col(GONE), F.lit(False)) if GONE in rows.columns else F.lit(False)
    new = rows.where(" and ".join(f"`{k}` is not null" for k in keys)).select(*columns, digest.alias(HASH), gone.alias(GONE))
    first = Window.partitionBy(*keys).orderBy(F.desc(GONE), F.desc(HASH))
    new = new.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    parts = _parts(spark, about)
    for n, p in enumerate(parts):
        new = new.join(p.select(*keys, F.col(HASH).alias(f"_was{n}"), F.col(GONE).alias(f"_off{n}")), keys, "left")
    if parts:
        was = F.coalesce(*(F.when(F.col(f"_was{n}").isNotNull(), F.struct(F.col(f"_was{n}").alias("h"), F.col(f"_off{n}").alias("g"))) for n in range(len(parts))))
        new = new.withColumn("_before", was)
        live = F.coalesce(~F.col("_before")["g"], F.lit(False))
        new = new.where(F.when(F.col(GONE), live).otherwise(~live | (F.col("_before")["h"] != F.col(HASH))))
    else:
        new = new.where(f"not {GONE}")
    new = new.select(*columns, HASH, GONE, F.lit(version).cast("long").alias(VERSION))
    out = about or {"keys": keys, "columns": columns, "buckets": buckets, "base": None, "delta": None, "n_base": 0}
    out = {**out, "schema": ", ".join(f"`{c}` {t}" for c, t in new.dtypes)}
    path = f"{at}/delta-{uuid.uuid4().hex}"
    if parts and len(parts) > 1:
        _store(new, f"{path}-own", out)
        new = _bucketed(spark, f"{path}-own", out)
        if new.isEmpty():
            return about
        new = new.unionByName(parts[0].join(new.select(*keys), keys, "left_anti"))
    _store(new, path, out)
    n = _bucketed(spark, path, out).count()
    if not parts:
        return {**out, "base": path, "n_base": n} if n else None
    if not n:
        return about
    if n <= COMPACT * out["n_base"]:
        return {**out, "delta": path}
    whole = f"{at}/base-{uuid.uuid4().hex}"
    _store(_view([_bucketed(spark, path, out), parts[-1]], keys), whole, out)
    return {**out, "base": whole, "delta": None, "n_base": _bucketed(spark, whole, out).count()}


def commit(spark: SparkSession, folder: str, tables: dict, events: DataFrame | None = None, app: str = "", number: int | None = None, buckets: int = BUCKETS) -> int:
    """Merges rows into tables and returns the version that holds them.

    tables: name -> (rows, key columns), or name -> a function of the tables merged so far in this commit that gives these, so that edges can ask
    which nodes there are. Rows may have a boolean column _gone. With a number, batches of an app that were committed before are not committed again.
    """
    last = entry(spark, folder)
    if number is not None and last["apps"].get(app, -1) >= number:
        return last["version"]
    new = {**last, "version": last["version"] + 1, "tables": dict(last["tables"]), "outbox": None}
    for name, what in tables.items():
        rows, keys = what(new["tables"]) if callable(what) else what
        merged = _merged(spark, f"{folder}/{name}", last["tables"].get(name), rows, list(keys), new["version"], buckets)
        new["tables"] |= {name: merged} if merged else {}
    if events is not None and not events.isEmpty():
        new["outbox"] = f"{folder}/outbox/{uuid.uuid4().hex}"
        events.withColumn(VERSION, F.lit(new["version"]).cast("long")).write.parquet(new["outbox"])
    if number is not None:
        new["apps"] = {**last["apps"], app: number}
    elif new["tables"] == last["tables"] and new["outbox"] is None:
        return last["version"]
    _publish(spark, folder, new)
    return new["version"]


def stream_sink(folder: str, app: str, tables, events=None, buckets: int = BUCKETS):
    """A foreachBatch function: a batch's tables(batch) and events(batch) are one commit, and a batch that the stream runs again is not committed twice."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if entry(spark, folder)["apps"].get(app, -1) >= number:
            return
        batch = batch.persist()
        try:
            commit(spark, folder, tables(batch), events(batch) if events else None, app, number, buckets)
        finally:
            batch.unpersist()

    return write
