"""Secret scans over an incremental blob ledger (operator 6).

Every text is a blob, addressed by the sha256 of its bytes. The ledger holds one row for each scanned (blob, rule version);
only pairs it does not hold are scanned, once each, and findings are joined back to every row that carries the blob. A ledger is stored as
Parquet, by rule version: `append` adds what a scan found, `stored` reads one version, and `increment` does both around a scan. The blobs of very
common copies are looked up in a table of bounded size instead of meeting all their rows in one task.

Defined results: null text is the empty blob (no findings); repeated rows and copies share one scan and each get its
findings; a blob that the ledger lacks under the rule version has null findings; rows with a null id are kept; only the named columns are read, so other columns can't clash; an empty table
gives an empty result; spans are code points, end exclusive, over whole texts of any length.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.text import map_batches, texts
from graphloom.operators.components import heavy_join
from graphloom.session import cut_lineage, shared_folder, table

RULE_VERSION = "2"
KINDS = ("assign", "access", "hex")
#: The patterns of the base rules; letters of the key word in either case, ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KEY_WORDS = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
#: Added rules: well-known public token formats. Name, a literal that must occur, pattern; none starts again inside the run that it reads.
ADDED = [
    ("pem", "-----BEGIN", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----")),
    ("github", "gh", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}")),
    ("slack", "xox", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}")),
    ("jwt", "eyJ", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}")),
    ("google", "AIza", re.compile(r"\bAIza[A-Za-z0-9_-]{35}")),
]
FINDINGS = "array<struct<kind:string,start:int,stop:int>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, stop) of the base rules, in that order."""
    out = []
    if KEY_WORDS.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def added_spans(text: str) -> list[tuple[int, str, int]]:
    return [(m.start(), kind, m.end()) for kind, literal, pattern in ADDED if literal in text for m in pattern.finditer(text)]


def address(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, blob (lowercase hex sha256), text with null as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col), F.sha2(text, 256).alias("blob"), text.alias("text"))


def stored(spark: SparkSession, path: str, rule_version: str = RULE_VERSION) -> DataFrame | None:
    """The ledger's rows of one rule version (a partition of the Parquet folder), or None before the first increment.

    One row for each blob, though a scan was appended twice or increments overlapped: scans of a blob by the same rules are equal.
    """
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return None
    return spark.read.schema(f"blob string, base {FINDINGS}, added {FINDINGS}, rule_version string").parquet(path).where(F.col("rule_version") == rule_version).dropDuplicates(["blob"])


def append(path: str, found: DataFrame) -> None:
    """Adds the rows of a scan (of blobs that the ledger lacks) to the stored ledger."""
    found.select("blob", "base", "added", "rule_version").write.mode("append").partitionBy("rule_version").parquet(path)


def increment(spark: SparkSession, path: str, docs: DataFrame, rule_version: str = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scans what the stored ledger lacks, appends it, and returns the new rows (read back by their blobs)."""
    before = stored(spark, path, rule_version)
    found = cut_lineage(scan_new(docs, before, rule_version, id_col, text_col))
    append(path, found)
    return found


def unseen(blobs: DataFrame, ledger: DataFrame | None, rule_version: str, id_col: str = "doc_id") -> DataFrame:
    """One row (blob, holder) for each blob that the ledger lacks under this rule version."""
    firsts = blobs.groupBy("blob").agg(F.min(id_col).alias("holder"))
    if ledger is not None:
        firsts = firsts.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    return firsts


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """blob, base and added findings, for each row of (blob, text)."""

    pair = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, added = [], []
        for text in texts(batch):
            base.append([{"kind": KINDS[k], "start": a, "stop": b} for a, k, b in base_spans(text)])
            added.append([{"kind": k, "start": a, "stop": b} for a, k, b in added_spans(text)])
        return pa.RecordBatch.from_pydict({"blob": batch.column(0), "base": pa.array(base, pair), "added": pa.array(added, pair)})

    return map_batches(blobs.select("blob", "text"), run, f"blob string, base {FINDINGS}, added {FINDINGS}")


def scan_new(docs: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger's new rows: blob, rule_version, base, added."""
    all_blobs = address(docs, id_col, text_col)
    todo = unseen(all_blobs.select(id_col, "blob"), ledger, rule_version, id_col)
    held = F.col("x.blob").eqNullSafe(F.col("y.blob")) & F.col(f"x.{id_col}").eqNullSafe(F.col("y.holder"))
    rows = all_blobs.alias("x").join(todo.hint("shuffle_hash").alias("y"), held, "left_semi").select("blob", "text")
    found = scan_blobs(rows).groupBy("blob").agg(F.first("base").alias("base"), F.first("added").alias("added"))  # one id may hold one blob twice
    return found.withColumn("rule_version", F.lit(rule_version))


def findings_by_path(docs: DataFrame, ledger: DataFrame, rule_version: str = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, blob, base, added for every row of docs."""
    rows = cut_lineage(address(docs, id_col, text_col).select(id_col, "blob"))
    own = ledger.where(F.col("rule_version") == rule_version).select("blob", "base", "added")
    facts = rows.groupBy("blob").agg(F.count("*").alias("n")).withColumn("met", F.lit(True)).join(own, "blob", "left").select("blob", "met", "base", "added", "n")
    return heavy_join(rows, cut_lineage(facts), ["blob"], rows.count()).select(id_col, "blob", "base", "added")


def joined(spans):
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = findings_by_path(docs, scan_new(docs))
    none = F.array().cast(FINDINGS)
    base, added = F.coalesce("base", none), F.coalesce("added", none)
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    rank = F.create_map(*(F.lit(x) for k in enumerate((*KINDS, *(a for a, _, _ in ADDED))) for x in k[::-1]))
    order = F.transform(F.concat(base, added), lambda x: F.struct(x["start"].alias("start"), rank[x["kind"]].alias("rank"), x["stop"].alias("stop"), x["kind"].alias("kind")))
    return out.select("doc_id", *(count(k) for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.array_sort(order)).alias("spans"))


def blob_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of every document under two increments of a stored ledger: blob, version (by which increment it was scanned), n_paths (how
    many document versions carry it), n_hex. The second version writes every line break as a blank, so one-line texts are not scanned again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    versions = [docs, docs.withColumn("text", F.translate("text", "\n", " "))]
    path = f"{shared_folder(spark)}/secret-ledger-{uuid.uuid4().hex}"
    scans = [increment(spark, path, v).select("blob", F.lit(k + 1).alias("version")) for k, v in enumerate(versions)]
    paths = versions[0].select(F.sha2("text", 256).alias("blob")).union(versions[1].select(F.sha2("text", 256))).groupBy("blob").agg(F.count("*").alias("n_paths"))
    found = stored(spark, path).select("blob", F.size(F.filter("base", lambda x: x["kind"] == "hex")).cast("long").alias("n_hex"))
    return scans[0].union(scans[1]).join(found, "blob").join(paths, "blob").select("blob", "version", "n_paths", "n_hex")


BLOB_HISTORY_SQL = r"""
with v as (select 1 version, coalesce(text, '') t from documents union all select 2, replace(coalesce(text, ''), chr(10), ' ') from documents)
select sha256(t) blob, min(version) version, count(*) n_paths, len(list_filter(regexp_extract_all(any_value(t), '[0-9a-f]+'), lambda x: length(x) >= 16))::bigint n_hex from v group by 1
"""
