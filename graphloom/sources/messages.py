"""Parsed messages, staged files and blobs: what may be read, and what is wrong with the rest."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "tenant_id string, file_path string, content string, source_type string, commit_sha string"


def parsed_messages(rows: DataFrame, value: str = "value") -> DataFrame:
    """(path, tenant_id, content, error) of JSON messages: the tenant and the content are mandatory."""
    text = F.col(value).cast("string")
    m = F.from_json(text, MESSAGE + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = rows.select(text.alias("_text"), m.alias("m"))
    tenant = F.nullif(F.trim("m.tenant_id"), F.lit(""))
    error = (
        F.when(F.col("_text").isNull(), "message value is empty")
        .when(F.col("m").isNull() | F.col("m._bad").isNotNull(), "json decode error")
        .when(tenant.isNull(), "parsed payload missing tenant_id")
        .when(F.col("m.content").isNull(), "parsed payload missing content field")
    )
    ok = lambda c: F.when(error.isNull(), c)
    return out.select(ok(F.coalesce("m.file_path", F.lit("unknown"))).alias("path"), ok(tenant).alias("tenant_id"), ok(F.col("m.content")).alias("content"), error.alias("error"))


def inside(path: Column, root: str) -> Column:
    """Whether a path stays below a root: absolute below it or relative, without any step up."""
    steps = F.split(F.translate(path, "\\", "/"), "/")
    below = ~path.startswith("/") | path.startswith(root.rstrip("/") + "/")
    return F.coalesce(below & ~F.array_contains(steps, "..") & (F.instr(path, "\0") == 0), F.lit(False))


def staged(rows: DataFrame, root: str) -> DataFrame:
    """rows (path, ...) and error: paths that leave the staging folder are refused."""
    return rows.withColumn("error", F.when(~inside(F.col("path"), root), "path outside the staging folder"))


def blobs(files: DataFrame, tenant: str) -> DataFrame:
    """files (path, content) below tenant/ only, with the path after it; content that isn't UTF-8 is left out."""
    own = files.where(F.col("path").startswith(f"{tenant}/") & inside(F.col("path"), "/"))
    return own.select(F.substring(F.col("path"), F.lit(len(tenant) + 2), F.length("path")).alias("path"), F.try_validate_utf8("content").alias("content")).where("content is not null")


def list_files(files: DataFrame, glob: str = "*") -> DataFrame:
    """path of files whose base name fits the pattern, sorted."""
    like = "^" + re.escape(glob).replace(r"\*", ".*").replace(r"\?", ".") + "$"
    return files.where(F.element_at(F.split("path", "/"), -1).rlike(like)).select("path").orderBy("path")


def schema_errors(rows: DataFrame, value: str, required: list[str]) -> DataFrame:
    """rows and missing: the required fields that a JSON value lacks or holds as null, sorted (all of them for bad JSON)."""
    has = [F.when(F.get_json_object(F.col(value).cast("string"), f"$.{c}").isNull(), F.lit(c)) for c in sorted(required)]
    return rows.withColumn("missing", F.filter(F.array(*has), lambda x: x.isNotNull()))


def ontology(path: str | None, default: dict) -> dict:
    """Labels and relationships from a YAML file; the default without one."""
    import yaml

    if not path or not Path(path).exists():
        return default
    return yaml.safe_load(Path(path).read_text()) or default


class Prompts:
    """Prompt texts by name and version; the version registered last is the latest."""

    def __init__(self) -> None:
        self.texts: dict[tuple[str, str], str] = {}
        self.last: dict[str, str] = {}

    def register(self, name: str, version: str, text: str) -> None:
        self.texts[name, version] = text
        self.last[name] = version

    def get(self, name: str, version: str | None = None) -> str:
        return self.texts[name, version or self.last[name]]


def read_list(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    from graphloom.sources.files import scan

    return list_files(scan(spark, root), glob)
