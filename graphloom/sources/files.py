"""Source files and manifests: scan, decode, search, and extraction of services, calls, topics and deployments."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.scalars import service_id

# Labels that name a team, in order of precedence.
TEAM_LABELS = ("graphrag.io/team-owner", "team", "owner", "app.kubernetes.io/managed-by")
# Folders that are never read, and endings that are.
EXCLUDED = [".git", ".venv", "__pycache__", "node_modules", ".mypy_cache", ".pytest_cache", ".tox", ".eggs", "venv"]
ENDINGS = [".go", ".py", ".yaml", ".yml"]
MAX_FILE = 1_048_576


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path (relative, posix), bytes, content: eligible files that are valid UTF-8."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    at = F.length(F.regexp_replace(F.lit(root.rstrip("/")), r"^\w+:/*", "/"))
    plain = F.regexp_replace("path", r"^\w+:/*", "/")
    return eligible(raw.select(plain.substr(at + 2, F.length(plain)).alias("path"), F.col("length").alias("bytes"), "content"))


def eligible(files: DataFrame) -> DataFrame:
    inside = F.exists(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), lambda x: x.isin(EXCLUDED))
    ok = F.rlike(F.col("path"), F.lit("(" + "|".join(re.escape(e) for e in ENDINGS) + ")$")) & ~inside & (F.col("bytes") <= MAX_FILE)
    return files.where(ok).withColumn("content", F.try_validate_utf8("content")).where("content is not null")


def decode_request(rows: DataFrame, cap: int = 104_857_600) -> DataFrame:
    """path, content, error from base64 content: bad base64, bad UTF-8, or beyond the cumulative cap in order of pos."""
    from graphloom.operators.context import prefix_sums

    raw = F.try_to_binary("content", F.lit("base64"))
    sized = rows.withColumn("raw", raw).withColumn("size", F.coalesce(F.length("raw"), F.lit(0)).cast("long"))
    out = prefix_sums(sized, ("pos",), "size", "total").withColumn("text", F.try_validate_utf8("raw"))
    error = F.when(F.col("raw").isNull(), "base64").when(F.col("text").isNull(), "utf8").when(F.col("total") > cap, "too large")
    return out.select("pos", "path", F.when(error.isNull(), F.col("text")).alias("content"), error.alias("error"))


def decode_messages(messages: DataFrame) -> DataFrame:
    """path, tenant_id, content, error of Kafka-shaped rows (key, value binary; headers map): the tenant is mandatory."""
    h = lambda *names: F.coalesce(*(F.try_element_at("headers", F.lit(n)) for n in names))
    raw = F.try_validate_utf8(F.try_to_binary(F.col("value").cast("string"), F.lit("base64")))
    tenant = h("tenant_id", "tenant-id", "x-tenant-id")
    error = F.when(tenant.isNull(), "no tenant").when(raw.isNull(), "content")
    return messages.select(F.coalesce(h("file_path", "file-path"), F.col("key").cast("string"), F.lit("unknown")).alias("path"), tenant.alias("tenant_id"), raw.alias("content"), error.alias("error"))


def grep(files: DataFrame, needle: str, glob: str = "*", path: str = "path", content: str = "content") -> DataFrame:
    """(path, line_no from 1, line) of lines that hold the needle."""
    like = "^" + re.escape(glob).replace(r"\*", ".*").replace(r"\?", ".") + "$"
    base = F.element_at(F.split(F.col(path).cast("string"), "/"), -1)
    rows = files.where(F.contains(F.col(content), F.lit(needle)) & base.rlike(like))
    lines = rows.select(F.col(path).alias("path"), F.posexplode(F.split(F.col(content), "\n")).alias("pos", "line"))
    return lines.where(F.contains("line", F.lit(needle))).select("path", (F.col("pos") + 1).alias("line_no"), "line")


def documents_of(text: str | None) -> list[dict]:
    """The mappings of a YAML stream; bad YAML has none."""
    import yaml

    try:
        return [d for d in yaml.safe_load_all(text or "") if isinstance(d, dict)]
    except yaml.YAMLError:
        return []


def _meta(d: dict) -> tuple[dict, dict]:
    meta = d.get("metadata") if isinstance(d.get("metadata"), dict) else {}
    return meta, meta.get("labels") if isinstance(meta.get("labels"), dict) else {}


def manifests(files: DataFrame) -> DataFrame:
    """path, kind, id, namespace, amount (replicas or partitions), retention_ms, team_owner of deployments and topics."""

    def run(batches):
        for pdf in batches:
            out = []
            for path, text in zip(pdf["path"], pdf["content"], strict=True):
                for d in documents_of(text):
                    meta, labels = _meta(d)
                    spec = d.get("spec") if isinstance(d.get("spec"), dict) else {}
                    name = meta.get("name")
                    team = next((str(labels[k]) for k in TEAM_LABELS if labels.get(k)), None)
                    if name and d.get("kind") == "Deployment":
                        out.append((path, "deployment", str(name), str(meta.get("namespace") or "default"), int(spec.get("replicas", 1)), None, team))
                    elif name and d.get("kind") == "KafkaTopic":
                        config = spec.get("config") if isinstance(spec.get("config"), dict) else {}
                        out.append((path, "topic", str(name), str(meta.get("namespace") or "default"), int(spec.get("partitions", 1)), int(config.get("retention.ms", 604_800_000)), team))
            yield pd.DataFrame(out, columns=["path", "kind", "id", "namespace", "amount", "retention_ms", "team_owner"]).astype({"retention_ms": "Int64"})

    rows = files.where(F.col("path").rlike(r"\.ya?ml$")).select("path", "content")
    return rows.mapInPandas(run, "path string, kind string, id string, namespace string, amount int, retention_ms long, team_owner string")


FACTS = "array<struct<kind:string,value:string>>"
# Frameworks by constructor, clients by module, and verbs.
FRAMEWORKS = {"FastAPI": "fastapi", "Flask": "flask"}
CLIENTS = {"httpx", "requests", "aiohttp"}
VERBS = {"get", "post", "put", "delete", "patch", "head", "options", "request"}


def python_facts(source: str) -> list[tuple[str, str]]:
    """(kind, value): framework, call, consumes, produces, otel, from the syntax tree; nothing for bad syntax."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    out, kafka = [], False
    for node in ast.walk(tree):
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            names = [a.name for a in node.names] + [getattr(node, "module", None) or ""]
            kafka |= any("kafka" in n for n in names)
            if any("opentelemetry" in n for n in names):
                out.append(("otel", "true"))
    for node in ast.walk(tree):
        if not isinstance(node, ast.Call):
            continue
        f = node.func
        name = f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else ""
        owner = f.value.id if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) else ""
        first = node.args[0] if node.args else None
        text = "unknown"
        if isinstance(first, ast.Constant) and isinstance(first.value, str):
            text = first.value
        elif isinstance(first, ast.JoinedStr):
            text = "".join(v.value if isinstance(v, ast.Constant) else "{...}" for v in first.values)
        if name in FRAMEWORKS:
            out.append(("framework", FRAMEWORKS[name]))
        elif owner == "grpc" and name == "server":
            out.append(("framework", "grpc"))
        elif owner in CLIENTS and name in VERBS:
            out.append(("call", text))
        elif "Consumer" in name and text != "unknown":
            out.append(("consumes", text))
        elif name == "send" and kafka and text != "unknown":
            out.append(("produces", text))
    return list(dict.fromkeys(out))


# Go constructors, clients, topics and telemetry, as patterns.
GO_PATTERNS = [
    ("framework", r"\b(gin|echo|fiber|chi|mux)\.(?:Default|New|NewRouter)\("),
    ("framework", r"\b(http)\.(?:ListenAndServe|NewServeMux|HandleFunc)\b"),
    ("framework", r"\b(grpc)\.NewServer\("),
    ("call", r"\bhttp\.(?:Get|Post|Head|PostForm)\(\s*\"([^\"]*)\""),
    ("call", r"\bhttp\.NewRequest(?:WithContext)?\([^\"\n]*\"[A-Z]+\"\s*,\s*\"([^\"]*)\""),
    ("consumes", r"\bConsumeTopics\(\s*\"([^\"]+)\""),
    ("produces", r"\bTopic:\s*\"([^\"]+)\""),
    ("otel", r"(go\.opentelemetry\.io)"),
]


def go_facts(source: str) -> list[tuple[str, str]]:
    return list(dict.fromkeys((kind, "true" if kind == "otel" else m[1]) for kind, p in GO_PATTERNS for m in re.finditer(p, source)))


def source_facts(files: DataFrame, max_bytes: int = 2_097_152) -> DataFrame:
    """path, service_id, facts of .py and .go files within the size guard."""

    def run(batches):
        for pdf in batches:
            facts = [[{"kind": k, "value": v} for k, v in (python_facts if p.endswith(".py") else go_facts)(c)] for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame({"path": pdf["path"], "service_id": pdf["service_id"], "facts": facts})

    rows = files.where(F.col("path").rlike(r"\.(py|go)$") & (F.octet_length("content") <= max_bytes))
    return rows.select("path", service_id(F.col("path")).alias("service_id"), "content").mapInPandas(run, f"path string, service_id string, facts {FACTS}")


def services(facts: DataFrame) -> DataFrame:
    """id, language, framework, otel of files that have a framework."""
    one = lambda kind: F.try_element_at(F.filter("facts", lambda x: x["kind"] == kind), F.lit(1))["value"]
    rows = facts.select(F.col("service_id").alias("id"), F.when(F.col("path").endswith(".py"), "python").otherwise("go").alias("language"), one("framework").alias("framework"), (one("otel") == "true").alias("otel")).where("framework is not null")
    return rows.groupBy("id").agg(F.min("language").alias("language"), F.min("framework").alias("framework"), F.coalesce(F.bool_or("otel"), F.lit(False)).alias("otel"))


def fact_edges(facts: DataFrame) -> DataFrame:
    """(src, rel, dst): calls to their target text, topics consumed and produced."""
    x = facts.select("service_id", F.explode("facts").alias("f"))
    rel = F.when(F.col("f.kind") == "call", "CALLS").when(F.col("f.kind") == "consumes", "CONSUMES").when(F.col("f.kind") == "produces", "PRODUCES")
    return x.select(F.col("service_id").alias("src"), rel.alias("rel"), F.col("f.value").alias("dst")).where("rel is not null").distinct()


def first_json(text: str | None) -> dict | None:
    m = re.search(r"\{.*\}", text or "", re.S)
    try:
        return json.loads(m[0]) if m else None
    except ValueError:
        return None


def is_blob(content: Column, threshold: int = 65_536) -> Column:
    """Whether content goes to the blob store rather than into the message."""
    return F.octet_length(content) >= threshold


def blob_key(tenant: Column, commit: Column, path: Column, key: Column) -> Column:
    """ingestion/tenant/commit/path with slashes replaced-8 bytes of the digest of path:key, in hex."""
    sha = F.coalesce(F.nullif(F.trim(commit), F.lit("")), F.lit("no-commit"))
    safe = F.coalesce(F.nullif(F.translate(F.trim(path), "/\\", "__"), F.lit("")), F.lit("unknown"))
    digest = F.substring(F.sha2(F.concat(path, F.lit(":"), key), 256), 1, 16)
    return F.concat(F.concat_ws("/", F.lit("ingestion"), F.trim(tenant), sha, safe), F.lit("-"), digest)
