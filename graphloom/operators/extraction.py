"""Extraction by a callable (a language model, say), entity resolution, and answers judged or summarised by one. Without a callable each step has a plain result."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import count_tokens, team_owner
from graphloom.functions.text import sanitize_query
from graphloom.operators import context
from graphloom.operators.commit import first_of_window
from graphloom.sources.files import first_json

Model = Callable[[str], str | None]
#: Token budgets in a stretch of files that one task packs.
STRETCH = 1000


def extract(files: DataFrame, model: Model | None = None, budget: int = 8000) -> tuple[DataFrame, DataFrame]:
    """(services, calls) that a model reads in batches of .go and .py files (path, content) within a budget of tokens.

    services: id, name, language, framework, team_owner, read_roles, each id once; calls: src, dst. Bad answers and no model give no rows.
    Files are taken in order of path, cut into stretches of about STRETCH budgets by running sums in ranges, and packed stretch by stretch.
    """
    rows = files.where(F.col("path").rlike(r"\.(go|py)$")).withColumn("text", sanitize_query(F.col("content"), 100_000))
    sized = context.prefix_sums(rows.select("path", count_tokens(F.col("text")).alias("cost")), ("path",), "cost", "_sum")
    sized = sized.select(F.floor((F.col("_sum") - F.col("cost")) / (budget * STRETCH)).alias("group"), F.col("path").alias("pos"), "cost")
    batches = context.token_batches(sized, budget).select(F.col("pos").alias("path"), (F.shiftleft("group", 32) + F.col("batch")).alias("batch"))
    prompts = rows.join(batches, "path").groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda x: F.concat(F.lit("# "), x["path"], F.lit("\n"), x["text"])), "\n\n").alias("prompt"))

    def ask(parts):
        for pdf in parts:
            out = []
            for batch, prompt in zip(pdf["batch"], pdf["prompt"], strict=True):
                told = (first_json(model(prompt)) if model else None) or {}
                out += [(batch, "service", s.get("id"), None, s.get("name"), s.get("language"), s.get("framework"), s.get("team_owner"), s.get("path")) for s in told.get("services", []) if s.get("id")]
                out += [(batch, "call", c.get("source"), c.get("target"), None, None, None, None, None) for c in told.get("calls", []) if c.get("source") and c.get("target")]
            yield pd.DataFrame(out, columns=["batch", "kind", "id", "dst", "name", "language", "framework", "team_owner", "path"])

    told = prompts.mapInPandas(ask, "batch long, kind string, id string, dst string, name string, language string, framework string, team_owner string, path string")
    services = first_of_window(told.where("kind = 'service'"), ["id"], "batch")
    services = acl_defaults(services.select("id", "name", "language", "framework", "team_owner", "path"))
    return services, told.where("kind = 'call'").select(F.col("id").alias("src"), "dst").distinct()


def acl_defaults(rows: DataFrame) -> DataFrame:
    """read_roles [reader] where missing; the team owner from the path where null."""
    roles = F.col("read_roles") if "read_roles" in rows.columns else F.lit(None).cast("array<string>")
    owner = F.coalesce("team_owner", team_owner(F.col("path"))) if "path" in rows.columns else F.col("team_owner")
    return rows.withColumns({"team_owner": owner, "read_roles": F.when(F.coalesce(F.size(roles), F.lit(0)) > 0, roles).otherwise(F.array(F.lit("reader")))})


def resolve(services: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """services (pos, id, name, ...) by exact name: the first of a canonical name (null: the id) keeps its id, later ones take the canonical name
    for theirs, and of equal ids the first stays. Edges are not remapped."""
    name = F.coalesce(F.nullif("name", F.lit("")), "id")
    rows = services.withColumn("_name", name)
    if aliases is not None:
        rows = rows.join(aliases.select(F.col("alias").alias("_name"), "canonical"), "_name", "left").withColumn("_name", F.coalesce("canonical", "_name")).drop("canonical")
    first = rows.groupBy("_name").agg(F.min("pos").alias("_first"))  # small beside the rows, and no name is gathered in one task
    both = rows.join(first, "_name").withColumn("id", F.when(F.col("pos") == F.col("_first"), F.col("id")).otherwise(F.col("_name")))
    return first_of_window(both, ["id"], "pos").drop("_name", "_first")


def corrected(run: Callable[[list[str]], tuple[list[dict], list[str]]], check: Callable[[list[dict]], list[str]], rounds: int = 3) -> tuple[list[dict], list[str]]:
    """Entities after at most `rounds` corrections: certain ones and those of manifests stay, failed files are read again; then they are committed anyway."""
    entities, failed = run([])
    for _ in range(rounds):
        errors = check(entities)
        if not errors:
            return entities, []
        kept = [e for e in entities if e.get("confidence") == 1.0 or e.get("source") == "manifest"]
        new, failed = run(failed)
        known = {(e.get("type"), e.get("id")) for e in kept}
        entities = kept + [e for e in new if (e.get("type"), e.get("id")) not in known]
    return entities, check(entities)


def judged(question: str, answer: str, sources: str, plain: dict[str, float], model: Model | None = None) -> dict:
    """Scores in 0..1 that a model gives as JSON; without one, or for a bad answer, the plain scores, marked."""
    told = first_json(model(json.dumps({"question": question, "answer": answer, "sources": sources[:4000]}))) if model else None
    try:
        scores = {k: min(1.0, max(0.0, float(told[k]))) for k in plain}
    except (TypeError, KeyError, ValueError):
        return plain | {"used_fallback": True}
    return scores | {"used_fallback": False}


def summarised(members: list[str], plain: str, model: Model | None = None, most: int = 20) -> str:
    """What a model says of at most `most` members, else the plain text."""
    try:
        told = model("\n".join(sorted(members)[:most])) if model else None
    except Exception:  # noqa: BLE001
        told = None
    return told or plain


def shortened(text: Column, most: int) -> Column:
    """Cut to most characters at a blank beyond the middle, with an ellipsis."""
    cut = most - 3
    if cut <= 0:
        return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("...")))
    head = F.substring(text, 1, cut + 1)
    last = F.length(head) - F.instr(F.reverse(head), " ")  # place of the last blank from 0
    at = F.when((F.instr(head, " ") > 0) & (last > cut // 2), last).otherwise(cut)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, F.lit(1), at.cast("int")), F.lit("...")))


def shortened_list(items: list, most: int) -> str:
    """A list as text within most characters; what doesn't fit is counted."""
    if len(repr(items)) <= most:
        return repr(items)
    kept, room = [], most - 4
    for k, item in enumerate(items):
        left = len(items) - k
        need = len(repr(item)) + (2 if kept else 0)
        if room - (len(f", '... {left} more'") if left > 1 else 0) < need:
            break
        kept.append(repr(item))
        room -= need
    more = len(items) - len(kept)
    return "[" + ", ".join(kept + ([f"'... {more} more'"] if more else [])) + "]"
