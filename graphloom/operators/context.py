"""Token budgets: prefix, greedy and topology-aware truncation, batching, prompt blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import count_tokens
from graphloom.operators.ranking import articulation_local, louvain_local
from graphloom.session import cut_lineage


def prefix_sums(rows: DataFrame, order: tuple, cost: str, out: str) -> DataFrame:
    """rows and out: the sum of cost up to this row, in order. Rows are dealt by ranges of the order, summed in each range, and
    shifted by the sums of the ranges before, of which there are as many as partitions; no task sees all rows."""
    dealt = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = cut_lineage(dealt)  # the ranges stay as they are
    before = dealt.groupBy("_range").agg(F.sum(cost).alias("_all"))
    before = before.select("_range", (F.sum("_all").over(Window.orderBy("_range")) - F.col("_all")).alias("_before"))
    inside = F.sum(cost).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = dealt.withColumn("_inside", inside).join(F.broadcast(before), "_range")
    return both.withColumn(out, F.coalesce("_inside", F.lit(0)) + F.coalesce("_before", F.lit(0))).drop("_range", "_inside", "_before")


def prefix_truncate(rows: DataFrame, budget: int, keys: tuple[str, ...] = (), order: tuple = ("pos",), cost: str = "cost") -> DataFrame:
    """Rows up to the first that overflows the budget, in order, for each key (without keys, over the whole table in ranges)."""
    if not keys:
        return prefix_sums(rows, order, cost, "_sum").where(F.col("_sum") <= budget).drop("_sum")
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_sum", F.sum(cost).over(w)).where(F.col("_sum") <= budget).drop("_sum")


def byte_cap(files: DataFrame, cap: int = 104_857_600) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped): files in path order stop at the first that would exceed the cap."""
    out = prefix_sums(files, ("path",), "bytes", "_sum")  # sizes aren't negative, so all after the first beyond the cap are beyond it too
    return out.where(F.col("_sum") <= cap).drop("_sum"), out.where(F.col("_sum") > cap).drop("_sum")


def greedy_fill(rows: DataFrame, budget: int) -> DataFrame:
    """(group, pos): in order, rows that still fit; those that don't are skipped and later ones may fit. Null is a group like others, a null cost is 0."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, left = object(), budget
        for b in batches:
            keep = []
            for k, (g, c) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if g != own:
                    own, left = g, budget
                if c <= left:
                    left -= c
                    keep.append(k)
            yield b.select([0, 1]).take(pa.array(keep, pa.int64()))

    return _in_order(rows, fill, "")


def token_batches(rows: DataFrame, budget: int) -> DataFrame:
    """(group, pos, batch): in order; a row that would overflow a batch that isn't empty opens the next. Null is a group like others, a null cost is 0."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, used, batch = object(), 0, 0
        for b in batches:
            out = []
            for g, c in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if g != own:
                    own, used, batch = g, 0, 0
                if used and used + c > budget:
                    batch, used = batch + 1, 0
                used += c
                out.append(batch)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int32())], ["group", "pos", "batch"])

    return _in_order(rows, split, ", batch int")


def _in_order(rows: DataFrame, run, more: str) -> DataFrame:
    """A pass over each group in order of pos; a group is streamed, never held, and only three columns of it travel."""
    kind = dict(rows.dtypes)
    dealt = rows.select("group", "pos", F.coalesce("cost", F.lit(0)).alias("cost")).repartition("group").sortWithinPartitions("group", "pos")
    return dealt.mapInArrow(run, f"group {kind['group']}, pos {kind['pos']}" + more)


def truncate(rows: DataFrame, budget: int = 32_000, top: int = 50, share: float = 0.95) -> DataFrame:
    """The best `top` rows by score (missing 0), then the prefix within the share of the budget. rows: id, score, text."""
    order = (F.desc(F.coalesce("score", F.lit(0.0))), F.col("id"))
    best = rows.orderBy(*order).limit(top)  # each task sends its best only; the window is over that page
    w = Window.orderBy(*order)
    best = best.withColumn("pos", F.row_number().over(w)).withColumn("cost", count_tokens(F.col("text")))
    return best.withColumn("_sum", F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_sum") <= int(budget * share)).drop("_sum")


def truncate_component(pairs: list[tuple[str, str, float, int]], budget: int, boost: float = 1.5) -> list[int]:
    """Edge rows (source, target, score, cost) of one component: cut vertices are boosted; rows that don't fit are skipped;
    each row after the first must touch what is kept. Returns row numbers."""
    cuts = set(articulation_local([(a, b) for a, b, _, _ in pairs]))
    top = max((s for _, _, s, _ in pairs), default=0.0)
    rank = sorted(range(len(pairs)), key=lambda i: (-(pairs[i][2] + (boost * top if {pairs[i][0], pairs[i][1]} & cuts else 0.0)), i))
    kept, nodes, left = [], set(), budget
    again = True
    while again:
        again = False
        for i in rank:
            a, b, _, cost = pairs[i]
            if i in kept or cost > left or (nodes and not {a, b} & nodes):
                continue
            kept.append(i)
            nodes |= {a, b}
            left -= cost
            again = True
    return kept


def truncate_topology(edges: DataFrame, budget: int) -> DataFrame:
    """Rows kept of each component of (src, dst, score, cost); whole components that fit stay whole. One component is one group."""
    from graphloom.operators.components import connected_components

    comp = connected_components(edges)
    rows = edges.join(comp.toDF("src", "component"), "src")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["src", "dst"]).reset_index(drop=True)
        if pdf["cost"].sum() <= budget:
            return pdf[["src", "dst", "score", "cost"]]
        keep = truncate_component(list(pdf[["src", "dst", "score", "cost"]].itertuples(index=False, name=None)), budget)
        return pdf.loc[sorted(keep), ["src", "dst", "score", "cost"]]

    kind = dict(edges.dtypes)
    return rows.groupBy("component").applyInPandas(run, ", ".join(f"{c} {kind[c]}" for c in ("src", "dst", "score", "cost")))


def summarize_component(pairs: list[tuple[str, str]]) -> list[dict]:
    """Communities of one component: name, members, and edges to other communities."""
    own = louvain_local(pairs)
    out = []
    for name in sorted(set(own.values())):
        members = sorted(v for v, c in own.items() if c == name)
        cross = sum((own[a] == name) != (own[b] == name) for a, b in pairs)
        out.append({"community": name, "members": members, "n_members": len(members), "n_cross": cross})
    return out


def community_summary(members: DataFrame) -> DataFrame:
    """(tenant_id, community_id, summary) from (tenant_id, community_id, label, name): counts by label, first ten names, and how many more."""
    c = F.coalesce("community_id", F.lit("unassigned"))
    own = members.select("tenant_id", c.alias("community_id"), "label", "name")
    kinds = own.groupBy("tenant_id", "community_id", "label").agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("tenant_id", "community_id").orderBy("name"))  # limited in each task before the shuffle
    ten = own.withColumn("_r", first).where("_r <= 10").groupBy("tenant_id", "community_id").agg(F.array_sort(F.collect_list("name")).alias("names"))
    part = F.concat(F.col("n").cast("string"), F.lit(" "), F.col("label"), F.when(F.col("n") > 1, "s").otherwise(""))
    g = kinds.withColumn("part", part).groupBy("tenant_id", "community_id").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.sum("n").alias("n"))
    same = F.col("a.tenant_id").eqNullSafe(F.col("b.tenant_id")) & (F.col("a.community_id") == F.col("b.community_id"))
    g = g.alias("a").join(ten.alias("b"), same).select("a.tenant_id", "a.community_id", "parts", "n", "names")
    more = F.col("n") - 10
    text = F.concat(F.array_join("parts", ", "), F.lit(": "), F.array_join("names", ", "), F.when(more > 0, F.concat(F.lit(", and "), more.cast("string"), F.lit(" more"))).otherwise(""))
    return g.select("tenant_id", "community_id", text.alias("summary"))


def prompt_block(records: DataFrame, budget: int, value_chars: int = 500) -> DataFrame:
    """(pos, block): records (pos, fields map) as numbered blocks of `key: value` lines, dropped from the end beyond the budget."""
    lines = F.transform(F.map_entries("fields"), lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), F.when(F.length(e["value"]) > value_chars, F.concat(F.substring(e["value"], 1, value_chars), F.lit("..."))).otherwise(e["value"])))
    block = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]\n"), F.array_join(lines, "\n"))
    rows = records.select("pos", block.alias("block")).withColumn("cost", count_tokens(F.col("block")))
    return prefix_truncate(rows, budget).drop("cost")
