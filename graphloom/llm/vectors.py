"""Shared helpers of the vector operators: integer matrices from Arrow columns, and per-task sums that meet in a small grouped table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def limit(width: int) -> int:
    """The largest component for which squared distances of width components stay below 2**62."""
    return int((2.0**60 / max(width, 1)) ** 0.5)


def scaled(column: pa.Array, scale: int, width: int, pad: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(rows, x): the rows of a list column without null or non-finite components, and floor(scale * component) as an n x width matrix.

    Lists of another length than width take no part, or with pad are filled with zeros (longer ones never occur then).
    Components beyond limit(width) raise: their squared distances don't fit 64-bit integers.
    """
    n = len(column)
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.asarray(pc.fill_null(pc.cast(pc.list_flatten(column), pa.float64()), float("nan")))
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    start = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])
    rows = np.flatnonzero((bad[start[1:]] == bad[start[:-1]]) & ((sizes >= 0) & (sizes <= width) if pad else sizes == width)) if n else np.zeros(0, np.int64)
    at, own = start[rows], sizes[rows]
    x = np.zeros((len(rows), width))
    inside = np.arange(width)[None, :] < own[:, None]
    x[inside] = np.floor(scale * flat[(at[:, None] + np.arange(width)[None, :])[inside]])
    if np.abs(x).max(initial=0) > limit(width):
        raise ValueError(f"a component exceeds {limit(width)} after scaling: squared distances would not fit 64-bit integers")
    return rows, x.astype(np.int64)


def group_sums(group: np.ndarray, values: np.ndarray, n_groups: int) -> np.ndarray:
    """Exact integer sums of the rows of values by group: n_groups x columns."""
    out = np.zeros((n_groups, values.shape[1]), np.int64)
    if len(group):
        order = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.diff(group[order], prepend=-1))
        out[group[order][first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def totals(df: DataFrame, fold: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum of fold(batch), an integer array of a fixed shape, over all batches, as Python integers.

    Each task adds its batches up; the arrays meet by position in one grouped aggregate, so only one array reaches the driver.
    """
    size = int(np.prod(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, np.int64)
        for b in batches:
            own += fold(b).reshape(-1)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_pydict({"at": at.astype(np.int64), "n": own[at]})

    got = df.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
    out = np.zeros(size, object)
    for r in got:
        out[r["at"]] = int(r["n"])
    return out.reshape(shape)
