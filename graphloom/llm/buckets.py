"""Comparing all members of each bucket, without emitting all pairs.

Rows of a bucket meet in one task, which compares them as a matrix and returns
only enough links to keep the bucket's components: at most one a member. A
bucket with over ``most`` members is cut into tiles: its members are dealt into
parts by hash, and each pair of parts is a task's work of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def dealt(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` (with ``key``, ``node``) of buckets with two members or more, with
    the two parts that a tile compares (``ta``, ``tb``) and the row's own ``part``."""
    size = rows.groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    side = F.ceil(F.col("many") / most).cast("int")
    rows = rows.join(size, "key").withColumn("side", side)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("side")).cast("int")).drop("many")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("side") - 1)))
    return rows.withColumn("ta", F.least("part", "other")).withColumn("tb", F.greatest("part", "other")).drop("other", "side")


def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches that end where a tile ends, from rows sorted by ``key, ta, tb``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < 2000:
            continue
        table = pa.Table.from_batches(held)
        edge = edges(table)
        if len(edge) > 2:
            yield table.slice(0, edge[-2])
            table = table.slice(edge[-2])
        held = table.to_batches()
    if held:
        yield pa.Table.from_batches(held)


def edges(table: pa.Table) -> np.ndarray:
    """Where tiles begin, and the end of the last."""
    change = np.zeros(table.num_rows - 1, bool)
    for name in ("key", "ta", "tb"):
        column = table.column(name).to_numpy()
        change |= column[1:] != column[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [table.num_rows]])


def labels(close: np.ndarray) -> np.ndarray:
    """The least member that each member of a symmetric matrix reaches."""
    n = len(close)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(close, label, n).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def linked(rows: DataFrame, value: str, close: Callable, most: int) -> DataFrame:
    """``a, b``: links that keep the components of all buckets. ``rows``: ``key``,
    ``node`` and ``value``; ``close(values, values)`` gives a matrix of flags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tiles(batches):
            node, part, ta, tb = (table.column(c).to_numpy() for c in ("node", "part", "ta", "tb"))
            values = table.column(value).to_pylist()
            edge = edges(table)
            a, b = [], []
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                near = close(values[lo:hi], values[lo:hi])
                if ta[lo] != tb[lo]:  # two parts (one may be empty): only across
                    near &= part[lo:hi, None] != part[None, lo:hi]
                if not near.any():
                    continue
                np.fill_diagonal(near, True)
                root = labels(near)
                far = np.flatnonzero(root != np.arange(hi - lo))
                a.append(node[lo:hi][far])
                b.append(node[lo:hi][root[far]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    work = dealt(saved(rows, "buckets"), most).repartition("key", "ta", "tb").sortWithinPartitions("key", "ta", "tb")
    return work.mapInArrow(run, "a long, b long").distinct()
