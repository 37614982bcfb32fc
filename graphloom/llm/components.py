"""Connected components by alternating large and small stars.

Each round links every node to the least of its neighbourhood: first for its
larger neighbours (large star), then for its smaller ones (small star). Edges
never grow in number, and rounds go as the logarithm of the size. Each round is
written to the shared folder, so lost executors cost at most a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """``node, root`` for each node of ``a, b`` edges but the roots themselves;
    ``root`` is the least node that it reaches. ``rows``: about how many edges there
    are, where few tasks are to write few of them (see :func:`saved`)."""
    now = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links", rows)
    last = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.filter("u <> v")
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        now = saved(small, "links", rows)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if tuple(state) == last and state[0] == state[2]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = tuple(state)
        rows = rows if rows is None else state[0]
