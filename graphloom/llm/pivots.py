"""Embedding near-dedup with a pivot-permutation index.

Each vector is described by its nearest reference points (pivots), in order of
nearness. Vectors with a cosine of 0.98 or more are within 11.5 degrees of each
other and order the pivots almost alike. A vector is listed under each set of
``shared`` of its first ``depth`` pivots, so two vectors meet in a list if and
only if they share ``shared`` pivots or more; then their cosine is verified in
double precision.

Pivots are fitted on a bounded sample (``sample`` vectors in all, 51,200, or
``pivots`` a label, by hash of the vector), spread out over it; every vector is
indexed. As only vectors of one label are compared, each of the ``own`` most
frequent labels has pivots of its own, ``pivots`` or, where that is more,
``growth`` times the root of its size: as lists go by the square of the pivots, their
length doesn't grow with the label until pivots are a quarter of its sample. Beyond
that, ``shared`` 3 of ``depth`` 6 makes lists go by the cube. The other labels share
pivots that are fitted on a sample of them all, in lists of their own.

Equal vectors are one node with a weight. Long lists are compared in tiles. A
pair that shares several lists is counted in one of them: the list of the least
pivots that both share, which no other shared pivot precedes.

Vectors that are null, zero, or hold null or non-finite components, and those
without a label, link with nothing: they are their own component, kept, with no
links. A null vec_id counts as the smallest; repeated rows are equal vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import dealt, edges, labels, tiles
from .common import lists, saved
from .components import components
from .repeats import mixed

NULL = -(2**63)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(column: str = "embedding"):
    """Whether a vector can link."""
    v = F.col(column)
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(fine, F.lit(False))


def spread(unit: np.ndarray, pivots: int, more: int = 0, apart: float = 1.0) -> np.ndarray:
    """Farthest-first choice: each next pivot is the vector least like those chosen.
    Pivots from one dense group would be near ties, ordered by chance; so those beyond
    ``pivots``, up to ``more``, are taken only while their cosine with all is below ``apart``."""
    best, chosen = unit @ unit[0], [0]
    while len(chosen) < min(max(pivots, more), len(unit)):
        at = int(best.argmin())
        if len(chosen) >= pivots and best[at] >= apart:
            break
        chosen.append(at)
        best = np.maximum(best, unit @ unit[at])
    return unit[chosen]


def nearest(unit: np.ndarray, refs: np.ndarray, depth: int) -> np.ndarray:
    """The ``depth`` nearest pivots of each vector, in ascending order of their numbers."""
    out = np.empty((len(unit), depth), np.int32)
    step = max(1, (1 << 21) // len(refs))
    for i in range(0, len(unit), step):
        far = -(unit[i : i + step] @ refs.T)
        out[i : i + step] = np.sort(np.argpartition(far, depth - 1, axis=1)[:, :depth], axis=1)
    return out


def pivot_table(vectors: DataFrame, pivots: int, growth: float = 1.0, apart: float = 1.0, sample: int = 51_200, own: int = 1000) -> dict[tuple[str | None, int], np.ndarray]:
    """Unit vectors of the pivots of each label and width of vectors, from ``sample``
    vectors in all; those of the label None serve all labels that aren't there."""
    from pyspark.sql import Window

    spark = vectors.sparkSession
    sizes = [(r["label"], r["count"]) for r in vectors.groupBy("label").count().orderBy(F.desc("count"), "label").limit(own + 1).collect()]
    others, sizes = len(sizes) > own, sizes[:own]
    each = max(pivots, sample // max(1, len(sizes)))
    # a label's rows with hashes in its share, about twice as many as needed, are all that is sorted
    shares = spark.createDataFrame([(label, min(1.0, 2 * each / n)) for label, n in sizes], "label string, share double")
    hashed = F.xxhash64("same")
    inside = F.pmod(hashed, F.lit(1 << 30)) < F.col("share") * (1 << 30)
    nth = F.row_number().over(Window.partitionBy("label").orderBy(hashed, "same"))
    drawn = vectors.join(F.broadcast(shares), "label").filter(inside).withColumn("nth", nth).filter(F.col("nth") <= each)
    tables = [drawn.select("label", "nth", "vector").toArrow()]
    if others:
        rest = vectors.join(F.broadcast(shares), "label", "left_anti").orderBy(hashed, "same").limit(max(pivots, sample // 10))
        tables.append(rest.select(F.lit(None).cast("string").alias("label"), F.lit(0).alias("nth"), "vector").toArrow())
    out: dict[tuple[str | None, int], np.ndarray] = {}
    many = dict(sizes)
    for table in tables:
        table = table.sort_by([("label", "ascending"), ("nth", "ascending")]).combine_chunks()
        name, vector = table.column("label").to_pylist(), table.column("vector").combine_chunks()
        group: dict[tuple[str | None, int], list[int]] = {}
        for i, k in enumerate(zip(name, np.diff(vector.offsets.to_numpy()).tolist(), strict=True)):
            group.setdefault(k, []).append(i)
        for k, at in group.items():
            unit = _unit(vector.take(pa.array(at)).flatten().to_numpy().astype(np.float64).reshape(len(at), -1))
            out[k] = spread(unit, pivots, min(int(growth * many.get(k[0], 0) ** 0.5), len(at) // 4), apart)
    return out


def near_duplicates(rows: DataFrame, cosine: float = 0.98, pivots: int = 48, depth: int = 4, shared: int = 2, most: int = 512, own: int = 1000, growth: float = 1.0) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, a row for each vector."""
    rows = rows.select(F.coalesce("vec_id", F.lit(NULL)).alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("vector"))
    rows = rows.withColumn("fine", usable("vector") & F.col("label").isNotNull())
    # -0.0 and 0.0 are equal components
    rows = rows.withColumn("vector", F.when(F.col("fine"), F.transform("vector", lambda x: F.when(x == 0, F.abs(x)).otherwise(x))))
    key = F.when(F.col("fine"), F.sha2(F.to_json(F.struct("label", "vector")), 256))
    rows = saved(rows.withColumn("same", key), "vectors")
    nodes = rows.filter("fine").groupBy("same").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"), F.min_by(F.struct("label", "vector"), "vec_id").alias("v"))
    nodes = saved(nodes.select("same", "node", "weight", "v.label", "v.vector"), "vectors")
    table = pivot_table(nodes, pivots, growth, 2 * cosine * cosine - 1, own=own)  # apart: twice the angle of a link
    items = nodes.schema["vector"].simpleString().split(":", 1)[1]
    schema = f"key long, node long, weight long, first array<int>, last int, vector {items}"

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("label").dictionary_encode()
            label, names = names.indices.to_numpy(), names.dictionary.to_pylist()
            vector = batch.column("vector")
            size = np.diff(vector.offsets.to_numpy())
            keys, where, firsts, lasts = [], [], [], []
            order = np.lexsort((size, label))
            edge = np.flatnonzero(np.concatenate([[True], (np.diff(label[order]) != 0) | (np.diff(size[order]) != 0), [True]]))
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                at = np.sort(order[lo:hi])
                name, width = names[label[at[0]]], int(size[at[0]])
                refs = table.get((name, width), table.get((None, width)))
                base = int(xxhash.xxh64_intdigest(f"{width}/{name}")) >> 2
                if refs is None:  # a width that no vector of the sample has: one list
                    keys.append(np.full(len(at), base, np.int64))
                    where.append(at)
                    firsts += list(np.zeros((len(at), 1), np.int32))
                    lasts.append(np.zeros(len(at), np.int32))
                    continue
                x = _unit(vector.take(pa.array(at)).flatten().to_numpy().astype(np.float64).reshape(-1, width))
                own = min(depth, len(refs))
                first = nearest(x, refs, own)
                for some in combinations(range(own), min(shared, own)):
                    key = np.full(len(at), base, np.uint64)
                    for i in some:
                        key = mixed(key + first[:, i].astype(np.uint64) + np.uint64(1))
                    keys.append((key >> np.uint64(1)).astype(np.int64))
                    where.append(at)
                    firsts += list(first)
                    lasts.append(first[:, some[-1]])
            if keys:
                at = pa.array(np.concatenate(where))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), batch.column("node").take(at), batch.column("weight").take(at), lists(firsts, pa.int32()), pa.array(np.concatenate(lasts)), vector.take(at)], names=["key", "node", "weight", "first", "last", "vector"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tiles(batches):
            node, weight, part, last, ta, tb = (t.column(c).to_numpy() for c in ("node", "weight", "part", "last", "ta", "tb"))
            vector, firsts, edge = t.column("vector").combine_chunks(), t.column("first").combine_chunks(), edges(t)
            found: list[list[np.ndarray]] = [[], [], []]
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                n = hi - lo
                if n < 2:
                    continue
                raw = vector.slice(lo, n).flatten().to_numpy().astype(np.float64).reshape(n, -1)
                norm = np.sqrt((raw * raw).sum(1))
                near = (raw @ raw.T) / (norm[:, None] * norm[None]) >= cosine
                np.fill_diagonal(near, False)
                if ta[lo] != tb[lo]:  # two parts (one may be empty): only across
                    near &= part[lo:hi, None] != part[None, lo:hi]
                a, b = np.nonzero(near)
                first = firsts.slice(lo, n).flatten().to_numpy().reshape(n, -1)
                both = (first[a][:, :, None] == first[b][:, None]).any(2) & (first[a] <= last[lo])
                least = both.sum(1) == min(shared, first.shape[1])
                a, b = a[least], b[least]
                if not len(a):
                    continue
                links = np.bincount(a, weights=weight[lo:hi][b], minlength=n).astype(np.int64)
                pair = np.eye(n, dtype=bool)
                pair[a, b] = True
                root = labels(pair)
                at = np.flatnonzero(links)
                for column, value in zip(found, (node[lo:hi][at], node[lo:hi][root[at]], links[at]), strict=True):
                    column.append(value)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in found], names=["a", "b", "links"])

    work = dealt(saved(nodes.mapInArrow(listed, schema), "lists"), most).repartition("key", "ta", "tb").sortWithinPartitions("key", "ta", "tb")
    pairs = saved(work.mapInArrow(verify, "a long, b long, links long"), "links")
    count = pairs.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    found = components(pairs.select("a", "b"))
    known = nodes.select("same", "node", "weight").join(count, "node", "left").join(found, "node", "left")
    known = known.select("same", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("component"))
    out = rows.select("vec_id", "same").join(known, "same", "left")
    component = F.coalesce("component", "vec_id")
    real = [F.nullif(c, F.lit(NULL)) for c in (F.col("vec_id"), component)]
    return out.select(real[0].alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), real[1].alias("component_id"), (F.col("vec_id") == component).alias("kept"))
