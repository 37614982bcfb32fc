"""Best-fit packing of token sequences by a grouping genetic algorithm.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens. The
pieces are dealt by number into shards of about ``shard`` pieces. Each shard is a
packing problem of its own that several islands work on: an island holds a small
population of packings, and its crossover injects whole well-filled bins of one
parent into another, removes the bins that hold the same pieces twice, and puts
the displaced pieces back best-fit, largest first. After each epoch an island's
best packing migrates to the next island of its shard; at the end the best of
all islands is taken. A packing with as few bins as the sum of lengths allows
can't be beaten, and ends its island's search.

Shards cost at most about one bin each, under 0.2 % of bins at the default.

Null text is empty (its end id alone); repeated rows are pieces of their own;
a null doc_id stays null; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, lean, saved, texts
from .word_bpe import word_encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
NUMBERED = f"{PIECES}, nth long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """:data:`PIECES` of all documents, with a number of their own (``nth``), by which
    repeated rows are dealt out as evenly as others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_encoder(tokenizer)
        end, nth = np.array([end_id], "<u4"), TaskContext.get().partitionId() << 40
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for key, ids in zip(batch.column("doc_id").to_pylist(), coder.encode(as_bytes(batch.column("text"))), strict=True):
                ids = np.concatenate([ids.astype("<u4"), end])
                for i in range(0, len(ids), capacity):
                    part = ids[i : i + capacity]
                    for column, value in zip(out, (key, i // capacity, i, len(part), zlib.crc32(part.tobytes())), strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            numbers = pa.array(np.arange(nth, nth + len(out[0])))
            nth += len(out[0])
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(out, kinds, strict=True)), numbers], names=[x.split()[0] for x in NUMBERED.split(", ")])

    return texts(docs).mapInArrow(lean(run, keep=True), NUMBERED)


class Packing:
    """Bins of piece numbers with their free space; fuller sorts first."""

    def __init__(self, bins: list[list[int]], free: list[int]):
        self.bins, self.free = bins, free
        self.score = (len(bins), -sum(f * f for f in free))


def best_fit(order: list[int], size: list[int], capacity: int, bins: list[list[int]], free: list[int]) -> Packing:
    """Put pieces, in order, where the least space is left."""
    by_free: dict[int, list[int]] = {}
    have = 0  # bit f: some bin has f tokens free
    for i, f in enumerate(free):
        by_free.setdefault(f, []).append(i)
        have |= 1 << f
    for item in order:
        fits = have >> size[item]
        if fits:
            f = (fits & -fits).bit_length() - 1 + size[item]
            at = by_free[f].pop()
            if not by_free[f]:
                have &= ~(1 << f)
            bins[at].append(item)
        else:
            f, at = capacity, len(bins)
            bins.append([item])
            free.append(capacity)
        f -= size[item]
        free[at] = f
        by_free.setdefault(f, []).append(at)
        have |= 1 << f
    return Packing(bins, free)


def exchange(bins: list[list[int]], free: list[int], displaced: list[int], size: list[int]) -> list[int]:
    """Fill bins better by taking a larger displaced piece for a piece, or for two, of
    a bin. Returns what is displaced then, which is smaller and so easier to place."""
    out = sorted(displaced, key=lambda i: size[i])
    sizes = [size[i] for i in out]
    for at, items in enumerate(bins):
        room = free[at]
        if not room or not out:
            continue
        best = (0, -1, ())
        for x, i in enumerate(items):
            for gone in ((i,), *((i, j) for j in items[x + 1 :])):
                own = sum(size[g] for g in gone)
                k = bisect_right(sizes, own + room) - 1
                if k >= 0 and sizes[k] - own > best[0]:
                    best = (sizes[k] - own, k, gone)
        gain, k, gone = best
        if gain:
            items.append(out.pop(k))
            sizes.pop(k)
            free[at] -= gain
            for g in gone:
                items.remove(g)
                k = bisect_right(sizes, size[g])
                sizes.insert(k, size[g])
                out.insert(k, g)
    return out[::-1]


def crossover(one: Packing, other: Packing, size: list[int], capacity: int, dice: random.Random) -> Packing:
    """``one`` with a third of the well-filled bins of ``other`` injected. Bins that
    hold one of their pieces twice go, as do the emptiest of the rest; displaced pieces
    are exchanged for smaller ones where that fills a bin, and placed best-fit."""
    full = sorted(range(len(other.free)), key=other.free.__getitem__)[: (len(other.free) + 1) // 2]
    some = dice.sample(full, (len(full) + 2) // 3)
    taken = {item for i in some for item in other.bins[i]}
    bins, free = [list(other.bins[i]) for i in some], [other.free[i] for i in some]
    rest = [(f, items) for items, f in zip(one.bins, one.free, strict=True) if taken.isdisjoint(items)]
    displaced = [i for items in one.bins if not taken.isdisjoint(items) for i in items if i not in taken]
    rest.sort(key=lambda x: x[0])
    loose = max(1, len(rest) // 20)
    for f, items in rest[:-loose]:
        bins.append(list(items))
        free.append(f)
    displaced += [i for _, items in rest[-loose:] for i in items]
    for _ in range(2):
        displaced = exchange(bins, free, displaced, size)
    return best_fit(displaced, size, capacity, bins, free)


def evolve(size: list[int], capacity: int, guests: list[list[int]], seed: int, population: int, generations: int) -> list[int]:
    """The bin of each piece in an island's best packing. ``guests``: packings,
    as the bin of each piece, that the island starts with."""
    dice = random.Random(seed)
    bound = -(-sum(size) // capacity)

    def packing(of: list[int]) -> Packing:
        bins: dict[int, list[int]] = {}
        for item, b in enumerate(of):
            bins.setdefault(b, []).append(item)
        groups = list(bins.values())
        return Packing(groups, [capacity - sum(size[i] for i in g) for g in groups])

    herd = [packing(g) for g in guests]
    while len(herd) < population and (not herd or min(p.score for p in herd)[0] > bound):
        # the first is best-fit decreasing; others blur the order a little
        blur = 0.05 * len(herd) + 0.1 * (seed % 7 > 0)
        order = sorted(range(len(size)), key=lambda i: -size[i] * (1 + dice.random() * blur))
        herd.append(best_fit(order, size, capacity, [], []))
    for _ in range(generations):
        herd.sort(key=lambda p: p.score)
        if herd[0].score[0] <= bound or len(herd) < 2:
            break
        a, b = dice.sample(range(len(herd)), 2)
        children = [crossover(herd[a], herd[b], size, capacity, dice), crossover(herd[0], herd[-1], size, capacity, dice)]
        herd = sorted(herd + children, key=lambda p: p.score)[: max(population, 2)]
    best = min(herd, key=lambda p: p.score)
    of = [0] * len(size)
    for b, items in enumerate(best.bins):
        for item in items:
            of[item] = b
    return of




def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, shard: int = 4096, islands: int = 2, epochs: int = 2, population: int = 4, generations: int = 12) -> DataFrame:
    """:data:`PIECES` with ``sequence_id`` and ``offset``, a row for each piece."""
    cut = saved(pieces(docs, tokenizer, capacity, end_id), "pieces")
    shards = max(1, -(-cut.count() // shard))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("nth"), F.lit(shards)))
    items = dealt.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("doc_id", "piece", "start", "length", "ids_crc32", "nth"))).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = [], []
            for key, island, sizes, guests in zip(batch.column("shard").to_pylist(), batch.column("island").to_pylist(), batch.column("sizes").to_pylist(), batch.column("guests").to_pylist(), strict=True):
                of = evolve(sizes, capacity, [g for g in guests if g], key * 7 + island, population, generations)
                fill: dict[int, int] = {}
                for b, s in zip(of, sizes, strict=True):
                    fill[b] = fill.get(b, 0) + s
                best.append(of)
                score.append([len(fill), -sum((capacity - f) ** 2 for f in fill.values())])
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("island"), pa.array(best, pa.list_(pa.int32())), pa.array(score, pa.list_(pa.int64()))], names=["shard", "island", "best", "score"])

    sizes = items.select("shard", F.transform("items", lambda x: x["length"]).alias("sizes"))
    state = None
    for epoch in range(epochs):
        if state is None:
            now = sizes.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("guests", F.array().cast("array<array<int>>"))
        else:  # an island keeps its best packing and is visited by that of the one before
            moved = state.withColumn("island", F.explode(F.array("island", F.pmod(F.col("island") + 1, F.lit(islands)))))
            guests = moved.groupBy("shard", "island").agg(F.collect_list("best").alias("guests"))
            now = guests.join(sizes, "shard")
        now = now.select("shard", "island", "sizes", "guests").repartition("shard", "island")
        state = now.mapInArrow(run, "shard long, island int, best array<int>, score array<long>")
        if epoch + 1 < epochs:
            state = saved(state, "islands")
    winner = state.groupBy("shard").agg(F.min_by("best", F.struct("score", "island")).alias("best"))
    placed = items.join(winner, "shard").select("shard", F.explode(F.arrays_zip("items", F.col("best").alias("bin"))).alias("x"))
    placed = placed.select("shard", "x.items.*", F.col("x.bin").alias("bin"))
    from pyspark.sql import Window

    inside = Window.partitionBy("shard", "bin").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(inside), F.lit(0))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("shard") * (1 << 32) + F.col("bin")).alias("sequence_id"), offset.alias("offset"))
