"""SimHash near-dedup: fingerprints, pigeonhole blocks, verified distances.

A fingerprint is the bitwise majority of the XXH64 hashes (seed 42) of a text's
shingles. Two fingerprints within ``bits`` differing bits agree on one of
``bits + 1`` blocks of them, so equal blocks are joined and distances verified.

Equal fingerprints are one node from the start. A block value that more than
``hot`` fingerprints share isn't joined with itself, which would try all pairs.
There, fingerprints within distance 2 are those that reach a common point by
flipping one bit at most, so each is listed under its own points and points are
grouped: as many rows as fingerprints times 65, and the same links.

Null and blank texts have fingerprint zero and link like any other; a null
doc_id counts as the smallest; repeated rows each get a row; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, lean, lists, saved, texts
from .components import components
from .repeats import mixed

NULL = -(2**63)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words in lower case (A-Z); of all words if
    there are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-size].tolist()]
    hash64 = xxhash.xxh64_intdigest
    return np.array([hash64(line[a:b], 42) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes, size: int) -> int:
    """A bit is one if it is in over half of the hashes. Signed."""
    h = shingle_hashes(text, size)
    if not len(h):
        return 0
    raw = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    if len(h) < 256:
        ones = np.unpackbits(raw, axis=1).sum(0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(raw[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(2 * ones > len(h)).view(">i8")[0])


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(t, size) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def links(nodes: DataFrame, bits: int, hot: int = 256, blocks: int | None = None) -> DataFrame:
    """``a, b``: enough links between nodes (``fp``, ``node``) that components
    are those of all pairs within ``bits``. ``blocks``: into how many blocks
    fingerprints are split; keys are ``blocks - bits`` of them together."""
    from itertools import combinations

    n = blocks or bits + 1
    cuts = [64 * i // n for i in range(n + 1)]
    masks = [sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in some) for some in combinations(range(n), n - bits)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = nodes.withColumn("key", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(signed)]))).select("fp", "node", F.col("key.i").alias("i"), F.col("key.value").alias("value"))
    shared = keyed.groupBy("i", "value").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    keyed = keyed.join(shared, ["i", "value"])
    few = keyed.filter(F.col("many") <= hot).select("i", "value", "fp", "node")
    other = few.select("i", "value", F.col("fp").alias("fp2"), F.col("node").alias("node2"))
    near = few.join(other, (few["i"] == other["i"]) & (few["value"] == other["value"]) & (F.col("node") < F.col("node2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= bits))
    near = near.select(F.col("node").alias("a"), F.col("node2").alias("b"))
    many = keyed.filter(F.col("many") > hot).select("fp", "node").distinct()
    return near.unionByName(_within(many, bits))


def _within(nodes: DataFrame, bits: int) -> DataFrame:
    """Links of nodes within an even number of bits: a pair is that close if and
    only if there is a point that each reaches by ``bits / 2`` flips."""
    if bits % 2:
        raise ValueError("common points need an even number of bits")
    flips = F.array(*[F.lit(x).cast("long") for x in (0, *(1 << i for i in range(63)), -(1 << 63))])
    point = nodes.select("fp", "node", F.col("fp").alias("point"))
    for _ in range(bits // 2):
        point = point.select("fp", "node", "point", F.explode(flips).alias("flip")).select("fp", "node", F.col("point").bitwiseXOR(F.col("flip")).alias("point")).distinct()
    least = point.groupBy("point").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    return point.join(least, "point").filter("a <> node").select("a", F.col("node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = 3, bits: int = 2, hot: int = 256, blocks: int | None = None) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits), ``component_id``: the least doc_id
    that a document reaches by links of at most ``bits`` differing bits."""
    each = saved(fingerprints(docs, size).withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL))), "simhash")
    nodes = each.groupBy("fp").agg(F.min("doc_id").alias("node"))
    found = components(links(nodes, bits, hot, blocks))
    roots = nodes.join(found, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    out = each.join(roots, "fp")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    real = [F.expr(f"nullif({c}, -9223372036854775808)").alias(c) for c in ("doc_id", "component_id")]
    return out.select(real[0], digits.alias("fingerprint"), real[1])


WORDS = 24  # 64-bit words of a wide fingerprint
SKETCH = 4  # of them, those that stand for all where candidates are compared
MANY = 4096  # rows of a bucket that are compared at once
FEW = 6  # rows of a bucket up to which all its pairs are candidates
CHANCE = 256  # rows that may share a key by chance before keys get wider
SAMPLE = 8192  # texts whose shingles tell which are common
COMMON = 100_000  # shingles at most that are held to be common
PAIRS = 1 << 17  # pairs that a task holds at once
_NEAR = 1e-9  # what rounding may take from a bound
_ODD = 2 * np.arange(WORDS, dtype=np.uint64) + np.uint64(1)
_STEP = np.arange(WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def wide_fingerprint(h: np.ndarray) -> bytes:
    """Majority bits of :data:`WORDS` hashes derived from each distinct shingle's
    hash. More bits tell similarities apart that 64 can't."""
    ones = np.zeros(64 * WORDS, np.int64)
    for lo in range(0, len(h), 255):  # so that a count fits into a byte
        g = mixed(mixed(h[lo : lo + 255, None] * _ODD + _STEP))
        ones += np.add.reduce(np.unpackbits(g.astype(">u8").view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h)).tobytes()


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Similarity of two sets, each distinct and sorted."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def least_common(sizes, similarity: float):
    """What two sets of so many members together must share to be alike."""
    return np.ceil(sizes * similarity / (1 + similarity) - _NEAR)


def prefix(h: np.ndarray, similarity: float, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first members of a set, in one order for all sets, of which sets that are alike
    share at least one: they share ``similarity`` of each. ``common`` ones, sorted, come
    last, by ``rank``; which are in it changes only how many sets meet at a member."""
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        late = common[at] == h
        h = np.concatenate([h[~late], h[late][np.argsort(rank[at[late]])]])
    return h[: len(h) - int(np.ceil(similarity * len(h) - _NEAR)) + 1]


def parity(h: np.ndarray) -> bytes:
    """Of each of two to four classes a member, by the last bits of its hash, whether the
    set has an odd number of members in it."""
    many = max(64, 1 << (2 * len(h)).bit_length())
    return np.packbits(np.bincount((h & np.uint64(many - 1)).astype(np.int64), minlength=many) & 1).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """In how many members two sets differ at least, from their parities: each class
    that differs holds one. Halves of the wider one are folded, as classes are."""
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(p) > len(q):
        p = p[: len(p) // 2] ^ p[len(p) // 2 :]
    while len(q) > len(p):
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    return int(np.bitwise_count(p ^ q).sum(dtype=np.int64))


def agreement(similarity: float) -> float:
    """Chance that a bit of two fingerprints agrees, at a Jaccard similarity."""
    return 1 - float(np.arccos(2 * similarity / (1 + similarity))) / np.pi


def block_bits(nodes: int, similarity: float = 0.8, lost: float = 0.001) -> np.ndarray:
    """Bits of each key, a row a key. Keys widen with the number of fingerprints, so
    that about :data:`CHANCE` at most share one by chance, and as many are taken as
    leave ``lost`` of the pairs at ``similarity`` without a common one. The first
    keys are the blocks of the fingerprint; more come from its bits dealt anew."""
    width = 16
    while nodes >> width > CHANCE:
        width += 1
    share = agreement(similarity) ** width
    many = -(-int(np.ceil(np.log(lost) / np.log1p(-share))) // 8) * 8
    bits, dice = np.arange(64 * WORDS), np.random.default_rng(5)
    each = len(bits) // width
    rounds = [bits] + [dice.permutation(bits) for _ in range(-(-many // each) - 1)]
    return np.concatenate([r[: each * width].reshape(each, width) for r in rounds])[:many]


def far_bits(similarity: float) -> int:
    """Bits of a sketch that a candidate may differ in: 4.4 standard deviations over
    what pairs at a similarity differ in."""
    p, n = 1 - agreement(similarity), 64 * SKETCH
    return int(n * p + 4.4 * np.sqrt(n * p * (1 - p)))


def far_apart(sketch: np.ndarray, i, j) -> np.ndarray:
    return np.bitwise_count(sketch[i] ^ sketch[j]).sum(-1, dtype=np.int64)


def leaders(sketch: np.ndarray, order: np.ndarray, far: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row linked to the first row, in ``order``, that leads and is near it. A
    row that no leader is near leads itself."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    left = order
    while len(left) > 512:
        near = far_apart(sketch, left[1:], left[0]) <= far
        b.append(left[1:][near])
        a.append(np.full(len(b[-1]), left[0]))
        left = left[1:][~near]
    near = np.triu(far_apart(sketch, left[:, None], left) <= far, 1)
    free = np.ones(len(left), bool)
    for i in np.flatnonzero(near.any(1)).tolist():
        if free[i]:
            led = np.flatnonzero(near[i] & free)
            free[led] = False
            b.append(left[led])
            a.append(np.full(len(led), left[i]))
    return np.concatenate(a), np.concatenate(b)


def all_pairs(sketch: np.ndarray, edge: np.ndarray, far: int) -> tuple[np.ndarray, np.ndarray]:
    """Near rows of one bucket, for small buckets that begin at ``edge``."""
    bucket = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, int(np.diff(edge).max(initial=0))):
        i = np.flatnonzero(bucket[step:] == bucket[:-step])
        i = i[far_apart(sketch, i, i + step) <= far]
        a.append(i)
        b.append(i + step)
    return np.concatenate(a), np.concatenate(b)


def nearest_of_groups(sketch: np.ndarray, root: np.ndarray, far: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each two groups that have near rows, the two nearest."""
    found = [[np.zeros(0, np.int64)] for _ in range(5)]
    for i in range(len(root) - 1):
        d = far_apart(sketch, slice(i + 1, None), i)
        at = np.flatnonzero((d <= far) & (root[i + 1 :] != root[i]))
        other = root[i + 1 + at]
        at = at[np.lexsort((d[at], other))]
        other = root[i + 1 + at]
        at = at[np.concatenate([[True], other[1:] != other[:-1]])[: len(at)]]  # the nearest of each group
        other = root[i + 1 + at]
        for column, value in zip(found, (np.minimum(other, root[i]), np.maximum(other, root[i]), d[at], np.full(len(at), i), i + 1 + at), strict=True):
            column.append(value)
    lo, hi, d, a, b = map(np.concatenate, found)
    order = np.lexsort((d, hi, lo))
    lo, hi, a, b = lo[order], hi[order], a[order], b[order]
    first = np.concatenate([[True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])[: len(lo)]
    return a[first], b[first]


def buckets(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], most: int | None) -> Iterator[tuple[pa.Table, np.ndarray, bool]]:
    """Tables of whole buckets, and where each begins and the last ends, from rows
    sorted by ``names``. A bucket of over ``most`` rows comes in parts, each a table
    of its own that isn't called whole."""

    def bounds(table: pa.Table) -> np.ndarray:
        change = np.zeros(table.num_rows - 1, bool)
        for name in names:
            column = table.column(name).to_numpy()
            change |= column[1:] != column[:-1]
        return np.concatenate([[0], np.flatnonzero(change) + 1, [table.num_rows]])

    held, broken = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        edge = bounds(held)
        if broken and len(edge) > 2:  # the end of a bucket that began in parts
            yield held.slice(0, edge[1]), edge[:2], False
            held, broken, edge = held.slice(edge[1]), False, edge[1:] - edge[1]
        if len(edge) > 2:
            yield held.slice(0, edge[-2]), edge[:-1], True
            held = held.slice(edge[-2])
        while most and held.num_rows > most:
            yield held.slice(0, most), np.array([0, most]), False
            held, broken = held.slice(most), True
    if held is not None and held.num_rows:
        yield held, bounds(held), not broken


def crossing(*rows, **limits) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of :func:`crossings`."""
    a, b = zip(*crossings(*rows, **limits), strict=True)
    return np.concatenate(a), np.concatenate(b)


def crossings(bucket: np.ndarray, n: np.ndarray, at: np.ndarray, root: np.ndarray, own: np.ndarray, similarity: float, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows that meet in a bucket, are in different groups and may be alike. A row is the
    member at place ``at`` of a set of ``n``; rows of a bucket are in order of ``n``. If it
    is the first that two sets share, they share no more than what follows it in either.
    Of two rows one must be the bucket's ``own``. As pairs grow with the square of a
    crowd, they come ``most`` at a time, and at most one more for each row."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    i, step, held = np.arange(len(bucket)), 1, 0
    while len(i := i[: np.searchsorted(i, len(bucket) - step)]):
        j = i + step
        stay = (bucket[i] == bucket[j]) & (n[i] >= similarity * n[j] - _NEAR)  # else no later row is alike
        i, j = i[stay], j[stay]
        met = (root[i] != root[j]) & (own[i] | own[j]) & (np.minimum(n[i] - at[i], n[j] - at[j]) >= least_common(n[i] + n[j], similarity))
        a.append(i[met])
        b.append(j[met])
        held += len(a[-1])
        step += 1
        if held >= most:
            yield np.concatenate(a), np.concatenate(b)
            a, b, held = [], [], 0
    if a:
        yield np.concatenate(a), np.concatenate(b)


_SKETCH = tuple(f"s{i}" for i in range(SKETCH))


def _sketches(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in _SKETCH], 1).view(np.uint64)


def _keyed(nodes: DataFrame, bits: np.ndarray) -> DataFrame:
    """``key, node, s0, ...``: a row for each key of each node."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, width = bits.shape
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                raw = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                own = np.zeros((batch.num_rows, many, 64), np.uint8)
                own[:, :, 64 - width :] = np.unpackbits(raw, axis=1)[:, bits]
                key = np.packbits(own, axis=2).view(">u8")[:, :, 0].astype(np.int64) + (np.arange(many) << width)
                at = np.repeat(np.arange(batch.num_rows), many)
                sketch = raw.view(np.int64).reshape(-1, WORDS)[:, :SKETCH][at]
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), batch.column("node").take(pa.array(at)), *(pa.array(np.ascontiguousarray(c)) for c in sketch.T)], names=["key", "node", *_SKETCH])

    return nodes.select("node", "fp").mapInArrow(lean(split), "key long, node long, " + ", ".join(f"{c} long" for c in _SKETCH))


def _candidates(nodes: DataFrame, bits: np.ndarray, count: int, far: int, many: int) -> DataFrame:
    """``a, b``, and ``key`` of buckets that need another round.

    A bucket of at most :data:`FEW` rows gives all near pairs. In others each row is
    linked to a leader, the near row with the least node; as two rows that are near share
    several keys and meet other rows under each, they have as many leaders to be linked
    by. Buckets that come in parts are looked at again, with the groups found so far."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edge, whole in buckets(batches, ("key", "part"), many):
            key, node, sketch = table.column("key").to_numpy(), table.column("node").to_numpy(), _sketches(table)
            size, parts = np.diff(edge), table.column("parts").to_numpy()[edge[:-1]]
            again = (parts > 1) | (not whole)
            rows = np.flatnonzero(np.repeat(size <= FEW, size))
            x, y = all_pairs(sketch[rows], np.concatenate([[0], np.cumsum(size[size <= FEW])]), far)
            a, b = [rows[x]], [rows[y]]
            for k in np.flatnonzero(size > FEW).tolist():
                own = slice(int(edge[k]), int(edge[k + 1]))
                x, y = leaders(sketch[own], np.argsort(node[own], kind="stable"), far)
                a.append(x + own.start)
                b.append(y + own.start)
            x, y = node[np.concatenate(a)], node[np.concatenate(b)]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.nulls(len(x), pa.int64())], names=["a", "b", "key"])
            if again.any():
                keys = pa.array(np.unique(key[edge[:-1][again]]))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.int64()), pa.nulls(len(keys), pa.int64()), keys], names=["a", "b", "key"])

    work = _dealt(_keyed(nodes, bits), _keyed(nodes.filter("pmod(xxhash64(node), 8) = 0"), bits), count * len(bits), 8, many)
    return work.mapInArrow(lean(compare), "a long, b long, key long").distinct()


def _dealt(rows: DataFrame, some: DataFrame, total: int, times: int, many: int) -> DataFrame:
    """``rows`` in order of ``key`` and ``part``; hot keys in ``parts`` parts, for which
    one row in ``times`` is counted (``some``). A list of at most 100,000 keys is sent
    to all tasks."""
    most = max(1, many // 2, total // 100_000)
    hot = some.groupBy("key").agg((times * F.count(F.lit(1))).alias("many")).filter(F.col("many") > most)
    rows = rows.join(F.broadcast(saved(hot, "hot")), "key", "left")
    rows = rows.withColumn("parts", F.coalesce(F.ceil(F.col("many") / most), F.lit(1)).cast("int")).drop("many")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    return rows.repartition("key", "part").sortWithinPartitions("key", "part")


def _again(nodes: DataFrame, bits: np.ndarray, count: int, keys: DataFrame, roots: DataFrame, far: int, many: int) -> DataFrame:
    """``a, b`` of buckets that hold several groups still: of each two groups with
    near rows, the two nearest. Where a bucket is too large to be compared at once,
    the row with the least node stands for its group there."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edge, _ in buckets(batches, ("key", "ta", "tb"), None):
            node, root, sketch = table.column("node").to_numpy(), table.column("root").to_numpy(), _sketches(table)
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                a, b = (node[lo:hi][x] for x in nearest_of_groups(sketch[lo:hi], root[lo:hi], far))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    rows = _keyed(nodes, bits).join(keys, "key").join(roots, "node", "left")
    rows = saved(rows.withColumn("root", F.coalesce("root", "node")), "open", count)
    several = rows.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    rows = rows.join(several.select("key", "many"), "key")
    large = rows.filter(F.col("many") > many).groupBy("key", "root").agg(F.min(F.struct("node", *_SKETCH)).alias("row")).select("key", "root", "row.*")
    # groups of one bucket that stay too many for one task are compared in tiles, each two parts in a task of its own
    side = large.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / max(1, many // 4)).cast("int").alias("side"))
    large = large.join(side, "key").withColumn("part", F.pmod(F.xxhash64("node"), "side").cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("side") - 1)))
    large = large.withColumns({"ta": F.least("part", "other"), "tb": F.greatest("part", "other")})
    small = rows.filter(F.col("many") <= many).withColumns({"ta": F.lit(0), "tb": F.lit(0)})
    columns = ["key", "ta", "tb", "node", "root", *_SKETCH]
    work = small.select(*columns).unionByName(large.select(*columns))
    return work.repartition("key", "ta", "tb").sortWithinPartitions("key", "ta", "tb").mapInArrow(lean(compare), "a long, b long").distinct()


def _common(text: DataFrame, total: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles, sorted, and the rank of each, rarer ones first, from a sample of
    about :data:`SAMPLE` texts. They only set an order (see :func:`prefix`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, size) for t in as_bytes(batch.column("text"))]
            h, many = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(many)], names=["h", "many"])

    times = -(-total // SAMPLE) or 1
    some = text.filter(F.pmod(F.xxhash64("_id", "_h"), F.lit(times)) == 0).select("text").mapInArrow(lean(run), "h long, many long")
    often = some.groupBy("h").agg(F.sum("many").alias("many")).filter(F.col("many") >= max(4, 64 // times))
    found = often.orderBy(F.desc("many"), "h").limit(COMMON).toArrow()
    h = found.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], -order


def _missed(nodes: DataFrame, count: int, similarity: float, many: int) -> DataFrame:
    """``a, b, ra, rb``: every two nodes of different groups (``root``) that may be alike.

    Sets that are alike share a member of their prefixes, so nodes meet at each member of
    theirs. No row is left out where many meet: they are dealt into parts, and all but those
    of the largest group go to every part, as rows of one group needn't be compared."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edge, _ in buckets(batches, ("key", "part"), None):
            root = table.column("root").to_numpy()
            several = np.minimum.reduceat(root, edge[:-1]) < np.maximum.reduceat(root, edge[:-1])
            rows = np.flatnonzero(np.repeat(several, np.diff(edge)))
            if not len(rows):
                continue
            bucket, root = np.repeat(np.arange(len(edge) - 1), np.diff(edge))[rows], root[rows]
            node, n, at, own = (table.column(c).to_numpy()[rows] for c in ("node", "n", "at", "own"))
            for x, y in crossings(bucket, n.astype(np.int64), at, root, own.astype(bool), similarity):
                x, y = np.where(node[x] < node[y], x, y), np.where(node[x] < node[y], y, x)
                found = np.unique(np.stack([node[x], node[y], root[x], root[y]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in found.T], names=["a", "b", "ra", "rb"])

    def able(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = np.array([apart(x, y) for x, y in zip(batch.column("pa").to_pylist(), batch.column("pb").to_pylist(), strict=True)], np.int64)
            sizes = batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()
            may = least <= sizes - 2 * least_common(sizes, similarity)
            yield batch.select(["a", "b", "ra", "rb"]).filter(pa.array(may, pa.bool_()))

    rows = nodes.select("node", "root", "n", F.posexplode("prefix").alias("at", "key"))
    total = nodes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    most = max(1, many // 2, total // 100_000)
    some = rows.filter("pmod(xxhash64(node), 8) = 0").groupBy("key").agg((8 * F.count(F.lit(1))).alias("many"))
    hot = F.broadcast(saved(some.filter(F.col("many") > most).select("key"), "hot"))
    each = rows.join(hot, "key").groupBy("key", "root").agg(F.count(F.lit(1)).alias("many"))
    largest = each.groupBy("key").agg(F.sum("many").alias("all"), F.max(F.struct("many", "root")).alias("largest")).filter(F.col("all") > F.col("largest.many"))
    largest = largest.select("key", F.ceil(F.col("all") / most).cast("int").alias("parts"), F.col("largest.root").alias("first"))
    crowd = rows.join(F.broadcast(saved(largest, "largest")), "key").withColumn("home", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    crowd = crowd.withColumn("part", F.explode(F.when(F.col("root") == F.col("first"), F.array("home")).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    crowd = crowd.withColumn("own", (F.col("part") == F.col("home")).cast("int"))
    calm = rows.join(hot, "key", "left_anti").withColumns({"part": F.lit(0), "own": F.lit(1)})
    columns = ["key", "part", "n", "at", "own", "node", "root"]
    work = calm.select(*columns).unionByName(crowd.select(*columns)).repartition("key", "part").sortWithinPartitions("key", "part", "n")
    pairs = saved(work.mapInArrow(lean(compare), "a long, b long, ra long, rb long").distinct(), "crossing", count)
    size = nodes.select("node", "n", "parity")
    pairs = pairs.join(size.toDF("a", "na", "pa"), "a").join(size.toDF("b", "nb", "pb"), "b")
    return pairs.mapInArrow(lean(able), "a long, b long, ra long, rb long")


def _groups(docs: DataFrame, size: int, similarity: float, many: int) -> DataFrame:
    """``_id, _h, root`` for each row of ``docs``, which has ``_id`` and ``_h`` (see
    :func:`representatives`); ``root`` is the same in a group and nowhere else."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, size) for t in as_bytes(batch.column("text"))]
            columns = {
                "fp": pa.array([wide_fingerprint(h) for h in sets], pa.binary()),
                "s": pa.array(np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)),
                "n": pa.array([len(h) for h in sets], pa.int32()),
                "parity": pa.array([parity(h) for h in sets], pa.binary()),
                "prefix": lists([prefix(h, similarity, common, rank).view(np.int64) for h in sets], pa.int64()),
            }
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_h"), *columns.values()], names=["_id", "_h", *columns])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = functools.lru_cache(64)(functools.partial(shingle_set, size=size))  # a leader comes many times
        for batch in batches:
            x, y = as_bytes(batch.column("ta")), as_bytes(batch.column("tb"))
            alike = pa.array([jaccard(shingles(t), shingles(u)) >= similarity for t, u in zip(x, y, strict=True)], pa.bool_())
            yield batch.drop_columns(["ta", "tb"]).filter(alike)

    def verified(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        wanted = nodes.join(ends, "node", "left_semi").select("node", "_id", "_h")
        there = saved(text.join(wanted, ["_id", "_h"]).dropDuplicates(["node"]).select("node", "text"), "texts", count)
        both = pairs.join(there.toDF("a", "ta"), "a").join(there.toDF("b", "tb"), "b")
        return saved(both.select(*pairs.columns, "ta", "tb").mapInArrow(lean(verify), pairs.schema), "links", count)

    text = texts(docs, "_id", "_h").drop("doc_id")
    total = text.count()
    common, rank = _common(text, total, size)
    each = saved(text.mapInArrow(lean(sign), "_id long, _h long, fp binary, s long, n int, parity binary, prefix array<long>"), "simhash")
    nodes = each.groupBy("fp", "s").agg(F.min(F.struct("_id", "_h")).alias("row"), *(F.first(c).alias(c) for c in ("n", "parity", "prefix")))
    nodes = nodes.select("fp", "s", "row.*", "n", "parity", "prefix")
    nodes = saved(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes", total)
    count = nodes.count()
    bits, far = block_bits(count, similarity), far_bits(similarity)
    found = saved(_candidates(nodes, bits, count, far, many), "pairs", count)
    open_, pairs = found.filter("key is not null").select("key"), found.filter("key is null").select("a", "b")
    some_open = not open_.isEmpty()
    links = roots = None
    while True:
        new = verified(pairs)
        if links is not None and new.isEmpty():
            break
        links = new if links is None else links.unionByName(new)
        roots = components(links, count)
        if not some_open:
            break
        pairs = saved(_again(nodes, bits, count, open_, roots, far, many), "pairs", count)
    nodes = saved(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "nodes", count)
    new = verified(saved(_missed(nodes, count, similarity, many), "pairs", count))
    joined = components(new.select(F.col("ra").alias("a"), F.col("rb").alias("b")), count).toDF("root", "least")
    roots = nodes.join(joined, "root", "left").select("fp", "s", F.coalesce("least", "root").alias("root"))
    return saved(each.select("_id", "_h", "fp", "s").join(roots, ["fp", "s"]).select("_id", "_h", "root"), "groups", total)


def _marked(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_id": F.coalesce("doc_id", F.lit(NULL)), "_h": F.xxhash64("text")})


def similar(docs: DataFrame, size: int = 5, similarity: float = 0.8, many: int = MANY) -> DataFrame:
    """``doc_id, component_id``: groups of texts whose sets of shingles have a Jaccard
    similarity of ``similarity`` or more, directly or through others. No pair from there on
    is left out: what the fingerprints miss, :func:`_missed` finds.

    Candidates of the fingerprints agree on one key of :func:`block_bits` (up to 17 million fingerprints, 96
    blocks of 16 bits) and differ in :func:`far_bits` of a 256-bit sketch at most; each
    is verified on its texts. Bits of two fingerprints differ with probability
    ``acos(2 J / (1 + J)) / pi``, so at J = 0.8 a pair is a candidate in over 99.8 of
    100 cases. In buckets of over :data:`FEW` rows candidates are linked to leaders; in
    those of over ``many``, groups that are near each other are then tried by their
    nearest rows, until no more are joined. Last, texts of different groups are compared
    wherever they share a shingle of the part of their sets that alike texts must share."""
    rows = _groups(_marked(docs), size, similarity, many)
    least = rows.groupBy("root").agg(F.min("_id").alias("least"))
    real = [F.expr(f"nullif({c}, -9223372036854775808)").alias(n) for c, n in (("_id", "doc_id"), ("least", "component_id"))]
    return rows.join(least, "root").select(*real)


def representatives(docs: DataFrame, size: int = 5, similarity: float = 0.8, many: int = MANY) -> DataFrame:
    """``docs`` with one row of each group of :func:`similar`: the one with the
    least doc_id (a null one is the least), then the least hash of its text."""
    docs = _marked(docs)
    first = _groups(docs, size, similarity, many).groupBy("root").agg(F.min(F.struct("_id", "_h")).alias("row")).select("row.*")
    kept = docs.join(first, ["_id", "_h"], "left_semi")
    again = kept.groupBy("_id", "_h").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    kept = kept.join(again, ["_id", "_h"], "left")
    twice = kept.filter("_n is not null").dropDuplicates(["_id", "_h"])
    return kept.filter("_n is null").unionByName(twice).drop("_id", "_h", "_n")
