"""Exact search for repeated windows, in space linear in the text.

A *window* is ``window`` consecutive units (bytes or words) of one document.
Every window picks its least ``gram`` of ``k`` units (its minimizer, leftmost
on ties). Equal windows pick the same gram at the same offset, wherever they
stand, so they meet in the group of that gram, and consecutive windows with
one minimizer form a run that needs only one row. Per document there are about
``2 / (window - k + 2)`` rows a unit, not one.

1. :func:`_index` scans texts once: grams of runs, and repeats inside a document.
2. Of exact copies only the least doc_id goes on (pre-aggregation on the text's
   hash), so a hot group of copies costs one document.
3. Grams that two different texts or more have are found. Each batch of documents
   sends one text for each gram (with a count), packed by bucket, so a frequent
   gram costs an entry for each batch. Only runs of such grams go on, with the
   slice of text that they cover.
4. A resolver decides each window inside its gram's group. The group of a gram
   that over ``hot`` texts have is split by the window's offset to the gram into
   bands, as only windows at equal offsets can be equal, and each band by a longer
   key: all the units around the gram that every window of the band has. What is
   left together are near copies of one passage, dealt by text into parts of about
   ``hot`` rows. A part settles all but the first of equal windows (the first two,
   where any other one counts), and what is left of the parts meets again: at most
   that many rows a part, however many copies there are.
5. Covered windows return to their documents.

Hashes are 64-bit polynomials with fixed odd base over a seeded random table;
equal windows always agree, and different windows of one gram's group agree
with a chance of about 2**-64.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, lists, partitions, saved, small_batches

U64 = np.uint64
SALTS = 16  # parts into which the texts of a hot gram are dealt in a join
CHUNK = 1 << 20  # units hashed at once; longer documents go in overlapping chunks
_LOW = U64(CHUNK * 2 - 1)
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(42).integers(0, 2**64, 256, dtype=U64) | U64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i below n."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        made = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            x = np.full(size, base, U64)
            x[0] = 1
            made.append(np.cumprod(x))
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread a polynomial hash so that its order is close to random."""
    h = h ^ (h >> U64(31))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(29)
    return h


def prefix_hash(x: np.ndarray) -> np.ndarray:
    h = np.zeros(len(x) + 1, U64)
    np.cumsum(x * powers(len(x))[0], out=h[1:])
    return h


def hashes_of(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` units, from prefix hashes."""
    n = len(h) - length
    return (h[length:] - h[:n]) * powers(n)[1] if n > 0 else np.zeros(0, U64)


def byte_units(text: bytes) -> np.ndarray:
    return _TABLE[np.frombuffer(text, np.uint8)]


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^ \\t-\\r]+``."""
    blank = np.ones(len(text) + 2, bool)
    blank[1:-1] = _SPACE[np.frombuffer(text, np.uint8)]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    return edges[::2], edges[1::2]


def word_units(text: bytes) -> np.ndarray:
    """A hash for each word, made in pieces so that long texts stay cheap."""
    starts, ends = word_bounds(text)
    out = np.zeros(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        a = int(starts[i])
        h = prefix_hash(byte_units(text[a : int(ends[j - 1])]))
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mixed((h[e] - h[s]) * powers(len(h))[1][s] + (e - s).astype(U64))
        i = j
    return out


UNITS = {"byte": byte_units, "word": word_units}


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, in about log2(width) passes."""
    have = 1
    while have * 2 <= width:
        a = np.minimum(a[:-have], a[have:])
        have *= 2
    return np.minimum(a[: len(a) - (width - have)], a[width - have :]) if have < width else a


def runs_of(x: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram, first window, number of windows, and offset of the first window to
    its gram, for each run of windows with one minimizer."""
    grams, firsts, counts, offsets = [], [], [], []
    n = len(x)
    for at in range(0, max(0, n - window + 1), CHUNK):
        part = x[at : at + CHUNK + window - 1]
        g = mixed(hashes_of(prefix_hash(part), k))
        least = sliding_min((g & ~_LOW) | np.arange(len(g), dtype=U64), window - k + 1) & _LOW
        first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        place = least[first].astype(np.int64)
        grams.append(g[place])
        firsts.append(first + at)
        counts.append(np.diff(np.append(first, len(least))))
        offsets.append(place - first)
    if not grams:
        z = np.zeros(0, np.int64)
        return z.astype(U64), z, z, z
    return tuple(map(np.concatenate, (grams, firsts, counts, offsets)))


def window_hashes(x: np.ndarray, window: int) -> np.ndarray:
    return np.concatenate([hashes_of(prefix_hash(x[i : i + CHUNK + window - 1]), window) for i in range(0, max(1, len(x) - window + 1), CHUNK)])


def spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open runs of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def repeated(keys: np.ndarray, keep_first: bool) -> np.ndarray:
    """Flags of keys that occur more than once; the first may stay unflagged."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    flags = np.zeros(len(keys), bool)
    flags[order[1:][same]] = True
    if not keep_first:
        flags[order[:-1][same]] = True
    return flags


def runs_and_repeats(x: np.ndarray, window: int, k: int, keep_first: bool) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """:func:`runs_of` a document, one of each different run, and half-open ranges
    of the windows that the document itself repeats."""
    g, first, count, offset = runs_of(x, window, k)
    lo = hi = np.zeros(0, np.int32)
    if len(g) > 1 and len(np.unique(g)) < len(g):
        w = window_hashes(x, window)
        lo, hi = spans(repeated(w, keep_first))
        # equal runs have equal first and last windows
        key = mixed(w[first]) + w[first + count - 1] * U64(3) + count.astype(U64)
        _, only = np.unique(key, return_index=True)
        only.sort()
        g, first, count, offset = g[only], first[only], count[only], offset[only]
    return (g, first, count, offset), lo, hi


#: Rows of three kinds: a document (doc_id, h, n, los, his); a batch's grams of one
#: bucket (bucket, packed); grams of a text that the batch itself shows are shared (h, grams).
INDEX = "doc_id long, h long, n long, los array<int>, his array<int>, bucket int, packed binary, grams array<long>"
SEEN = np.dtype([("g", "<i8"), ("h", "<i8"), ("many", "<u4")])  # gram, a text that has it, texts in the batch


def _index(unit: str, window: int, k: int, keep_first: bool, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in INDEX.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.list_(pa.int64())]

        def rows(**columns: pa.Array) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([columns[c].cast(t) if c in columns else pa.nulls(n, t) for c, t in zip(names, kinds, strict=True)], names=names)

        for batch in batches:
            h = batch.column("h").to_numpy()
            n, grams, los, his = [], [], [], []
            for text in as_bytes(batch.column("text")):
                x = UNITS[unit](text)
                (g, *_), lo, hi = runs_and_repeats(x, window, k, keep_first)
                n.append(len(x))
                grams.append(np.unique(g).view(np.int64))
                los.append(lo.astype(np.int32))
                his.append(hi.astype(np.int32))
            yield rows(doc_id=batch.column("doc_id"), h=batch.column("h"), n=pa.array(n, pa.int64()), los=lists(los, pa.int32()), his=lists(his, pa.int32()))
            # of each gram one text goes on, however many of the batch have it
            g, text = np.concatenate([*grams, np.zeros(0, np.int64)]), np.repeat(h, [len(x) for x in grams])
            if not len(g):
                continue
            order = np.lexsort((text, g))
            g, text = g[order], text[order]
            new = np.concatenate([[True], (g[1:] != g[:-1]) | (text[1:] != text[:-1])])
            g, text = g[new], text[new]
            at = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            many = np.diff(np.append(at, len(g)))
            one = np.empty(len(at), SEEN)
            one["g"], one["h"], one["many"] = g[at], text[at], many
            bucket = (g[at].view(U64) % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            one, bucket = one[order], bucket[order]
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])).tolist()
            yield rows(bucket=pa.array(bucket[edge[:-1]], pa.int32()), packed=pa.array([one[a:b].tobytes() for a, b in zip(edge, edge[1:], strict=False)], pa.binary()))
            shared = np.repeat(many > 1, many)
            if shared.any():
                g, text = g[shared], text[shared]
                order = np.argsort(text, kind="stable")
                g, text = g[order], text[order]
                edge = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1], [True]])).tolist()
                yield rows(h=pa.array(text[edge[:-1]]), grams=lists([g[a:b] for a, b in zip(edge, edge[1:], strict=False)], pa.int64()))

    return run


SHARED = "g long, h long, many long"


def _shared() -> Callable:
    """Grams that two texts or more have, one of them new, from rows sorted by bucket,
    with the text that stood for each batch and how many texts (a text for each batch
    that has it) there are; a bucket is held at a time."""

    def found(packed: list[bytes], news: list[bool]) -> pa.RecordBatch:
        seen = np.frombuffer(b"".join(packed), SEEN)
        new = np.repeat(news, [len(p) // SEEN.itemsize for p in packed])
        order = np.lexsort((seen["h"], seen["g"]))
        seen, new = seen[order], new[order]
        g, h = seen["g"], seen["h"]
        at = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        size = np.diff(np.append(at, len(g)))
        several = (h[at] != h[at + size - 1]) | (np.maximum.reduceat(seen["many"], at) > 1)
        several &= np.maximum.reduceat(new, at)
        keep = np.repeat(several, size)
        total = np.repeat(np.add.reduceat(seen["many"].astype(np.int64), at), size)
        return pa.RecordBatch.from_arrays([pa.array(g[keep]), pa.array(h[keep]), pa.array(total[keep])], names=["g", "h", "many"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, news = None, [], []
        for batch in batches:
            for bucket, packed, new in zip(*(batch.column(c).to_pylist() for c in ("bucket", "packed", "new")), strict=True):
                if bucket != now and held:
                    yield found(held, news)
                    held, news = [], []
                now = bucket
                held.append(packed)
                news.append(new)
        if held:
            yield found(held, news)

    return run


CONTEXT = "g long, band int, doc_id long, h long, first int, slice binary"
RANGES = "doc_id long, h long, lo int, hi int"
#: Ranges, and slices of what a part of a hot group leaves open.
FIRST = RANGES + ", g long, band int, first int, slice binary"


def common_key(x: np.ndarray, gram: int, least: int, band: int, window: int, k: int) -> int:
    """Hash of the units that all windows have whose offset to the gram at ``gram`` is
    ``least`` or up to ``band - 1`` more. Signed."""
    most = min(least + band - 1, window - k)
    return int(mixed(prefix_hash(x[gram - least : gram - most + window])[-1:]).view(np.int64)[0])


def _slices(unit: str, window: int, k: int, keep_first: bool, hot_band: int) -> Callable:
    """Cut the text that each run of a shared gram covers; hot runs are cut again by
    band, with a key of what the windows of a band have in common, and dealt into
    parts. Runs are found anew, which costs less than carrying them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gs, bands, ids, hs, firsts, cut, parts = [], [], [], [], [], [], []
            spread = mixed(batch.column("h").to_numpy().view(U64)).tolist()
            for doc, h, deal, text, shared, hots in zip(batch.column("doc_id").to_pylist(), batch.column("h").to_pylist(), spread, as_bytes(batch.column("text")), batch.column("shared"), batch.column("hots").to_pylist(), strict=True):
                if unit == "word":
                    starts, ends = word_bounds(text)
                x = UNITS[unit](text)
                (g, first, count, offset), _, _ = runs_and_repeats(x, window, k, keep_first)
                g = g.view(np.int64)
                hot = {r["g"]: r["parts"] for r in hots}
                for i in np.flatnonzero(np.isin(g, shared.values.to_numpy())).tolist():
                    gram = int(g[i])
                    pieces, part = [(gram, 0, int(first[i]), int(count[i]))], 0
                    if gram in hot:  # offset falls by one from window to window
                        pieces, a, many, off = [], 0, int(count[i]), int(offset[i])
                        part = deal % hot[gram]
                        while a < many:
                            band = (off - a) // hot_band
                            b = min(many, off - band * hot_band + 1)
                            pieces.append((common_key(x, int(first[i]) + off, band * hot_band, hot_band, window, k), band + 1, int(first[i]) + a, b - a))
                            a = b
                    for key, band, at, many in pieces:
                        last = at + many - 1 + window
                        gs.append(key)
                        bands.append(band)
                        ids.append(doc)
                        hs.append(h)
                        firsts.append(at)
                        cut.append(text[at:last] if unit == "byte" else text[int(starts[at]) : int(ends[last - 1])])
                        parts.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(gs, pa.int64()), pa.array(bands, pa.int32()), pa.array(ids, pa.int64()), pa.array(hs, pa.int64()), pa.array(firsts, pa.int32()), pa.array(cut, pa.binary()), pa.array(parts, pa.int32())], names=["g", "band", "doc_id", "h", "first", "slice", "part"])

    return run


def ranks(keys: np.ndarray) -> np.ndarray:
    """How many equal keys stand before each."""
    order = np.argsort(keys, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]])[: len(keys)])
    out = np.empty(len(keys), np.int64)
    out[order] = np.arange(len(keys)) - np.repeat(edge, np.diff(np.append(edge, len(keys))))
    return out


def _first_pass(unit: str, window: int, keep_first: bool, resolver: Callable) -> Callable:
    """:data:`FIRST` from slices, those of hot groups last: the resolver's ranges of the
    others; in a part of a hot group, a window with one equal one before it (two, if not
    ``keep_first``) is covered, and all others are left open."""
    names, kinds = [x.split()[0] for x in FIRST.split(", ")], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    most = 1 if keep_first else 2

    def rows(**columns: pa.Array) -> pa.RecordBatch:
        n = len(columns["doc_id"])
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in zip(names, kinds, strict=True)], names=names)

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, open_group = np.zeros(0, U64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            b = Slices(batch, unit, window)
            if open_group != b.group(last=False):
                seen = seen[:0]
            rank = ranks(np.concatenate([seen, b.keys]))[len(seen) :]
            open_group = b.group(last=True)
            ends = b.keys[b.tail :][rank[b.tail :] < most]
            seen = np.concatenate([seen, ends]) if b.tail == 0 else ends
            found = b.ranges(rank >= most)
            yield rows(**dict(zip(found.schema.names, found.columns, strict=True)))
            left = b.left(rank < most)
            yield rows(**dict(zip(left.schema.names, left.columns, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def others() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = int(np.count_nonzero(batch.column("band").to_numpy() == 0))
                yield batch.slice(0, n)
                if n < batch.num_rows:
                    rest.append(batch.slice(n))
                    return

        for found in resolver(others()):
            yield rows(**dict(zip(found.schema.names, found.columns, strict=True)))
        yield from thinned(itertools.chain(rest, batches))

    return run


def prepared(docs: DataFrame) -> DataFrame:
    """``docs`` with ``h``, a hash of the text; a null doc_id is the smallest id and a
    null text empty."""
    return docs.withColumns({"doc_id": F.coalesce("doc_id", F.lit(-(2**63))), "text": F.coalesce("text", F.lit(""))}).withColumn("h", F.xxhash64("text"))


def indexed(docs: DataFrame, unit: str, window: int, k: int, keep_first: bool, buckets: int) -> DataFrame:
    """:data:`INDEX` of :func:`prepared` documents."""
    return docs.select("doc_id", "h", "text").mapInArrow(_index(unit, window, k, keep_first, buckets), INDEX)


def covered_windows(docs: DataFrame, unit: str, window: int, k: int, keep_first: bool, resolver: Callable, hot: int = 4096, hot_band: int | None = None) -> DataFrame:
    """``docs`` with ``h`` (a hash of the text) and ``ranges``: the starts of its
    covered windows as half-open ranges. With ``keep_first`` a window is covered if
    an equal one starts earlier, else if there is any other equal one. A null
    doc_id counts as the smallest id."""
    small_batches(docs.sparkSession)
    docs = prepared(docs)
    index = saved(indexed(docs, unit, window, k, keep_first, 16 * partitions(docs.sparkSession)), "repeats")
    found = ranges_of(index, docs, None, unit, window, k, keep_first, resolver, hot, hot_band)
    found = found.groupBy("doc_id", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    return docs.join(found, ["doc_id", "h"], "left")


def ranges_of(index: DataFrame, docs: DataFrame, older: DataFrame | None, unit: str, window: int, k: int, keep_first: bool, resolver: Callable, hot: int = 4096, hot_band: int | None = None) -> DataFrame:
    """:data:`RANGES` of windows of ``docs`` that are covered. With ``older``, the index
    of texts that were there before, only repeats in which a text of ``index`` takes
    part are looked for; ``docs`` has the texts of both."""
    each = index.filter("n is not null").select("doc_id", "h", "n", "los", "his")
    seen = index.filter("bucket is not null").select("bucket", "packed", F.lit(True).alias("new"))
    local = index.filter("grams is not null").select(F.explode("grams").alias("g"), "h")
    rows = each.select("doc_id", "h", "n", F.lit(True).alias("new"))
    if older is not None:
        rows = rows.unionByName(older.filter("n is not null").select("doc_id", "h", "n", F.lit(False).alias("new")))
        seen = seen.unionByName(older.filter("bucket is not null").select("bucket", "packed", F.lit(False).alias("new")))

    # of equal texts, the least doc_id stands for all
    groups = rows.groupBy("h", "n").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.max("new").alias("new"))
    copies = rows.select("doc_id", "h", "n").join(groups.filter("copies > 1 and new").drop("new"), ["h", "n"]).filter("n >= %d" % window)
    removed = copies.filter("doc_id <> least") if keep_first else copies

    known = saved(seen.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared(), SHARED), "shared")
    if older is not None:  # of the grams that older batches shared, those that come again
        before = older.filter("grams is not null").select(F.explode("grams").alias("g"), "h")
        local = local.unionByName(before.join(known.select("g").distinct(), "g", "left_semi"))
    often = known.filter(F.col("many") > hot).select("g", F.ceil(F.col("many") / hot).cast("int").alias("parts")).distinct()
    often = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = known.select("g", "h").unionByName(local).withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int")).join(often, ["g", "salt"], "left")
    hits = hits.groupBy("h").agg(F.collect_set("g").alias("shared"), F.collect_set(F.when(F.col("parts").isNotNull(), F.struct("g", "parts"))).alias("hots"))
    hits = groups.select("h", F.col("least").alias("doc_id")).join(hits, "h")
    context = docs.join(hits, ["doc_id", "h"])  # all columns, as in covered_windows: one exchange of texts serves both joins
    context = context.mapInArrow(_slices(unit, window, k, keep_first, hot_band or max(1, (window - k + 1) // 10)), CONTEXT + ", part int")
    context = context.repartition("g", "band", "part").sortWithinPartitions(F.col("band") > 0, "g", "band", "doc_id", "first")
    first = saved(context.mapInArrow(_first_pass(unit, window, keep_first, resolver), FIRST), "first")
    left = first.filter("slice is not null").select("g", "band", "doc_id", "h", "first", "slice")
    left = left.repartition("g", "band").sortWithinPartitions("g", "band", "doc_id", "first")
    ranges = first.filter("slice is null").select("doc_id", "h", "lo", "hi").unionByName(left.mapInArrow(resolver, RANGES))

    own = each.filter(F.size("los") > 0).select("doc_id", "h", F.explode(F.arrays_zip("los", "his")).alias("r")).select("doc_id", "h", F.col("r.los").alias("lo"), F.col("r.his").alias("hi"))
    entire = removed.select("doc_id", "h", F.lit(0).alias("lo"), (F.col("n") - (window - 1)).cast("int").alias("hi"))
    return ranges.unionByName(own).unionByName(entire)


def covered_units(n: int, ranges: list[dict] | None, window: int) -> np.ndarray:
    """Flags of the units that covered windows cover."""
    change = np.zeros(n + 1, np.int64)
    for r in ranges or ():
        change[r["lo"]] += 1
        change[r["hi"] - 1 + window] -= 1
    return np.cumsum(change[:n]) > 0


class Slices:
    """A batch of :data:`CONTEXT` rows laid end to end. ``valid`` are the places
    of windows in ``x``; rows stand in order of group, document and place."""

    def __init__(self, batch: pa.RecordBatch, unit: str, window: int):
        g, band, doc, h, first = (batch.column(i).to_numpy() for i in range(5))
        rows = [g, band, doc, h, first]
        again = np.zeros(len(g), bool)  # a repeated row of the table
        again[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in rows])
        keep = np.flatnonzero(~again)
        self.g, self.band, self.doc, self.h, self.first = (c[keep] for c in rows)
        cut = batch.column("slice").to_pylist()
        cut = [cut[i] for i in keep] if again.any() else cut
        glue = b"" if unit == "byte" else b" "
        text = glue.join(cut)
        self.x = UNITS[unit](text)
        bounds = np.cumsum([0, *(len(c) + len(glue) for c in cut)])
        self.text, self.window = text, window
        self.starts = self.ends = None
        if unit == "word":
            self.starts, self.ends = word_bounds(text)
            bounds = np.searchsorted(self.starts, bounds)
        self.at, self.end = bounds[:-1], bounds[1:]
        inside = np.zeros(len(self.x) + 1, np.int32)
        inside[self.at] += 1
        inside[np.minimum(self.end - window + 1, len(self.x))] -= 1
        self.valid = np.flatnonzero(np.cumsum(inside)[:-1])
        self.keys = window_hashes(self.x, window)[self.valid]
        self.row = np.searchsorted(self.at, self.valid, "right") - 1
        new = np.flatnonzero((self.g[1:] != self.g[:-1]) | (self.band[1:] != self.band[:-1])) + 1
        #: places in ``valid`` at which the first group ends and the last begins
        self.head = int(np.searchsorted(self.row, new[0])) if len(new) else len(self.valid)
        self.tail = int(np.searchsorted(self.row, new[-1])) if len(new) else 0

    def group(self, last: bool) -> tuple[int, int]:
        i = -1 if last else 0
        return int(self.g[i]), int(self.band[i])

    def spans(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of flagged windows, and the row that each is of."""
        all_flags = np.zeros(len(self.x), bool)
        all_flags[self.valid[flags]] = True
        lo, hi = spans(all_flags)
        return lo, hi, np.searchsorted(self.at, lo, "right") - 1

    def ranges(self, flags: np.ndarray) -> pa.RecordBatch:
        """:data:`RANGES` of flagged windows."""
        lo, hi, row = self.spans(flags)
        shift = self.first[row] - self.at[row]
        return range_batch(self.doc[row], self.h[row], lo + shift, hi + shift)

    def left(self, flags: np.ndarray) -> pa.RecordBatch:
        """:data:`CONTEXT` of flagged windows."""
        lo, hi, row = self.spans(flags)
        last = hi - 1 + self.window
        a, b = (lo, last) if self.starts is None else (self.starts[lo], self.ends[last - 1])
        cut = [self.text[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        first = (self.first[row] + lo - self.at[row]).astype(np.int32)
        columns = {"g": pa.array(self.g[row]), "band": pa.array(self.band[row]), "doc_id": pa.array(self.doc[row]), "h": pa.array(self.h[row]), "first": pa.array(first), "slice": pa.array(cut, pa.binary())}
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def range_batch(doc: np.ndarray, h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(h, pa.int64()), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["doc_id", "h", "lo", "hi"])
