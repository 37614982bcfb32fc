"""Substring dedup over bytes with a logarithmic family of suffix arrays.

Every byte is removed that lies in a ``length``-byte string which also starts
anywhere else. :class:`Family` keeps the levels of an index in a folder: each new batch
of documents is scanned against them, becomes a level, and levels of equal size
class merge. :func:`dedup` is the same for one batch and no levels, without storing
one. In both, :mod:`repeats` brings suffixes that can match to one task, in groups. A group that lies inside an Arrow batch is settled by one sort of hashes.
One that goes on in the next batch enters a :class:`LogarithmicIndex` batch by
batch: each batch gets a suffix array, which is looked up in the existing levels
by bisection, and levels of equal size class are merged. Suffixes of finished
groups leave the index, so it never holds more than one group.

The suffix arrays order suffixes by the 64-bit hash of their first ``length``
bytes rather than by the bytes themselves: equal strings are still neighbours,
which is all that a search at one fixed length needs, and arrays of different
batches stay comparable without their texts.

Null text is empty; texts under ``length`` bytes keep everything; a repeated
row of the table is a copy like any other; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, small_batches, texts
from .repeats import INDEX, RANGES, Slices, covered_units, covered_windows, indexed, prepared, range_batch, ranges_of, repeated, spans


class SuffixArray:
    """Sorted keys of one or more batches; each key once, with the place where
    it was first seen (document, text hash, start) and whether it has matched."""

    def __init__(self, keys: np.ndarray, places: np.ndarray, matched: np.ndarray):
        self.keys, self.places, self.matched = keys, places, matched

    def merged(self, other: SuffixArray) -> SuffixArray:
        keys = np.concatenate([self.keys, other.keys])
        order = np.argsort(keys, kind="stable")  # two sorted runs: a merge
        return SuffixArray(keys[order], np.concatenate([self.places, other.places])[order], np.concatenate([self.matched, other.matched])[order])


class LogarithmicIndex:
    """Suffix arrays whose sizes grow geometrically."""

    def __init__(self) -> None:
        self.levels: list[SuffixArray] = []

    def add(self, keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flags of the new suffixes that match anything; places of older
        suffixes that match now for the first time. ``places``: rows of int64."""
        flags = repeated(keys, keep_first=False)
        older, rest = [places[:0]], np.arange(len(keys))
        for level in self.levels:
            at = np.minimum(np.searchsorted(level.keys, keys[rest]), len(level.keys) - 1)
            met = level.keys[at] == keys[rest]
            flags[rest[met]] = True
            fresh = np.unique(at[met & ~level.matched[at]])
            level.matched[fresh] = True
            older.append(level.places[fresh])
            rest = rest[~met]  # what matched is in the index already
        self._push(keys[rest], places[rest], flags[rest])
        return flags, np.concatenate(older)

    def _push(self, keys: np.ndarray, places: np.ndarray, matched: np.ndarray) -> None:
        if len(keys):
            unique, at = np.unique(keys, return_index=True)
            self.levels.append(SuffixArray(unique, places[at], matched[at].copy()))
        while len(self.levels) > 1 and len(self.levels[-1].keys).bit_length() >= len(self.levels[-2].keys).bit_length():
            small, large = self.levels.pop(), self.levels.pop()
            self.levels.append(large.merged(small))


def resolver(length: int) -> Callable:
    """Ranges of windows that occur elsewhere, from sorted slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, open_group = LogarithmicIndex(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            b = Slices(batch, "byte", length)
            flags = np.zeros(len(b.valid), bool)
            places = np.stack([b.doc[b.row], b.h[b.row], b.first[b.row] + b.valid - b.at[b.row]], axis=1)
            head = b.head if open_group == b.group(last=False) else 0
            if head:  # the group that the last batch left open
                flags[:head], older = index.add(b.keys[:head], places[:head])
                if len(older):
                    older = older[np.lexsort(older.T[::-1])]
                    joined = (older[1:, :2] == older[:-1, :2]).all(1) & (older[1:, 2] == older[:-1, 2] + 1)
                    edge = np.flatnonzero(np.concatenate([[True], ~joined]))
                    last = np.append(edge[1:], len(older)) - 1
                    yield range_batch(older[edge, 0], older[edge, 1], older[edge, 2], older[last, 2] + 1)
            tail = max(b.tail, head)
            flags[head:tail] = repeated(b.keys[head:tail], keep_first=False)
            if tail < len(b.keys):  # a group that may go on in the next batch
                index = LogarithmicIndex()
                flags[tail:], _ = index.add(b.keys[tail:], places[tail:])
            open_group = b.group(last=True)
            yield b.ranges(flags)

    return run


def dedup(docs: DataFrame, length: int = 400, gram: int = 100, hot: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (binary), a row for each document."""
    return _cut(covered_windows(texts(docs), "byte", length, gram, False, resolver(length), hot), length)


def _cut(found: DataFrame, length: int) -> DataFrame:
    """Documents with ``ranges`` without the bytes that those windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, parts, kept = [], [], [], []
            for text, ranges in zip(as_bytes(batch.column("text")), batch.column("ranges").to_pylist(), strict=True):
                total.append(len(text))
                if ranges:
                    gone = covered_units(len(text), ranges, length)
                    removed.append(int(gone.sum()))
                    parts.append(len(spans(gone)[0]))
                    kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
                else:
                    removed.append(0)
                    parts.append(0)
                    kept.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(parts, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumn("doc_id", F.expr("nullif(doc_id, -9223372036854775808)"))


class Family:
    """A logarithmic family of indexes in a folder, to which batches of documents are
    added over time, in one session or in many.

    A level has the texts of some batches and the index of their suffixes: those that
    begin at a minimizer, by bucket and in order of their first ``gram`` bytes (as
    hashes). A new batch is indexed and merge-scanned with the lists of all levels, which
    shows the places that may match; only texts with such a place are read again. Then
    the batch becomes a level, and levels of one size class are merged, so there are
    about log2 of the number of documents, and a document is written as often.

    The folder's ``state`` says which levels count. It is written last, so that a
    failed call changes nothing. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, length: int = 400, gram: int = 100, hot: int = 4096, buckets: int = 256):
        self.spark, self.folder, self.length, self.gram, self.hot, self.buckets = spark, folder.rstrip("/"), length, gram, hot, buckets
        self.version, self.levels, self.ranges = 0, [], []
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if self.fs.exists(path):
            names = [s.getPath().getName() for s in self.fs.listStatus(path)]
            done = [int(n[6:]) for n in names if n.startswith("state-") and self._path(f"{n}/_SUCCESS") is not None]
            if done:
                self.version = max(done)
                state = spark.read.parquet(f"{self.folder}/state-{self.version}").orderBy("nth").collect()
                self.levels = [(r["name"], r["size"]) for r in state if r["kind"] == "level"]
                self.ranges = [r["name"] for r in state if r["kind"] == "ranges"]

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path if self.fs.exists(path) else None

    def _written(self, name: str, df: DataFrame) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return self._read(name, df.schema)

    def _read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def _all(self, part: str, schema: str) -> DataFrame | None:
        found = [self._read(f"{name}/{part}", schema) for name, _ in self.levels]
        return functools.reduce(DataFrame.unionByName, found) if found else None

    def add(self, docs: DataFrame) -> DataFrame:
        """Add a batch. Returns the rows of :func:`dedup`, as they are now, of its documents
        and of older ones that it has taken something from; read them before the next
        call, which may merge the levels that they come from."""
        spark, name = self.spark, f"level-{uuid.uuid4().hex[:12]}"
        small_batches(spark)
        own = self._written(f"{name}/texts", prepared(texts(docs)).select(*_TEXTS))
        index = self._written(f"{name}/index", indexed(own, "byte", self.length, self.gram, False, self.buckets))
        older, before = self._all("index", INDEX), self._all("texts", _TEXT_SCHEMA)
        both = own if before is None else own.unionByName(before)
        new = f"ranges-{uuid.uuid4().hex[:12]}"
        found = self._written(new, ranges_of(index, both, older, "byte", self.length, self.gram, False, resolver(self.length), self.hot))
        self.ranges.append(new)
        self.levels.append((name, own.count()))
        gone = []
        while len(self.levels) > 1 and self.levels[-1][1].bit_length() >= self.levels[-2][1].bit_length():
            gone += [self.levels[-2][0], self.levels[-1][0]]
            merged, size = f"level-{uuid.uuid4().hex[:12]}", self.levels[-2][1] + self.levels[-1][1]
            for part, schema in (("texts", _TEXT_SCHEMA), ("index", INDEX)):
                self._written(f"{merged}/{part}", self._read(f"{gone[-2]}/{part}", schema).unionByName(self._read(f"{gone[-1]}/{part}", schema)))
            self.levels[-2:] = [(merged, size)]
        self.version += 1
        state = [(i, "level", n, size) for i, (n, size) in enumerate(self.levels)] + [(i, "ranges", n, 0) for i, n in enumerate(self.ranges)]
        spark.createDataFrame(state, "nth int, kind string, name string, size long").coalesce(1).write.parquet(f"{self.folder}/state-{self.version}")
        touched = found.select("doc_id", "h").union(prepared(texts(docs)).select("doc_id", "h")).distinct()
        out = _cut(self._covered().join(touched, ["doc_id", "h"], "left_semi"), self.length)
        for old in gone:
            if (path := self._path(old)) is not None:
                self.fs.delete(path, True)
        return out

    def _covered(self) -> DataFrame:
        every = functools.reduce(DataFrame.unionByName, [self._read(n, RANGES) for n in self.ranges])
        every = every.groupBy("doc_id", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
        return self._all("texts", _TEXT_SCHEMA).join(every, ["doc_id", "h"], "left")

    def documents(self) -> DataFrame:
        """The rows of :func:`dedup` of all documents added so far."""
        return _cut(self._covered(), self.length)


_TEXT_SCHEMA = "doc_id long, text string, h long"
_TEXTS = ("doc_id", "text", "h")


def digest(docs: DataFrame, **options) -> DataFrame:
    """The removals with a hash of what is left."""
    return dedup(docs, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

