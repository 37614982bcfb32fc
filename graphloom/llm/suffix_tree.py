"""Substring dedup over words with prefix-partitioned suffix trees.

A window of ``length`` words is removed if its words also start earlier (in a
document with a smaller doc_id, or earlier in the same one). :mod:`repeats`
splits the suffixes that can repeat into groups that fit in memory: by the
window's minimizer, and for frequent ones by a longer key (offset, and the words
around the minimizer that all windows at that offset have), as classic partitioned
construction lengthens a prefix until its suffixes fit. A plain word prefix would put every word of the corpus into the
shuffle; the minimizer puts about one in eight there, and only if it repeats.

:func:`deep_nodes` grows the subtree of a batch top-down, with nodes at depths
1, 2, 4, 8, ... and ``length`` words (the paths between are left implicit).
Suffixes alone in their node are cut off at once, as a leaf has no repeat below
it. Nodes at full depth with two leaves or more are the repeats; their least
leaf stays.

Null text has no words; texts under ``length`` words keep everything; a
repeated row (same doc_id, same text) is neither earlier nor later than its
twin, so both stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, texts
from .repeats import Slices, covered_units, covered_windows, repeated


def internal(keys: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that share their node with others, and the node of each place
    (-1 where a suffix is alone)."""
    order = np.argsort(keys, kind="stable")
    new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]]) if len(keys) else np.zeros(0, bool)
    node = np.cumsum(new) - 1
    shared = np.bincount(node, minlength=1)[node] > 1 if len(node) else np.zeros(0, bool)
    nodes = np.full(size, -1, np.int64)
    nodes[at[order[shared]]] = node[shared]
    return np.flatnonzero(nodes >= 0), nodes


def deep_nodes(x: np.ndarray, length: int) -> np.ndarray:
    """Node at depth ``length`` of the suffix at each place; -1 if none is shared."""
    at, nodes = internal(x, np.arange(len(x)), len(x))
    depth = 1
    while depth < length:
        step = min(depth, length - depth)
        at = at[at + step < len(x)]
        at = at[nodes[at + step] >= 0]
        at, nodes = internal(nodes[at] * (len(x) + 1) + nodes[at + step], at, len(x))
        depth += step
    return nodes


def resolver(length: int) -> Callable:
    """Ranges of windows that start earlier too, from sorted slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, open_group = np.zeros(0, np.uint64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            b = Slices(batch, "word", length)
            nodes = deep_nodes(b.x, length)[b.valid]
            flags = np.zeros(len(nodes), bool)
            deep = np.flatnonzero(nodes >= 0)
            flags[deep] = repeated(nodes[deep], keep_first=True)
            same = open_group == b.group(last=False)
            if same:  # leaves of this group in earlier batches come first
                flags[: b.head] |= np.isin(b.keys[: b.head], seen)
            open_group = b.group(last=True)
            kept = [b.keys[b.tail :]] + ([seen] if same and b.tail == 0 else [])
            seen = np.unique(np.concatenate(kept))
            yield b.ranges(flags)

    return run


def dedup(docs: DataFrame, length: int = 20, gram: int = 5, hot: int = 4096, only_cut: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (the words left, joined by one space)
    and the other columns of ``docs``. With ``only_cut`` the text of a document
    that loses nothing stays as it is, white space included."""
    found = covered_windows(docs, "word", length, gram, True, resolver(length), hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text, ranges in zip(as_bytes(batch.column("text")), batch.column("ranges").to_pylist(), strict=True):
                words = text.split()
                total.append(len(words))
                if ranges:
                    gone = covered_units(len(words), ranges, length)
                    removed.append(int(gone.sum()))
                    words = [words[i] for i in np.flatnonzero(~gone)]
                else:
                    removed.append(0)
                kept.append(text if only_cut and not removed[-1] else b" ".join(words))
            rest = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in ("text", "ranges")]
            names = [n for n in batch.schema.names if n not in ("text", "ranges")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[*names, "n_words", "n_removed", "kept"])

    found = found.drop("h")
    schema = found.drop("text", "ranges").schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return found.mapInArrow(run, schema).withColumn("doc_id", F.expr("nullif(doc_id, -9223372036854775808)"))


def digest(docs: DataFrame, **options) -> DataFrame:
    """The removals with a hash of what is left."""
    return dedup(texts(docs), **options).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
