"""Quality classifier: a convolutional network over bytes, in numpy.

Input are a text's bytes, each with a flag that says whether the four bytes from
there repeat ones at most 24 bytes before. ``FILTERS`` learned filters of
``WIDTH`` symbols run over the whole text; each filter's greatest response is
taken in overlapping chunks that cover the text; the mean and the greatest over
all chunks are combined into one probability. As a filter is a sum of one weight
for each symbol at each place, responses are sums of table rows.

Training takes a bounded sample of labelled rows: the ``sample`` documents with the
least hash of doc_id (of rows with one doc_id, the text with the least hash), as far
as their texts come to ``sample_bytes`` together. Texts are whole there, as they are
in scoring. Only the text is an input.

Null text is empty; its score, and that of texts under ``WIDTH`` bytes, comes
from the text padded with zero bytes. If no labelled document can be used, all
scores are 0.5. Repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import as_bytes, saved, small_batches, texts

WIDTH, FILTERS = 5, 8
BLOCK, STRIDE, CHUNK = 64, 3, 4  # a chunk is 4 blocks of 64 bytes, and begins 3 blocks after the last
BACK = 24
SLAB = 1 << 14  # places whose responses are held at once


def symbols(text: bytes) -> np.ndarray:
    """Bytes, plus 256 where the four bytes from there occurred shortly before."""
    x = np.frombuffer(text.ljust(WIDTH, b"\0"), np.uint8)
    four = x[:-3].astype(np.uint32)
    for i in (1, 2, 3):
        four = four << np.uint32(8) | x[i : len(x) - 3 + i]
    again = np.zeros(len(x), bool)
    for back in range(2, min(BACK, len(four) - 1) + 1):
        again[back : len(four)] |= four[back:] == four[:-back]
    return x.astype(np.int64) + 256 * again


class Network:
    def __init__(self, seed: int = 7):
        dice = np.random.default_rng(seed)
        self.table = (dice.normal(0, 0.3, (WIDTH, 512, FILTERS))).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = dice.normal(0, 0.3, 2 * FILTERS).astype(np.float32)
        self.base = np.zeros(1, np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.bias, self.out, self.base]

    def responses(self, s: np.ndarray) -> np.ndarray:
        n = len(s) - WIDTH + 1
        z = self.table[0].take(s[:n], axis=0, mode="clip")
        row = np.empty_like(z)
        for j in range(1, WIDTH):
            z += self.table[j].take(s[j : j + n], axis=0, mode="clip", out=row)
        return z

    def blocks(self, s: np.ndarray) -> np.ndarray:
        """Greatest response of each filter in each block, the network's hot loop."""
        found = []
        for at in range(0, max(1, len(s) - WIDTH + 1), SLAB):
            z = self.responses(s[at : at + SLAB + WIDTH - 1])
            if rest := -len(z) % BLOCK:
                z = np.concatenate([z, np.full((rest, FILTERS), -np.inf, np.float32)])
            z, width = z.reshape(-1, BLOCK, FILTERS), BLOCK
            while width > 1:  # halves against halves, as numpy reduces a middle axis slowly
                width //= 2
                z = np.maximum(z[:, :width], z[:, width:])
            found.append(z[:, 0])
        return np.concatenate(found)

    def blocks_and_places(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`blocks`, and where in its block each greatest response stands."""
        found, places = [], []
        for at in range(0, max(1, len(s) - WIDTH + 1), SLAB):
            z = self.responses(s[at : at + SLAB + WIDTH - 1])
            if rest := -len(z) % BLOCK:
                z = np.concatenate([z, np.full((rest, FILTERS), -np.inf, np.float32)])
            shaped = np.ascontiguousarray(z.T).reshape(FILTERS, -1, BLOCK)
            place = shaped.argmax(2)
            found.append(np.take_along_axis(shaped, place[:, :, None], 2)[:, :, 0].T)
            places.append(place.T)
        return np.concatenate(found), np.concatenate(places)

    @staticmethod
    def chunks(blocks: np.ndarray) -> np.ndarray:
        """First block of each chunk; the chunks cover all blocks."""
        return np.arange(0, max(1, len(blocks) - CHUNK + STRIDE), STRIDE)

    def pooled(self, blocks: np.ndarray) -> np.ndarray:
        first = self.chunks(blocks)
        at = np.minimum(first[:, None] + np.arange(CHUNK), len(blocks) - 1)
        return blocks[at].max(1)

    def score(self, text: bytes) -> float:
        top = np.maximum(self.pooled(self.blocks(symbols(text))) + self.bias, 0)
        x = float(np.concatenate([top.mean(0), top.max(0)]) @ self.out + self.base[0])
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))

    def gradient(self, s: np.ndarray, label: int, grads: list[np.ndarray]) -> None:
        """Add a text's gradient of the log loss. Through a maximum it only flows
        to the place that has it."""
        blocks, place = self.blocks_and_places(s)
        first = self.chunks(blocks)
        at = np.minimum(first[:, None] + np.arange(CHUNK), len(blocks) - 1)
        which = blocks[at].argmax(1)
        block = np.take_along_axis(at, which, 1)
        raw = np.take_along_axis(blocks, block, 0) + self.bias
        top = np.maximum(raw, 0)
        x = np.concatenate([top.mean(0), top.max(0)])
        error = 1 / (1 + np.exp(-np.clip(x @ self.out + self.base[0], -30, 30))) - label
        grads[2] += error * x
        grads[3] += error
        back = np.tile(error * self.out[:FILTERS] / len(top), (len(top), 1))
        back[top.argmax(0), np.arange(FILTERS)] += error * self.out[FILTERS:]
        back *= raw > 0
        grads[1] += back.sum(0)
        start = block * BLOCK + np.take_along_axis(place, block, 0)
        for j in range(WIDTH):
            np.add.at(grads[0][j], (s[start + j], np.arange(FILTERS)), back)


def fit(texts: list[bytes], labels: list[int], epochs: int = 10, batch: int = 32, rate: float = 0.02, seed: int = 7) -> Network:
    """Train by Adam on whole texts; the same texts give the same network."""
    net, dice = Network(seed), np.random.default_rng(seed)
    order0 = sorted(range(len(texts)), key=lambda i: (texts[i], labels[i]))
    coded = [texts[i] for i in order0]
    target = [labels[i] for i in order0]
    first = [np.zeros_like(w) for w in net.weights()]
    second = [np.zeros_like(w) for w in net.weights()]
    step, steps = 0, epochs * -(-len(coded) // batch)
    for _ in range(epochs):
        order = dice.permutation(len(coded))
        for lo in range(0, len(order), batch):
            grads = [np.zeros_like(w) for w in net.weights()]
            some = order[lo : lo + batch]
            for i in some:
                net.gradient(symbols(coded[i]), target[i], grads)
            step += 1
            now = rate * (1 - step / (steps + 1))
            for w, g, m, v in zip(net.weights(), grads, first, second, strict=True):
                g /= len(some)
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(column: str = "doc_id"):
    """Whether a document's label may not be learned from."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 2400, sample_bytes: int = 64 << 20, **options) -> Network | None:
    """A network from labelled documents that aren't held out. The driver gets at
    most ``sample`` whole texts with ``sample_bytes`` bytes in all; a text that goes
    beyond them is left out, not cut."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = texts(docs).join(F.broadcast(known), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = saved(rows, "sample")
    sizes = rows.select("doc_id", F.xxhash64("doc_id").alias("h"), F.octet_length("text").alias("n")).collect()
    chosen, total = [], 0
    for r in sorted(sizes, key=lambda r: (r.h, r.doc_id)):
        if total + r.n <= sample_bytes:
            chosen.append(r.doc_id)
            total += r.n
    got = rows.filter(F.col("doc_id").isin(chosen)).select("text", "quality").collect()
    if not got:
        return None
    return fit([r.text.encode() for r in got], [int(r.quality) for r in got], **options)


def scores(docs: DataFrame, network: Network | None) -> DataFrame:
    """``docs`` with a ``score`` (0 to 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [network.score(t) if network else 0.5 for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=[*batch.schema.names, "score"])

    small_batches(docs.sparkSession)
    docs = docs.select([c for c in docs.columns if c.lower() != "score"])
    return docs.mapInArrow(run, StructType([*docs.schema, StructField("score", DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted``, a row for each document."""
    scored = scores(texts(docs), train(docs, labels, **options)).select("doc_id", "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
