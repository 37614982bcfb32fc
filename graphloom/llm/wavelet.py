"""Token ids in wavelet matrices, a compressed file per shard of documents.

A wavelet matrix stores a sequence over an alphabet of size s in ceil(log2 s)
planes of one bit a token, each plane in the order that a stable partition by
the plane above gives. Counts of set bits up to each 512th bit are stored with
the planes (rank) and a search in them (select) gives access to a token, the
count of a token before a place, and the place of its k-th occurrence, without
decoding the rest. :func:`access`, :func:`count` and :func:`occurrences` answer
these over all shards of a table, shard by shard.

Shards are ranges of doc_id in ascending order. A shard is a Parquet file in
the shared folder, which any store that Spark knows can hold, and has one matrix
of all its tokens; one with over ``LARGEST`` tokens has a matrix for each so many
(whole documents; one document, if that is longer), which bounds a task's
memory. The payload is the format proper: :meth:`WaveletMatrix.to_bytes`.

Null text is empty: such a document has its end id alone. Documents with the
same doc_id keep a row each, in any order; a null doc_id comes first. An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, partitions, saved, texts
from .word_bpe import word_encoder

LARGEST = 1 << 22
SPAN = 8  # 64-bit words between two stored counts
NULL = -(2**63)


def words_for(n: int) -> int:
    """64-bit words of a plane: whole spans, and one more, so that every place has one."""
    return (n // (64 * SPAN) + 1) * SPAN


class WaveletMatrix:
    def __init__(self, n: int, alphabet: np.ndarray, zeros: list[int], planes: list[np.ndarray], before: list[np.ndarray]):
        """``alphabet``: ids in ascending order; ``planes``: 64-bit words, most
        significant plane first; ``zeros``: unset bits of each plane; ``before``:
        set bits of a plane before each span of :data:`SPAN` words."""
        self.n, self.alphabet, self.zeros, self.planes, self.before = n, alphabet, zeros, planes, before

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        used = np.zeros(int(ids.max(initial=0)) + 1, bool)
        used[ids] = True
        alphabet = np.flatnonzero(used).astype(np.uint32)
        symbol = np.zeros(len(used), np.uint32)
        symbol[alphabet] = np.arange(len(alphabet))
        now = symbol[ids]
        if len(alphabet) <= 1 << 16:
            now = now.astype(np.uint16)
        zeros, planes, before = [], [], []
        for bit in reversed(range(max(0, int(len(alphabet) - 1).bit_length()))):
            ones = (now >> now.dtype.type(bit) & now.dtype.type(1)).astype(bool)
            packed = np.zeros(words_for(len(now)) * 8, np.uint8)
            raw = np.packbits(ones, bitorder="little")
            packed[: len(raw)] = raw
            planes.append(packed.view(np.uint64))
            each = np.bitwise_count(planes[-1]).reshape(-1, SPAN).sum(1, dtype=np.uint32)
            before.append(np.cumsum(each, dtype=np.uint32) - each)
            low = now[~ones]
            zeros.append(len(low))
            now = np.concatenate([low, now[ones]])
        return cls(len(ids), alphabet, zeros, planes, before)

    def to_bytes(self) -> bytes:
        """Zstandard of: tokens (8 bytes), size of the alphabet (4), number of
        planes (1), the alphabet (4 each), zeros (8 each), planes (8 each word), set
        bits before each span of a plane (4 each)."""
        head = struct.pack("<QIB", self.n, len(self.alphabet), len(self.planes))
        return zstandard.compress(b"".join([head, self.alphabet.astype("<u4").tobytes(), np.array(self.zeros, "<u8").tobytes(), *(p.astype("<u8").tobytes() for p in self.planes), *(b.astype("<u4").tobytes() for b in self.before)]), 1)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        data = zstandard.decompress(data)
        n, size, depth = struct.unpack_from("<QIB", data)
        at = 13
        alphabet = np.frombuffer(data, "<u4", size, at)
        at += size * 4
        zeros = np.frombuffer(data, "<u8", depth, at).tolist()
        at += depth * 8
        words = words_for(n)
        planes = [np.frombuffer(data, "<u8", words, at + i * words * 8) for i in range(depth)]
        at += depth * words * 8
        return cls(n, alphabet, zeros, planes, [np.frombuffer(data, "<u4", words // SPAN, at + i * words // SPAN * 4) for i in range(depth)])

    def _bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level].view(np.uint8), count=self.n, bitorder="little").astype(bool)

    def _rank(self, level: int, at: int) -> int:
        """Set bits before a place."""
        span, word, rest = at // (64 * SPAN), at // 64, at % 64
        got = int(self.before[level][span]) + int(np.bitwise_count(self.planes[level][span * SPAN : word]).sum())
        return got + ((int(self.planes[level][word]) & ((1 << rest) - 1)).bit_count() if rest else 0)

    def _select(self, level: int, k: np.ndarray, bit: int) -> np.ndarray:
        """Places of the k-th set (or unset) bits, from 0."""
        before = self.before[level].astype(np.int64)
        before = before if bit else np.arange(len(before)) * 64 * SPAN - before
        out, spans = np.empty(len(k), np.int64), self.planes[level].reshape(-1, SPAN)
        for lo in range(0, len(k), 4096):
            some = k[lo : lo + 4096]
            span = np.searchsorted(before, some, "right") - 1
            bits = np.unpackbits(np.ascontiguousarray(spans[span]).view(np.uint8).reshape(len(some), -1), axis=1, bitorder="little")
            bits = bits if bit else 1 - bits
            nth = np.cumsum(bits, axis=1, dtype=np.int16) == (some - before[span] + 1)[:, None]
            out[lo : lo + 4096] = span * 64 * SPAN + (nth & (bits > 0)).argmax(1)
        return out

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        symbol = 0
        for level, zeros in enumerate(self.zeros):
            bit = int(self.planes[level][at // 64]) >> (at % 64) & 1
            ones = self._rank(level, at)
            at = zeros + ones if bit else at - ones
            symbol = symbol << 1 | bit
        return int(self.alphabet[symbol])

    def _range(self, token: int, until: int) -> tuple[int, int]:
        """Where the token's occurrences before a place stand below the last plane."""
        symbol = int(np.searchsorted(self.alphabet, token))
        if symbol == len(self.alphabet) or self.alphabet[symbol] != token:
            return 0, 0
        lo, hi = 0, until
        for level, zeros in enumerate(self.zeros):
            a, b = self._rank(level, lo), self._rank(level, hi)
            lo, hi = (zeros + a, zeros + b) if symbol >> (len(self.zeros) - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, until: int | None = None) -> int:
        """Occurrences of a token, before a place if one is given."""
        lo, hi = self._range(token, self.n if until is None else until)
        return hi - lo

    def occurrences(self, token: int) -> np.ndarray:
        """Places of a token, ascending."""
        lo, hi = self._range(token, self.n)
        at = np.arange(lo, hi)
        if not len(at):
            return at
        symbol = int(np.searchsorted(self.alphabet, token))
        for level in reversed(range(len(self.zeros))):
            bit = symbol >> (len(self.zeros) - 1 - level) & 1
            at = self._select(level, at - (self.zeros[level] if bit else 0), bit)
        return at

    def tokens(self) -> np.ndarray:
        """All ids in order: the partitions undone from the last plane up."""
        now = np.zeros(self.n, np.uint16 if len(self.zeros) <= 16 else np.uint32)
        for level in reversed(range(len(self.zeros))):
            ones = self._bits(level)
            zeros = self.zeros[level]
            up = np.empty_like(now)
            up[~ones] = now[:zeros]
            up[ones] = now[zeros:] | now.dtype.type(1 << (len(self.zeros) - 1 - level))
            now = up
        return self.alphabet[now]


FILES = "shard int, matrix int, before long, n_tokens long, doc_ids binary, lengths binary, payload binary"


def write(docs: DataFrame, tokenizer: str, end_id: int = 1, shards: int | None = None, largest: int = LARGEST) -> DataFrame:
    """Write the shards; the returned table reads them (:data:`FILES`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = word_encoder(tokenizer), TaskContext.get().partitionId()
        names = [x.split()[0] for x in FILES.split(", ")]
        held: list[np.ndarray] = []
        ids: list[int] = []
        size = matrix = before = 0

        def closed() -> pa.RecordBatch:
            nonlocal held, ids, size, matrix, before
            lengths = np.array([len(x) for x in held], "<u4")
            row = [[shard], [matrix], [before], [size], [np.array(ids, "<i8").tobytes()], [lengths.tobytes()], [WaveletMatrix.build(np.concatenate(held)).to_bytes()]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            held, ids, size, matrix, before = [], [], 0, matrix + 1, before + size
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            keys = [NULL if k is None else k for k in batch.column("doc_id").to_pylist()]
            for key, got in zip(keys, coder.encode(as_bytes(batch.column("text"))), strict=True):
                if size and size + len(got) + 1 > largest:
                    yield closed()
                held.append(np.append(got, np.uint32(end_id)))
                ids.append(key)
                size += len(got) + 1
        if size:
            yield closed()

    docs = texts(docs)
    ranged = docs.repartitionByRange(shards or partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    return saved(ranged.mapInArrow(run, FILES), "wavelet")


def read(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (binary, little-endian unsigned 32-bit) of
    every document."""
    return _read(files, "doc_id long, start long, n_tokens long, ids binary", lambda ids: ids.astype("<u4").tobytes())


def digest(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document."""
    return _read(files, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


def _read(files: DataFrame, schema: str, of) -> DataFrame:
    def answer(matrix: WaveletMatrix, start: int, keys: np.ndarray, lengths: np.ndarray) -> list[pa.Array]:
        ids, ends = matrix.tokens(), np.cumsum(lengths)
        value = [of(ids[b - k : b]) for b, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
        return [pa.array(keys, pa.int64(), mask=keys == NULL), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(value)]

    return _each(files, schema, answer)


def _each(files: DataFrame, schema: str, answer) -> DataFrame:
    """Columns that ``answer(matrix, start, doc_ids, lengths)`` gives for each matrix;
    ``start``: tokens of all matrices before. The driver gets a number for each shard."""
    sizes = sorted((r.shard, r.n) for r in files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    first = dict(zip([s for s, _ in sizes], np.cumsum([0, *(n for _, n in sizes)]).tolist(), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, before, keys, lengths, payload in zip(*(batch.column(i) for i in range(5)), strict=True):
                keys, lengths = np.frombuffer(keys.as_buffer(), "<i8"), np.frombuffer(lengths.as_buffer(), "<u4").astype(np.int64)
                matrix = WaveletMatrix.from_bytes(payload.as_buffer())
                yield pa.RecordBatch.from_arrays(answer(matrix, first[shard.as_py()] + before.as_py(), keys, lengths), names=[x.split()[0] for x in schema.split(", ")])

    return files.select("shard", "before", "doc_ids", "lengths", "payload").mapInArrow(run, schema)


def access(files: DataFrame, places: list[int]) -> DataFrame:
    """``place, token`` of places in the whole sequence; places outside give no row.
    The list is part of the question and travels with it."""
    asked = np.unique(np.array(places, np.int64))

    def answer(matrix: WaveletMatrix, start: int, keys: np.ndarray, lengths: np.ndarray) -> list[pa.Array]:
        own = asked[(asked >= start) & (asked < start + matrix.n)]
        return [pa.array(own), pa.array([matrix.access(at - start) for at in own.tolist()], pa.int64())]

    return _each(files, "place long, token long", answer)


def count(files: DataFrame, token: int, until: int | None = None) -> DataFrame:
    """``n``: occurrences of a token, before a place of the whole sequence if given."""

    def answer(matrix: WaveletMatrix, start: int, keys: np.ndarray, lengths: np.ndarray) -> list[pa.Array]:
        end = matrix.n if until is None else min(max(until - start, 0), matrix.n)
        return [pa.array([matrix.count(token, end)], pa.int64())]

    return _each(files, "n long", answer).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def occurrences(files: DataFrame, token: int) -> DataFrame:
    """``doc_id, place, offset``: each occurrence of a token, by its place in the whole
    sequence and in its document."""

    def answer(matrix: WaveletMatrix, start: int, keys: np.ndarray, lengths: np.ndarray) -> list[pa.Array]:
        at, ends = matrix.occurrences(token), np.cumsum(lengths)
        doc = np.searchsorted(ends, at, "right")
        return [pa.array(keys[doc], pa.int64(), mask=keys[doc] == NULL), pa.array(start + at, pa.int64()), pa.array(at - (ends - lengths)[doc], pa.int64())]

    return _each(files, "doc_id long, place long, offset long", answer)
