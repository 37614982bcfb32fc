"""Byte-level BPE: encoding by ranked merges, and decoding.

Texts are split by the tokenizer's pattern. Each new piece is merged once: the
adjacent pair of least rank merges until no pair has a rank. :class:`pieces.Merger`
folds all new pieces of a batch at once, a merge of each per step, over their
byte arrays; :func:`merge` shows it for one piece. Decoding concatenates the byte
pieces of the ids.

:func:`encode_words` is the same fold in Spark's higher-order functions with a
literal rank map. See the README for why the query over documents does not use
it: the distinct words of a corpus grow with it, each costs far more there, and
bringing their ids back to every occurrence needs a shuffle of all occurrences.

Null text is empty and gives no ids; repeated rows each get a row; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, texts
from .pieces import END, SPACE as BLANK, Merger, PieceMemory, by_text, groups, joined, piece_keys, ranges, simple

#: Unicode's White_Space, which ``\s`` means in the pattern. Fixed values.
SPACE = r"\t-\r \x85\xa0  -     　"
#: The usual pattern of byte-level tokenizers. Fixed value.
USUAL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 200_000  # pieces that a worker remembers of texts that aren't simple


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = 1 << 60
    pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs:
        least = min(pairs)
        if least == none:
            break
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def pair_table(ranks: dict[bytes, int]) -> dict[tuple[int, int], tuple[int, int]]:
    """An id is its token's rank: all ways to make a token of two others."""
    pairs = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                pairs[a, b] = (rank, rank)
    return pairs


class Encoder:
    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.pieces[rank] = token
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.merger = Merger(pair_table(self.ranks))
        self.memory = PieceMemory(self.merge)
        tokens = list(self.ranks)
        ends = np.cumsum([len(t) for t in tokens])
        keys = piece_keys(np.frombuffer(b"".join(tokens), np.uint8), ends - [len(t) for t in tokens], ends)
        order = np.argsort(keys)
        self.token_keys, self.token_ranks = keys[order], np.array([self.ranks[t] for t in tokens], np.int32)[order]
        #: byte classes split texts only as this pattern does
        self.usual = pattern == USUAL
        self.split = regex.compile(pattern.replace(r"[^\s", rf"[^{SPACE}").replace(r"\S", rf"[^{SPACE}]").replace(r"\s", rf"[{SPACE}]"))
        self.known: dict[str, np.ndarray] = {}

    def merge(self, raw: np.ndarray, size: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces; one that is a token itself needs no merges."""
        at = np.minimum(np.searchsorted(self.token_keys, key), len(self.token_keys) - 1)
        whole = self.token_keys[at] == key
        ids = self.byte[raw]
        ends = np.cumsum(size)
        ids[(ends - size)[whole]] = self.token_ranks[at[whole]]
        short = np.where(whole, 1, size)
        return self.merger(ids[ranges(ends - size, short)], short)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        easy = [i for i, text in enumerate(texts) if self.usual and simple(text)]
        mine = [texts[i] for i in easy]
        for group in groups(mine):
            split = []
            for some in group:
                data, kind = joined([mine[i] for i in some])
                start = kind == END
                start[0] = True
                start[1:] |= kind[1:] != kind[:-1]
                # before a word, the last white space stands alone or, if a blank, joins the word
                word = np.flatnonzero((kind[1:] != BLANK) & (kind[1:] != END) & (kind[:-1] == BLANK)) + 1
                start[word - 1] = True
                start[word] = data[word - 1] != 32
                starts = np.flatnonzero(start)
                ends = np.append(starts[1:], len(data))
                real = kind[starts] != END
                split.append((data, starts[real], ends[real]))
            for some, (data, starts, _), (ids, lengths) in zip(group, split, self.memory.ids(split), strict=True):
                cuts = np.cumsum(by_text(data, starts, lengths)).tolist()
                for i, a, b in zip(some, [0, *cuts], cuts, strict=False):
                    out[easy[i]] = ids[a:b]
        for i, x in enumerate(out):
            if x is None:
                out[i] = self._encode(texts[i].decode())
        return out

    def _encode(self, text: str) -> np.ndarray:
        pieces = self.split.findall(text)
        if len(self.known) + len(pieces) > CACHE:
            self.known.clear()
        new = list(set(pieces).difference(self.known))
        if new:
            raw = [p.encode() for p in new]
            size = np.array([len(p) for p in raw])
            data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size)
            flat, many = self.merge(data, size, piece_keys(data, ends - size, ends))
            self.known.update(zip(new, np.split(flat, np.cumsum(many)[:-1]), strict=True))
        return np.concatenate([self.known[p] for p in pieces]) if pieces else np.zeros(0, np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids.tolist()])


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker, as its memory of pieces serves all its tasks."""
    return Encoder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, digest: bool = False) -> DataFrame:
    """``doc_id, ids`` (binary, little-endian unsigned 32-bit), ``decoded`` (binary);
    with ``digest`` their number and hashes instead."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids binary, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            for ids in coder.encode(as_bytes(batch.column("text"))):
                back, packed = coder.decode(ids), ids.astype("<u4").tobytes()
                row = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(back).hexdigest()) if digest else (packed, back)
                for column, value in zip(out, row, strict=False):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.string()] if digest else [pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=False))], names=[x.split()[0] for x in schema.split(", ")])

    return texts(docs).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, decoded`` from ``doc_id, ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for batch in batches:
            back = [coder.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(back, pa.binary())], names=["doc_id", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def rank_map(ranks: dict[bytes, int], buckets: int = 4096) -> Column:
    """A literal: buckets of small maps from a token (bytes as Latin-1) to its
    rank. A map's lookup scans its entries, so one map of all tokens would cost
    50,000 comparisons; a bucket has about twelve."""
    from zlib import crc32

    maps: list[dict[str, int]] = [{} for _ in range(buckets)]
    for token, rank in ranks.items():
        maps[crc32(token) % buckets][token.decode("latin-1")] = rank
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def encode_words(words: DataFrame, ranks: dict[bytes, int], buckets: int = 4096) -> DataFrame:
    """``word, ids``: distinct words, merged by higher-order functions alone.

    Each step of the fold finds the least rank of adjacent pairs and merges its
    first place; a word of n bytes needs at most n - 1 steps."""
    table = rank_map(ranks, buckets)

    def rank(token: Column) -> Column:
        return F.get(F.col("_ranks"), F.pmod(F.crc32(F.encode(token, "ISO-8859-1")), F.lit(buckets)).cast("int"))[token]

    def step(parts: Column, _: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(F.coalesce(rank(F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))), F.lit(2**31 - 1)).alias("r"), i.alias("i")))
        best = F.array_min(pairs)
        joined = F.concat(
            F.slice(parts, F.lit(1), best["i"] - 1),
            F.array(F.concat(F.element_at(parts, best["i"]), F.element_at(parts, best["i"] + 1))),
            F.slice(parts, best["i"] + 2, F.greatest(F.size(parts) - best["i"] - 1, F.lit(0))),
        )
        return F.when(F.size(parts) < 2, parts).when(best["r"] == 2**31 - 1, parts).otherwise(joined)

    chars = F.split(F.decode(F.encode("word", "UTF-8"), "ISO-8859-1"), "")
    parts = F.filter(chars, lambda c: c != "")
    folded = F.when(F.size(parts) < 2, parts).otherwise(F.reduce(F.sequence(F.lit(1), F.size(parts) - 1), parts, step))
    ids = F.transform(folded, lambda t: rank(t))
    return words.select("word").distinct().withColumn("_ranks", table).select("word", ids.alias("ids"))


def decode_words(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``word`` as bytes again: the binary pieces of its ids, concatenated."""
    pieces = ["" for _ in range(max(ranks.values()) + 1)]
    for token, rank in ranks.items():
        pieces[rank] = token.decode("latin-1")
    table = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    text = F.concat_ws("", F.transform("ids", lambda i: F.get(F.col("_pieces"), i)))
    return encoded.withColumn("_pieces", table).select("word", F.encode(text, "ISO-8859-1").alias("decoded"))
