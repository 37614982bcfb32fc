"""Splitting texts into pieces and remembering the ids of pieces, in numpy.

Most bytes of a corpus belong to pieces met before. Texts of simple characters
(:func:`simple`) are split by byte classes, a piece is looked up by a 64-bit
hash in a direct-mapped table, and its ids are copied from a pool; only new
pieces become Python objects. Other texts take their tokenizer's general path.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np

from .repeats import byte_units, mixed, powers, prefix_hash

SPACE, LETTER, DIGIT, OTHER, END = range(5)
#: Bytes of simple texts: printable ASCII but the apostrophe, white space, and
#: the two-byte letters from U+00C0 to U+00FF.
_SIMPLE = bytes({*range(9, 14), *range(32, 127), 0xC3, *range(0x80, 0xC0)} - {39})
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[32, *range(9, 14)]] = SPACE
_CLASS[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = LETTER
_CLASS[48:58] = DIGIT
_CLASS[255] = END


def simple(text: bytes) -> bool:
    return not text.translate(None, _SIMPLE)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end, each closed by a byte that UTF-8 never has, and its class."""
    data = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
    kind = _CLASS[data]
    signs = np.flatnonzero((data[1:] == 0x97) | (data[1:] == 0xB7))  # the signs × and ÷ are no letters
    signs = signs[data[signs] == 0xC3]
    kind[signs] = OTHER
    kind[signs + 1] = OTHER
    return data, kind


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of simple characters."""
    data = data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    value = data[after]
    after = after[(value >= 0x80) & (value <= 0x9E) & (value != 0x97)]
    data[after] += 32
    return data


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places ``start[i], start[i] + 1, ...`` of all i, end to end."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


class Merger:
    """Ranked merges of many pieces at once: in each step of the fold, every
    piece merges its adjacent pair of least rank, until no pair has a rank.

    ``pairs``: ``(left id, right id) -> (rank, merged id)``, in a hash table with
    linear probing."""

    NONE = np.int32(2**31 - 1)
    PAD = 2**20 - 1
    WIDTHS = (4, 6, 8, 10, 12, 16, 20, 28, 40)

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        keys = np.array([a << 20 | b for a, b in pairs], np.int64)
        values = np.array(list(pairs.values()), np.int32)
        self.bits = max(8, int(len(keys) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, self.NONE, np.int32)
        self.merged = np.zeros(int(values[:, 0].max(initial=0)) + 1, np.int32)
        self.merged[values[:, 0]] = values[:, 1]
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.ranks[slot[put]] = keys[put], values[put, 0]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 20 | b
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], self.NONE)
        left = np.nonzero((found != key) & (found >= 0))
        while len(left[0]):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[left]]
            hit = found == key[left]
            out[tuple(x[hit] for x in left)] = self.ranks[slot[left][hit]]
            left = tuple(x[~hit & (found >= 0)] for x in left)
        return out

    def __call__(self, flat: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final ids of pieces given by their first ids, end to end."""
        start = np.cumsum(length) - length
        out = flat.astype(np.uint32)  # final ids stand where a piece's first ids begin
        many = length.copy()
        low = 1
        for width in (*self.WIDTHS, None):
            which = np.flatnonzero((length > low) & (length <= (width or 1 << 62)))
            low = width
            if width is None:
                for i in which.tolist():
                    ids = self.one(flat[start[i] : start[i] + length[i]])
                    many[i] = len(ids)
                    out[start[i] : start[i] + len(ids)] = ids
            elif len(which):
                ids = np.full((len(which), width), self.PAD, np.int32)
                real = np.arange(width) < length[which][:, None]
                ids[real] = flat[ranges(start[which], length[which])]
                self._fold(ids, which, start, out, many)
        return out[ranges(start, many)], many

    def _fold(self, ids: np.ndarray, which: np.ndarray, start: np.ndarray, out: np.ndarray, many: np.ndarray) -> None:
        ranks = self.rank(ids[:, :-1], ids[:, 1:])
        while len(which):
            each = np.arange(len(which))
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(which), np.int64)
            least = ranks[each, at] if ranks.shape[1] else np.full(len(which), self.NONE)
            done = np.flatnonzero(least == self.NONE)
            if len(done):
                rest = ids[done]
                real = rest != self.PAD
                many[which[done]] = real.sum(1)
                out[ranges(start[which[done]], many[which[done]])] = rest[real]
                go = np.flatnonzero(least != self.NONE)
                which, ids, ranks, at, least, each = which[go], ids[go], ranks[go], at[go], least[go], each[: len(go)]
            if not len(which):
                return
            ids[each, at] = self.merged[least]
            width = ids.shape[1]
            keep = np.arange(width) != at[:, None] + 1
            ids = ids[keep].reshape(len(which), width - 1)
            ranks = ranks[keep[:, 1:]].reshape(len(which), width - 2)
            for near in (at - 1, at):
                ok = np.flatnonzero((near >= 0) & (near < width - 2))
                ranks[ok, near[ok]] = self.rank(ids[ok, near[ok]], ids[ok, near[ok] + 1])

    def one(self, piece: np.ndarray) -> np.ndarray:
        """A piece of any length, with a heap of pairs and links between parts."""
        n = len(piece)
        ids, after, before = piece.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(self.rank(piece[:-1], piece[1:]).tolist()) if r != self.NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has merged since
            ids[i], ids[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n:
                    r = int(self.rank(np.array([ids[x]]), np.array([ids[y]]))[0])
                    if r != self.NONE:
                        heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], np.uint32)


def piece_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each piece, never zero."""
    h = prefix_hash(byte_units(data))
    return mixed((h[ends] - h[starts]) * powers(len(h))[1][starts] + (ends - starts).astype(np.uint64)) | np.uint64(1)


class PieceMemory:
    """Ids of pieces by hash: a table of four places a slot, where a newer piece
    takes an older one's place, and a pool of ids."""

    def __init__(self, learn: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], bits: int = 19, pool: int = 8_000_000):
        self.learn, self.shift = learn, np.uint64(64 - bits)
        self.table = np.zeros((1 << bits, 4), np.uint64)
        self.offset = np.zeros((1 << bits, 4), np.int32)
        self.length = np.zeros((1 << bits, 4), np.int32)
        self.pool, self.used = np.zeros(pool, np.uint32), 0

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat place in the table of each key, and whether it is there."""
        slot = (key >> self.shift).astype(np.int64)
        same = self.table[slot] == key[:, None]
        way = same.argmax(1)
        return slot * 4 + way, same[np.arange(len(key)), way]

    def teach(self, key: np.ndarray, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Learn new pieces, given by sorted keys, their bytes end to end and
        sizes: their offsets and lengths in the pool. None if the pool is full;
        all is forgotten then."""
        flat, many = self.learn(raw, size, key)
        if self.used + len(flat) > len(self.pool):
            if not self.used:
                self.pool = np.zeros(len(flat) * 2, np.uint32)
            self.table[:] = 0
            self.used = 0
            return None
        place = self.used + np.cumsum(many) - many
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        slot = (key >> self.shift).astype(np.int64)
        nth = np.arange(len(slot)) - np.searchsorted(slot, slot)  # among new ones of the slot
        way = ((self.table[slot] == 0).argmax(1) + nth) & 3
        self.table[slot, way], self.offset[slot, way], self.length[slot, way] = key, place, many
        return place, many

    def ids(self, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For blocks of (data, starts, ends): the ids of all pieces end to end,
        and how many each piece has."""
        keys = [piece_keys(*block) for block in blocks]
        taught = None
        while taught is None:
            found, fresh, raws, sizes = [], [], [], []
            for key, (data, starts, ends) in zip(keys, blocks, strict=True):
                at, here = self.find(key)
                found.append((self.offset.ravel()[at].astype(np.int64), self.length.ravel()[at].astype(np.int64), np.flatnonzero(~here)))
                new, first = np.unique(key[~here], return_index=True)
                first = found[-1][2][first]
                fresh.append(new)
                sizes.append(ends[first] - starts[first])
                raws.append(data[ranges(starts[first], sizes[-1])])
            size, raw = np.concatenate(sizes), np.concatenate(raws)
            new, one = np.unique(np.concatenate(fresh), return_index=True)
            taught = self.teach(new, raw[ranges((np.cumsum(size) - size)[one], size[one])], size[one])
        place, many = taught
        out = []
        for key, (offset, length, lost) in zip(keys, found, strict=True):
            i = np.searchsorted(new, key[lost])
            offset[lost], length[lost] = place[i], many[i]
            out.append((self.pool[ranges(offset, length)], length))
        return out


def by_text(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many ids each text has; the last piece before a closing byte is its own."""
    closing = np.flatnonzero(data == 255)
    total = np.concatenate([[0], np.cumsum(lengths)])
    return np.diff(total[np.searchsorted(starts, closing)], prepend=0)


def groups(texts: list[bytes], size: int = 4 << 20):
    """Lists of blocks of about ``size`` bytes together."""
    some: list[list[int]] = []
    held = 0
    for block in blocks(texts):
        some.append(block)
        held += sum(len(texts[i]) for i in block)
        if held >= size:
            yield some
            some, held = [], 0
    if some:
        yield some


def blocks(texts: list[bytes], size: int = 1 << 18):
    """Runs of texts of about ``size`` bytes; a longer text alone."""
    some: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        if some and held + len(text) > size:
            yield some
            some, held = [], 0
        some.append(i)
        held += len(text) + 1
    if some:
        yield some
