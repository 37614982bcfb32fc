"""Fast exact use of the word-level BPE tokenizer of the ``tokenizers`` library.

The library normalises, splits and merges every occurrence of every word anew.
Its result for a text is the concatenation of its results for the words between
ASCII white space: NFC and lower case never reach across such a space, and the
splitting pattern never matches one. So each worker keeps the ids of words it
has met. New words of plain letters are split here and merged by :class:`pieces.Merger`
with the merges of the library's model, and a few of each call are held against
the library; any other word goes through the whole library. Texts of simple
characters are split by :mod:`pieces`, without a Python object a word.

Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import regex

from .pieces import DIGIT, END, SPACE, Merger, PieceMemory, by_text, groups, joined, lowered, simple

CACHE = 500_000
_ASCII = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_LATIN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Words of these characters are the same after NFC, and have simple lower case.
_PLAIN = re.compile("[!-~¡-įı-ǃǍ-ǰǴ-ɏ]+")


def byte_letters() -> dict[int, str]:
    """The usual printable letter for each byte: itself, or the next free one from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        model = spec["model"]
        vocab = model["vocab"]
        letters = byte_letters()
        #: first ids of a part: its bytes, the last one as the end of a word
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[letters[b] + "</w>"] for b in range(256)], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merger = Merger({(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)})
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}
        self.memory = PieceMemory(self._merged)

    def _split(self, word: bytes) -> list[bytes] | None:
        if word.isascii():
            return _ASCII.findall(word.lower()) if not word.translate(None, _PRINT) else None
        text = word.decode()
        return [p.encode() for p in _LATIN.findall(text.lower())] if _PLAIN.fullmatch(text) else None

    def _learn(self, new: list[bytes]) -> None:
        if len(self.words) + len(new) > CACHE:
            self.words.clear()
        if len(self.parts) > CACHE:
            self.parts.clear()
        split = {w: self._split(w) for w in new}
        fresh = list({p for parts in split.values() if parts for p in parts} - self.parts.keys())
        if fresh:
            flat, many = self._merged(np.frombuffer(b"".join(fresh), np.uint8), np.array([len(p) for p in fresh]))
            for p, ids in zip(fresh, np.split(flat, np.cumsum(many)[:-1]), strict=True):
                self.parts[p] = ids.astype("<u4").tobytes()
        odd = [w for w, parts in split.items() if parts is None]
        for w, e in zip(odd, self.whole.encode_batch([w.decode() for w in odd], add_special_tokens=False), strict=True):
            self.words[w] = np.array(e.ids, "<u4").tobytes()
        for w, parts in split.items():
            if parts is not None:
                self.words[w] = b"".join([self.parts[p] for p in parts])

    def _merged(self, raw: np.ndarray, size: np.ndarray, _: object = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts that the pattern splits off, by the merges of the library's
        model. The library itself encodes a few of each call; a difference ends
        the job rather than give other ids than the library's."""
        ends = np.cumsum(size)
        first = self.inner[raw]
        first[ends - 1] = self.final[raw[ends - 1]]
        flat, many = self.merger(first, size)
        until = np.cumsum(many)
        for i in range(0, len(size), max(1, len(size) // 16)):
            part = raw[ends[i] - size[i] : ends[i]].tobytes().decode()
            if self.whole.encode(part, add_special_tokens=False).ids != flat[until[i] - many[i] : until[i]].tolist():
                raise ValueError(f"the tokenizers library encodes {part!r} otherwise")
        return flat, many

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        easy = [i for i, text in enumerate(texts) if simple(text)]
        mine = [texts[i] for i in easy]
        for group in groups(mine):
            split = []
            for some in group:
                data, kind = joined([mine[i] for i in some])
                start = (kind == DIGIT) | (kind == END)
                start[0] = True
                start[1:] |= kind[1:] != kind[:-1]
                edges = np.flatnonzero(start)
                word = (kind[edges] != SPACE) & (kind[edges] != END)
                split.append((lowered(data), edges[word], np.append(edges[1:], len(data))[word]))
            for some, (data, starts, _), (ids, lengths) in zip(group, split, self.memory.ids(split), strict=True):
                cuts = np.cumsum(by_text(data, starts, lengths)).tolist()
                for i, a, b in zip(some, [0, *cuts], cuts, strict=False):
                    out[easy[i]] = ids[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, packed in zip(rest, self._encode_words([texts[i] for i in rest]), strict=True):
            out[i] = np.frombuffer(packed, "<u4")
        return out

    def _encode_words(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, by way of
        the words between ASCII white space."""
        out: list[bytes] = []
        some: list[list[bytes]] = []
        size = 0
        for i, text in enumerate(texts):
            # A-Z only changes nothing where no combining mark can follow
            some.append((text.lower() if text.isascii() or not _HIGH.search(text) else text).split())
            size += len(text)
            if size > 2_000_000 or i + 1 == len(texts):
                known = self.words
                new = set().union(*some).difference(known)
                if new:
                    self._learn(list(new))
                    if any(w not in known for s in some for w in s):  # the memory was cleared
                        self._learn([w for w in set().union(*some) if w not in known])
                get = known.__getitem__
                out += [b"".join(map(get, s)) for s in some]
                some, size = [], 0
        return out


_PRINT = bytes(range(33, 127))
_HIGH = re.compile(rb"[\xcc-\xff]")


@lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    """One for each worker, as its memory of words serves all its tasks."""
    return WordEncoder(path)
