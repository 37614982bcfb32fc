"""Search for short license notices, exact and with a few edits.

A notice of ``n`` characters may differ from a text by ``n // 10`` edits. By the
pigeonhole principle, one of ``edits + 1`` pieces of the notice then stands in
the text unchanged, so an automaton over all pieces (Aho-Corasick) finds every
candidate in one pass. Around each candidate the ``regex`` library matches the
whole notice with bounded errors on each run of whole words that may be it, which
verifies the edits. Of runs that overlap, the one with the fewest edits is a span.
Spans are positions in the *folded* text: words in lower case (A-Z only), one
space between them and at both ends.

Null text is empty; texts without words give no spans; a table without rows
gives none; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import as_bytes, texts

#: Base phrases: words that stand consecutively. Fixed values.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notices, searched with edits like the base phrases. Fixed values.
NOTICES = {
    **BASE,
    "licensed under the apache license": "apache",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "creative commons attribution": "cc-by",
    "eclipse public license": "epl",
    "all rights reserved": "proprietary",
}
#: ASCII letters and digits, lower case; every byte of other characters; else a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def edits_allowed(notice: str) -> int:
    return len(notice) // 10


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` consecutive pieces of near equal length, with their offsets."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def gaps(folded: str, lo: int, hi: int) -> list[int]:
    """Places of spaces from ``lo`` to ``hi``, both included."""
    found, at = [], folded.find(" ", max(lo, 0), hi + 1)
    while at >= 0:
        found.append(at)
        at = folded.find(" ", at + 1, hi + 1)
    return found


class Places:
    """Short spans by stretches of 64 characters, so that those that meet a span are
    found without looking at the others."""

    def __init__(self) -> None:
        self.by: dict[int, list[tuple[int, int, int]]] = {}

    def add(self, a: int, b: int, edits: int) -> None:
        for k in range(a >> 6, (b - 1 >> 6) + 1):
            self.by.setdefault(k, []).append((a, b, edits))

    def meeting(self, a: int, b: int) -> list[int]:
        """Edits of the spans that overlap one."""
        return [e for k in range(a >> 6, (b - 1 >> 6) + 1) for x, y, e in self.by.get(k, ()) if x < b and a < y]


class Scanner:
    def __init__(self, notices: dict[str, str] = NOTICES, base: dict[str, str] = BASE):
        self.base = {f" {p} ": label for p, label in base.items()}
        self.notices = notices
        seeds: dict[str, list[tuple[str, int]]] = {}
        self.fuzzy = {}
        for notice in notices:
            k = edits_allowed(notice)
            for at, piece in pieces(notice, k):
                seeds.setdefault(piece, []).append((notice, at))
            self.fuzzy[notice] = regex.compile(rf"(?b)(?:{regex.escape(notice, special_only=True)}){{e<={k}}}")
        self.seeds = ahocorasick.Automaton()
        for piece, where in seeds.items():
            self.seeds.add_word(piece, (len(piece), where))
        self.seeds.make_automaton()

    def spans(self, folded: str) -> list[tuple[str, int, int, int]]:
        """``(notice, start, end, edits)`` of each place that matches."""
        tried: dict[str, dict[tuple[int, int], int]] = {}
        for last, (length, where) in self.seeds.iter(folded):
            for notice, at in where:
                k = edits_allowed(notice)
                start = last + 1 - length - at
                done = tried.setdefault(notice, {})
                # whole words only, or "commit license" would be a notice
                for a in gaps(folded, start - k - 1, start + k - 1):
                    for b in gaps(folded, a + 1 + len(notice) - k, a + 1 + len(notice) + k):
                        if (a + 1, b) not in done:
                            m = self.fuzzy[notice].fullmatch(folded, a + 1, b)
                            done[a + 1, b] = sum(m.fuzzy_counts) if m else k + 1
        found = []
        for notice, done in tried.items():
            own = Places()
            for edits, a, b in sorted((e, a, b) for (a, b), e in done.items() if e <= edits_allowed(notice)):
                if not own.meeting(a, b):
                    own.add(a, b, edits)
                    found.append((notice, a, b, edits))
        # where notices overlap, the nearest one is meant ("version 3" isn't "version 2" with an edit)
        every = Places()
        for _, a, b, edits in found:
            every.add(a, b, edits)
        return [x for x in found if not any(edits < x[3] for edits in every.meeting(x[1], x[2]))]

    def places(self, folded: str) -> list[tuple[int, str]]:
        """First word and label of each exact place of a base phrase."""
        found = []
        for phrase, label in self.base.items():
            at = folded.find(phrase)
            while at >= 0:
                found.append((at, label))
                at = folded.find(phrase, at + 1)
        found.sort()
        word, before, out = 0, 0, []
        for at, label in found:  # the space at `at` ends word number word - 1
            word += folded.count(" ", before, at)
            before = at
            out.append((word, label))
        return out


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<notice: string, start: long, end: long, edits: int>>"
_SPANS = pa.list_(pa.struct([("notice", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))


def scan(docs: DataFrame, notices: dict[str, str] = NOTICES, base: dict[str, str] = BASE) -> DataFrame:
    """:data:`SCHEMA`, a row for each document. ``score``: 1 for an exact notice,
    less by its share of edits for others, 0 for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, base)
        for batch in batches:
            rows = []
            for text in as_bytes(batch.column("text")):
                words = text.translate(FOLD).split(b" ")
                words = [w for w in words if w]
                folded = f" {b' '.join(words).decode()} "
                spans = scanner.spans(folded)
                places = scanner.places(folded)
                at = [p for p, _ in places]
                score = max([1.0 if places else 0.0, *(1 - e / len(n) for n, _, _, e in spans)])
                own = {label for _, label in places}
                rows.append((len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | {notices[n] for n, _, _, _ in spans})), score, [{"notice": n, "start": s, "end": t, "edits": e} for n, s, t, e in spans]))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _SPANS]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return texts(docs).mapInArrow(run, SCHEMA)
