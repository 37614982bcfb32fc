"""Trigger templates learned from texts with known facts, grounding with gaps between
the parts of a template, and scores against known facts.

Templates are mined and scored with DataFrame functions alone. Grounding compares each
text with the entities given for it, in Arrow batches.
"""

from __future__ import annotations

import datetime
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that neither texts nor templates need. Fixed values.
ARTICLES = frozenset(("the", "a", "an"))
MARKS = ("{source}", "{target}")


def template(text: Column, subject: Column, obj: Column) -> Column:
    """``text`` in lower case with ``{source}`` and ``{target}`` in place of the two
    surfaces, the longer first; null where one is missing or nothing else is left."""
    low, s, o = F.lower(text), F.lower(F.replace(subject, F.lit("_"), F.lit(" "))), F.lower(F.replace(obj, F.lit("_"), F.lit(" ")))
    longer = F.octet_length(s) >= F.octet_length(o)
    source_first = F.replace(F.replace(low, s, F.lit(MARKS[0])), o, F.lit(MARKS[1]))
    target_first = F.replace(F.replace(low, o, F.lit(MARKS[1])), s, F.lit(MARKS[0]))
    made = F.regexp_replace(F.when(longer, source_first).otherwise(target_first), r"^\s+|\s+$", "")
    made = F.regexp_replace(F.regexp_replace(made, r"^[.,;:!?]+|[.,;:!?]+$", ""), r"^\s+|\s+$", "")
    rest = F.trim(F.replace(F.replace(made, F.lit(MARKS[0]), F.lit("")), F.lit(MARKS[1]), F.lit("")))
    fine = (s != "") & (o != "") & F.contains(low, s) & F.contains(low, o) & F.contains(made, F.lit(MARKS[0])) & F.contains(made, F.lit(MARKS[1])) & (F.octet_length(rest) >= 2)
    return F.when(fine, made)


def mine(docs: DataFrame, triples: DataFrame, min_count: int = 1, most: int = 20, disambiguate: bool = True) -> DataFrame:
    """``predicate, template, n, place``: of each predicate the ``most`` most frequent
    templates. ``docs``: ``id``, ``text``; ``triples``: ``id``, ``subject``,
    ``predicate``, ``object``. Only texts with one triple teach. With ``disambiguate`` a
    template belongs to the predicate that has it most often (then the first by
    name)."""
    single = triples.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in ("subject", "predicate", "object")]).filter("_n = 1").drop("_n")
    made = docs.select("id", "text").join(single, "id").select("predicate", template(F.col("text"), F.col("subject"), F.col("object")).alias("template"))
    counted = made.filter("template is not null").groupBy("predicate", "template").agg(F.count(F.lit(1)).alias("n"))
    if disambiguate:
        owner = Window.partitionBy("template").orderBy(F.desc("n"), "predicate")
        counted = counted.withColumn("_n", F.row_number().over(owner)).filter("_n = 1").drop("_n")
    rank = Window.partitionBy("predicate").orderBy(F.desc("n"), "template")
    counted = counted.filter(F.col("n") >= min_count).withColumn("place", F.row_number().over(rank))
    return counted.filter(F.col("place") <= most)


# -- grounding with gaps -----------------------------------------------------------


def words(text: str) -> list[str]:
    """Runs of letters and digits in lower case, without articles."""
    runs = "".join(c if c.isalnum() else " " for c in text).lower().split()
    return [w for w in runs if w not in ARTICLES]


def dates(surface: str) -> list[str]:
    """Ways to write out an ISO date."""
    m = re.fullmatch(r'\s*"*(\d+)-(\d+)-(\d+)"*\s*', surface)
    if not m or not 1 <= int(m[2]) <= 12 or not 1 <= int(m[3]) <= 31:
        return []
    year, day = str(int(m[1])), int(m[3])
    month = datetime.date(2000, int(m[2]), 1).strftime("%B")
    nth = f"{day}" + ("th" if day in (11, 12, 13) else {1: "st", 2: "nd", 3: "rd"}.get(day % 10, "th"))
    return [x for d in (str(day), nth) for x in (f"{month} {d} {year}", f"{d} {month} {year}")]


def spellings(entity: str) -> list[list[str]]:
    found = {tuple(words(x)) for x in (entity.replace("_", " "), entity, *dates(entity))}
    return [list(x) for x in sorted(found) if x]


def parts(pattern: str) -> list[str | list[str]]:
    """A template as marks and runs of words."""
    out = [x if x in MARKS else words(x) for x in re.split(r"(\{source\}|\{target\})", pattern)]
    return [x for x in out if x]


class Sentence:
    def __init__(self, text: str):
        self.words = words(text)
        self.at: dict[str, list[int]] = {}
        for i, w in enumerate(self.words):
            self.at.setdefault(w, []).append(i)

    def find(self, some: list[list[str]], begin: int) -> tuple[int, int] | None:
        """The first place from ``begin`` on of one of several runs of words, the first
        listed of those that begin there."""
        best = None
        for n, run in enumerate(some):
            for i in self.at.get(run[0], ()):
                if i >= begin and (best is None or (i, n) < best[:2]) and self.words[i : i + len(run)] == run:
                    best = (i, n, i + len(run))
                    break
        return best and (best[0], best[2])

    def fits(self, pattern: list, source: list[list[str]], target: list[list[str]], gap: int) -> bool:
        """Whether the parts stand one after the other, ``gap`` words apart at most."""
        end = None
        for part in pattern:
            found = self.find(source if part == MARKS[0] else target if part == MARKS[1] else [part], end or 0)
            if found is None or (end is not None and found[0] - end > gap):
                return False
            end = found[1]
        return True


def ground_fuzzy(docs: DataFrame, rules: dict[str, list[str]], gap: int = 3, only: list[str] | None = None) -> DataFrame:
    """``id, subject, predicate, object``: facts of ``docs`` (``id``, ``text``,
    ``entities``) whose template stands in one sentence, with up to ``gap`` other words
    between its parts. ``rules``: templates of each predicate."""
    patterns = [(p, [parts(t) for t in some]) for p, some in sorted(rules.items()) if only is None or p in only]

    def facts(text: str, entities: list[str]) -> list[tuple[str, str, str]]:
        spelled = {e: spellings(e) for e in dict.fromkeys(entities)}
        found = set()
        for sentence in map(Sentence, re.split(r"[.!?]", text)):
            there = [e for e, some in spelled.items() if some and sentence.find(some, 0)]
            for a, b in itertools.permutations(there, 2):
                found |= {(a, p, b) for p, some in patterns if any(sentence.fits(x, spelled[a], spelled[b], gap) for x in some)}
        return sorted(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *f) for i, t, e in zip(*(c.to_pylist() for c in batch.columns), strict=True) for f in facts(t or "", [x for x in e or () if x])]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["id", "subject", "predicate", "object"])

    docs = docs.select(F.col("id").cast("string").alias("id"), "text", "entities")
    return docs.mapInArrow(run, "id string, subject string, predicate string, object string")


# -- scores ------------------------------------------------------------------------


def canonical(field: str) -> Column:
    """Lower case, spaces for underscores; numbers by value."""
    base = F.lower(F.trim(F.replace(F.col(field), F.lit("_"), F.lit(" "))))
    number = F.when(base.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"), base.try_cast("double"))
    return F.coalesce(number.cast("string"), base)


def score(known: DataFrame, built: DataFrame) -> DataFrame:
    """``predicate`` (null: all), ``known, built, correct, recall, precision, mislabeled,
    pairs``. Facts (``id``, ``subject``, ``predicate``, ``object``) count once a document.
    ``mislabeled``: right ends, another predicate; ``pairs``: these, and those the
    wrong way round."""

    def distinct(df: DataFrame) -> DataFrame:
        return df.select("id", *[canonical(c).alias(c) for c in ("subject", "predicate", "object")]).distinct()

    triple = ["id", "subject", "predicate", "object"]
    left, right = distinct(known).withColumn("k", F.lit(1)), distinct(built).withColumn("b", F.lit(1))
    facts = left.join(right, triple, "full")
    ends = left.select("id", "subject", "object").distinct()
    wrong = facts.filter("k is null").select(*triple)
    same = ends.withColumn("same", F.lit(1))
    back = ends.select("id", F.col("object").alias("subject"), F.col("subject").alias("object"), F.lit(1).alias("back"))
    wrong = wrong.join(same, ["id", "subject", "object"], "left").join(back, ["id", "subject", "object"], "left")
    facts = facts.join(wrong, triple, "left")
    out = facts.rollup("predicate").agg(F.count("k").alias("known"), F.count("b").alias("built"), F.count_if(F.col("k").isNotNull() & F.col("b").isNotNull()).alias("correct"), F.count("same").alias("mislabeled"), F.count_if(F.col("same").isNotNull() | F.col("back").isNotNull()).alias("pairs"))
    ratio = lambda of: F.when(F.col(of) > 0, F.col("correct") / F.col(of))
    return out.select("predicate", "known", "built", "correct", ratio("known").alias("recall"), ratio("built").alias("precision"), "mislabeled", "pairs")
