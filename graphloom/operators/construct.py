"""From a text corpus to a graph with evidence: preparing texts, finding mentions,
grounding facts, deriving and storing them, and judging the outcome.

Rules, entities and vetoes are small and configured by people; they travel to the
executors with the code. Texts stay distributed.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError

#: Words that negate what follows in their clause, besides any that ends in n't. Fixed values.
NEGATIONS = frozenset("not no never none nor false untrue without denied denies deny retracted withdrawn cannot".split())
#: Abbreviations whose dot ends no sentence. Fixed values.
ABBREVIATIONS = frozenset("st no dr mr mrs ms prof vs cf al fig approx".split())
CLAUSE_END = re.compile(r"[.;!?,:]")
TOKEN = re.compile(r"[A-Za-z0-9']+")


@dataclass(frozen=True)
class Entity:
    name: str
    type: str = ""
    aliases: tuple[str, ...] = ()

    def surfaces(self) -> tuple[str, ...]:
        return (self.name, *self.aliases)


@dataclass(frozen=True)
class Rule:
    source: str
    relation: str
    target: str
    when_any: tuple[str, ...]
    require_in_sentence: tuple[str, ...] = ()  # "source", "target"
    licences: tuple[tuple[str, str, str | None], ...] = ()  # trigger, neuron, reviewer


@dataclass(frozen=True)
class Veto:
    source: str
    relation: str
    target: str
    when_any: tuple[str, ...]


@dataclass(frozen=True)
class Space:
    id: str
    entities: tuple[Entity, ...] = ()
    rules: tuple[Rule, ...] = ()
    vetoes: tuple[Veto, ...] = field(default=())

    @classmethod
    def from_json(cls, data: dict) -> Space:
        entities = tuple(Entity(e["name"], e.get("type", ""), tuple(e.get("aliases", ()))) for e in data.get("entities", ()))
        rules = tuple(Rule(r["source"], r["relation"], r["target"], tuple(r["when_any"]), tuple(r.get("require_in_sentence", ()))) for r in data.get("relation_rules", ()))
        return cls(data.get("id", data.get("name", "")), entities, rules)

    def with_neurons(self, neurons: list[dict]) -> Space:
        """Accepted aliases, triggers and blockers added, in any order; each added
        trigger remembers who licensed it."""
        accepted = sorted((n for n in neurons if n.get("status") == "accepted"), key=lambda n: n["id"])
        entities = []
        for e in self.entities:
            extra = [a for n in accepted if n["type"] == "entity_alias" and n.get("entity") == e.name for a in n.get("aliases", ())]
            entities.append(replace(e, aliases=tuple(dict.fromkeys([*e.aliases, *extra]))))
        rules = []
        for r in self.rules:
            hints = [n for n in accepted if n["type"] == "relation_hint" and (n["source"], n["relation"], n["target"]) == (r.source, r.relation, r.target)]
            new = [(t, n["id"], n.get("reviewed_by")) for n in hints for t in n.get("triggers", ()) if t not in r.when_any]
            rules.append(replace(r, when_any=tuple(dict.fromkeys([*r.when_any, *(t for t, _, _ in new)])), licences=(*r.licences, *new)))
        known = {(r.source, r.relation, r.target) for r in rules}
        new_rules: dict[tuple, list[tuple]] = {}
        for n in accepted:
            triple = (n.get("source"), n.get("relation"), n.get("target"))
            if n["type"] == "relation_hint" and triple not in known:
                new_rules.setdefault(triple, []).extend((t, n["id"], n.get("reviewed_by")) for t in n.get("triggers", ()))
        rules += [Rule(*triple, tuple(dict.fromkeys(t for t, _, _ in signed)), (), tuple(signed)) for triple, signed in new_rules.items()]
        vetoes = tuple(Veto(n["source"], n["relation"], n["target"], tuple(n.get("triggers", ()))) for n in accepted if n["type"] == "relation_blocker")
        return Space(self.id, tuple(entities), tuple(rules), (*self.vetoes, *vetoes))


# -- preparing texts -------------------------------------------------------------


def normalised(raw: bytes) -> str:
    """NFC, a line for each paragraph, white space collapsed. Blank lines part
    paragraphs; control characters other than line ends and tabs are refused."""
    text = raw.decode("utf-8").removeprefix("﻿")
    if any(unicodedata.category(c) == "Cc" and c not in "\r\n\t" for c in text):
        raise QueryError("the text has control characters")
    text = unicodedata.normalize("NFC", text.replace("\r\n", "\n").replace("\r", "\n"))
    lines = [" ".join(line.split()) for line in text.split("\n")]
    paragraphs = [" ".join(p) for p in _runs(lines)]
    if not paragraphs:
        raise QueryError("the text is empty")
    return "\n".join(paragraphs)


def _runs(lines: list[str]) -> Iterator[list[str]]:
    run: list[str] = []
    for line in [*lines, ""]:
        if line:
            run.append(line)
        elif run:
            yield run
            run = []


def bounded(text: str, most: int) -> Iterator[str]:
    """Pieces of at most ``most`` bytes: cut behind a sentence, else at white
    space, else between characters."""
    while len(text.encode()) > most:
        head = text.encode()[:most].decode(errors="ignore") or text[0]
        sentences = [m.end() for m in re.finditer(r"[.!?]", head) if text[m.end() : m.end() + 1].isspace()]
        blanks = [i for i, c in enumerate(head) if c.isspace() and i]
        cut = (sentences or blanks or [len(head)])[-1]
        if piece := text[:cut].rstrip():
            yield piece
        text = text[cut:].lstrip()
    if text:
        yield text


def chunks_of(id_: str, raw: bytes, most: int) -> list[tuple[str, str]]:
    """``(chunk id, text)`` of a document: paragraphs packed up to ``most`` bytes."""
    key, out, now = hashlib.sha256(id_.encode()).hexdigest(), [], ""
    for paragraph in normalised(raw).split("\n"):
        for piece in bounded(paragraph, most):
            if now and len(now.encode()) + 1 + len(piece.encode()) > most:
                out.append(now)
                now = ""
            now = f"{now} {piece}" if now else piece
    if now:
        out.append(now)
    return [(f"d-{key}-c{i:08d}", text) for i, text in enumerate(out)]


def prepare(docs: DataFrame, max_chunk_bytes: int = 2000, skip_bad: bool = False) -> DataFrame:
    """``id, title, text``: chunks of documents (``id``, ``title``, ``text``). A bad
    text is an error, or with ``skip_bad`` gives no chunks. Ids must be unique."""
    if max_chunk_bytes < 4:
        raise QueryError("a chunk has 4 bytes at least")
    has_title = "title" in docs.columns
    docs = docs.select(F.col("id").cast("string").alias("id"), (F.col("title") if has_title else F.lit("")).cast("string").alias("title"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, list, list] = ([], [], [])
            for id_, title, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    made = chunks_of(id_, text or b"", max_chunk_bytes)
                except (QueryError, UnicodeDecodeError) as e:
                    if not skip_bad:
                        raise QueryError(f"document {id_}: {e}") from e
                    continue
                for chunk, part in made:
                    rows[0].append(chunk)
                    rows[1].append(title)
                    rows[2].append(part)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in rows], names=["id", "title", "text"])

    return docs.mapInArrow(run, "id string, title string, text string")


# -- grounding ---------------------------------------------------------------------


class Clauses:
    """Where the clauses of a text begin and which words negate, found once."""

    def __init__(self, text: str):
        self.begins = [0, *(m.end() for m in CLAUSE_END.finditer(text))]
        self.negations = [m.end() for m in TOKEN.finditer(text) if m.group() in NEGATIONS or m.group().endswith("n't")]
        self.text = text

    def negated(self, at: int) -> bool:
        """Whether a negation stands before a place, in the same clause."""
        begin = self.begins[bisect_right(self.begins, at) - 1]
        n = bisect_right(self.negations, at)
        if n and self.negations[n - 1] > begin:
            return True
        # a word that the place cuts is read up to there
        m = re.search(r"[A-Za-z0-9']+$", self.text[max(begin, at - 16) : at])
        return bool(m) and (m.group() in NEGATIONS or m.group().endswith("n't"))


def affirmed(folded: str, phrase: str, clauses: Clauses) -> Iterator[int]:
    """Places of a phrase (in lower case) that no negation precedes in its clause."""
    at = folded.find(phrase) if phrase else -1
    while at >= 0:
        if not clauses.negated(at):
            yield at
        at = folded.find(phrase, at + 1)


def sentences(text: str) -> list[tuple[int, int]]:
    """Ranges of sentences. A dot ends one only before white space or the end, and
    not after an abbreviation."""
    out, begin = [], 0
    for m in re.finditer(r"[.!?\n]", text):
        if m.group() == ".":
            if m.end() < len(text) and not text[m.end()].isspace():
                continue
            word = re.search(r"[^\W\d_]*$", text[:m.start()]).group()
            if word.lower() in ABBREVIATIONS:
                continue
        out.append((begin, m.end()))
        begin = m.end()
    return [*out, (begin, len(text))] if begin < len(text) else out


def sentence_at(bounds: list[tuple[int, int]], at: int, end: int) -> tuple[int, int]:
    """The sentence that holds a place, or all of the text."""
    i = bisect_right(bounds, (at, end + 1)) - 1
    return bounds[i] if i >= 0 and bounds[i][0] <= at < bounds[i][1] else (0, end)


def original_bytes(text: str, folded_at: int) -> int:
    """Byte offset in ``text`` of a place in ``text.lower()``."""
    folded = size = 0
    for c in text:
        if folded >= folded_at:
            return size
        folded += len(c.lower())
        if folded > folded_at:
            return size
        size += len(c.encode())
    return size


def expansions(phrase: str, rule: Rule, surfaces: dict[str, tuple[str, ...]]) -> list[str]:
    """A trigger with ``{source}`` and ``{target}`` replaced by each surface."""
    out = [phrase]
    for slot, name in (("{source}", rule.source), ("{target}", rule.target)):
        out = [x.replace(slot, s) for x in out for s in (surfaces.get(name, ()) if slot in x else ("",))]
    return list(dict.fromkeys(out))


def ground_text(text: str, space: Space) -> list[tuple]:
    """``(source, relation, target, trigger, start, end, neuron, reviewer)`` of each
    rule that a text affirms: a trigger stands in a clause that isn't negated
    before it, in a sentence with the endpoints the rule asks for, and no veto
    phrase of the same fact stands anywhere. Spans are bytes of the text."""
    folded = text.lower()
    surfaces = {e.name: e.surfaces() for e in space.entities}
    bounds: list[tuple[int, int]] | None = None
    clauses: Clauses | None = None
    out = []
    for rule in space.rules:
        triple = (rule.source, rule.relation, rule.target)
        if any((v.source, v.relation, v.target) == triple and any(p.strip() and p.lower() in folded for p in v.when_any) for v in space.vetoes):
            continue
        needed = [tuple(s.lower() for s in surfaces.get(rule.source if end == "source" else rule.target, ())) for end in rule.require_in_sentence]
        found = None
        for phrase in rule.when_any:
            for trigger in expansions(phrase, rule, surfaces):
                low = trigger.lower()
                if not low or low not in folded:
                    continue
                clauses = clauses or Clauses(folded)
                for at in affirmed(folded, low, clauses):
                    fine = True
                    if needed:
                        bounds = sentences(folded) if bounds is None else bounds
                        a, b = sentence_at(bounds, at, len(folded))
                        fine = all(any(s in folded[a:b] for s in some) for some in needed)
                    if fine:
                        found = (trigger, at, at + len(low), phrase)
                        break
                if found:
                    break
            if found:
                break
        if found:
            trigger, a, b, phrase = found
            licence = next(((n, r) for t, n, r in rule.licences if t == phrase), (None, None))
            out.append((*triple, trigger, original_bytes(text, a), original_bytes(text, b), *licence))
    return out


FACTS = "chunk_id string, source string, relation string, target string, trigger string, trigger_start int, trigger_end int, neuron_id string, reviewed_by string"


def ground(chunks: DataFrame, space: Space) -> DataFrame:
    """:data:`FACTS` that chunks (``id``, ``text``) affirm."""
    names = [x.split()[0] for x in FACTS.split(", ")]
    kinds = [pa.string()] * 5 + [pa.int32()] * 2 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(id_, *fact) for id_, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for fact in ground_text(text or "", space)]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return chunks.select("id", "text").mapInArrow(run, FACTS)


def mentions(chunks: DataFrame, entities: tuple[Entity, ...]) -> DataFrame:
    """``chunk_id, entity``: entities whose name or alias stands in a chunk, case
    ignored. The entities are configuration, so they become conditions of one scan."""
    folded = F.lower("text")
    named = [F.when(_any([folded.contains(s.lower()) for s in e.surfaces() if s]), F.lit(e.name)) for e in entities]
    if not named:
        return chunks.limit(0).select(F.col("id").alias("chunk_id"), F.lit("").alias("entity"))
    some = F.filter(F.array(*named), lambda x: x.isNotNull())
    return chunks.select(F.col("id").alias("chunk_id"), F.explode(F.array_distinct(some)).alias("entity"))


def _any(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def sanitised(c: Column) -> Column:
    """A key: ASCII letters and digits in lower case, other runs as one hyphen."""
    return F.trim(F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", "-")), F.lit("-"))


def occurrence_key(kind: str, *parts: Column) -> Column:
    """A key that the same occurrence always gets."""
    joined = F.concat_ws("\0", F.lit(kind), *parts)
    return F.concat(F.lit(kind + "-"), F.sha2(joined.cast("binary"), 256))


def derive(chunks: DataFrame, space: Space) -> DataFrame:
    """``source, relation, target, evidence_chunk_id``: distinct and sorted."""
    facts = ground(chunks, space).select("source", "relation", "target", F.col("chunk_id").alias("evidence_chunk_id"))
    return facts.distinct().orderBy("source", "relation", "target", "evidence_chunk_id")


def materialise(chunks: DataFrame, space: Space) -> dict[str, DataFrame]:
    """The graph of a corpus: ``entities``, ``chunks``, ``mentions`` and ``facts``."""
    spark, sid = chunks.sparkSession, F.lit(space.id)
    rows = [(e.name, e.type, list(e.aliases)) for e in space.entities]
    entities = spark.createDataFrame(rows, "name string, type string, aliases array<string>").withColumn("_key", sanitised(F.col("name")))
    entities = entities.dropDuplicates(["_key"]).withColumn("_id", F.concat(F.lit("entities/"), "_key"))
    key = F.concat(sanitised(sid), F.lit("-"), sanitised(F.col("id")))
    title = F.col("title") if "title" in chunks.columns else F.lit("")
    stored = chunks.select(key.alias("_key"), F.concat(F.lit("chunks/"), key).alias("_id"), sid.alias("space_id"), F.col("id").alias("chunk_id"), title.alias("title"), "text", F.concat(F.lit("sha256:"), F.sha2(F.col("text").cast("binary"), 256)).alias("content_hash"))
    chunk_key = F.concat(F.lit("chunks/"), sanitised(sid), F.lit("-"), sanitised(F.col("chunk_id")))

    def entity(name: str) -> Column:
        return F.concat(F.lit("entities/"), sanitised(F.col(name)))

    found = mentions(chunks, space.entities)
    k = occurrence_key("mention", sid, F.col("chunk_id"), sanitised(F.col("entity")))
    found = found.select(k.alias("_key"), F.concat(F.lit("mentions/"), k).alias("_id"), chunk_key.alias("_from"), entity("entity").alias("_to"), F.lit("MENTIONS").alias("relation_type"), sid.alias("space_id"), F.col("chunk_id").alias("evidence_chunk_id")).dropDuplicates(["_key"])
    facts = ground(chunks, space)
    k = occurrence_key("fact", sid, F.col("chunk_id"), sanitised(F.col("source")), F.col("relation"), sanitised(F.col("target")))
    facts = facts.select(k.alias("_key"), F.concat(F.lit("facts/"), k).alias("_id"), entity("source").alias("_from"), entity("target").alias("_to"), F.col("relation").alias("relation_type"), sid.alias("space_id"), F.col("chunk_id").alias("evidence_chunk_id"), "trigger", "trigger_start", "trigger_end", F.lit("narrative").alias("provenance"), "neuron_id", "reviewed_by").dropDuplicates(["_key"])
    return {"entities": entities, "chunks": stored, "mentions": found, "facts": facts}


def ingest(graph: dict[str, DataFrame], chunks: DataFrame, space: Space) -> dict[str, DataFrame]:
    """``graph`` with these chunks built anew: what was derived from them before
    goes, all else stays."""
    new = materialise(chunks, space)
    ids = new["chunks"].select(F.col("chunk_id").alias("evidence_chunk_id"), "space_id")
    out = {"entities": graph["entities"].unionByName(new["entities"], allowMissingColumns=True).dropDuplicates(["_key"])}
    kept = graph["chunks"].join(new["chunks"].select("_key"), "_key", "left_anti")
    out["chunks"] = kept.unionByName(new["chunks"], allowMissingColumns=True)
    for name in ("mentions", "facts"):
        out[name] = graph[name].join(ids, ["evidence_chunk_id", "space_id"], "left_anti").unionByName(new[name], allowMissingColumns=True)
    return out


# -- judging ---------------------------------------------------------------------------


def parse_fact(text: str) -> tuple[str, str, str] | None:
    """``A --REL--> B``."""
    m = re.fullmatch(r"\s*(.+?)\s*--(.+?)-->\s*(.+?)\s*", text)
    return (m[1], m[2].strip(), m[3]) if m else None


def evaluate(facts: DataFrame, expected: list[str], forbidden: list[str]) -> DataFrame:
    """``category, source, relation, target, present`` of each distinct fact asked
    for. The specification is small; facts are joined against it once."""
    spark = facts.sparkSession
    rows = [(c, *f) for c, some in (("expected", expected), ("forbidden", forbidden)) for f in dict.fromkeys(filter(None, map(parse_fact, some)))]
    spec = spark.createDataFrame(rows, "category string, source string, relation string, target string")
    triple = ["source", "relation", "target"]
    there = facts.select(*triple).join(F.broadcast(spec.select(*triple).distinct()), triple, "left_semi").distinct().withColumn("present", F.lit(True))
    return spec.join(there, triple, "left").select("category", *triple, F.coalesce("present", F.lit(False)).alias("present"))


def score(outcome: DataFrame) -> DataFrame:
    """``expected_total, expected_found, forbidden_total, forbidden_triggered``."""

    def many(category: str, present: bool) -> Column:
        fits = F.col("category") == category
        return F.count_if(fits & F.col("present") if present else fits)

    return outcome.agg(many("expected", False).alias("expected_total"), many("expected", True).alias("expected_found"), many("forbidden", False).alias("forbidden_total"), many("forbidden", True).alias("forbidden_triggered"))


GATES = {"none": (), "source": ("source",), "target": ("target",), "both": ("source", "target")}


def advise_gates(chunks: DataFrame, space: Space) -> DataFrame:
    """``gate, source, relation, target, chunks``: in how many chunks each rule
    fires under each of the four sentence gates."""
    out = None
    for gate, ends in GATES.items():
        gated = Space(space.id, space.entities, tuple(replace(r, require_in_sentence=ends) for r in space.rules), space.vetoes)
        found = ground(chunks, gated).groupBy("source", "relation", "target").agg(F.countDistinct("chunk_id").alias("chunks"))
        found = found.withColumn("gate", F.lit(gate)).select("gate", "source", "relation", "target", "chunks")
        out = found if out is None else out.unionByName(found)
    return out


def ablate(chunks: DataFrame, space: Space, neurons: list[dict]) -> DataFrame:
    """``neuron_id, source, relation, target, chunk_id, change``: facts that go or
    come when an accepted neuron is left out."""
    whole = derive(chunks, space.with_neurons(neurons))
    out = None
    for n in sorted((n for n in neurons if n.get("status") == "accepted"), key=lambda n: n["id"]):
        less = derive(chunks, space.with_neurons([m for m in neurons if m["id"] != n["id"]]))
        lost, gained = whole.subtract(less).withColumn("change", F.lit("lost")), less.subtract(whole).withColumn("change", F.lit("gained"))
        part = lost.unionByName(gained).withColumn("neuron_id", F.lit(n["id"]))
        out = part if out is None else out.unionByName(part)
    columns = ["neuron_id", "source", "relation", "target", F.col("evidence_chunk_id").alias("chunk_id"), "change"]
    if out is None:
        return whole.limit(0).withColumn("change", F.lit("")).withColumn("neuron_id", F.lit("")).select(*columns)
    return out.select(*columns)


def triples_of(facts: DataFrame) -> DataFrame:
    return facts.select("source", "relation", "target").distinct()


def _specified(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def blocker_report(chunks: DataFrame, space: Space, neurons: list[dict], forbidden: list[tuple[str, str, str]]) -> DataFrame:
    """``source, relation, target, status, attributed_to`` of each forbidden fact:
    ``never_fired`` without blockers, ``suppressed`` by them, or ``still_violated``;
    with the blockers that name it."""
    whole, triple = space.with_neurons(neurons), ["source", "relation", "target"]
    open_ = triples_of(ground(chunks, replace(whole, vetoes=()))).withColumn("open", F.lit(True))
    shut = triples_of(ground(chunks, whole)).withColumn("shut", F.lit(True))
    rows = [(*f, [n["id"] for n in neurons if n["type"] == "relation_blocker" and (n.get("source"), n.get("relation"), n.get("target")) == tuple(f)]) for f in dict.fromkeys(map(tuple, forbidden))]
    spec = _specified(chunks.sparkSession, rows, "source string, relation string, target string, attributed_to array<string>")
    status = F.when(F.col("open").isNull(), "never_fired").when(F.col("shut").isNull(), "suppressed").otherwise("still_violated")
    return spec.join(open_, triple, "left").join(shut, triple, "left").select(*triple, status.alias("status"), "attributed_to")


def graduation_report(chunks: DataFrame, space: Space, neurons: list[dict]) -> DataFrame:
    """``neuron_id, source, relation, target, reason`` of accepted neurons that the
    corpus doesn't need: a hint whose fact grounds without it (``covered_by_base`` or
    ``covered_by_others``), a blocker whose fact doesn't (``inert_blocker``)."""
    spark, triple = chunks.sparkSession, ["source", "relation", "target"]
    accepted = sorted((n for n in neurons if n.get("status") == "accepted"), key=lambda n: n["id"])
    base = triples_of(ground(chunks, replace(space, vetoes=()))).withColumn("base", F.lit(True))
    schema = "neuron_id string, source string, relation string, target string, kind string"
    out = _specified(spark, [], f"{schema.rsplit(',', 1)[0]}, reason string")
    for n in accepted:
        if n["type"] not in ("relation_hint", "relation_blocker"):
            continue
        one = _specified(spark, [(n["id"], n["source"], n["relation"], n["target"], n["type"])], schema)
        without = triples_of(ground(chunks, space.with_neurons([m for m in accepted if m is not n]))).withColumn("there", F.lit(True))
        found = one.join(without, triple, "left").join(base, triple, "left")
        reason = F.when(F.col("kind") == "relation_blocker", F.when(F.col("there").isNull(), F.lit("inert_blocker"))).when(F.col("there"), F.when(F.col("base"), F.lit("covered_by_base")).otherwise(F.lit("covered_by_others")))
        out = out.unionByName(found.select("neuron_id", *triple, reason.alias("reason")).filter("reason is not null"))
    return out


def degradation_report(chunks: DataFrame, space: Space, neurons: list[dict]) -> DataFrame:
    """``id, kind, source, relation, target, dead_triggers``: rules (``rule:0``, ...) and
    accepted hints none of whose triggers is affirmed in any chunk. One pass over the
    corpus looks for the triggers of all."""
    spark = chunks.sparkSession
    ways = [(f"rule:{i}", "base_rule", r.source, r.relation, r.target, list(r.when_any)) for i, r in enumerate(space.rules)]
    ways += [(n["id"], "neuron", n["source"], n["relation"], n["target"], list(n.get("triggers", ()))) for n in neurons if n.get("status") == "accepted" and n["type"] == "relation_hint"]
    ways = [w for w in ways if w[5]]
    phrases = sorted({p for w in ways for p in w[5]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alive: set[str] = set()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                folded = (text or "").lower()
                open_ = [p for p in phrases if p not in alive and p.lower() in folded]
                if open_:
                    clauses = Clauses(folded)
                    alive |= {p for p in open_ if next(affirmed(folded, p.lower(), clauses), None) is not None}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(alive), pa.string())], names=["phrase"])

    alive = chunks.select("text").mapInArrow(run, "phrase string").distinct()
    spec = _specified(spark, ways, "id string, kind string, source string, relation string, target string, dead_triggers array<string>")
    fires = spec.select("id", F.explode("dead_triggers").alias("phrase")).join(alive, "phrase").select("id").distinct()
    return spec.join(fires, "id", "left_anti")


#: Words that carry no meaning in a relation's name. Fixed values.
RELATION_STOPWORDS = ("of", "to", "in", "with", "for", "by", "on", "at", "as", "the", "a", "an", "is", "are", "has", "have", "be", "and", "or", "from", "into")


def semantic_signals(facts: DataFrame, entities: tuple[Entity, ...]) -> DataFrame:
    """``facts`` (with ``source``, ``relation``, ``target``, ``sentence``) with ``signals``:
    reasons to doubt that the sentence asserts the fact. It doesn't name the target; it
    only lists both ends next to each other; no word of the relation's name, cut to
    its stem, occurs. JVM-side; the entities are configuration."""
    folded = F.lower("sentence")
    catalog = F.create_map(*[x for e in entities for x in (F.lit(e.name), F.array(*map(F.lit, dict.fromkeys(s.lower() for s in e.surfaces() if s.strip()))))]) if entities else None

    def surfaces(name: str) -> Column:
        own = F.array(F.lower(name))
        found = F.coalesce(F.try_element_at(catalog, F.col(name)), own) if catalog is not None else own
        return F.filter(found, lambda s: F.trim(s) != "")

    def adjacent(a: Column, b: Column) -> Column:
        """Whether the first ``a`` is followed by ``b`` with only a separator between."""
        after = F.substr(folded, F.instr(folded, a) + F.length(a))
        between = F.substr(after, F.lit(1), F.instr(after, b) - 1)
        between = F.regexp_replace(between, r"^[\s,;]+|[\s,;]+$", "")
        return (F.instr(folded, a) > 0) & (F.instr(after, b) > 0) & between.isin("", "and", "or", "and/or")

    named = F.exists(surfaces("target"), lambda s: F.contains(folded, s))
    beside = F.exists(surfaces("source"), lambda a: F.exists(surfaces("target"), lambda b: adjacent(a, b) | adjacent(b, a)))
    words = F.filter(F.split(F.lower("relation"), r"[_\s]+"), lambda w: (w != "") & ~w.isin(*RELATION_STOPWORDS))
    stem = lambda w: F.substr(w, F.lit(1), F.least(F.greatest(F.length(w) - 3, F.lit(4)), F.length(w)))
    silent = (F.size(words) > 0) & ~F.exists(words, lambda w: F.contains(folded, stem(w)))
    signals = [F.when(~named, "target absent from the licensing sentence"), F.when(beside, "endpoints merely co-listed, not related"), F.when(silent, "sentence never uses the relation's vocabulary")]
    return facts.withColumn("signals", F.filter(F.array(*signals), lambda x: x.isNotNull()))


def gaps(views: DataFrame, space: Space, facts: DataFrame, min_support: int = 1) -> DataFrame:
    """``source, relation, target, support``: pairs of entities that side views
    (``id``, ``text``) mention together, that exactly one rule allows by its types of
    ends, and that no fact joins either way."""
    types = {e.name: e.type for e in space.entities}
    allowed: dict[tuple[str, str], set[str]] = {}
    for r in space.rules:
        allowed.setdefault((types.get(r.source, ""), types.get(r.target, "")), set()).add(r.relation)
    fits = [(a, *rel, b) for a in types for b in types if a != b and (rel := tuple(allowed.get((types[a], types[b]), ())))]
    pairs: dict[tuple[str, str], list[tuple[str, str, str]]] = {}
    for a, *rels, b in fits:
        pairs.setdefault((min(a, b), max(a, b)), []).extend((a, r, b) for r in rels)
    rows = [(x, y, *f[0]) for (x, y), f in pairs.items() if len(f) == 1]
    spark = views.sparkSession
    licensed = spark.createDataFrame(rows, "x string, y string, source string, relation string, target string")
    found = mentions(views, space.entities)
    # a view mentions few entities, each listed once
    lists = found.groupBy("chunk_id").agg(F.sort_array(F.collect_set("entity")).alias("e"))
    each = lists.select("chunk_id", "e", F.posexplode("e").alias("i", "x")).select("chunk_id", "x", F.explode(F.slice("e", F.col("i") + 2, F.size("e"))).alias("y"))
    support = each.join(F.broadcast(licensed), ["x", "y"]).groupBy("source", "relation", "target").agg(F.countDistinct("chunk_id").alias("support")).filter(F.col("support") >= max(1, min_support))
    joined = facts.select(F.least("source", "target").alias("x"), F.greatest("source", "target").alias("y")).distinct()
    support = support.withColumn("x", F.least("source", "target")).withColumn("y", F.greatest("source", "target"))
    return support.join(joined, ["x", "y"], "left_anti").drop("x", "y").orderBy(F.desc("support"), "source", "relation", "target")


def vocabulary(chunks: DataFrame, least: int = 3) -> DataFrame:
    """``word, documents``: words of at least ``least`` documents."""
    from .search import token_column

    words = chunks.select(F.explode(F.array_distinct(token_column("text"))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("documents")).filter(F.col("documents") >= least)
