import hashlib

import pytest

from graphloom.errors import QueryError
from graphloom.operators import construct as C

SPACE = C.Space.from_json({
    "id": "Test Space",
    "entities": [{"name": "Acme", "type": "org", "aliases": ["Acme Corp"]}, {"name": "Bolt", "type": "thing"}, {"name": "Cog", "type": "thing"}],
    "relation_rules": [{"source": "Acme", "relation": "MAKES", "target": "Bolt", "when_any": ["makes bolts", "{source} builds the {target}"]}, {"source": "Acme", "relation": "SELLS", "target": "Cog", "when_any": ["sells"], "require_in_sentence": ["source", "target"]}],
})


def facts(text, space=SPACE):
    return [(f[1], f[4], f[5]) for f in C.ground_text(text, space)]


def test_trigger_and_span():
    assert facts("Straße: Acme makes bolts") == [("MAKES", 14, 25)]
    assert facts("ACME CORP Builds The BOLT today") == [("MAKES", 0, 25)]


@pytest.mark.parametrize("text", ["Acme never makes bolts", "It isn't so that Acme makes bolts", "nothing here"])
def test_negation(text):
    assert facts(text) == []


def test_later_affirmation_counts():
    assert facts("Acme never makes bolts; it makes bolts") == [("MAKES", 27, 38)]


def test_sentence_gate():
    assert facts("Acme sells. Cog is here") == []
    assert facts("Dr. Acme sells a Cog.") == [("SELLS", 9, 14)]
    assert facts("Acme v1.5 sells a Cog") == [("SELLS", 10, 15)]


def test_neurons():
    hint = {"id": "n1", "type": "relation_hint", "status": "accepted", "source": "Acme", "relation": "MAKES", "target": "Bolt", "triggers": ["forges"], "reviewed_by": "r"}
    block = {"id": "n2", "type": "relation_blocker", "status": "accepted", "source": "Acme", "relation": "MAKES", "target": "Bolt", "triggers": ["rumour"]}
    space = SPACE.with_neurons([block, hint])
    assert C.ground_text("Acme forges", space)[0][6:] == ("n1", "r")
    assert C.ground_text("rumour: Acme forges", space) == []
    assert C.ground_text("Acme forges", SPACE.with_neurons([{**hint, "status": "proposed"}])) == []


def test_normalised():
    assert C.normalised("﻿a\r\nb  c\r\n\r\n é ".encode()) == "a b c\né"
    for bad in (b" \n ", b"a\x00"):
        with pytest.raises(QueryError):
            C.normalised(bad)


def test_chunks():
    got = C.chunks_of("doc", "One two. Three four five six seven.\n\nééééé".encode(), 16)
    assert [t for _, t in got] == ["One two.", "Three four five", "six seven.", "ééééé"]
    assert got[0][0] == f"d-{hashlib.sha256(b'doc').hexdigest()}-c00000000"
    assert [t for _, t in C.chunks_of("x", b"a b\n\nc", 10)] == ["a b c"]
    assert all(len(t.encode()) <= 5 for _, t in C.chunks_of("x", "éééééééééé".encode(), 5))


def test_graph(spark):
    docs = spark.createDataFrame([("1", "t", "Acme makes bolts."), ("2", "t", "Nothing."), ("3", "t", None)], "id string, title string, text string")
    chunks = C.prepare(docs, 100, skip_bad=True)
    graph = C.materialise(chunks, SPACE)
    assert graph["facts"].count() == 1 and graph["entities"].count() == 3
    assert {r["_to"] for r in graph["mentions"].collect()} == {"entities/acme", "entities/bolt"}
    derived = C.derive(chunks, SPACE)
    outcome = C.score(C.evaluate(derived, ["Acme --MAKES--> Bolt", "Acme --MAKES--> Bolt", "X --R--> Y"], ["Acme --SELLS--> Cog"])).first()
    assert tuple(outcome) == (2, 1, 1, 0)
    first = chunks.filter("text like 'Acme%'").withColumn("text", C.F.lit("Cog"))
    again = C.ingest(graph, first, SPACE)
    assert again["facts"].count() == 0 and again["chunks"].count() == graph["chunks"].count()
    with pytest.raises(Exception, match="empty"):
        C.prepare(docs, 100).collect()


def test_gates_gaps_and_ablation(spark):
    chunks = spark.createDataFrame([("a", "Acme makes bolts"), ("b", "It makes bolts. Acme and Cog.")], "id string, text string")
    gates = {(r["gate"], r["relation"]): r["chunks"] for r in C.advise_gates(chunks, SPACE).collect()}
    assert gates[("none", "MAKES")] == 2 and gates[("source", "MAKES")] == 1
    space = C.Space("s", SPACE.entities, (C.Rule("Acme", "MAKES", "Bolt", ("makes",)),))
    found = [tuple(r) for r in C.gaps(chunks, space, spark.createDataFrame([("Acme", "Bolt")], "source string, target string")).collect()]
    assert found == [("Acme", "MAKES", "Cog", 1)]
    alias = {"id": "n", "type": "relation_hint", "status": "accepted", "source": "Acme", "relation": "NEW", "target": "Cog", "triggers": ["and"]}
    assert [(r["neuron_id"], r["relation"], r["change"]) for r in C.ablate(chunks, SPACE, [alias]).collect()] == [("n", "NEW", "lost")]


def test_stream(spark, tmp_path):
    from graphloom.streaming import incremental

    source = str(tmp_path / "in")
    spark.createDataFrame([("a", "Acme makes bolts")], "id string, text string").write.parquet(source)
    stream = spark.readStream.schema("id string, text string").parquet(source)
    for text in ("Acme makes bolts", "Cog"):
        incremental.follow(stream, SPACE, str(tmp_path / "graph"), str(tmp_path / "ck")).awaitTermination()
        spark.createDataFrame([("a", "Cog"), ("b", text)], "id string, text string").write.mode("append").parquet(source)
    graph = incremental.load(spark, str(tmp_path / "graph"))
    assert graph["chunks"].count() == 2


def test_negation_is_read_up_to_the_place():
    text = "it is not so, but never mind: cannot do; can't do. fine"
    clauses = C.Clauses(text)

    def slowly(at):
        begin = max([0, *(m.end() for m in C.CLAUSE_END.finditer(text, 0, at))])
        return any(t in C.NEGATIONS or t.endswith("n't") for t in C.TOKEN.findall(text[begin:at]))

    assert [clauses.negated(at) for at in range(len(text) + 1)] == [slowly(at) for at in range(len(text) + 1)]


def test_many_triggers_in_one_text():
    import time

    took = []
    for many in (2000, 16_000):
        began = time.process_time()
        assert facts("never makes bolts " * many) == []
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 0.5


def test_hints_of_one_new_fact_all_count():
    hints = [{"id": i, "type": "relation_hint", "status": "accepted", "source": "Acme", "relation": "NEW", "target": "Cog", "triggers": [t]} for i, t in (("a", "adds"), ("b", "mends"))]
    space = SPACE.with_neurons(hints)
    assert [C.ground_text(f"It {t} cogs", space)[0][6] for t in ("adds", "mends")] == ["a", "b"]


def test_versions_go_on_and_replays_are_passed_over(spark, tmp_path):
    from graphloom.streaming import incremental

    folder, source = str(tmp_path / "graph"), str(tmp_path / "in")
    spark.createDataFrame([("a", "Acme makes bolts")], "id string, text string").write.parquet(source)
    stream = spark.readStream.schema("id string, text string").parquet(source)
    incremental.follow(stream, SPACE, folder, str(tmp_path / "one")).awaitTermination()
    spark.createDataFrame([("b", "Acme makes bolts")], "id string, text string").write.mode("append").parquet(source)
    incremental.follow(stream, SPACE, folder, str(tmp_path / "two")).awaitTermination()  # a new checkpoint
    graph = incremental.load(spark, folder)
    assert incremental.versions(spark, folder) == ([0, 1], [0, 1]) and graph["chunks"].count() == 2
    incremental.store(spark, graph, folder, str(tmp_path / "two"), 7)
    spark.createDataFrame([("c", "Cog")], "id string, text string").write.mode("append").parquet(source)
    incremental.follow(stream, SPACE, folder, str(tmp_path / "two")).awaitTermination()  # batch 1: before 7
    assert incremental.load(spark, folder)["chunks"].count() == 2
    assert incremental.versions(spark, folder)[1] == [0, 1, 2]
