"""Choosing edges, against a plain loop."""

import random

from graphloom.operators import traverse


def plainly(edges, seeds, boosts, limit=12, low_limit=4, per_entity=2):
    def score(relation):
        upper = relation.upper()
        return (20 if upper == "MENTIONS" else 10 if upper in traverse.LOW_SIGNAL else 100) + boosts.get(upper, 0)

    def rank(e):
        f, r, t, c = e
        return (-score(r), -((f in seeds) + (t in seeds)), c is None, f.lower(), r.lower(), t.lower(), c or "", f, r, t)

    out, seen, low, touched = [], set(), 0, {}
    for e in sorted(set(edges), key=rank):
        f, r, t, c = e
        little = r.upper() in traverse.LOW_SIGNAL
        key = (f, r, t, c or "") if little else (f, r, t)
        if len(out) >= limit or key in seen:
            continue
        if little:
            if low >= low_limit or any(touched.get(x, 0) >= per_entity for x in (f, t)):
                continue
            low += 1
            for x in (f, t):
                touched[x] = touched.get(x, 0) + 1
        seen.add(key)
        out.append(e)
    return out


def test_edges_are_those_of_a_plain_loop(spark):
    dice = random.Random(1)
    for round_ in range(6):
        some = ["TREATS", "related_to", "mentions", "MENTIONS", "Has_Chunk", "CO_OCCURS_WITH"]
        edges = [(dice.choice("abcdef"), dice.choice(some), dice.choice("abcdef"), dice.choice([None, "c1", "c2"])) for _ in range(150 if round_ else 5)]
        if round_ == 2:  # a hub that many edges touch before others come
            edges = [("a", "MENTIONS", f"n{i:03}", f"c{i}") for i in range(200)] + [("z", "HAS_CHUNK", "y", None)]
        boosts = {"MENTIONS": 200.0} if round_ % 2 else {"TREATS": 3.0}
        df = spark.createDataFrame(edges, "_from string, relation_type string, _to string, evidence_chunk_id string")
        got = [(r["_from"], r["relation_type"], r["_to"], r["evidence_chunk_id"]) for r in traverse.select_edges(df, ["a", "b"], boosts=boosts).collect()]
        assert got == plainly(edges, {"a", "b"}, boosts), round_
    assert len(traverse.select_edges(df, [], limit=3, low_signal_limit=1).collect()) == 3


def test_a_join_for_each_depth_and_a_scan_for_each_join(spark, tmp_path):
    pairs = [(f"n/{a}", f"n/{b}") for a in range(8) for b in range(8) if (a * 5 + b * 3) % 7 < 2]
    spark.createDataFrame(pairs, "_from string, _to string").write.parquet(str(tmp_path / "e"))
    edges = spark.read.parquet(str(tmp_path / "e"))

    def plainly(start, low, high):
        found, level = [], [(start,)]
        for depth in range(high + 1):
            found += level if depth >= low else []
            level = [p + (t,) for p in level for f, t in pairs if f == p[-1] and t not in p]
        return sorted(found)

    starts = spark.createDataFrame([("n/1",), ("n/2",), ("n/none",)], "start string")
    for low, high in ((0, 0), (0, 2), (1, 3), (2, 3), (3, 3), (1, 5)):
        one = traverse.traverse(edges, "n/1", low, high, keep_edges=high == 2)
        assert sorted(tuple(r["ids"]) for r in one.collect()) == plainly("n/1", low, high)
        assert all(r["depth"] == len(r["ids"]) - 1 and r["id"] == r["ids"][-1] for r in one.collect())
        some = traverse.traverse(edges, starts, low, high)
        want = sorted(p for s in ("n/1", "n/2", "n/none") for p in plainly(s, low, high))
        assert sorted(tuple(r["ids"]) for r in some.collect()) == want
    plan = traverse.traverse(edges, "n/1", 1, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 4 and plan.count("Relation [") == 5
    executed = traverse.traverse(edges, "n/1", 1, 1)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(_from,n/1)" in executed
