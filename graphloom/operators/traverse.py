"""Bounded graph traversal over simple paths, a join for each depth.

Paths carry ids, score and the edges asked for; documents of vertices are joined
last. Depth is at most ten, so levels are unrolled: each join lengthens the longest
paths and lets shorter ones that are results pass, so no level is evaluated twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BudgetExceeded
from ..functions.values import KEYS

DECAY = 0.8
BUDGET = 10_000


def confidence(edges: DataFrame):
    """An edge's confidence: 1 where it is missing, null or no number."""
    found = next((f for f in edges.schema if f.name == "confidence"), None)
    if found is None:
        return F.lit(1.0)
    if isinstance(found.dataType, T.VariantType):
        number = F.when(F.schema_of_variant("confidence").isin("STRING", "BOOLEAN"), None).otherwise(F.try_variant_get("confidence", F.lit("$"), "double"))
        return F.coalesce(number, F.lit(1.0))
    if isinstance(found.dataType, T.NumericType):
        return F.coalesce(F.col("confidence").cast("double"), F.lit(1.0))
    return F.lit(1.0)


def steps(edges: DataFrame, direction: str, fields: set[str] | None = None, min_confidence: float | None = None) -> DataFrame:
    """``src, dst, sure, edge``: an edge in each direction that it may be walked. A
    self-loop never extends a simple path, and stands once."""
    edges = edges.withColumn("_sure", confidence(edges))
    if min_confidence is not None:
        edges = edges.filter(F.col("_sure") >= min_confidence)
    names = [c for c in edges.columns if c != "_sure" and (fields is None or c in fields or c == "_id" or c == KEYS)]
    edge = F.struct(*[F.col(f"`{c}`").alias(c) for c in names])
    out = edges.select(F.col("_from").alias("src"), F.col("_to").alias("dst"), F.col("_sure").alias("sure"), edge.alias("edge"))
    back = edges.select(F.col("_to").alias("src"), F.col("_from").alias("dst"), F.col("_sure").alias("sure"), edge.alias("edge"))
    if direction == "OUTBOUND":
        return out
    if direction == "INBOUND":
        return back
    return out.unionByName(back.filter("src <> dst"))


def traverse(edges: DataFrame, starts: DataFrame | str, low: int = 1, high: int = 1, direction: str = "OUTBOUND", min_confidence: float | None = None, decay: float = DECAY, edge_fields: set[str] | None = None, keep_edges: bool = False, keep_vertices: bool = False, budget: int | None = None) -> DataFrame:
    """``start, id, ids, depth, score, edge`` and, if kept, ``edges``: every simple
    path from each of ``starts`` (``start``, distinct; or one id, which then filters the
    scan of the first edges) with ``low`` to ``high`` edges.

    ``score`` is the product of confidences times ``decay`` to the power of depth.
    ``budget``: raise if a start has more paths (this runs a job)."""
    fields = None if keep_edges else edge_fields
    walk = steps(edges, direction, fields, min_confidence)
    edge_type = walk.schema["edge"].dataType
    one = isinstance(starts, str)
    if one:
        begin, starts = F.lit(starts), edges.sparkSession.range(1).select(F.lit(starts).alias("start"))
    out = starts.select("start", F.col("start").alias("id"), F.array("start").alias("ids"), F.lit(0).alias("depth"), F.lit(1.0).alias("score"), F.lit(None).cast(edge_type).alias("edge"))
    if keep_edges:
        out = out.withColumn("edges", F.array().cast(T.ArrayType(edge_type)))
    walk = walk.withColumnRenamed("edge", "_edge")
    for depth in range(1, high + 1):
        longer = {"start": F.col("start"), "id": F.col("dst"), "ids": F.array_append("ids", F.col("dst")), "depth": F.lit(depth), "score": F.col("score") * F.col("sure") * decay, "edge": F.col("_edge")}
        if keep_edges:
            longer["edges"] = F.array_append("edges", F.col("_edge"))
        if one and depth == 1:
            first = walk.filter((F.col("src") == begin) & (F.col("dst") != begin)).withColumns({"start": begin, "ids": F.array(begin), "score": F.lit(1.0)})
            if keep_edges:
                first = first.withColumn("edges", F.array().cast(T.ArrayType(edge_type)))
            first = first.select(*[c.alias(n) for n, c in longer.items()])
            out = out.unionByName(first) if low == 0 else first
            continue
        if depth <= low:
            out = out.join(walk, F.col("id") == F.col("src")).filter(~F.array_contains("ids", F.col("dst")))
            out = out.select(*[c.alias(n) for n, c in longer.items()])
            continue
        # a path of the last depth goes on, and stays; its other copy has a key that no edge has
        out = out.withColumn("_go", F.explode(F.when(F.col("depth") == depth - 1, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
        key = F.when(F.col("_go"), F.col("id")).otherwise(F.concat(F.lit("\0"), F.col("id")))
        out = out.withColumn("_at", key).join(walk, (F.col("_at") == F.col("src")) & F.col("_go"), "left")
        out = out.filter(~F.col("_go") | (F.col("src").isNotNull() & ~F.array_contains("ids", F.col("dst"))))
        out = out.select(*[F.when(F.col("_go"), c).otherwise(F.col(n)).alias(n) for n, c in longer.items()])
    out = out.filter(F.col("depth") >= low)
    if budget is not None:
        worst = out.groupBy("start").count().filter(F.col("count") > budget).first()
        if worst:
            raise BudgetExceeded(f"over {budget} paths from {worst['start']}")
    return out


def neighbours(edges: DataFrame, vertex: str, direction: str = "ANY") -> DataFrame:
    """Edges at a vertex; the filter reaches the scan."""
    out, into = F.col("_from") == vertex, F.col("_to") == vertex
    return edges.filter(out if direction == "OUTBOUND" else into if direction == "INBOUND" else out | into)


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` edges merged in by (from, to, relation type): an existing edge keeps
    its key and takes the new fields."""
    triple = ["_from", "_to", "relation_type"]
    old = edges.select(*triple, F.col("_key").alias("_old_key"), F.col("_id").alias("_old_id")).dropDuplicates(triple)
    merged = new.join(old, triple, "left")
    merged = merged.withColumn("_key", F.coalesce("_old_key", "_key")).withColumn("_id", F.coalesce("_old_id", "_id")).drop("_old_key", "_old_id")
    kept = edges.join(new.select(*triple).distinct(), triple, "left_anti")
    changed = edges.join(merged.select("_key"), "_key", "left_semi")
    fill = [c for c in edges.columns if c not in new.columns]
    merged = merged.join(changed.select("_key", *fill), "_key", "left") if fill else merged
    return kept.unionByName(merged, allowMissingColumns=True)


#: Relations that say little. Fixed values.
LOW_SIGNAL = ("CO_OCCURS_WITH", "HAS_CHUNK", "MENTIONS")


def relation_score(boosts: dict[str, float] | None = None):
    """100 for a relation, 20 for MENTIONS, 10 for others that say little, and what
    ``boosts`` adds to a relation (by its name in upper case)."""
    upper = F.upper("relation_type")
    score = F.when(upper == "MENTIONS", 20.0).when(upper.isin(*LOW_SIGNAL), 10.0).otherwise(100.0)
    for relation, boost in (boosts or {}).items():
        score = score + F.when(upper == relation, float(boost)).otherwise(0.0)
    return score


def select_edges(edges: DataFrame, seeds: list[str], limit: int = 12, low_signal_limit: int = 4, low_signal_per_entity: int = 2, boosts: dict[str, float] | None = None) -> DataFrame:
    """The ``limit`` best edges for a trace: by relation score with boosts, number of
    ends that are seeds, having evidence (``evidence_chunk_id``), then by names in
    lower case. A fact counts once, whatever its evidence; of relations that say
    little, an edge counts once for each evidence, at most ``low_signal_limit`` are
    taken, and at most ``low_signal_per_entity`` that touch an entity at either end.

    Duplicates go in one aggregation. The best edges that say little are folded on the
    driver, a bounded page of candidates at a time: one that is passed over touches an
    entity that is full, and stays so, so a page leaves out all of these."""
    evidence = F.coalesce("evidence_chunk_id", F.lit("")) if "evidence_chunk_id" in edges.columns else F.lit("")
    seeded = F.col("_from").isin(seeds).cast("int") + F.col("_to").isin(seeds).cast("int")
    ranked = edges.withColumns({"_score": relation_score(boosts), "_seeded": seeded, "_evidence": evidence, "_low": F.upper("relation_type").isin(*LOW_SIGNAL)})
    order = [F.desc("_score"), F.desc("_seeded"), F.desc(F.col("_evidence") != ""), F.lower("_from"), F.lower("relation_type"), F.lower("_to"), "_evidence", "_from", "relation_type", "_to", *[F.col(c) for c in ("_key",) if c in edges.columns]]
    same = ["_from", "relation_type", "_to", F.when(F.col("_low"), F.col("_evidence"))]
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy(*same).orderBy(*order))
    ranked = ranked.withColumn("_nth", first).filter("_nth = 1").drop("_nth")
    low, chosen, page = ranked.filter("_low"), [], max(64, 8 * low_signal_limit)
    touched: dict[str, int] = {}
    taken: set[tuple] = set()
    while len(chosen) < min(low_signal_limit, limit):
        full = [e for e, n in touched.items() if n >= low_signal_per_entity]
        left = low.filter(~F.col("_from").isin(full) & ~F.col("_to").isin(full)) if full else low
        rows = [r for r in left.orderBy(*order).limit(page + len(chosen)).collect() if (r["_from"], r["relation_type"], r["_to"], r["_evidence"]) not in taken]
        before = len(chosen)
        for r in rows:
            ends = (r["_from"], r["_to"])
            if len(chosen) < low_signal_limit and all(touched.get(e, 0) < low_signal_per_entity for e in ends):
                chosen.append(r)
                taken.add((*ends[:1], r["relation_type"], ends[1], r["_evidence"]))
                for e in ends:
                    touched[e] = touched.get(e, 0) + 1
        if len(chosen) == before or len(rows) < page:
            break
    best = ranked.filter(~F.col("_low")).orderBy(*order).limit(limit)
    if chosen:
        best = best.unionByName(edges.sparkSession.createDataFrame(chosen, ranked.schema))
    return best.orderBy(*order).limit(limit).drop("_seeded", "_evidence", "_low")
