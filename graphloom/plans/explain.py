"""EXPLAIN: a query's sources and pipeline, without touching data."""

from __future__ import annotations

import json
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..lang import ast as A
from ..lang.validate import binds_of, deep, expressions, free_names
from .lower import Lowering, conjuncts, used_fields

SCHEMA = "sources array<struct<kind: string, collection: string, var: string, depth: int, pushdown: string>>, pipeline array<string>, bind_vars array<string>"


def rendered(e: A.Node) -> str:
    if isinstance(e, A.Bind):
        return "@" + e.name
    if isinstance(e, A.Array):
        return "[" + ", ".join(map(rendered, e.items)) + "]"
    return json.dumps(e.value)


def constant(e: A.Node) -> bool:
    return isinstance(e, A.Literal | A.Bind) or (isinstance(e, A.Array) and all(map(constant, e.items)))


FLIP = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "==", "!=": "!="}


def pushed(var: str, filters: list[A.Node]) -> tuple[list[str], bool]:
    """Conditions that compare a field of ``var`` with a constant."""
    found, all_pushed = [], True
    for part in filters:
        text = None
        if isinstance(part, A.Binary) and part.op in (*FLIP, "IN"):
            left, right, op = part.left, part.right, part.op
            if constant(left) and op in FLIP:
                left, right, op = right, left, FLIP[op]
            path = A.path_of(left)
            if path and path[0] == var and path[1] and constant(right):
                text = f".{'.'.join(path[1])} {op} {rendered(right)}"
        if text:
            found.append(text)
        else:
            all_pushed = False
    return found, all_pushed


def sources(q: A.Query, depth: int = 0) -> list[tuple]:
    out = []
    bound: set[str] = set()
    single = sum(isinstance(c, A.For | A.ForVector | A.ForTraversal) for c in q.body) == 1
    for i, c in enumerate(q.body):
        filters = [p for f in q.body[i + 1 :] if isinstance(f, A.Filter) for p in conjuncts(f.test)]
        match c:
            case A.For(var=var, source=A.Name(name=name)) if name not in bound:
                fields = used_fields(q, var)
                predicates, every = pushed(var, filters)
                more: dict[str, Any] = {"projection": sorted(fields) if fields is not None else None, "predicates": predicates, "all_filters_pushed": every}
                if single and q.limit and every and not q.sort and not q.collect and all(isinstance(x, A.Literal) for x in (q.limit.offset or A.Literal(0), q.limit.count)):
                    more["fetch_limit"] = q.limit.count.value + (q.limit.offset.value if q.limit.offset else 0)
                out.append(("collection_scan", name, var, depth, json.dumps(more)))
            case A.For(var=var):
                out.append(("array", None, var, depth, None))
            case A.ForVector(var=var, collection=name):
                more = {"limit": 100}
                if q.limit and isinstance(q.limit.count, A.Literal):
                    more["limit"] = q.limit.count.value + (q.limit.offset.value if isinstance(q.limit.offset, A.Literal) else 0)
                least = [p for p in pushed(var, filters)[0] if p.startswith("._score >= ")]
                if least:
                    more["threshold"] = least[0].removeprefix("._score >= ")
                out.append(("vector_search", name, var, depth, json.dumps(more)))
            case A.ForTraversal(vertex=var, edges=name):
                correlated = any(isinstance(n, A.Name) for n in A.walk(c.start))
                out.append(("traversal", name, var, depth, json.dumps({"low": c.low, "high": c.high, "direction": c.direction, "correlated": correlated})))
        bound |= {n for n in (getattr(c, "var", None), getattr(c, "vertex", None), getattr(c, "edge", None), getattr(c, "path", None)) if n}
    for e in expressions(q):
        for n in deep(e):
            if isinstance(n, A.Subquery):
                out += [s for s in sources(n.query, depth + 1) if s[3] == depth + 1]
    return out


def pipeline(q: A.Query) -> list[str]:
    out = []
    for c in q.body:
        match c:
            case A.For(var=v) | A.ForVector(var=v) | A.ForTraversal(vertex=v):
                out.append(f"FOR {v}")
            case A.Let(var=v, value=e):
                kind = ""
                if isinstance(e, A.Subquery):
                    kind = " (correlated subquery)" if free_names(e.query) & {n for x in q.body for n in [getattr(x, "var", None), getattr(x, "vertex", None)]} else " (subquery, once)"
                out.append(f"LET {v}{kind}")
            case A.Filter():
                out.append("FILTER")
    if q.mutation:
        out.append(f"{q.mutation.kind} {'INTO' if q.mutation.kind == 'INSERT' else 'IN'} {q.mutation.collection}")
    if q.collect:
        out.append("COLLECT")
    if q.sort:
        out.append("SORT")
    if q.limit:
        parts = [x for x in (q.limit.offset, q.limit.count) if x is not None]
        out.append("LIMIT " + ", ".join(rendered(x) for x in parts))
    if q.result is not None:
        out.append("RETURN DISTINCT" if q.distinct else "RETURN")
    return out


def described(spark: SparkSession, q: A.Query) -> DataFrame:
    return spark.createDataFrame([(sources(q), pipeline(q), sorted(binds_of(q)))], SCHEMA)


def analyzed(engine, q: A.Query, binds: dict) -> DataFrame:
    """Runs the read: the description with rows, seconds and Spark's plan."""
    df = Lowering(engine.catalog, binds, engine.strict).run(q)
    began = time.monotonic()
    rows = df.count()
    plan = df._jdf.queryExecution().executedPlan().toString()
    row = (sources(q), pipeline(q), sorted(binds_of(q)), rows, time.monotonic() - began, plan)
    return engine.spark.createDataFrame([row], SCHEMA + ", rows long, seconds double, plan string")
