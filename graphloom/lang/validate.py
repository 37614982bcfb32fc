"""Names, arities, limits and placement of clauses, before anything is read."""

from __future__ import annotations

import re

from ..errors import ValidationError
from . import ast as A
from .parser import KEYWORDS

MAX_LIMIT = 10_000
MAX_DEPTH = 10
MAX_SUBQUERIES = 4
AGGREGATES = ("SUM", "MIN", "MAX", "AVG")
#: Least and greatest number of arguments (None: any). Fixed values.
ARITY: dict[str, tuple[int, int | None]] = {
    **dict.fromkeys("NORMALIZE_NFC LENGTH UPPER LOWER TRIM ABS FLOOR CEIL ROUND MIN MAX SUM AVG FIRST LAST DOCUMENT TO_NUMBER TO_STRING TO_BOOL UNIQUE SORTED SORTED_UNIQUE TYPENAME PARSE_IDENTIFIER DATE_YEAR DATE_MONTH DATE_DAY DATE_HOUR DATE_MINUTE DATE_SECOND DATE_TIMESTAMP".split(), (1, 1)),
    **dict.fromkeys("CONTAINS STARTS_WITH SPLIT HAS IS_SAME_COLLECTION COSINE_SIMILARITY".split(), (2, 2)),
    **dict.fromkeys("DATE_ADD DATE_DIFF".split(), (3, 3)),
    **dict.fromkeys("COALESCE NOT_NULL CONCAT".split(), (1, None)),
    **dict.fromkeys("INTERSECTION MINUS".split(), (2, None)),
    **dict.fromkeys("SUBSTRING SLICE REGEX_TEST".split(), (2, 3)),
    "FLATTEN": (1, 2),
    "REGEX_REPLACE": (3, 4),
    "NOW": (0, 0),
}


def validate(query: A.Query, binds: set[str] = frozenset()) -> None:
    if query.explain == "analyze" and query.mutation:
        raise ValidationError("a mutation can't be analyzed")
    Validator().query(query, (), 0, top=True)


class Validator:
    def fresh(self, name: str, scope: tuple[str, ...]) -> str:
        if name.upper() in KEYWORDS:
            raise ValidationError(f"{name} is a reserved word")
        if name in scope:
            raise ValidationError(f"{name} is bound already")
        return name

    def collection(self, name: str) -> None:
        if name.upper() in KEYWORDS:
            raise ValidationError(f"{name} is a reserved word")

    def query(self, q: A.Query, outer: tuple[str, ...], depth: int, top: bool = False) -> None:
        if depth > MAX_SUBQUERIES:
            raise ValidationError(f"subqueries nest {MAX_SUBQUERIES} deep at most")
        scope = outer
        seen_for = False
        for clause in q.body:
            match clause:
                case A.For(var=var, source=source):
                    if not isinstance(source, A.Name):
                        self.expr(source, scope, depth)
                    elif source.name not in scope:
                        self.collection(source.name)
                    scope += (self.fresh(var, scope),)
                    seen_for = True
                case A.ForVector(var=var, collection=collection, vector=vector):
                    if seen_for or not top:
                        raise ValidationError("VECTOR_SEARCH is only for the first FOR of the outermost query")
                    self.collection(collection)
                    fine = isinstance(vector, A.Bind) or (isinstance(vector, A.Array) and all(isinstance(i, A.Literal) and isinstance(i.value, float) for i in vector.items))
                    if not fine:
                        raise ValidationError("VECTOR_SEARCH takes a bind or an array of numbers")
                    scope += (self.fresh(var, scope),)
                    seen_for = True
                case A.ForTraversal():
                    if clause.high > MAX_DEPTH:
                        raise ValidationError(f"traversals go {MAX_DEPTH} deep at most")
                    if isinstance(clause.start, A.Array | A.Object) or (isinstance(clause.start, A.Literal) and not isinstance(clause.start.value, str)):
                        raise ValidationError("a traversal starts at a document id")
                    self.expr(clause.start, scope, depth)
                    self.collection(clause.edges)
                    for name in (clause.vertex, clause.edge, clause.path):
                        if name:
                            scope += (self.fresh(name, scope),)
                    seen_for = True
                case A.Let(var=var, value=value):
                    self.expr(value, scope, depth)
                    scope += (self.fresh(var, scope),)
                case A.Filter(test=test):
                    self.expr(test, scope, depth)
        if q.mutation:
            self.mutation(q, scope)
            return
        if c := q.collect:
            names: tuple[str, ...] = ()
            for name, value in c.keys:
                self.expr(value, scope, depth)
                names += (self.fresh(name, names),)
            for name, function, value in c.aggregates:
                if function not in AGGREGATES:
                    raise ValidationError(f"{function} is no aggregate; there are {', '.join(AGGREGATES)}")
                self.expr(value, scope, depth)
                names += (self.fresh(name, names),)
            if c.into:
                if c.into_value is not None:
                    if any(isinstance(n, A.Subquery) for n in A.walk(c.into_value)):
                        raise ValidationError("INTO takes no subquery")
                    self.expr(c.into_value, scope, depth)
                names += (self.fresh(c.into, names),)
            if c.count:
                names += (self.fresh(c.count, names),)
            scope = outer + names
        if q.sort:
            for key, _ in q.sort.keys:
                self.expr(key, scope, depth)
            if q.sort.locale is not None and not re.fullmatch(r"[A-Za-z]{2,3}(-[A-Za-z0-9]{2,8})*", q.sort.locale):
                raise ValidationError(f"{q.sort.locale!r} is no locale")
        if q.limit:
            for part, least in ((q.limit.offset, 0), (q.limit.count, 1)):
                if isinstance(part, A.Literal):
                    limit_value(part.value, least, part is q.limit.count)
        self.expr(q.result, scope, depth)

    def mutation(self, q: A.Query, scope: tuple[str, ...]) -> None:
        m = q.mutation
        self.collection(m.collection)
        for part in (m.key, m.value, m.update):
            if part is not None:
                self.expr(part, scope, 0)
                if any(isinstance(n, A.Subquery) for n in A.walk(part)):
                    raise ValidationError("a mutation's operand takes no subquery")
        looks_up = any(isinstance(n, A.Call) and n.name == "DOCUMENT" for e in expressions(q) for n in deep(e))
        crosses = any(isinstance(c, A.ForTraversal) and any(isinstance(n, A.Name) for n in A.walk(c.start)) for c in q.body)
        if looks_up or crosses:
            raise ValidationError("a mutation takes no DOCUMENT() and no correlated traversal")
        if q.result is not None:
            self.expr(q.result, (*scope, "OLD", "NEW"), 0)

    def expr(self, node: A.Node, scope: tuple[str, ...], depth: int) -> None:
        match node:
            case A.Name(name=name):
                if name not in scope:
                    raise ValidationError(f"{name} is unknown")
            case A.Call(name=name, args=args):
                if name not in ARITY:
                    raise ValidationError(f"there is no function {name}")
                low, high = ARITY[name]
                if len(args) < low or (high is not None and len(args) > high):
                    raise ValidationError(f"{name} takes {low}{'' if high == low else ' or more' if high is None else f' to {high}'} arguments")
            case A.Object(fields=fields):
                names = [n for n, _ in fields]
                if len(set(names)) < len(names):
                    raise ValidationError("an object has a field twice")
            case A.Subquery(query=query):
                self.query(query, scope, depth + 1)
        for part in A.children(node):
            self.expr(part, scope, depth)


def limit_value(value, least: int, is_count: bool) -> int:
    if isinstance(value, bool) or not isinstance(value, int | float) or value != int(value) or value < 0:
        raise ValidationError("LIMIT takes whole numbers from 0")
    if value < least or (is_count and value > MAX_LIMIT):
        raise ValidationError(f"LIMIT counts from 1 to {MAX_LIMIT}")
    return int(value)


def expressions(q: A.Query) -> list[A.Node]:
    out: list[A.Node] = []
    for c in q.body:
        match c:
            case A.For(source=s):
                out.append(s)
            case A.ForVector(vector=v):
                out.append(v)
            case A.ForTraversal(start=s):
                out.append(s)
            case A.Let(value=v):
                out.append(v)
            case A.Filter(test=t):
                out.append(t)
    if q.mutation:
        out += [x for x in (q.mutation.key, q.mutation.value, q.mutation.update) if x is not None]
    if q.collect:
        out += [v for _, v in q.collect.keys] + [v for *_, v in q.collect.aggregates]
        if q.collect.into_value is not None:
            out.append(q.collect.into_value)
    if q.sort:
        out += [k for k, _ in q.sort.keys]
    if q.limit:
        out += [x for x in (q.limit.offset, q.limit.count) if x is not None]
    if q.result is not None:
        out.append(q.result)
    return out


def deep(node: A.Node):
    """All nodes below, subqueries entered."""
    for n in A.walk(node):
        yield n
        if isinstance(n, A.Subquery):
            for e in expressions(n.query):
                yield from deep(e)


def binds_of(q: A.Query) -> list[str]:
    return list(dict.fromkeys(n.name for e in expressions(q) for n in deep(e) if isinstance(n, A.Bind)))


def free_names(q: A.Query, bound: frozenset[str] = frozenset()) -> set[str]:
    """Names that a subquery takes from outside."""
    free: set[str] = set()

    def of(e: A.Node, known: frozenset[str]) -> None:
        for n in A.walk(e):
            if isinstance(n, A.Name) and n.name not in known:
                free.add(n.name)
            elif isinstance(n, A.Subquery):
                free.update(free_names(n.query, known))

    known = bound
    for c in q.body:
        match c:
            case A.For(var=v, source=s):
                of(s, known)
                known |= {v}
            case A.ForVector(var=v):
                known |= {v}
            case A.ForTraversal():
                of(c.start, known)
                known |= {n for n in (c.vertex, c.edge, c.path) if n}
            case A.Let(var=v, value=e):
                of(e, known)
                known |= {v}
            case A.Filter(test=e):
                of(e, known)
    if c := q.collect:
        for _, e in c.keys:
            of(e, known)
        for *_, e in c.aggregates:
            of(e, known)
        if c.into_value is not None:
            of(c.into_value, known)
        known = bound | {n for n, _ in c.keys} | {n for n, *_ in c.aggregates} | {n for n in (c.into, c.count) if n}
    if q.sort:
        for e, _ in q.sort.keys:
            of(e, known)
    if q.result is not None:
        of(q.result, known)
    return free
