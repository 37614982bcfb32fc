"""Recursive-descent parser."""

from __future__ import annotations

import json
import re

from ..errors import ParseError
from . import ast as A

MAX_TEXT = 256 * 1024
MAX_NESTING = 32  # brackets; the innermost value is one more
TOKEN = re.compile(r'(?P<space>[ \t\r\n]+|//[^\r\n]*)|(?P<number>\d+(?:\.\d+)?(?![.\w]|\.\d)|\d+(?=\.\.\d))|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<string>"(?:[^"\\]|\\["\\/bfnrt]|\\u[0-9A-Fa-f]{4})*")|(?P<op>\.\.|==|!=|<=|>=|[-+*/<>=?:.,(){}\[\]@])')
#: Words that can't name anything. Fixed values.
KEYWORDS = frozenset("ANALYZE AND AGGREGATE ANY ASC COLLATE COLLECT COUNT DESC INSERT INTO REMOVE REPLACE UPDATE UPSERT WITH EXPLAIN FALSE FILTER FOR IN INBOUND LET DISTINCT LIMIT NOT NULL OR OUTBOUND RETURN SORT TRUE VECTOR_SEARCH".split())


class Tokens:
    def __init__(self, text: str):
        if len(text.encode()) > MAX_TEXT:
            raise ParseError(f"a query has at most {MAX_TEXT} bytes")
        self.items: list[tuple[str, str, int]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ParseError(f"unexpected {text[at : at + 12]!r} at {at}")
            if m.lastgroup != "space":
                self.items.append((m.lastgroup, m.group(), at))
            at = m.end()
        self.items.append(("end", "", len(text)))
        self.at = 0
        self.depth = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        kind, value, _ = self.items[min(self.at + ahead, len(self.items) - 1)]
        return kind, value

    def next(self) -> tuple[str, str]:
        found = self.peek()
        self.at += 1
        return found

    def fail(self, wanted: str) -> ParseError:
        kind, value, at = self.items[min(self.at, len(self.items) - 1)]
        return ParseError(f"expected {wanted}, found {value or kind!r} at {at}")

    def word(self, *words: str) -> str | None:
        kind, value = self.peek()
        if kind == "name" and value.upper() in words:
            self.at += 1
            return value.upper()
        return None

    def need_word(self, word: str) -> None:
        if not self.word(word):
            raise self.fail(word)

    def op(self, *ops: str) -> str | None:
        kind, value = self.peek()
        if kind == "op" and value in ops:
            self.at += 1
            return value
        return None

    def need_op(self, op: str) -> None:
        if not self.op(op):
            raise self.fail(repr(op))

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "name":
            raise self.fail("a name")
        self.at += 1
        return value

    def uint(self) -> int:
        kind, value = self.peek()
        if kind != "number" or "." in value:
            raise self.fail("a whole number")
        self.at += 1
        return int(value)


def parse(text: str) -> A.Query:
    t = Tokens(text)
    explain = None
    if t.word("EXPLAIN"):
        explain = "analyze" if t.word("ANALYZE") else "plan"
    query = read_query(t, top=True)
    if t.peek()[0] != "end":
        raise t.fail("the end")
    return A.Query(**{**query.__dict__, "explain": explain})


def read_query(t: Tokens, top: bool = False) -> A.Query:
    body: list[A.Node] = []
    while True:
        if t.word("FOR"):
            body.append(for_clause(t))
        elif t.word("LET"):
            var = t.name()
            t.need_op("=")
            body.append(A.Let(var, expression(t)))
        elif t.word("FILTER"):
            body.append(A.Filter(expression(t)))
        else:
            break
    if top and (kind := t.word("INSERT", "UPDATE", "REPLACE", "REMOVE", "UPSERT")):
        if sum(isinstance(c, A.For | A.ForVector | A.ForTraversal) for c in body) > 1 or (body and not isinstance(body[0], A.For | A.ForVector | A.ForTraversal)):
            raise ParseError("a mutation has one FOR at most, and it comes first")
        mutation = mutation_clause(t, kind)
        result = expression(t) if t.word("RETURN") else None
        return A.Query(tuple(body), mutation=mutation, result=result)
    collect = collect_clause(t) if t.word("COLLECT") else None
    sort = sort_clause(t) if t.word("SORT") else None
    limit = limit_clause(t) if t.word("LIMIT") else None
    t.need_word("RETURN")
    distinct = bool(t.word("DISTINCT"))
    result = expression(t)
    if collect:
        late = [k for k, _ in sort.keys] if sort else []
        if any(isinstance(n, A.Subquery) for e in [*late, result] for n in A.walk(e)):
            raise ParseError("no subquery may follow COLLECT")
    return A.Query(tuple(body), collect, sort, limit, result, distinct)


def for_clause(t: Tokens) -> A.Node:
    names = [t.name()]
    while len(names) < 3 and t.op(","):
        names.append(t.name())
    t.need_word("IN")
    if t.peek()[0] == "number" and t.peek(1) == ("op", ".."):
        low = t.uint()
        t.need_op("..")
        high = t.uint()
        if low > high:
            raise ParseError("the depth range is reversed")
        direction = t.word("OUTBOUND", "INBOUND", "ANY")
        if not direction:
            raise t.fail("a direction")
        start = expression(t)
        return A.ForTraversal(names[0], names[1] if len(names) > 1 else None, names[2] if len(names) > 2 else None, low, high, direction, start, t.name())
    if len(names) > 1:
        raise t.fail("a depth range")
    if t.peek()[1].upper() == "VECTOR_SEARCH" and t.peek(1) == ("op", "("):
        t.next()
        t.need_op("(")
        collection = t.name()
        t.need_op(",")
        vector = expression(t)
        t.need_op(")")
        return A.ForVector(names[0], collection, vector)
    return A.For(names[0], expression(t))


def mutation_clause(t: Tokens, kind: str) -> A.Mutation:
    first = additive(t)
    if kind == "INSERT":
        t.need_word("INTO")
        return A.Mutation(kind, t.name(), value=first)
    if kind == "UPSERT":
        t.need_word("INSERT")
        insert = additive(t)
        t.need_word("UPDATE")
        update = additive(t)
        t.need_word("IN")
        return A.Mutation(kind, t.name(), key=first, value=insert, update=update)
    value = None
    if kind != "REMOVE":
        t.need_word("WITH")
        value = additive(t)
    t.need_word("IN")
    return A.Mutation(kind, t.name(), key=first, value=value)


def collect_clause(t: Tokens) -> A.Collect:
    keys, aggregates = [], []
    into = into_value = count = None
    if t.peek(1) == ("op", "="):
        while True:
            name = t.name()
            t.need_op("=")
            keys.append((name, expression(t)))
            if not t.op(","):
                break
    if t.word("AGGREGATE"):
        while True:
            name = t.name()
            t.need_op("=")
            function = t.name()
            t.need_op("(")
            aggregates.append((name, function.upper(), expression(t)))
            t.need_op(")")
            if not t.op(","):
                break
    if t.word("INTO"):
        into = t.name()
        if into.upper() in KEYWORDS:
            raise t.fail("a name after INTO")
        if t.op("="):
            into_value = expression(t)
    if t.word("WITH"):
        t.need_word("COUNT")
        t.need_word("INTO")
        count = t.name()
    return A.Collect(tuple(keys), tuple(aggregates), into, into_value, count)


def sort_clause(t: Tokens) -> A.Sort:
    keys = []
    while True:
        key = expression(t)
        keys.append((key, t.word("ASC", "DESC") == "DESC"))
        if not t.op(","):
            break
    locale = None
    if t.word("COLLATE"):
        kind, value = t.next()
        if kind != "string":
            raise t.fail("a locale")
        locale = json.loads(value)
    return A.Sort(tuple(keys), locale)


def limit_clause(t: Tokens) -> A.Limit:
    def value() -> A.Node:
        if t.op("@"):
            return A.Bind(t.name())
        return A.Literal(t.uint())

    first = value()
    return A.Limit(first, value()) if t.op(",") else A.Limit(None, first)


def expression(t: Tokens) -> A.Node:
    test = disjunction(t)
    if t.op("?"):
        then = expression(t)
        t.need_op(":")
        return A.Ternary(test, then, expression(t))
    return test


def disjunction(t: Tokens) -> A.Node:
    left = conjunction(t)
    while t.word("OR"):
        left = A.Binary("OR", left, conjunction(t))
    return left


def conjunction(t: Tokens) -> A.Node:
    left = comparison(t)
    while t.word("AND"):
        left = A.Binary("AND", left, comparison(t))
    return left


def comparison(t: Tokens) -> A.Node:
    left = additive(t)
    op = t.op("==", "!=", "<=", ">=", "<", ">") or t.word("IN")
    return A.Binary(op, left, additive(t)) if op else left


def additive(t: Tokens) -> A.Node:
    left = multiplicative(t)
    while op := t.op("+", "-"):
        left = A.Binary(op, left, multiplicative(t))
    return left


def multiplicative(t: Tokens) -> A.Node:
    left = unary(t)
    while op := t.op("*", "/"):
        left = A.Binary(op, left, unary(t))
    return left


def unary(t: Tokens) -> A.Node:
    if t.word("NOT"):
        return A.Unary("NOT", unary(t))
    if t.op("-"):
        arg = unary(t)
        if isinstance(arg, A.Literal) and isinstance(arg.value, float):
            return A.Literal(-arg.value)
        return A.Unary("-", arg)
    node = primary(t)
    while t.op("."):
        node = A.Field(node, t.name())
    return node


def listed(t: Tokens, close: str, item) -> list:
    out: list = []
    if t.op(close):
        return out
    while True:
        out.append(item())
        if t.op(close):
            return out
        t.need_op(",")


def primary(t: Tokens) -> A.Node:
    t.depth += 1
    if t.depth > MAX_NESTING + 1:
        raise ParseError(f"nested more than {MAX_NESTING} deep")
    try:
        kind, value = t.peek()
        if kind == "number":
            t.next()
            return A.Literal(float(value))
        if kind == "string":
            t.next()
            return A.Literal(json.loads(value))
        if t.op("@"):
            return A.Bind(t.name())
        if t.op("["):
            return A.Array(tuple(listed(t, "]", lambda: expression(t))))
        if t.op("{"):
            return A.Object(tuple(listed(t, "}", lambda: object_field(t))))
        if t.op("("):
            if t.peek()[0] == "name" and t.peek()[1].upper() in ("FOR", "LET", "FILTER", "COLLECT", "SORT", "LIMIT", "RETURN"):
                query = read_query(t)
                t.need_op(")")
                return A.Subquery(query)
            inner = expression(t)
            t.need_op(")")
            return inner
        if kind == "name":
            if t.peek(1) == ("op", "("):
                t.next()
                t.next()
                return A.Call(value.upper(), tuple(listed(t, ")", lambda: expression(t))))
            if t.word("TRUE"):
                return A.Literal(True)
            if t.word("FALSE"):
                return A.Literal(False)
            if t.word("NULL"):
                return A.Literal(None)
            if value.upper() == "RETURN" and t.peek(1)[0] in ("name", "op", "string", "number") and t.peek(1)[1] not in (".", ",", ")", "]", "}"):
                raise t.fail("an expression")
            return A.Name(t.name())
        raise t.fail("an expression")
    finally:
        t.depth -= 1


def object_field(t: Tokens) -> tuple[str, A.Node]:
    name = t.name()
    return (name, expression(t)) if t.op(":") else (name, A.Name(name))
