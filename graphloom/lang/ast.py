"""Syntax tree. Expressions and clauses are frozen, so they can be keys."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class Literal(Node):
    value: Any


@dataclass(frozen=True)
class Bind(Node):
    name: str


@dataclass(frozen=True)
class Name(Node):
    name: str


@dataclass(frozen=True)
class Field(Node):
    base: Node
    name: str


@dataclass(frozen=True)
class Array(Node):
    items: tuple


@dataclass(frozen=True)
class Object(Node):
    fields: tuple  # (name, expression)


@dataclass(frozen=True)
class Call(Node):
    name: str  # upper case
    args: tuple


@dataclass(frozen=True)
class Unary(Node):
    op: str  # NOT, -
    arg: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str  # OR AND == != < <= > >= IN + - * /
    left: Node
    right: Node


@dataclass(frozen=True)
class Ternary(Node):
    test: Node
    then: Node
    other: Node


@dataclass(frozen=True)
class Subquery(Node):
    query: Query


@dataclass(frozen=True)
class For(Node):
    var: str
    source: Node


@dataclass(frozen=True)
class ForVector(Node):
    var: str
    collection: str
    vector: Node


@dataclass(frozen=True)
class ForTraversal(Node):
    vertex: str
    edge: str | None
    path: str | None
    low: int
    high: int
    direction: str
    start: Node
    edges: str


@dataclass(frozen=True)
class Let(Node):
    var: str
    value: Node


@dataclass(frozen=True)
class Filter(Node):
    test: Node


@dataclass(frozen=True)
class Collect(Node):
    keys: tuple  # (name, expression)
    aggregates: tuple  # (name, function, expression)
    into: str | None
    into_value: Node | None
    count: str | None


@dataclass(frozen=True)
class Sort(Node):
    keys: tuple  # (expression, descending)
    locale: str | None


@dataclass(frozen=True)
class Limit(Node):
    offset: Node | None
    count: Node


@dataclass(frozen=True)
class Mutation(Node):
    kind: str  # INSERT UPDATE REPLACE REMOVE UPSERT
    collection: str
    key: Node | None = None  # UPDATE, REPLACE, REMOVE: key; UPSERT: search
    value: Node | None = None  # INSERT, UPDATE, REPLACE: document; UPSERT: insert
    update: Node | None = None  # UPSERT


@dataclass(frozen=True)
class Query(Node):
    body: tuple  # For*, Let, Filter
    collect: Collect | None = None
    sort: Sort | None = None
    limit: Limit | None = None
    result: Node | None = None
    distinct: bool = False
    mutation: Mutation | None = None
    explain: str | None = None  # None, plan, analyze


def children(node: Node) -> list[Node]:
    """Direct parts of an expression, subqueries not entered."""
    match node:
        case Field(base=b):
            return [b]
        case Array(items=i):
            return list(i)
        case Object(fields=f):
            return [v for _, v in f]
        case Call(args=a):
            return list(a)
        case Unary(arg=a):
            return [a]
        case Binary(left=a, right=b):
            return [a, b]
        case Ternary(test=a, then=b, other=c):
            return [a, b, c]
    return []


def walk(node: Node):
    yield node
    for part in children(node):
        yield from walk(part)


def path_of(node: Node) -> tuple[str, tuple[str, ...]] | None:
    """``(name, fields)`` of ``name.a.b``."""
    fields: list[str] = []
    while isinstance(node, Field):
        fields.insert(0, node.name)
        node = node.base
    return (node.name, tuple(fields)) if isinstance(node, Name) else None
