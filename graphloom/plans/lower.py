"""Building a DataFrame from a query.

A :class:`State` is a DataFrame with the variables in scope. A document of a
collection stays spread over top-level columns, so that column pruning and
filter pushdown see plain columns; it becomes a struct only where it is used
whole. Order is a list of columns that is sorted by only where order shows.

A correlated subquery becomes a join: the distinct values that it takes from
outside drive its body, everything in it is grouped by them, and its results
are joined back by them (null-safe).
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Catalog
from ..errors import BindError, TypeMismatch, ValidationError
from ..functions import scalar
from ..functions.values import BOOL, DOUBLE, KEYS, LONG, STRING, Val, array, cast, common, equal, less, lit, number, plain, struct, truth
from ..functions.values import field as field_of
from ..lang import ast as A
from ..lang.validate import binds_of, deep, expressions, free_names, limit_value
from ..operators import search, traverse

counter = itertools.count()


def fresh(hint: str = "c") -> str:
    return f"_{hint}{next(counter)}"


class Order(NamedTuple):
    col: Column
    down: bool = False

    @property
    def key(self) -> Column:
        return self.col.desc() if self.down else self.col.asc()


@dataclass
class State:
    df: DataFrame
    scope: dict[str, Val] = field(default_factory=dict)
    order: list[Order] = field(default_factory=list)
    groups: list[str] = field(default_factory=list)
    #: what a subquery takes from outside: (name, fields) -> value
    paths: dict[tuple[str, tuple[str, ...]], Val] = field(default_factory=dict)


def only_source(clauses: list, i: int, q: A.Query) -> A.Let | None:
    """The clause, if it is a LET with a subquery that takes nothing from outside and
    whose variable only one FOR of the same query uses, as its source."""
    let = clauses[i]
    if not isinstance(let, A.Let) or not isinstance(let.value, A.Subquery) or let.value.query.distinct:
        return None
    names = {c.var for c in clauses[:i] if isinstance(c, A.For | A.Let)} | {n for c in clauses[:i] if isinstance(c, A.ForVector | A.ForTraversal) for n in (getattr(c, "var", None), getattr(c, "vertex", None), getattr(c, "edge", None), getattr(c, "path", None)) if n}
    if names or free_names(let.value.query) & {let.var}:
        return None
    if q.collect and q.collect.into and q.collect.into_value is None:  # INTO takes every variable
        return None
    uses = sum(isinstance(n, A.Name) and n.name == let.var for e in expressions(q) for n in deep(e))
    sources = [c for c in clauses[i + 1 :] if isinstance(c, A.For) and c.source == A.Name(let.var)]
    return let if uses == len(sources) == 1 else None


class Lowering:
    def __init__(self, catalog: Catalog, binds: dict, strict: bool = False, ordered: bool = False):
        self.catalog, self.binds, self.strict, self.ordered = catalog, binds, strict, ordered
        self.inlined: dict[tuple[str, int], A.Query] = {}

    # -- whole queries -----------------------------------------------------

    def run(self, q: A.Query) -> DataFrame:
        """The rows of a read query: a column for each field of a RETURN object,
        else one column ``value``."""
        wanted = binds_of(q)
        if missing := [b for b in wanted if b not in self.binds]:
            raise BindError(f"no value for @{missing[0]}")
        if extra := [b for b in self.binds if b not in wanted]:
            raise BindError(f"@{extra[0]} isn't in the query")
        self.root = q
        state = self.body(State(self.catalog.spark.range(1).select()), q, top=True)
        return self.result(state, q)

    def result(self, state: State, q: A.Query) -> DataFrame:
        if isinstance(q.result, A.Object) and q.result.fields:
            values = [(n, plain_if_null(self.expr(state, e))) for n, e in q.result.fields]
        else:
            values = [("value", plain_if_null(self.expr(state, q.result)))]
        names = [fresh("r") for _ in values]
        df = state.df.select(*[v.col.alias(n) for n, (_, v) in zip(names, values, strict=True)], *[o.col.alias(f"_o{i}") for i, o in enumerate(state.order)])
        order = [Order(F.col(f"_o{i}"), o.down) for i, o in enumerate(state.order)]
        show = [F.col(n).alias(label) for n, (label, _) in zip(names, values, strict=True)]
        sorted_ = bool(q.sort) or self.ordered
        if q.distinct:
            keys = names if all(groupable(v.type) for _, v in values) else None
            if keys is None:
                df = df.withColumn("_j", F.to_json(F.struct(*names)))
                keys = ["_j"]
            if sorted_ and any(o.down for o in order):  # the first row of each value, then a distributed sort
                first = F.row_number().over(Window.partitionBy(*keys).orderBy(*[o.key for o in order]))
                df = df.withColumn("_n", first).filter("_n = 1").orderBy(*[o.key for o in order])
            elif sorted_ and order:
                place = F.struct(*[o.col for o in order])
                first = [F.min_by(n, place).alias(n) for n in names if n not in keys]
                df = df.groupBy(*keys).agg(F.min(place).alias("_o"), *first).orderBy("_o")
            else:
                df = df.dropDuplicates(keys)
        elif sorted_ and order:
            df = df.orderBy(*[o.key for o in order])
        return df.select(*show)

    def body(self, state: State, q: A.Query, top: bool = False) -> State:
        """All clauses but RETURN."""
        now, later = deferred(q)
        for i, clause in enumerate(now):
            if source := only_source(now, i, q):
                self.inlined[source.var, id(q)] = source.value.query
                continue
            match clause:
                case A.For(var=var, source=A.Name(name=name)) if (name, id(q)) in self.inlined:
                    state = self.for_rows(state, var, self.inlined.pop((name, id(q))))
                case A.For(var=var, source=source):
                    state = self.for_in(state, var, source)
                case A.ForVector():
                    state = self.for_vector(state, clause, q)
                case A.ForTraversal():
                    state = self.for_traversal(state, clause, q, now[i + 1 :])
                case A.Let(var=var, value=value):
                    state = self.bind(state, var, self.expr(state, value, used_fields(q, var)))
                case A.Filter(test=test):
                    state = self.filter(state, test)
        if q.collect:
            state = self.collect(state, q.collect)
        if q.sort:
            state = self.sort(state, q.sort)
        if q.limit:
            state = self.limit(state, q.limit)
        for clause in later:
            state = self.bind(state, clause.var, self.expr(state, clause.value, used_fields(q, clause.var)))
        return state

    def bind(self, state: State, name: str, value: Val) -> State:
        """``value`` was made on ``state``, whose frame may have grown meanwhile."""
        column = fresh(name)
        if value.fields is not None or value.literal is not None:
            return replace(state, scope={**state.scope, name: value})
        df = state.df.withColumn(column, value.col if value.kind != "null" else F.lit(None).cast("void"))
        return replace(state, df=df, scope={**state.scope, name: Val(F.col(column), value.type)})

    # -- sources -----------------------------------------------------------

    def spread(self, state: State, var: str, df: DataFrame, order: list[str]) -> State:
        """Join a frame of documents, a column for each field."""
        prefix = fresh(var)
        fields = {c: f"{prefix}_{i}" for i, c in enumerate(df.columns)}
        inner = df.select(*[F.col(f"`{c}`").alias(n) for c, n in fields.items()])
        made = F.struct(*[F.col(n).alias(c) for c, n in fields.items()])
        value = Val(made, df.schema, None, fields)
        frame = inner if not state.df.columns and not state.scope else state.df.crossJoin(inner)
        return replace(state, df=frame, scope={**state.scope, var: value}, order=[*state.order, *[Order(F.col(fields[o])) for o in order]])

    def for_in(self, state: State, var: str, source: A.Node) -> State:
        if isinstance(source, A.Name) and source.name not in state.scope and (source.name, ()) not in state.paths:
            return self.spread(state, var, self.catalog[source.name].df, ["_key"])
        value = self.expr(state, source)
        if value.kind == "null":
            value = Val(F.array().cast("array<double>"), T.ArrayType(DOUBLE))
        if value.kind == "any":
            value = Val(F.try_variant_get(value.col, F.lit("$"), "array<variant>"), T.ArrayType(T.VariantType()))
        if value.kind != "array":
            raise TypeMismatch(f"FOR takes an array, not {value.kind}")
        item, place = fresh(var), fresh("p")
        element = value.type.elementType
        df = state.df.select("*", F.posexplode(value.col if not isinstance(element, T.NullType) else value.col.cast("array<double>")).alias(place, item))
        return replace(state, df=df, scope={**state.scope, var: Val(F.col(item), DOUBLE if isinstance(element, T.NullType) else element)}, order=[*state.order, Order(F.col(place))])

    def for_rows(self, state: State, var: str, q: A.Query) -> State:
        """FOR over the rows of a subquery that nothing else uses: its frame itself, not
        an array of all rows in one."""
        inner = self.body(State(self.catalog.spark.range(1).select()), q)
        v = plain_if_null(self.expr(inner, q.result))
        item, places = fresh(var), [fresh("p") for _ in inner.order]
        rows = inner.df.select(v.col.alias(item), *[o.col.alias(p) for o, p in zip(inner.order, places, strict=True)])
        frame = rows if not state.df.columns and not state.scope else state.df.crossJoin(rows)
        order = [Order(F.col(p), o.down) for p, o in zip(places, inner.order, strict=True)]
        return replace(state, df=frame, scope={**state.scope, var: Val(F.col(item), v.type)}, order=[*state.order, *order])

    def for_vector(self, state: State, c: A.ForVector, q: A.Query) -> State:
        vector = self.binds[c.vector.name] if isinstance(c.vector, A.Bind) else [i.value for i in c.vector.items]
        if not isinstance(vector, list | tuple) or not all(isinstance(x, int | float) and not isinstance(x, bool) for x in vector):
            raise TypeMismatch("a vector of numbers is needed")
        most = 100
        if q.limit:
            most = (self.limit_of(q.limit.offset, 0) if q.limit.offset else 0) + self.limit_of(q.limit.count, 1)
        threshold = None
        for clause in q.body[1:]:
            if not isinstance(clause, A.Filter):
                break
            for part in conjuncts(clause.test):
                if isinstance(part, A.Binary) and part.op == ">=" and A.path_of(part.left) == (c.var, ("_score",)) and isinstance(part.right, A.Literal | A.Bind):
                    value = self.binds[part.right.name] if isinstance(part.right, A.Bind) else part.right.value
                    threshold = value if threshold is None else max(threshold, value)
        hits = search.vector_search(self.catalog[c.collection].df, list(map(float, vector)), most, threshold)
        made = self.spread(state, c.var, hits, ["_key"])
        fields = made.scope[c.var].fields
        return replace(made, order=[*state.order, Order(F.col(fields["_score"]), True), Order(F.col(fields["_key"]))])

    def for_traversal(self, state: State, c: A.ForTraversal, q: A.Query, rest: list) -> State:
        start = self.expr(state, c.start)
        path = used_fields(q, c.path) if c.path else set()
        edge = used_fields(q, c.edge) if c.edge else set()
        vertex = used_fields(q, c.vertex)
        least = None
        if c.low == c.high == 1 and c.edge:  # a bound on the only edge's confidence
            for clause in rest:
                if not isinstance(clause, A.Filter):
                    break
                for part in conjuncts(clause.test):
                    if isinstance(part, A.Binary) and part.op == ">=" and A.path_of(part.left) == (c.edge, ("confidence",)) and isinstance(part.right, A.Literal) and isinstance(part.right.value, float):
                        least = part.right.value
        edges = self.catalog[c.edges]
        paths = {"vertices", "edges", "depth", "score"} if path is None else path
        options = {"low": c.low, "high": c.high, "direction": c.direction, "min_confidence": least, "edge_fields": edge, "keep_edges": "edges" in paths, "keep_vertices": "vertices" in paths}
        if start.kind != "string":
            start = Val(F.lit(None).cast("string"), STRING)
        key = fresh("start")
        if isinstance(start.literal, str):
            found = traverse.traverse(edges.df, start.literal, **options)
            frame = found if not state.df.columns and not state.scope else state.df.crossJoin(found)
        else:
            outer = state.df.withColumn(key, start.col)
            starts = outer.select(F.col(key).alias("start")).filter("start is not null").distinct()
            found = traverse.traverse(edges.df, starts, **options)
            frame = outer.join(found, F.col(key) == F.col("start")).drop(key)
        made = {n: fresh(n) for n in found.columns}
        frame = frame.withColumnsRenamed(made)
        scope = dict(state.scope)
        frame, scope[c.vertex] = self.vertex(frame, made["id"], vertex)
        if c.edge:
            scope[c.edge] = Val(F.col(made["edge"]), found.schema["edge"].dataType)
        if c.path:
            parts = [("depth", Val(F.col(made["depth"]).cast("long"), LONG)), ("score", Val(F.col(made["score"]), DOUBLE))]
            if options["keep_edges"]:
                parts.insert(0, ("edges", Val(F.col(made["edges"]), found.schema["edges"].dataType)))
            if options["keep_vertices"]:
                frame, value = self.looked_up(replace(state, df=frame, scope=scope), Val(F.col(made["ids"]), T.ArrayType(STRING)), None, stub=True)
                parts.insert(0, ("vertices", value))
            scope[c.path] = struct(parts)
        return replace(state, df=frame, scope=scope, order=[*state.order, Order(F.col(made["depth"])), Order(F.col(made["ids"]))])

    def vertex(self, df: DataFrame, column: str, fields: set[str] | None) -> tuple[DataFrame, Val]:
        """A reached vertex; one that no collection holds has an ``_id`` alone. If
        only its identity is used, nothing is looked up."""
        own = struct([("_id", Val(F.col(column), STRING)), ("_key", Val(F.substring_index(column, "/", -1), STRING))])
        if fields is not None and fields <= {"_id"}:
            return df, own
        only = None if fields is None else fields | {"_id"}
        docs = self.catalog.lookup(only, {n for n, c in self.catalog.collections.items() if c.kind != "edge"})
        key, doc = fresh("id"), fresh("doc")
        docs = docs.withColumnsRenamed({"id": key, "doc": doc})
        df = df.join(docs, F.col(column) == F.col(key), "left").drop(key)
        t = docs.schema[doc].dataType
        stub = F.struct(*[(F.col(column) if f.name == "_id" else F.array(F.lit("_id")) if f.name == KEYS else F.lit(None).cast(f.dataType)).alias(f.name) for f in t])
        full = fresh("v")
        return df.withColumn(full, F.coalesce(F.col(doc), stub)).drop(doc), Val(F.col(full), t)

    # -- filters and order --------------------------------------------------

    def filter(self, state: State, test: A.Node) -> State:
        for part in conjuncts(test):
            if found := self.existence(state, part):
                state = found
                continue
            col = self.predicate(state, part)
            state = replace(state, df=state.df.filter(col))
        return state

    def existence(self, state: State, e: A.Node) -> State | None:
        """``LENGTH((FOR ...)) > 0`` and ``== 0`` as semi and anti joins."""
        if not (isinstance(e, A.Binary) and isinstance(e.left, A.Call) and e.left.name == "LENGTH" and isinstance(e.left.args[0], A.Subquery) and isinstance(e.right, A.Literal)):
            return None
        how = {(">", 0.0): "left_semi", ("!=", 0.0): "left_semi", (">=", 1.0): "left_semi", ("==", 0.0): "left_anti", ("<", 1.0): "left_anti"}.get((e.op, e.right.value))
        if not how:
            return None
        inner, keys, outer = self.inside(state, e.left.args[0].query)
        if not keys:
            return None
        some = inner.df.select(*inner.groups).distinct()
        match = [F.col(k).eqNullSafe(F.col(g)) for k, g in zip(keys, inner.groups, strict=True)]
        return replace(state, df=outer.join(some, and_all(match), how).drop(*keys))

    def sort(self, state: State, s: A.Sort) -> State:
        keys: list[Order] = []
        df = state.df
        for e, down in s.keys:
            v = self.expr(state, e)
            df = state.df
            if v.kind in ("null", "array", "object"):
                continue  # such values all compare equal
            cols = [v.col]
            if v.kind == "any":
                cols = [F.try_variant_get(v.col, F.lit("$"), "double"), F.try_variant_get(v.col, F.lit("$"), "string")]
            elif v.kind == "string" and s.locale:
                cols = [F.collate(v.col, collation(s.locale))]
            for col in cols:
                name = fresh("s")
                df = df.withColumn(name, col)
                keys.append(Order(F.col(name), down))
                state = replace(state, df=df)
        return replace(state, df=df, order=[*keys, *state.order]) if not state.groups else self.numbered(replace(state, order=[*keys, *state.order]))

    def numbered(self, state: State) -> State:
        """Order as one column: a row's number in its group."""
        name = fresh("n")
        window = Window.partitionBy(*(state.groups or [F.lit(1)])).orderBy(*([o.key for o in state.order] or [F.lit(1)]))
        return replace(state, df=state.df.withColumn(name, F.row_number().over(window)), order=[Order(F.col(name))])

    def limit_of(self, part: A.Node, least: int) -> int:
        value = self.binds[part.name] if isinstance(part, A.Bind) else part.value
        try:
            return limit_value(value, least, least == 1)
        except ValidationError as e:
            raise BindError(str(e)) if isinstance(part, A.Bind) else e from None

    def limit(self, state: State, c: A.Limit) -> State:
        offset = self.limit_of(c.offset, 0) if c.offset else 0
        count = self.limit_of(c.count, 1)
        if state.groups:
            state = self.numbered(state)
            n = state.order[0].col
            return replace(state, df=state.df.filter((n > offset) & (n <= offset + count)))
        df = state.df.orderBy(*[o.key for o in state.order]) if state.order else state.df
        return replace(state, df=(df.offset(offset) if offset else df).limit(count))

    # -- grouping ------------------------------------------------------------

    def collect(self, state: State, c: A.Collect) -> State:
        made: dict[str, Val] = {}
        for name, e in c.keys:
            v = plain(self.expr(state, e))
            column = fresh(name)
            made[name] = Val(F.col(column), v.type if v.kind != "null" else STRING)
            state = replace(state, df=state.df.withColumn(column, v.col if v.kind != "null" else F.lit(None).cast("string")))
        aggregates, scope = [], {}
        for name, f, e in c.aggregates:
            v = self.expr(state, e)
            column = fresh(name)
            x = number(v) if v.kind == "number" else F.try_variant_get(v.col, F.lit("$"), "double") if v.kind == "any" else F.lit(None).cast("double")
            col = {"SUM": lambda x: F.coalesce(F.sum(x), F.lit(0.0)), "MIN": F.min, "MAX": F.max, "AVG": F.avg}[f](x)
            aggregates.append(col.alias(column))
            scope[name] = Val(F.col(column), DOUBLE)
        order = F.struct(*[o.col.alias(f"o{i}") for i, o in enumerate(state.order)]) if state.order else F.lit(0)
        if c.into:
            if c.into_value is not None:
                v = plain_if_null(self.expr(state, c.into_value))
            else:
                v = struct([(n, plain_if_null(x)) for n, x in sorted(state.scope.items())])
            column = fresh(c.into)
            aggregates.append(in_order(order, v).alias(column))
            scope[c.into] = Val(F.col(column), T.ArrayType(v.type))
        if c.count:
            column = fresh(c.count)
            aggregates.append(F.count(F.lit(1)).alias(column))
            scope[c.count] = Val(F.col(column), LONG)
        seen = fresh("seen")
        aggregates.append(F.min(order).alias(seen))
        keys = [*state.groups, *[str(v.col._jc.toString()) for v in made.values()]]
        keys = [k.strip("`") for k in keys]
        group = state.df.groupBy(*keys) if keys else state.df.groupBy(F.lit(1).alias(fresh("one")))
        return State(group.agg(*aggregates), {**made, **scope}, [Order(F.col(seen))], state.groups, state.paths)

    # -- subqueries ------------------------------------------------------------

    def inside(self, state: State, q: A.Query) -> tuple[State, list[str], DataFrame]:
        """The subquery's rows up to RETURN, grouped by what it takes from outside;
        the columns of that in the outer frame, and the outer frame."""
        free = {n for n in free_names(q) if n in state.scope or any(p == n for p, _ in state.paths)}
        paths = sorted({p for p in used_paths(q) if p[0] in free})
        paths = [p for p in paths if not any(o != p and o[0] == p[0] and p[1][: len(o[1])] == o[1] for o in paths)]
        if not paths:
            return self.body(State(self.catalog.spark.range(1).select()), q), [], state.df
        outer, keys, groups, known = state.df, [], [], {}
        for name, fields in paths:
            node: A.Node = A.Name(name)
            for f in fields:
                node = A.Field(node, f)
            v = self.expr(replace(state, df=outer), node)
            v = v if v.kind != "null" else Val(F.lit(None).cast("string"), STRING)
            k, g = fresh("k"), fresh("g")
            outer = outer.withColumn(k, v.col)
            keys.append(k)
            groups.append(g)
            known[name, fields] = Val(F.col(g), v.type)
        distinct = outer.select(*[F.col(k).alias(g) for k, g in zip(keys, groups, strict=True)]).distinct()
        inner = self.body(State(distinct, {}, [], groups, known), q)
        return inner, keys, outer

    def subquery(self, state: State, q: A.Query, count_only: bool = False) -> tuple[DataFrame, Val]:
        """The outer frame with the subquery's array (or its length)."""
        inner, keys, outer = self.inside(state, q)
        column = fresh("sq")
        if count_only and not q.distinct:
            value, to = F.count(F.lit(1)), LONG
        else:
            v = plain_if_null(self.expr(inner, q.result))
            rows = self.numbered(inner) if any(o.down for o in inner.order) else inner
            order = F.struct(*[o.col.alias(f"o{i}") for i, o in enumerate(rows.order)]) if rows.order else F.lit(0)
            df = rows.df
            if q.distinct:
                d = fresh("d")
                df = df.withColumn(d, v.col).withColumn("_o", order)
                df = df.groupBy(*rows.groups, d).agg(F.min("_o").alias("_o"))
                v, order = Val(F.col(d), v.type), F.col("_o")
            inner = replace(rows, df=df)
            value = in_order(order, v)
            to = T.ArrayType(v.type if v.kind != "null" else STRING)
            if count_only:
                value, to = F.size(value).cast("long"), LONG
        empty = F.lit(0).cast("long") if to == LONG else F.array().cast(to)
        if not keys:
            one = inner.df.agg(value.alias(column))
            alone = not state.df.columns and not state.scope
            return (one if alone else state.df.crossJoin(F.broadcast(one))), Val(F.col(column), to)
        found = inner.df.groupBy(*inner.groups).agg(value.alias(column))
        match = and_all([F.col(k).eqNullSafe(F.col(g)) for k, g in zip(keys, inner.groups, strict=True)])
        joined = outer.join(found, match, "left").drop(*keys, *inner.groups)
        full = fresh("sq")
        return joined.withColumn(full, F.coalesce(F.col(column), empty)).drop(column), Val(F.col(full), to)

    def looked_up(self, state: State, v: Val, fields: set[str] | None, stub: bool = False) -> tuple[DataFrame, Val]:
        """``DOCUMENT(id)`` or ``DOCUMENT(ids)`` by a left join on ids."""
        only = None if fields is None else fields | {"_id"}
        where = {v.literal.split("/", 1)[0]} if isinstance(v.literal, str) else None
        docs = self.catalog.lookup(only, where)
        key, doc = fresh("id"), fresh("doc")
        docs = docs.withColumnsRenamed({"id": key, "doc": doc})
        t = docs.schema[doc].dataType
        if v.kind == "string":
            mine = fresh("k")
            df = state.df.withColumn(mine, v.col).join(docs, F.col(mine) == F.col(key), "left").drop(mine, key)
            return df, Val(F.col(doc), t)
        if v.kind == "array" and isinstance(v.type.elementType, T.StringType):
            ids, place, out = fresh("ids"), fresh("p"), fresh("docs")
            outer = state.df.withColumn(ids, v.col)
            each = outer.select(ids).distinct().select(F.col(ids), F.posexplode(ids).alias(place, "_one"))
            each = each.join(docs, F.col("_one") == F.col(key), "left")
            item = F.col(doc)
            if stub:
                item = F.coalesce(item, F.struct(*[(F.col("_one") if f.name == "_id" else F.array(F.lit("_id")) if f.name == KEYS else F.lit(None).cast(f.dataType)).alias(f.name) for f in t]))
            got = each.groupBy(F.col(ids).alias("_ids")).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(place).alias("p"), item.alias("v")))), lambda r: r["v"]).alias(out))
            df = outer.join(got, F.col(ids).eqNullSafe(F.col("_ids")), "left").drop(ids, "_ids")
            return df, Val(F.col(out), T.ArrayType(t))
        return state.df, lit(None)

    # -- expressions -------------------------------------------------------------

    def predicate(self, state: State, e: A.Node) -> Column:
        """A condition of which null and false both drop the row: comparisons stay
        plain, so that they reach the scan."""
        match e:
            case A.Binary(op="AND", left=a, right=b):
                return self.predicate(state, a) & self.predicate(state, b)
            case A.Binary(op="OR", left=a, right=b):
                return self.predicate(state, a) | self.predicate(state, b)
            case A.Binary(op="==", left=a, right=b):
                return equal(self.expr(state, a), self.expr(state, b), raw=True)
            case A.Binary(op="<" | "<=" | ">" | ">=" as op, left=a, right=b):
                c = less(op, self.expr(state, a), self.expr(state, b))
                return F.lit(False) if c is None else c
            case A.Binary(op="IN"):
                return self.member(state, e, raw=True)
        return truth(self.expr(state, e))

    def member(self, state: State, e: A.Binary, raw: bool = False) -> Column:
        v, many = self.expr(state, e.left), self.expr(state, e.right)
        if many.kind == "null" or many.kind not in ("array", "any"):
            return F.lit(False)
        items = many.literal
        if raw and isinstance(items, list) and items and None not in items and v.kind in ("string", "number"):
            same = [i for i in items if isinstance(i, str) == (v.kind == "string") and not isinstance(i, bool | list | dict)]
            if v.kind == "number" and isinstance(v.type, T.IntegralType):
                same = [int(i) for i in same if float(i).is_integer()]
            return v.col.isin(same) if same else F.lit(False)
        if many.kind == "any":
            many = Val(F.try_variant_get(many.col, F.lit("$"), "array<variant>"), T.ArrayType(T.VariantType()))
        return F.coalesce(F.exists(many.col, lambda x: F.coalesce(equal(Val(x, many.type.elementType), v), F.lit(False))), F.lit(False))

    def expr(self, state: State, e: A.Node, needs: set[str] | None = None) -> Val:
        """The value of an expression. Subqueries and lookups join columns to
        ``state.df``, which is replaced in place. ``needs``: the fields used of a
        document that the expression gives (None: all)."""
        if (p := A.path_of(e)) is not None:
            return self.path(state, *p)
        match e:
            case A.Literal(value=v):
                return lit(v)
            case A.Bind(name=name):
                return lit(self.binds[name])
            case A.Field(base=base, name=name):
                return field_of(self.expr(state, base, {name}), name)
            case A.Array(items=items):
                made = array([plain_if_null(self.expr(state, i)) for i in items])
                constant = all(isinstance(i, A.Literal | A.Bind) for i in items)
                return Val(made.col, made.type, [self.binds[i.name] if isinstance(i, A.Bind) else i.value for i in items] if constant and items else None)
            case A.Object(fields=fields):
                return struct([(n, plain_if_null(self.expr(state, v))) for n, v in fields])
            case A.Subquery(query=q):
                state.df, v = self.subquery(state, q)
                return v
            case A.Call(name="LENGTH", args=(A.Subquery(query=q),)):
                state.df, v = self.subquery(state, q, count_only=True)
                return v
            case A.Call(name="DOCUMENT", args=(arg,)):
                state.df, v = self.looked_up(state, self.expr(state, arg), needs)
                return v
            case A.Call(name=name, args=args):
                return scalar.TABLE[name](*[self.expr(state, a) for a in args])
            case A.Unary(op="NOT", arg=a):
                return Val(~F.coalesce(truth(self.expr(state, a)), F.lit(False)), BOOL)
            case A.Unary(op="-", arg=a):
                return Val(-self.operand(self.expr(state, a)), DOUBLE)
            case A.Ternary(test=test, then=then, other=other):
                t, a, b = (self.expr(state, x) for x in (test, then, other))
                to = common([a.type, b.type])
                yes = truth(t) if t.kind in ("bool", "any") else F.lit(False)
                return Val(F.when(F.coalesce(yes, F.lit(False)), cast(a, to)).otherwise(cast(b, to)), to)
            case A.Binary(op="AND" | "OR" as op, left=a, right=b):
                x, y = (F.coalesce(truth(self.expr(state, s)), F.lit(False)) for s in (a, b))
                return Val(x & y if op == "AND" else x | y, BOOL)
            case A.Binary(op="==" | "!=" as op, left=a, right=b):
                same = equal(self.expr(state, a), self.expr(state, b))
                return Val(same if op == "==" else ~same, BOOL)
            case A.Binary(op="<" | "<=" | ">" | ">=" as op, left=a, right=b):
                c = less(op, self.expr(state, a), self.expr(state, b))
                return Val(F.lit(False) if c is None else F.coalesce(c, F.lit(False)), BOOL)
            case A.Binary(op="IN"):
                return Val(self.member(state, e), BOOL)
            case A.Binary(op=op, left=a, right=b):
                x, y = (self.operand(self.expr(state, s)) for s in (a, b))
                return scalar.finite({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y)}[op]())
        raise TypeError(e)

    def operand(self, v: Val) -> Column:
        """A number of an arithmetic expression. Null gives null, or an error at
        run time with ``strict``."""
        if v.kind == "any":
            x = F.try_variant_get(v.col, F.lit("$"), "double")
        elif v.kind == "number":
            x = number(v)
        elif v.kind == "null":
            x = F.lit(None).cast("double")
        else:
            raise TypeMismatch(f"a number is needed, not {v.kind}")
        return F.coalesce(x, F.raise_error(F.lit("a number is needed, not null")).cast("double")) if self.strict else x

    def path(self, state: State, name: str, fields: tuple[str, ...]) -> Val:
        for n in range(len(fields), -1, -1):
            if (name, fields[:n]) in state.paths and name not in state.scope:
                v, fields = state.paths[name, fields[:n]], fields[n:]
                break
        else:
            if name not in state.scope:
                raise ValidationError(f"{name} is unknown")
            v = state.scope[name]
        for f in fields:
            v = field_of(v, f)
        return v


def plain_if_null(v: Val) -> Val:
    """A value fit for a column: documents keep the list of their fields."""
    return v if v.kind != "null" else Val(F.lit(None).cast("string"), STRING)


def groupable(t: T.DataType) -> bool:
    if isinstance(t, T.ArrayType):
        return groupable(t.elementType)
    if isinstance(t, T.StructType):
        return all(groupable(f.dataType) for f in t)
    return not isinstance(t, T.MapType | T.VariantType)


def and_all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def in_order(order: Column, v: Val) -> Column:
    """An aggregate: all values (nulls too) in order."""
    rows = F.collect_list(F.struct(order.alias("o"), v.col.alias("v")))
    if groupable(v.type):
        return F.transform(F.sort_array(rows), lambda r: r["v"])
    by = F.array_sort(rows, lambda x, y: F.when(x["o"] < y["o"], -1).when(x["o"] > y["o"], 1).otherwise(0))
    return F.transform(by, lambda r: r["v"])


def conjuncts(e: A.Node) -> list[A.Node]:
    if isinstance(e, A.Binary) and e.op == "AND":
        return [*conjuncts(e.left), *conjuncts(e.right)]
    return [e]


def used_paths(q: A.Query) -> set[tuple[str, tuple[str, ...]]]:
    """Longest ``name.a.b`` of all expressions, subqueries entered."""
    out: set[tuple[str, tuple[str, ...]]] = set()

    def of(e: A.Node) -> None:
        if (p := A.path_of(e)) is not None:
            out.add(p)
            return
        if isinstance(e, A.Subquery):
            for x in expressions(e.query):
                of(x)
        for c in A.children(e):
            of(c)

    for e in expressions(q):
        of(e)
    return out


def used_fields(q: A.Query, name: str) -> set[str] | None:
    """Fields of a variable that a query uses; None if it is used whole."""
    fields: set[str] = set()
    whole = bool(q.collect and q.collect.into and q.collect.into_value is None)
    for n, path in used_paths(q):
        if n == name:
            if not path:
                return None
            fields.add(path[0])
    return None if whole else fields


def deferred(q: A.Query) -> tuple[list, list]:
    """LETs with subqueries or lookups that only RETURN uses run after LIMIT."""
    if q.collect or not (q.limit or q.sort):
        return list(q.body), []
    now, later = [], []
    for i, c in enumerate(q.body):
        heavy = isinstance(c, A.Let) and any(isinstance(n, A.Subquery) or (isinstance(n, A.Call) and n.name == "DOCUMENT") for n in A.walk(c.value))
        if heavy:
            rest = A.Query(tuple(q.body[i + 1 :]), None, q.sort, q.limit, None)
            used = {n.name for e in expressions(rest) for n in deep(e) if isinstance(n, A.Name)}
            if c.var not in used:
                later.append(c)
                continue
        now.append(c)
    return now, later


def collation(locale: str) -> str:
    """Spark's name for a BCP 47 tag: the language, with its script if given."""
    parts = locale.split("-")
    name = parts[0].lower()
    if len(parts) > 1 and len(parts[1]) == 4:
        name += "_" + parts[1].title()
    return name
