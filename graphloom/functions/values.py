"""A typed column, and the language's rules for equality, order and truth."""

from __future__ import annotations

import json
from typing import Any, NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TypeMismatch

DOUBLE, LONG, STRING, BOOL, NULL, VARIANT = T.DoubleType(), T.LongType(), T.StringType(), T.BooleanType(), T.NullType(), T.VariantType()
KEYS = "__keys"  # field of a document: names that it has, even with null values


class Val(NamedTuple):
    col: Column
    type: T.DataType
    literal: Any = None  # a constant's Python value
    fields: dict[str, str] | None = None  # a document kept as top-level columns

    @property
    def kind(self) -> str:
        t = self.type
        if isinstance(t, T.NullType):
            return "null"
        if isinstance(t, T.BooleanType):
            return "bool"
        if isinstance(t, T.NumericType):
            return "number"
        if isinstance(t, T.StringType | T.DatetimeType | T.DateType | T.TimestampType):
            return "string"
        if isinstance(t, T.ArrayType):
            return "array"
        if isinstance(t, T.StructType | T.MapType):
            return "object"
        return "any"


def lit(value: Any) -> Val:
    """A Python value (as from JSON) as a constant."""
    if value is None:
        return Val(F.lit(None), NULL)
    if isinstance(value, bool):
        return Val(F.lit(value), BOOL, value)
    if isinstance(value, int) and abs(value) < 2**63:
        return Val(F.lit(value).cast("long"), LONG, value)
    if isinstance(value, int | float):
        return Val(F.lit(float(value)), DOUBLE, float(value))
    if isinstance(value, str):
        return Val(F.lit(value), STRING, value)
    if isinstance(value, list | tuple):
        made = array([lit(v) for v in value])
        return Val(made.col, made.type, list(value))
    if isinstance(value, dict):
        made = struct([(k, lit(v)) for k, v in value.items()])
        return Val(made.col, made.type, dict(value))
    raise TypeMismatch(f"{value!r} is no JSON value")


def text(v: Val) -> Val:
    """A time stamp as RFC 3339 text; strings as they are."""
    if isinstance(v.type, T.TimestampType | T.TimestampNTZType):
        return Val(F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss'Z'"), STRING)
    if isinstance(v.type, T.DateType):
        return Val(v.col.cast("string"), STRING)
    return v


def number(v: Val) -> Column:
    return v.col if isinstance(v.type, T.DoubleType) else v.col.cast("double")


def variant(v: Val) -> Column:
    if v.kind == "any":
        return v.col
    if v.kind in ("array", "object"):
        v = plain(v)
        return F.parse_json(F.to_json(v.col)) if v.kind == "object" or not isinstance(v.type.elementType, T.NullType) else F.parse_json(F.lit("[]"))
    return text(v).col.cast("variant")


def plain(v: Val) -> Val:
    """A value without the hidden field that documents carry, inside arrays too."""
    t = v.type
    if isinstance(t, T.StructType):
        inner = [(f.name, plain(Val(v.col.getField(f.name), f.dataType))) for f in t if f.name != KEYS]
        if len(inner) == len(t) and all(i.type == f.dataType for (_, i), f in zip(inner, t, strict=True)):
            return v
        return Val(F.when(v.col.isNotNull(), F.struct(*[i.col.alias(n) for n, i in inner])) if inner else v.col, T.StructType([T.StructField(n, i.type) for n, i in inner]))
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType | T.ArrayType):
        probe = plain(Val(F.lit(None), t.elementType)).type
        if probe != t.elementType:
            return Val(F.transform(v.col, lambda x: plain(Val(x, t.elementType)).col), T.ArrayType(probe))
    return v


def common(types: list[T.DataType]) -> T.DataType:
    """The type that values of these types share; VARIANT if there is no other."""
    real = [t for t in types if not isinstance(t, T.NullType)]
    if not real:
        return NULL
    if all(t == real[0] for t in real):
        return real[0]
    if all(isinstance(t, T.NumericType) for t in real):
        return LONG if all(isinstance(t, T.IntegralType) for t in real) else DOUBLE
    if all(isinstance(t, T.ArrayType) for t in real):
        return T.ArrayType(common([t.elementType for t in real]))
    if all(isinstance(t, T.StructType) for t in real) and len({tuple(f.name for f in t) for t in real}) == 1:
        return T.StructType([T.StructField(f.name, common([t[f.name].dataType for t in real])) for f in real[0]])
    if all(isinstance(t, T.StringType | T.TimestampType | T.DateType) for t in real):
        return STRING
    return VARIANT


def cast(v: Val, to: T.DataType) -> Column:
    if v.type == to:
        return v.col
    if isinstance(to, T.VariantType):
        return variant(v)
    if isinstance(to, T.ArrayType) and isinstance(v.type, T.ArrayType):
        if isinstance(v.type.elementType, T.NullType):
            return v.col.cast(to) if not isinstance(to.elementType, T.VariantType) else F.transform(v.col, lambda x: F.lit(None).cast(to.elementType))
        return F.transform(v.col, lambda x: cast(Val(x, v.type.elementType), to.elementType))
    if isinstance(to, T.StringType):
        return text(v).col.cast(to)
    return v.col.cast(to)


def array(items: list[Val]) -> Val:
    to = common([i.type for i in items])
    return Val(F.array(*[cast(i, to) for i in items]), T.ArrayType(to))


def struct(fields: list[tuple[str, Val]]) -> Val:
    if not fields:
        return Val(F.from_json(F.lit("{}"), "struct<>"), T.StructType([]))
    return Val(F.struct(*[v.col.alias(n) for n, v in fields]), T.StructType([T.StructField(n, v.type) for n, v in fields]))


def field(v: Val, name: str) -> Val:
    """A missing field reads as null."""
    if isinstance(v.type, T.StructType):
        found = [f for f in v.type if f.name == name and name != KEYS]
        if not found:
            return lit(None)
        t, col = found[0].dataType, F.col(v.fields[name]) if v.fields else v.col.getField(name)
        if isinstance(t, T.DecimalType):
            return Val(col.cast("double"), DOUBLE)
        return Val(col, t)
    if isinstance(v.type, T.MapType):
        return Val(F.try_element_at(v.col, F.lit(name)), v.type.valueType)
    if v.kind == "any":
        return Val(F.try_variant_get(v.col, F.lit(f"$.{name}"), "variant"), VARIANT)
    return lit(None)


def canonical(v: Val) -> Val:
    """A value in the form that equality and grouping compare: numbers as doubles
    (-0.0 as 0.0), object fields by name."""
    t = v.type
    if v.kind == "number":
        return Val(number(v) + F.lit(0.0), DOUBLE)
    if isinstance(t, T.StructType):
        names = sorted(f.name for f in t if f.name != KEYS)
        inner = struct([(n, canonical(field(v, n))) for n in names])
        return Val(F.when(v.col.isNotNull(), inner.col), inner.type)
    if isinstance(t, T.ArrayType):
        to = canonical(Val(F.lit(None), t.elementType)).type
        if to == t.elementType and not isinstance(t.elementType, T.NumericType | T.StructType | T.ArrayType):
            return v
        return Val(F.transform(v.col, lambda x: canonical(Val(x, t.elementType)).col), T.ArrayType(to))
    if v.kind == "any":
        return Val(F.to_json(v.col), STRING)
    return text(v)


def equal(a: Val, b: Val, raw: bool = False) -> Column:
    """``==``: by value, null equal to null. ``raw``: where null is as good as
    false, plain ``=`` reaches the scan."""
    if a.kind == "null" and b.kind == "null":
        return F.lit(True)
    if a.kind == "null":
        return b.col.isNull()
    if b.kind == "null":
        return a.col.isNull()
    if {a.kind, b.kind} == {"string"}:
        a, b = stamp(a, b)
    if a.kind == b.kind == "number":
        x, y = (a.col, b.col) if isinstance(a.type, T.IntegralType) == isinstance(b.type, T.IntegralType) else narrowed(a, b)
    elif a.kind == b.kind and a.kind in ("string", "bool"):
        x, y = a.col, b.col
    elif "any" in (a.kind, b.kind):
        x, y = F.to_json(F.when(F.lit(True), variant(a))), F.to_json(F.when(F.lit(True), variant(b)))
        if "number" in (a.kind, b.kind):
            x, y = (number(v) if v.kind == "number" else F.try_variant_get(v.col, F.lit("$"), "double") for v in (a, b))
    elif a.kind == b.kind:
        p, q = canonical(a), canonical(b)
        to = common([p.type, q.type])
        if isinstance(to, T.VariantType):
            return a.col.isNull() & b.col.isNull()
        x, y = cast(p, to), cast(q, to)
    else:
        return a.col.isNull() & b.col.isNull()
    if raw and (a.literal is not None or b.literal is not None):
        return x == y
    return x.eqNullSafe(y)


def narrowed(a: Val, b: Val) -> tuple[Column, Column]:
    """A whole-number column against a whole literal stays whole, so that the
    comparison reaches the scan."""
    for v, w in ((a, b), (b, a)):
        if isinstance(w.literal, float) and w.literal.is_integer() and abs(w.literal) < 2**53 and isinstance(v.type, T.IntegralType):
            whole = F.lit(int(w.literal)).cast(v.type if -(2**31) <= w.literal < 2**31 else "long")
            return (v.col, whole) if v is a else (whole, v.col)
    return number(a), number(b)


def stamp(a: Val, b: Val) -> tuple[Val, Val]:
    """A time stamp against a literal date compares as time stamps, so that the
    scan can use it; else both become text."""
    for v, w in ((a, b), (b, a)):
        if isinstance(v.type, T.TimestampType | T.DateType) and isinstance(w.literal, str):
            import datetime

            try:
                datetime.datetime.fromisoformat(w.literal)
            except ValueError:
                continue
            made = Val(F.lit(w.literal).cast(v.type), v.type, w.literal)
            return (v, made) if v is a else (made, v)
    return text(a), text(b)


def less(op: str, a: Val, b: Val) -> Column | None:
    """``< <= > >=`` for two numbers or two strings; None if never true."""
    if a.kind == b.kind == "number":
        x, y = (a.col, b.col) if isinstance(a.type, T.IntegralType) == isinstance(b.type, T.IntegralType) else narrowed(a, b)
    elif a.kind == b.kind == "string":
        p, q = stamp(a, b)
        x, y = p.col, q.col
    elif "any" in (a.kind, b.kind) and {a.kind, b.kind} & {"number", "any"}:
        x, y = (number(v) if v.kind == "number" else F.try_variant_get(v.col, F.lit("$"), "double") for v in (a, b))
    else:
        return None
    return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def truth(v: Val) -> Column:
    """A bool column, null where the value is null; other types are errors."""
    if v.kind == "null":
        return F.lit(None).cast("boolean")
    if v.kind == "bool":
        return v.col
    if v.kind == "any":
        return F.try_variant_get(v.col, F.lit("$"), "boolean")
    raise TypeMismatch(f"a bool is needed, not {v.kind}")


def as_json(value: Any) -> Any:
    """A collected value as JSON data: documents without absent fields, and
    variants decoded."""
    from pyspark.sql import Row

    if isinstance(value, Row):
        data = value.asDict()
        keys = data.pop(KEYS, None)
        return {k: as_json(v) for k, v in data.items() if keys is None or k in keys}
    if isinstance(value, list):
        return [as_json(v) for v in value]
    if isinstance(value, dict):
        return {k: as_json(v) for k, v in value.items()}
    if isinstance(value, T.VariantVal):
        return json.loads(value.toJson())
    return value
