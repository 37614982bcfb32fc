"""The functions of the language. Arguments of a wrong type give null."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import nfc, series_udf
from .values import BOOL, DOUBLE, KEYS, LONG, STRING, Val, cast, common, field, lit, number, plain, text

TABLE: dict[str, Callable[..., Val]] = {}
#: White space of Unicode, as a regular-expression class. Fixed values.
BLANKS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def function(*names: str):
    def add(f):
        for name in names:
            TABLE[name] = f
        return f

    return add


def finite(c: Column, of: T.DataType = DOUBLE) -> Val:
    """Results that aren't finite are null."""
    return Val(F.when(F.abs(c) < float("inf"), c), of)


def strings(*args: Val) -> list[Val] | None:
    args = [text(a) for a in args]
    return args if all(a.kind == "string" for a in args) else None


# -- values --------------------------------------------------------------


@function("COALESCE", "NOT_NULL")
def coalesce(*args: Val) -> Val:
    to = common([a.type for a in args])
    return Val(F.coalesce(*[cast(a, to) for a in args]), to)


@function("LENGTH")
def length(v: Val) -> Val:
    v = text(v)
    if v.kind == "string":
        return Val(F.length(v.col).cast("long"), LONG)
    if v.kind == "array" or isinstance(v.type, T.MapType):
        return Val(F.when(v.col.isNotNull(), F.size(v.col)).cast("long"), LONG)
    if isinstance(v.type, T.StructType):
        names = [f.name for f in v.type]
        many = F.size(v.col.getField(KEYS)) if KEYS in names else F.lit(len(names))
        return Val(F.when(v.col.isNotNull(), many).cast("long"), LONG)
    return lit(None)


@function("HAS")
def has(v: Val, name: Val) -> Val:
    if name.kind != "string":
        return lit(None)
    if isinstance(v.type, T.MapType):
        return Val(F.map_contains_key(v.col, name.col), BOOL)
    if isinstance(v.type, T.StructType):
        fields = [f.name for f in v.type]
        if KEYS in fields:
            return Val(F.array_contains(v.col.getField(KEYS), name.col), BOOL)
        return Val(F.when(v.col.isNotNull(), name.col.isin(fields)), BOOL)
    return lit(None)


@function("TYPENAME")
def typename(v: Val) -> Val:
    if v.kind == "any":
        s = F.schema_of_variant(v.col)
        kind = F.when(v.col.isNull() | (s == "VOID"), "null").when(s == "BOOLEAN", "bool").when(s == "STRING", "string").when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").otherwise("number")
        return Val(kind, STRING)
    return Val(F.lit("null") if v.kind == "null" else F.when(v.col.isNull(), "null").otherwise(v.kind), STRING)


def identifier(v: Val) -> Column | None:
    """``collection/key`` of a document or string; null if it is none."""
    if v.kind == "object":
        v = field(v, "_id")
    if v.kind != "string":
        return None
    return F.when(v.col.rlike("^[^/]+/.+$"), v.col)


@function("IS_SAME_COLLECTION")
def is_same_collection(name: Val, v: Val) -> Val:
    i = identifier(v)
    if i is None or name.kind != "string":
        return lit(None)
    return Val(F.substring_index(i, "/", 1) == name.col, BOOL)


@function("PARSE_IDENTIFIER")
def parse_identifier(v: Val) -> Val:
    i = identifier(v)
    if i is None:
        return lit(None)
    parts = F.split(i, "/", 2)
    return Val(F.when(i.isNotNull(), F.struct(parts[0].alias("collection"), parts[1].alias("key"))), T.StructType([T.StructField("collection", STRING), T.StructField("key", STRING)]))


@function("TO_NUMBER")
def to_number(v: Val) -> Val:
    if v.kind in ("number", "bool"):
        return Val(v.col.cast("double"), DOUBLE)
    if v.kind == "string":
        s = trim(text(v)).col
        return finite(F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.expr("0D") + s.try_cast("double")))
    return lit(None)


@function("TO_STRING")
def to_string(v: Val) -> Val:
    v = text(v)
    if v.kind == "string":
        return v
    if v.kind == "bool":
        return Val(v.col.cast("string"), STRING)
    if v.kind == "number":
        if isinstance(v.type, T.IntegralType):
            return Val(v.col.cast("string"), STRING)
        whole = (v.col == F.floor(v.col)) & (F.abs(v.col) < 9e15)
        return Val(F.when(whole, v.col.cast("long").cast("string")).otherwise(v.col.cast("string")), STRING)
    return lit(None)


@function("TO_BOOL")
def to_bool(v: Val) -> Val:
    v = text(v)
    if v.kind == "bool":
        return v
    if v.kind == "number":
        return Val(v.col != 0, BOOL)
    if v.kind == "string":
        return Val(F.length(v.col) > 0, BOOL)
    return lit(None)


# -- strings -------------------------------------------------------------


def string_function(name: str, f: Callable[[Column], Column]) -> None:
    @function(name)
    def apply(v: Val) -> Val:
        s = strings(v)
        return Val(f(s[0].col), STRING) if s else lit(None)


string_function("UPPER", F.upper)
string_function("LOWER", F.lower)
string_function("TRIM", lambda c: F.regexp_replace(c, f"^{BLANKS}+|{BLANKS}+$", ""))
trim = TABLE["TRIM"]


@function("NORMALIZE_NFC")
def normalize_nfc(v: Val) -> Val:
    s = strings(v)
    if not s:
        return lit(None)
    return Val(series_udf(nfc, "string")(s[0].col), STRING)


@function("CONTAINS")
def contains(a: Val, b: Val) -> Val:
    s = strings(a, b)
    return Val(s[0].col.contains(s[1].col), BOOL) if s else lit(None)


@function("STARTS_WITH")
def starts_with(a: Val, b: Val) -> Val:
    s = strings(a, b)
    return Val(s[0].col.startswith(s[1].col), BOOL) if s else lit(None)


@function("SUBSTRING")
def substring(v: Val, start: Val, many: Val | None = None) -> Val:
    s = strings(v)
    if not s or start.kind != "number" or (many is not None and many.kind != "number"):
        return lit(None)
    a = start.col.cast("int")
    n = many.col.cast("int") if many is not None else F.length(s[0].col)
    fine = (start.col >= 0) & (n >= 0)
    return Val(F.when(fine, F.substring(s[0].col, a + 1, n)), STRING)


def rendered(v: Val) -> Column | None:
    v = text(v)
    if v.kind in ("string", "null"):
        return v.col.cast("string")
    if v.kind in ("number", "bool"):
        return v.col.cast("string")
    if v.kind == "any":
        return F.try_variant_get(v.col, F.lit("$"), "string")
    return None


@function("CONCAT")
def concat(*args: Val) -> Val:
    parts = [rendered(a) for a in args]
    return lit(None) if any(p is None for p in parts) else Val(F.concat_ws("", *parts), STRING)


@function("SPLIT")
def split(v: Val, by: Val) -> Val:
    s = strings(v, by)
    if not s:
        return lit(None)
    quoted = F.concat(F.lit("\\Q"), F.replace(s[1].col, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    if isinstance(by.literal, str):
        quoted = F.lit("".join("\\" + c if not c.isalnum() and ord(c) < 128 and not c.isspace() else c for c in by.literal))
    return Val(F.when(F.length(s[1].col) > 0, F.split(s[0].col, quoted, F.lit(-1))), T.ArrayType(STRING))


def usable_pattern(p: Val) -> bool:
    """Literal patterns are checked here; bad ones give null, as do look-around
    and back-references, which the language's dialect lacks."""
    if not isinstance(p.literal, str):
        return True
    if re.search(r"\(\?(=|!|<=|<!|>)|\\[1-9]", p.literal):
        return False
    try:
        re.compile(p.literal)
    except re.error:
        return bool(re.search(r"\\[pP]\{|\(\?<", p.literal))
    return True


def pattern(p: Val, ci: Val | None) -> Column:
    if ci is None or ci.kind != "bool":
        return p.col
    return F.when(ci.col, F.concat(F.lit("(?i)"), p.col)).otherwise(p.col)


@function("REGEX_TEST")
def regex_test(v: Val, p: Val, ci: Val | None = None) -> Val:
    s = strings(v, p)
    if not s or not usable_pattern(p):
        return lit(None)
    return Val(F.regexp_like(s[0].col, pattern(p, ci)), BOOL)


@function("REGEX_REPLACE")
def regex_replace(v: Val, p: Val, by: Val, ci: Val | None = None) -> Val:
    s = strings(v, p, by)
    if not s or not usable_pattern(p):
        return lit(None)
    if isinstance(by.literal, str):  # a group's number in braces is only a name to Java
        by = lit(re.sub(r"\$\{(\d+)\}", r"$\1", by.literal))
    return Val(F.regexp_replace(s[0].col, pattern(p, ci), by.col), STRING)


# -- numbers -------------------------------------------------------------


def number_function(name: str, f: Callable[[Column], Column]) -> None:
    @function(name)
    def apply(v: Val) -> Val:
        return Val(f(number(v)).cast("double"), DOUBLE) if v.kind == "number" else lit(None)


number_function("ABS", F.abs)
number_function("FLOOR", lambda c: F.when(F.abs(c) < 2.0**52, F.floor(c).cast("double")).otherwise(c))
number_function("CEIL", lambda c: F.when(F.abs(c) < 2.0**52, F.ceil(c).cast("double")).otherwise(c))
number_function("ROUND", lambda c: F.round(c))


def numbers(v: Val) -> Column | None:
    """An array's numeric elements as doubles; None if it is no array."""
    if v.kind != "array":
        return None
    e = Val(F.lit(None), v.type.elementType)
    if e.kind == "number":
        return F.filter(F.transform(v.col, lambda x: x.cast("double")), lambda x: x.isNotNull())
    if e.kind == "any":
        return F.filter(F.transform(v.col, lambda x: F.try_variant_get(x, F.lit("$"), "double")), lambda x: x.isNotNull())
    return F.when(v.col.isNotNull(), F.array().cast("array<double>"))


@function("MIN")
def least(v: Val) -> Val:
    n = numbers(v)
    return lit(None) if n is None else Val(F.array_min(n), DOUBLE)


@function("MAX")
def greatest(v: Val) -> Val:
    n = numbers(v)
    return lit(None) if n is None else Val(F.array_max(n), DOUBLE)


@function("SUM")
def total(v: Val) -> Val:
    n = numbers(v)
    return lit(None) if n is None else finite(F.reduce(n, F.lit(0.0), lambda a, x: a + x))


@function("AVG")
def average(v: Val) -> Val:
    n = numbers(v)
    return lit(None) if n is None else finite(F.try_divide(F.reduce(n, F.lit(0.0), lambda a, x: a + x), F.size(n)))


def dot(a: Column, b: Column) -> Column:
    return F.reduce(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


@function("COSINE_SIMILARITY")
def cosine_similarity(a: Val, b: Val) -> Val:
    if any(v.kind != "array" or Val(F.lit(None), v.type.elementType).kind != "number" for v in (a, b)):
        return lit(None)
    x, y = (F.transform(v.col, lambda e: e.cast("double")) for v in (a, b))
    fine = (F.size(x) == F.size(y)) & (F.size(x) > 0) & ~F.exists(x, lambda e: e.isNull()) & ~F.exists(y, lambda e: e.isNull())
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return finite(F.when(fine & (norm > 0), F.try_divide(dot(x, y), norm)))


# -- arrays --------------------------------------------------------------


def element(v: Val, at: int) -> Val:
    return Val(F.try_element_at(v.col, F.lit(at)), v.type.elementType) if v.kind == "array" else lit(None)


function("FIRST")(lambda v: element(v, 1))
function("LAST")(lambda v: element(v, -1))


def distinct_form(v: Val) -> Val:
    """An array whose elements compare by value with Spark's set functions."""
    e = Val(F.lit(None), v.type.elementType)
    return v if e.kind != "any" else Val(F.transform(v.col, lambda x: F.to_json(x)), T.ArrayType(STRING))


def back(v: Val, col: Column) -> Val:
    if isinstance(v.type.elementType, T.VariantType):
        return Val(F.transform(col, lambda x: F.parse_json(x)), v.type)
    return Val(col, v.type)


@function("UNIQUE")
def unique(v: Val) -> Val:
    if v.kind != "array":
        return lit(None)
    return back(v, F.array_distinct(distinct_form(plain(v)).col))


@function("SORTED")
def sorted_(v: Val) -> Val:
    if v.kind != "array":
        return lit(None)
    if isinstance(v.type.elementType, T.NullType):
        return v
    if isinstance(v.type.elementType, T.VariantType):  # null < bool < number < string < array < object

        def key(x: Column) -> Column:
            s = F.schema_of_variant(x)
            rank = F.when(x.isNull() | (s == "VOID"), 0).when(s == "BOOLEAN", 1).when(s == "STRING", 3).when(s.startswith("ARRAY"), 4).when(s.startswith("OBJECT"), 5).otherwise(2)
            return F.struct(rank.alias("r"), F.try_variant_get(x, F.lit("$"), "double").alias("n"), F.to_json(x).alias("j"))

        return Val(F.transform(F.sort_array(F.transform(v.col, key)), lambda k: F.parse_json(k["j"])), v.type)
    return Val(F.sort_array(plain(v).col), plain(v).type)


@function("SORTED_UNIQUE")
def sorted_unique(v: Val) -> Val:
    s = sorted_(v)
    return unique(s) if s.kind == "array" else s


@function("SLICE")
def slice_(v: Val, start: Val, many: Val | None = None) -> Val:
    if v.kind != "array" or start.kind != "number" or (many is not None and many.kind != "number"):
        return lit(None)
    size, a = F.size(v.col), start.col.cast("int")
    first = F.least(F.greatest(F.when(a < 0, size + a).otherwise(a), F.lit(0)), size)
    if many is None:
        end = size
    else:
        n = many.col.cast("int")
        end = F.when(n < 0, size + n).otherwise(F.least(first + n, size))
    return Val(F.slice(v.col, first + 1, F.greatest(end - first, F.lit(0))), v.type)


@function("FLATTEN")
def flatten(v: Val, depth: Val | None = None) -> Val:
    n = 1 if depth is None else depth.literal
    if v.kind != "array" or not isinstance(n, int | float) or n < 0:
        return lit(None)
    for _ in range(int(n)):
        if not isinstance(v.type.elementType, T.ArrayType):
            break
        v = Val(F.flatten(F.transform(v.col, lambda x: F.coalesce(x, F.array(F.lit(None)).cast(v.type.elementType)))), v.type.elementType)
    return v


def set_function(name: str, f: Callable[[Column, Column], Column]) -> None:
    @function(name)
    def apply(*args: Val) -> Val:
        if any(a.kind != "array" for a in args):
            return lit(None)
        to = common([plain(a).type for a in args])
        forms = [distinct_form(Val(cast(plain(a), to), to)).col for a in args]
        out = F.array_distinct(forms[0])
        for other in forms[1:]:
            out = f(out, other)
        return back(Val(out, to), out)


set_function("INTERSECTION", F.array_intersect)
set_function("MINUS", F.array_except)


# -- dates ---------------------------------------------------------------

#: Milliseconds of a unit. Fixed values.
UNITS = {"days": 86_400_000, "day": 86_400_000, "d": 86_400_000, "hours": 3_600_000, "hour": 3_600_000, "h": 3_600_000, "minutes": 60_000, "minute": 60_000, "m": 60_000, "seconds": 1_000, "second": 1_000, "s": 1_000}
DATE = r"^(\d{4})-(\d{2})-(\d{2})(?:[Tt ](\d{2}):(\d{2}):(\d{2})(\.\d+)?([Zz]|[+-]\d{2}:\d{2}))?$"


def instant(v: Val) -> Column:
    """Time stamp of an RFC 3339 text or date; null for anything else."""
    s = text(v).col
    day = F.when(F.length(s) == 10, F.concat(s, F.lit("T00:00:00Z"))).otherwise(s)
    return F.when(s.rlike(DATE), day.try_cast("timestamp"))


def date_part(name: str, group: int) -> None:
    @function(name)
    def apply(v: Val) -> Val:
        s = strings(v)
        if not s:
            return lit(None)
        part = F.regexp_extract(s[0].col, DATE, group)
        return Val(F.when(instant(v).isNotNull(), F.when(part == "", F.lit(0)).otherwise(part.try_cast("long"))).cast("long"), LONG)


for _i, _name in enumerate(("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND"), 1):
    date_part(f"DATE_{_name}", _i)


@function("DATE_TIMESTAMP")
def date_timestamp(v: Val) -> Val:
    return Val(F.unix_millis(instant(v)), LONG) if strings(v) else lit(None)


@function("NOW")
def now() -> Val:
    return Val(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), STRING)


def unit(v: Val) -> Column | None:
    """Milliseconds of a unit's name; null for none."""
    if v.kind != "string":
        return None
    if isinstance(v.literal, str):
        return F.lit(UNITS.get(v.literal.lower())).cast("long")
    table = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    return F.try_element_at(table, F.lower(v.col)).cast("long")


@function("DATE_DIFF")
def date_diff(a: Val, b: Val, by: Val) -> Val:
    u = unit(by)
    if u is None or not strings(a, b):
        return lit(None)
    return Val(F.try_divide((F.unix_millis(instant(b)) - F.unix_millis(instant(a))).cast("double"), u.cast("double")), DOUBLE)


@function("DATE_ADD")
def date_add(v: Val, many: Val, by: Val) -> Val:
    u = unit(by)
    if u is None or many.kind != "number" or not strings(v):
        return lit(None)
    s = text(v).col
    offset = F.regexp_extract(s, DATE, 8)
    zone = F.when(offset.rlike(r"^[+-]"), offset).otherwise(F.lit("+00:00"))
    shift = (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int")) * F.when(zone.startswith("-"), -1).otherwise(1)
    millis = F.unix_millis(instant(v)) + F.round(number(many) * u).cast("long")
    local = F.timestamp_millis(millis + shift.cast("long") * 60_000)
    utc = F.to_utc_timestamp(local, F.current_timezone())
    stem = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    rest = F.pmod(millis, F.lit(1000))
    fraction = F.when(rest == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(rest.cast("string"), 3, "0")))
    return Val(F.concat(stem, fraction, F.when(zone == "+00:00", F.lit("+00:00")).otherwise(zone)), STRING)
