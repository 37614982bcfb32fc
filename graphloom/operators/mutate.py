"""Changes to collections.

A DataFrame can't change, so a change makes a new version of its collection: a
folder of Parquet files, to which the catalog then points. Readers of the old
version are not disturbed, and a failed change leaves the old version in place.
"""

from __future__ import annotations

import datetime
import uuid
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadKey, BindError, Conflict, MutationNotAllowed, TypeMismatch, UniqueViolation, UnknownDocument
from ..functions.values import KEYS, Val, as_json, cast, common, plain
from ..lang import ast as A
from ..lang.validate import binds_of


def publish(engine, name: str, df: DataFrame) -> None:
    """Write the next version of a collection and point to it."""
    c = engine.catalog[name]
    check_unique(c.indexes, df, name)
    path = f"{engine.store}/{name}/v{c.version + 1}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    c.df = engine.spark.read.schema(df.schema).parquet(path)
    c.version += 1


def now() -> str:
    return datetime.datetime.now(datetime.UTC).isoformat().replace("+00:00", "Z")


def key_of(value: Any, collection: str) -> str:
    """A plain key, or a full id of the same collection."""
    if not isinstance(value, str) or not value:
        raise BadKey(f"{value!r} is no key")
    if "/" in value:
        of, _, key = value.partition("/")
        if of != collection or not key:
            raise BadKey(f"{value} is no id of {collection}")
        return key
    return value


# -- unique indexes --------------------------------------------------------


def index_key(df: DataFrame, fields: list[str]):
    """Canonical text of the indexed values; whole and broken numbers differ."""
    have = {f.name for f in df.schema}
    parts = [F.col(f"`{f}`") if f in have else F.lit(None).cast("string") for f in fields]
    return F.to_json(F.struct(*[p.alias(f"f{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), parts


def duplicates(df: DataFrame, fields: list[str], sparse: bool = False) -> DataFrame:
    """``k, n``: values of the fields (as JSON) that several documents have. With
    ``sparse``, documents without one of the fields don't count."""
    key, parts = index_key(df, fields)
    if sparse:
        for p in parts:
            df = df.filter(p.isNotNull())
    return df.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def check_unique(indexes: dict[str, dict], df: DataFrame, name: str) -> None:
    for label, index in indexes.items():
        if not index.get("unique"):
            continue
        twice = duplicates(df, index["fields"], index.get("sparse", False)).first()
        if twice:
            raise UniqueViolation(f"{name}: index {label} has {twice['k']} twice")


def ensure_index(engine, collection: str, name: str, fields: list[str], unique: bool, sparse: bool) -> None:
    c = engine.catalog[collection]
    made = {"fields": list(fields), "unique": unique, "sparse": sparse, "type": "persistent"}
    if name in c.indexes:
        if c.indexes[name] != made:
            raise Conflict(f"{collection} has another index {name}")
        return
    check_unique({name: made}, c.df, collection)
    c.indexes[name] = made


# -- frames of documents -----------------------------------------------------


def merged_types(df: DataFrame, more: DataFrame) -> list[T.StructField]:
    """Fields of both, with the type that holds either's values."""
    types: dict[str, list] = {}
    for f in [*df.schema, *more.schema]:
        types.setdefault(f.name, []).append(f.dataType)
    fields = [T.StructField(n, common(t)) for n, t in types.items()]
    return [T.StructField(f.name, T.StringType()) if isinstance(f.dataType, T.NullType) else f for f in fields]


def shaped(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    have = {f.name: f.dataType for f in df.schema}
    return df.select(*[(cast(Val(F.col(f"`{f.name}`"), have[f.name]), f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])


def frame(engine, documents: list[dict]) -> DataFrame:
    """Documents given as Python data, with the list of their fields."""
    import json

    rows = [json.dumps({**d, KEYS: sorted(k for k in d if k != KEYS)}) for d in documents]
    return engine.spark.read.json(engine.spark.sparkContext.parallelize(rows))


def stamped(doc: dict, collection: str, kind: str, created: str | None = None) -> dict:
    doc = {k: v for k, v in doc.items() if k not in ("_id", "_rev", KEYS)}
    doc["_key"] = key_of(doc["_key"], collection) if doc.get("_key") is not None else str(uuid.uuid4())
    doc["_id"] = f"{collection}/{doc['_key']}"
    at = now()
    doc |= {"created_at": created or doc.get("created_at") or at, "updated_at": at}
    if kind == "edge":
        if not isinstance(doc.get("_from"), str) or not isinstance(doc.get("_to"), str):
            raise TypeMismatch("an edge needs _from and _to")
        doc.setdefault("relation_type", "related_to")
        doc.setdefault("confidence", 1.0)
    return doc


def proper(value: Any, collection: str) -> str | None:
    """The key that ``value`` names, or none: what is no key is refused where it is used."""
    value = value.get("_key") if isinstance(value, dict) else value
    try:
        return key_of(value, collection)
    except BadKey:
        return None


def documents_of(engine, name: str, keys: list[str | None]) -> dict[str, dict | None]:
    """Documents by key, looked up in one job; None for a key that no document has."""
    found: dict[str, dict | None] = dict.fromkeys(k for k in keys if k is not None)
    if not found or name not in engine.catalog:
        return found
    df = engine.catalog[name].df
    if len(found) <= 100:
        df = df.filter(F.col("_key").isin(list(found)))
    else:
        df = df.join(engine.spark.createDataFrame([(k,) for k in found], "_key string"), "_key", "left_semi")
    for row in df.collect():
        document = as_json(row)
        found[document["_key"]] = found[document["_key"]] or document
    return found


def apply_batch(engine, operations: list[dict]) -> list[dict]:
    """Inserts, updates, replacements and removals of single documents. They are
    folded by key on the driver and applied at once; all or nothing."""
    touched: dict[str, dict[str, dict | None]] = {}
    out = []
    keys: dict[str, list[str | None]] = {}
    for o in operations:
        keys.setdefault(o["collection"], []).append(proper(o["document"] if o["op"] == "insert" else o.get("key"), o["collection"]))
    stored = {n: documents_of(engine, n, k) for n, k in keys.items()}

    def current(name: str, key: str) -> dict | None:
        known = touched.setdefault(name, {})
        return known[key] if key in known else stored[name].get(key)

    for o in operations:
        op, name = o["op"], o["collection"]
        if name not in engine.catalog:
            if op != "insert":
                raise UnknownDocument(f"{name}/{o.get('key')}")
            engine.ensure_collection(name, "edge" if "_from" in o["document"] else "document")
        kind = engine.catalog[name].kind
        if op == "insert":
            doc = stamped(o["document"], name, kind)
            if current(name, doc["_key"]) is not None:
                raise Conflict(f"{name}/{doc['_key']} exists")
        else:
            key = key_of(o["key"], name)
            old = current(name, key)
            if old is None:
                raise UnknownDocument(f"{name}/{key}")
            fields = {k: v for k, v in (o.get("document") or {}).items() if k not in ("_key", "_id")}
            if op == "remove":
                touched[name][key] = None
                out.append(old)
                continue
            base = old if op == "update" else {}
            doc = stamped({**base, **fields, "_key": key}, name, kind, old.get("created_at"))
        touched.setdefault(name, {})[doc["_key"]] = doc
        out.append(doc)
    before = {n: (engine.catalog[n].df, engine.catalog[n].version) for n in touched}
    try:
        for name, documents in touched.items():
            upsert_documents(engine, name, [d for d in documents.values() if d], list(documents))
    except BaseException:
        for n, (df, version) in before.items():
            engine.catalog[n].df, engine.catalog[n].version = df, version
        raise
    return out


def with_keys(df: DataFrame) -> DataFrame:
    """A table's rows have all columns; said so before documents with fewer join."""
    if KEYS in df.columns:
        return df
    return df.withColumn(KEYS, F.array(*map(F.lit, df.columns)))


def upsert_documents(engine, name: str, documents: list[dict], keys: list[str]) -> None:
    df = with_keys(engine.catalog[name].df)
    gone = engine.spark.createDataFrame([(k,) for k in keys], "_key string")
    rest = df.join(gone, "_key", "left_anti")  # as many keys as the caller's operations; a short list is broadcast
    if documents:
        new = frame(engine, documents)
        fields = merged_types(rest, new)
        rest = shaped(rest, fields).unionByName(shaped(new, fields))
    publish(engine, name, rest)


def bulk_insert(engine, name: str, docs: DataFrame) -> None:
    """Append documents; keys must be present, new and unique."""
    if "_key" not in docs.columns:
        raise BadKey("documents need _key")
    if docs.filter("_key is null or _key = '' or contains(_key, '/')").limit(1).count():
        raise BadKey("a document has no proper _key")
    if docs.groupBy("_key").count().filter("count > 1").limit(1).count():
        raise Conflict("a key is given twice")
    docs = docs.drop("_id", "_rev").withColumn("_id", F.concat(F.lit(name + "/"), "_key"))
    if name not in engine.catalog:
        engine.ensure_collection(name, "edge" if "_from" in docs.columns else "document")
    if engine.catalog[name].kind == "edge" and ({"_from", "_to"} - set(docs.columns) or docs.filter("_from is null or _to is null").limit(1).count()):
        raise TypeMismatch("an edge needs _from and _to")
    old = engine.catalog[name].df
    if docs.join(old.select("_key"), "_key", "left_semi").limit(1).count():
        raise Conflict("a key is taken")
    if KEYS in old.columns or set(old.columns) != set(docs.columns):
        old, docs = with_keys(old), with_keys(docs)
    fields = merged_types(old, docs)
    publish(engine, name, shaped(old, fields).unionByName(shaped(docs, fields)))


# -- mutations of the language --------------------------------------------------


def run(engine, q: A.Query, binds: dict) -> DataFrame:
    """Run a mutation query; rows of its RETURN, else of the documents it left."""
    from ..plans.lower import Lowering, Order, State, plain_if_null

    wanted = binds_of(q)
    if missing := [b for b in wanted if b not in binds]:
        raise BindError(f"no value for @{missing[0]}")
    if extra := [b for b in binds if b not in wanted]:
        raise BindError(f"@{extra[0]} isn't in the query")
    m = q.mutation
    if m.collection not in engine.catalog:
        if m.kind not in ("INSERT", "UPSERT"):
            return engine.catalog[m.collection].df
        engine.ensure_collection(m.collection)
    low = Lowering(engine.catalog, binds, engine.strict, ordered=True)
    state = low.body(State(engine.spark.range(1).select()), A.Query(q.body, result=q.result))
    parts = {n: e for n, e in (("key", m.key), ("value", m.value), ("update", m.update)) if e is not None}
    values = {n: plain_if_null(low.expr(state, e)) for n, e in parts.items()}
    df = state.df.select("*", *[(plain(v) if n == "key" else v).col.alias(f"_m_{n}") for n, v in values.items()])
    df = df.orderBy(*[o.key for o in state.order]) if state.order else df
    # each row is one document's change, applied in order: the driver folds them
    rows = df.select(*[f"_m_{n}" for n in values]).collect()
    operations, olds = [], []
    for r in rows:
        got = {n: as_json(r[f"_m_{n}"]) for n in values}
        operations.append(got)
    news: list[dict] = []
    batch: list[dict] = []
    name = m.collection
    seen = documents_of(engine, name, [proper(got["value"] if m.kind == "INSERT" else got["key"], name) for got in operations])

    def look(key: str) -> dict | None:
        if key not in seen:
            seen[key] = engine.document(name, key)
        return seen[key]

    def done(op: dict, key: str | None, old: dict | None, new: dict | None) -> None:
        batch.append(op)
        if key is not None:
            seen[key] = new
        olds.append(old)
        news.append(new)

    kind = engine.catalog[name].kind
    least = first_matches(engine, name, [got["key"] for got in operations]) if m.kind == "UPSERT" else {}
    for got in operations:
        if m.kind == "INSERT" or (m.kind == "UPSERT" and (match := matching(engine, name, got["key"], seen, least)) is None):
            value = got["value"]
            if not isinstance(value, dict):
                raise TypeMismatch("a document is needed")
            doc = stamped(value, name, kind)
            if value.get("_key") is not None and look(doc["_key"]) is not None:
                raise Conflict(f"{name}/{doc['_key']} exists")
            done({"op": "insert", "collection": name, "document": doc}, doc["_key"], None, doc)
            continue
        key = match["_key"] if m.kind == "UPSERT" else key_of(got["key"]["_key"] if isinstance(got["key"], dict) and "_key" in got["key"] else got["key"], name)
        old = match if m.kind == "UPSERT" else look(key)
        if old is None:
            raise UnknownDocument(f"{name}/{key}")
        if m.kind == "REMOVE":
            done({"op": "remove", "collection": name, "key": key}, key, old, None)
            continue
        fields = got["update"] if m.kind == "UPSERT" else got["value"]
        if not isinstance(fields, dict):
            raise TypeMismatch("a document is needed")
        op = "replace" if m.kind == "REPLACE" else "update"
        fields = {k: v for k, v in fields.items() if k not in ("_key", "_id")}
        new = stamped({**(old if op == "update" else {}), **fields, "_key": key}, name, kind, old.get("created_at"))
        done({"op": op, "collection": name, "key": key, "document": fields}, key, old, new)
    apply_batch(engine, batch)
    if q.result is None:
        return frame(engine, [n or o for n, o in zip(news, olds, strict=True)]).drop(KEYS) if news else engine.catalog[name].df.limit(0).drop(KEYS)
    if any(isinstance(n, A.Name) and n.name not in ("OLD", "NEW") for n in A.walk(q.result)):
        raise MutationNotAllowed("RETURN of a mutation uses OLD and NEW alone")
    if not news:
        return engine.spark.createDataFrame([], "value string")
    both = frame(engine, [{"n": i, "OLD": o and {**o, KEYS: sorted(o)}, "NEW": n and {**n, KEYS: sorted(n)}} for i, (o, n) in enumerate(zip(olds, news, strict=True))])
    scope = {x: Val(F.col(x), both.schema[x].dataType) if x in both.columns and isinstance(both.schema[x].dataType, T.StructType) else Val(F.lit(None), T.NullType()) for x in ("OLD", "NEW")}
    return low.result(State(both, scope, [Order(F.col("n"))]), A.Query((), result=q.result))


def canonical(search: dict) -> str:
    import json

    return json.dumps(search, sort_keys=True)


def fitting(df: DataFrame, search: dict):
    """Whether a stored document has every field of ``search``; None if none can."""
    from ..functions.values import equal, lit

    columns = {f.name: f.dataType for f in df.schema}
    if any(k not in columns for k in search):
        return None
    fits = F.lit(True)
    for k, v in search.items():
        fits &= equal(Val(F.col(f"`{k}`"), columns[k]), lit(v))
        if KEYS in columns:
            fits &= F.array_contains(KEYS, F.lit(k))
    return fits


def first_matches(engine, name: str, searches: list[Any]) -> dict[str, dict | None]:
    """For each search by other fields than the key, the stored document with the least
    key that fits it: a job for a hundred distinct searches, and one for the documents."""
    df = engine.catalog[name].df
    least: dict[str, Any] = {}
    conditions = {canonical(s): fitting(df, s) for s in searches if isinstance(s, dict) and "_key" not in s}
    able = [(c, f) for c, f in conditions.items() if f is not None]
    for i in range(0, len(able), 100):
        some = able[i : i + 100]
        row = df.agg(*[F.min(F.when(f, F.col("_key"))).alias(f"k{j}") for j, (_, f) in enumerate(some)]).first()
        least |= {c: row[j] for j, (c, _) in enumerate(some)}
    stored = documents_of(engine, name, list(least.values()))
    return {c: stored.get(least.get(c)) for c in conditions}


def matching(engine, name: str, search: Any, seen: dict, least: dict[str, dict | None]) -> dict | None:
    """The first document, by key, that has every field of ``search``; ``least`` are
    the first matches among stored documents, before this mutation."""
    if not isinstance(search, dict):
        raise TypeMismatch("UPSERT searches by a document")

    def fits(doc: dict | None) -> bool:
        return doc is not None and all(k in doc and doc[k] == v for k, v in search.items())

    if "_key" in search:
        key = search["_key"]
        doc = seen[key] if key in seen else engine.document(name, key)
        return doc if fits(doc) else None
    found = least[canonical(search)]
    if found is not None and found["_key"] in seen:  # looked up again without the documents that this mutation has seen
        df = engine.catalog[name].df
        row = df.filter(fitting(df, search) & ~F.col("_key").isin(list(seen))).orderBy("_key").limit(1).collect()
        found = as_json(row[0]) if row else None
    own = sorted((d for d in seen.values() if fits(d)), key=lambda d: d["_key"])
    return min([d for d in [found, *own[:1]] if d is not None], key=lambda d: d["_key"], default=None)
