"""The engine: collections, queries and operators behind one object."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog
from .errors import MutationNotAllowed, UnknownDocument
from .functions.values import as_json
from .lang.parser import parse
from .lang.validate import validate
from .operators import mutate, search, traverse
from .plans import explain
from .plans.lower import Lowering


class Engine:
    def __init__(self, spark: SparkSession, store: str | None = None, strict: bool = False):
        """``store``: folder for versions of changed collections (default: below the
        warehouse). ``strict``: arithmetic on null is an error, not null."""
        self.spark, self.strict = spark, strict
        self.catalog = Catalog(spark)
        self.store = store or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/graphloom"

    def register(self, name: str, df: DataFrame, key: str | Column | None = None, **options) -> None:
        """Name a table as a collection; see :meth:`Catalog.register`."""
        self.catalog.register(name, df, key, **options)

    def query(self, text: str, binds: dict[str, Any] | None = None, ordered: bool = False, read_only: bool = False) -> DataFrame:
        """Run a query. ``ordered``: rows of queries without SORT come in scan order
        (a sort that large results had better not pay for)."""
        q = parse(text)
        validate(q)
        binds = binds or {}
        if q.explain == "plan":
            return explain.described(self.spark, q)
        if q.mutation:
            if read_only:
                raise MutationNotAllowed("this call only reads")
            return mutate.run(self, q, binds)
        if q.explain:
            return explain.analyzed(self, q, binds)
        return Lowering(self.catalog, binds, self.strict, ordered).run(q)

    def rows(self, text: str, binds: dict[str, Any] | None = None) -> list[Any]:
        """A small result as JSON data, in order."""
        q = parse(text)
        df = self.query(text, binds, ordered=True)
        out = [as_json(r) for r in df.collect()]
        single = df.columns == ["value"] and not (q.result is not None and getattr(q.result, "fields", None))
        return [r["value"] for r in out] if single else out

    # -- documents -----------------------------------------------------------

    def documents(self, collection: str, limit: int | None = None, offset: int = 0, after: str | None = None, fields: list[str] | None = None, where: Column | None = None) -> DataFrame:
        """A page in key order; ``after`` continues behind a key."""
        df = self.catalog[collection].df
        df = df.filter(where) if where is not None else df
        df = df.filter(F.col("_key") > after) if after is not None else df
        df = df.select(*dict.fromkeys(["_key", "_id", *fields])) if fields is not None else df
        df = df.orderBy("_key")
        df = df.offset(offset) if offset else df
        return df if limit is None else df.limit(limit)

    def document(self, collection: str, key: str) -> dict | None:
        row = self.catalog[collection].df.filter(F.col("_key") == key).limit(1).collect()
        return as_json(row[0]) if row else None

    def insert(self, collection: str, document: dict) -> dict:
        return mutate.apply_batch(self, [{"op": "insert", "collection": collection, "document": document}])[0]

    def update(self, collection: str, key: str, fields: dict) -> dict:
        return mutate.apply_batch(self, [{"op": "update", "collection": collection, "key": key, "document": fields}])[0]

    def replace(self, collection: str, key: str, document: dict) -> dict:
        return mutate.apply_batch(self, [{"op": "replace", "collection": collection, "key": key, "document": document}])[0]

    def remove(self, collection: str, key: str) -> dict:
        return mutate.apply_batch(self, [{"op": "remove", "collection": collection, "key": key}])[0]

    def batch(self, operations: list[dict]) -> list[dict]:
        """All or nothing; later operations see earlier ones."""
        return mutate.apply_batch(self, operations)

    def bulk_insert(self, collection: str, docs: DataFrame) -> None:
        """Append documents that have keys; refused as a whole if any is bad."""
        mutate.bulk_insert(self, collection, docs)

    def ensure_index(self, collection: str, name: str, fields: list[str], unique: bool = True, sparse: bool = False) -> None:
        mutate.ensure_index(self, collection, name, fields, unique, sparse)

    def indexes(self, collection: str) -> list[dict]:
        return [{"name": n, **d} for n, d in sorted(self.catalog[collection].indexes.items())]

    def drop_index(self, collection: str, name: str) -> None:
        self.catalog[collection].indexes.pop(name, None)

    def ensure_collection(self, name: str, kind: str = "document") -> None:
        if name not in self.catalog:
            extra = ", _from string, _to string, relation_type string, confidence double" if kind == "edge" else ""
            self.catalog.register(name, self.spark.createDataFrame([], f"_key string, _id string{extra}"), kind=kind)

    def drop_collection(self, name: str) -> None:
        self.catalog.collections.pop(name, None)

    def collections(self) -> DataFrame:
        return self.catalog.listing()

    # -- graph and search -------------------------------------------------------

    def edges(self, collection: str, vertex: str, direction: str = "ANY") -> DataFrame:
        return traverse.neighbours(self.catalog[collection].df, vertex, direction)

    def traverse(self, edges: str, start: str, low: int = 1, high: int = 1, direction: str = "OUTBOUND", **options) -> DataFrame:
        return traverse.traverse(self.catalog[edges].df, start, low, high, direction, **options)

    def upsert_edge(self, edges: str, source: str, target: str, relation: str, fields: dict | None = None) -> dict:
        found = self.catalog[edges].df.filter((F.col("_from") == source) & (F.col("_to") == target) & (F.col("relation_type") == relation)).select("_key").first()
        document = {"_from": source, "_to": target, "relation_type": relation, **(fields or {})}
        return self.update(edges, found["_key"], fields or {}) if found else self.insert(edges, document)

    def vector_search(self, collection: str, vector: list[float], **options) -> DataFrame:
        return search.vector_search(self.catalog[collection].df, vector, **options)

    def text_search(self, collection: str, query: str, **options) -> DataFrame:
        return search.text_search(self.catalog[collection].df, query, **options)

    def hybrid_search(self, documents: str, chunks: str, query: str, vector: list[float], **options) -> DataFrame:
        return search.hybrid_search(self.catalog[documents].df, self.catalog[chunks].df, query, vector, **options)

    def semantic_search(self, chunks: str, query: str, embed: Callable[[str], list[float]], **options) -> DataFrame:
        return search.semantic_search(self.catalog[chunks].df, query, embed, **options)

    def graph_augmented_search(self, documents: str, edges: str, vector: list[float], **options) -> DataFrame:
        return search.graph_augmented_search(self.catalog[documents].df, self.catalog[edges].df, vector, **options)

    def need(self, collection: str, key: str) -> dict:
        found = self.document(collection, key)
        if found is None:
            raise UnknownDocument(f"{collection}/{key}")
        return found
