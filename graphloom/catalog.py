"""Collections: named DataFrames with a key, as documents or edges."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import UnknownCollection
from .functions.values import KEYS, NULL, Val, cast, common


@dataclass
class Collection:
    name: str
    df: DataFrame  # has _key and _id; edges have _from and _to
    kind: str = "document"
    version: int = 0
    indexes: dict[str, dict] = field(default_factory=dict)


class Catalog:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.collections: dict[str, Collection] = {}

    def register(self, name: str, df: DataFrame, key: str | Column | None = None, kind: str = "document", source: Column | None = None, target: Column | None = None) -> Collection:
        """``key``: a column or expression whose text becomes ``_key``. For edges,
        ``source`` and ``target`` give ``_from`` and ``_to`` where the table has none."""
        if key is not None:
            col = F.col(key) if isinstance(key, str) else key
            df = df.withColumn("_key", col.cast("string"))
        if "_key" not in df.columns:
            raise ValueError(f"{name} has no _key; name a key")
        if "_id" not in df.columns:
            df = df.withColumn("_id", F.concat(F.lit(name + "/"), F.col("_key")))
        if kind == "edge":
            if source is not None:
                df = df.withColumn("_from", source)
            if target is not None:
                df = df.withColumn("_to", target)
            for column, value in (("relation_type", F.lit("related_to")), ("confidence", F.lit(1.0))):
                if column not in df.columns:
                    df = df.withColumn(column, value)
        self.collections[name] = Collection(name, df, kind)
        return self.collections[name]

    def __getitem__(self, name: str) -> Collection:
        if name not in self.collections:
            raise UnknownCollection(name)
        return self.collections[name]

    def __contains__(self, name: str) -> bool:
        return name in self.collections

    def listing(self) -> DataFrame:
        """``name, kind, count`` of all collections by name: one job for each."""
        rows = [(n, c.kind, c.df.count()) for n, c in sorted(self.collections.items())]
        return self.spark.createDataFrame(rows, "name string, kind string, count long")

    def lookup(self, fields: set[str] | None, only: set[str] | None = None) -> DataFrame:
        """``id, doc``: documents of all (or ``only`` some) collections by id, with
        the fields asked for (None: all), so that scans read no others. Collections
        with none of these fields are left out: what is read of their documents is
        null either way."""
        some = [c for n, c in sorted(self.collections.items()) if only is None or n in only]
        wanted = (fields or set()) - {"_id"}
        if wanted and "_key" not in wanted:
            some = [c for c in some if wanted & set(c.df.columns)]
        if not some:
            return self.spark.createDataFrame([], "id string, doc struct<_id: string>")
        types: dict[str, list[T.DataType]] = {}
        for c in some:
            for f in c.df.schema:
                if fields is None or f.name in fields or f.name in ("_id",):
                    types.setdefault(f.name, []).append(f.dataType)
        merged = {n: common(t) for n, t in sorted(types.items())}
        merged = {n: T.StringType() if t == NULL else t for n, t in merged.items()}
        frames = []
        for c in some:
            have = {f.name: f.dataType for f in c.df.schema}
            parts = []
            for n, t in merged.items():
                if n in have:
                    parts.append(cast(Val(F.col(f"`{n}`"), have[n]), t).alias(n))
                else:
                    parts.append(F.lit(None).cast(t).alias(n))
            if fields is None and KEYS not in merged and len({frozenset(x.df.columns) for x in some}) > 1:
                parts.append(F.array(*map(F.lit, c.df.columns)).alias(KEYS))
            frames.append(c.df.select(F.col("_id").alias("id"), F.struct(*parts).alias("doc")))
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out
