"""Dumps: a folder of JSON-lines files for each collection.

``NAME.structure.json`` says the kind and indexes of a collection (``parameters.type``
2: documents, 3: edges); ``NAME.data.json`` (also ``.gz``, or parts
``NAME.N.data.json``) holds its records, plain or enveloped as ``{"type": 2300,
"data": {...}}``. Everything is checked before anything is published.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadKey, Conflict, QueryError, TypeMismatch
from ..functions.values import KEYS

DATA = re.compile(r"^(?P<name>.+?)(?:_[0-9a-f]{32})?(?:\.\d+)?\.data\.json(?:\.gz)?$")
STRUCTURE = re.compile(r"^(?P<name>.+?)(?:_[0-9a-f]{32})?\.structure\.json$")
IGNORED = {"dump.json", "ENCRYPTION"}


def layout(spark, folder: str) -> dict[str, dict]:
    """Files of each collection. Unknown files are refused."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    found: dict[str, dict] = {}
    for f in files:
        name = f.getPath().getName()
        if name in IGNORED or f.isDirectory():
            continue
        if m := DATA.match(name):
            found.setdefault(m["name"], {"data": []}).setdefault("data", []).append(f.getPath().toString())
        elif m := STRUCTURE.match(name):
            found.setdefault(m["name"], {"data": []})["structure"] = f.getPath().toString()
        else:
            raise QueryError(f"{name} is no file of a dump")
    for name, parts in found.items():
        if "structure" not in parts:
            raise QueryError(f"{name} has no structure file")
    return found


def records(spark, paths: list[str]) -> DataFrame:
    """Records with ``_key`` and the list of their fields. A line that is no JSON
    object is an error."""
    raw = spark.read.text(paths).filter("trim(value) <> ''")
    if raw.filter(F.json_object_keys("value").isNull()).limit(1).count():
        raise QueryError("a line is no JSON object")
    enveloped = F.get_json_object("value", "$.type").isin("2300", "2301") & F.get_json_object("value", "$.data").isNotNull()
    removed = F.get_json_object("value", "$.type") == "2302"
    if raw.filter(removed).limit(1).count():
        raise QueryError("removal markers aren't supported")
    raw = raw.select(F.when(enveloped, F.get_json_object("value", "$.data")).otherwise(F.col("value")).alias("value")).filter("value is not null")
    schema = spark.read.option("prefersDecimal", False).json(raw.rdd.map(lambda r: r[0])).schema
    keys = F.array_except(F.json_object_keys("value"), F.array(F.lit("_rev")))
    df = raw.select(F.from_json("value", T.StructType([f for f in schema if f.name != "_rev"])).alias("d"), keys.alias(KEYS))
    return df.select("d.*", KEYS)


def load(engine, folder: str, limit: int | None = None) -> dict[str, int]:
    """Import a dump; the number of documents of each collection. Keys must be
    present and unique, ids must fit, edges must have ends that exist."""
    spark = engine.spark
    frames: dict[str, tuple[DataFrame, str, list]] = {}
    counts: dict[str, int] = {}
    for name, files in layout(spark, folder).items():
        text = spark.read.option("wholetext", True).text(files["structure"]).first()["value"]
        spec = json.loads(text)
        kind = "edge" if spec.get("parameters", {}).get("type") == 3 else "document"
        if not files["data"]:
            raise QueryError(f"{name} has no data file")
        df = records(spark, files["data"])
        if "_key" not in df.columns or df.filter("_key is null or _key = ''").limit(1).count():
            raise BadKey(f"{name}: a record has no _key")
        if df.groupBy("_key").count().filter("count > 1").limit(1).count():
            raise Conflict(f"{name}: a key occurs twice")
        identity = F.concat(F.lit(name + "/"), "_key")
        if "_id" in df.columns and df.filter(F.col("_id") != identity).limit(1).count():
            raise BadKey(f"{name}: an _id doesn't fit its _key")
        df = df.withColumn("_id", identity).withColumn(KEYS, F.array_union(KEYS, F.array(F.lit("_id"))))
        if kind == "edge" and ({"_from", "_to"} - set(df.columns) or df.filter("_from is null or _to is null").limit(1).count()):
            raise TypeMismatch(f"{name}: an edge has no _from or _to")
        counts[name] = df.count()
        if limit is not None and counts[name] > limit:
            raise QueryError(f"{name} has over {limit} documents")
        frames[name] = (df, kind, [i for i in spec.get("indexes", []) if i.get("unique") and i.get("type") in ("persistent", "hash")])
    ids = None
    for df, _, _ in frames.values():
        ids = df.select("_id") if ids is None else ids.unionByName(df.select("_id"))
    for name, (df, kind, _) in frames.items():
        if kind == "edge":
            ends = df.select(F.explode(F.array("_from", "_to")).alias("_id"))
            if ends.join(ids, "_id", "left_anti").limit(1).count():
                raise QueryError(f"{name}: an edge has an end that doesn't exist")
    from ..operators.mutate import check_unique, publish

    for name, (df, _, indexes) in frames.items():
        check_unique({str(i): {**x, "unique": True} for i, x in enumerate(indexes)}, df, name)
    for name, (df, kind, indexes) in frames.items():
        engine.catalog.register(name, df, kind=kind)
        for i, x in enumerate(indexes):
            engine.catalog[name].indexes[x.get("name", f"unique_{i}")] = {"fields": x["fields"], "unique": True, "sparse": x.get("sparse", False), "type": "persistent"}
        publish(engine, name, df)
    return counts


def save(engine, folder: str, names: list[str] | None = None) -> None:
    """Write collections as dumps, a folder of JSON lines and a structure each."""
    for name, c in sorted(engine.catalog.collections.items()):
        if names is not None and name not in names:
            continue
        c.df.drop(KEYS).write.mode("error").json(f"{folder}/{name}.data")
        spec = json.dumps({"parameters": {"name": name, "type": 3 if c.kind == "edge" else 2}, "indexes": engine.indexes(name)})
        engine.spark.createDataFrame([(spec,)], "value string").coalesce(1).write.text(f"{folder}/{name}.structure")
