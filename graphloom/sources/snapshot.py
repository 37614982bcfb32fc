"""JSON snapshots: ``{"collections": {name: {"type", "documents": {key: doc}}}}``.

The format is one JSON object, so a snapshot is read and written by the driver;
for large collections use Parquet tables or dumps (:mod:`.dump`).
"""

from __future__ import annotations

import json

from ..functions.values import as_json
from ..operators.mutate import frame, upsert_documents


def load(engine, data: dict | str) -> None:
    """Import a snapshot (data, or the path of a file): additive, and documents
    with the same key are overwritten."""
    if isinstance(data, str):
        rows = engine.spark.read.option("wholetext", True).text(data).collect()
        data = json.loads(rows[0]["value"])
    for name, c in data["collections"].items():
        documents = [{**d, "_key": k, "_id": f"{name}/{k}"} for k, d in c["documents"].items()]
        kind = c.get("type", "document")
        if name in engine.catalog:
            upsert_documents(engine, name, documents, list(c["documents"]))
        elif documents:
            engine.catalog.register(name, frame(engine, documents), kind=kind)
        else:
            engine.ensure_collection(name, kind)
        for index in c.get("indexes", []):
            engine.ensure_index(name, index["name"], index["fields"], index.get("unique", True), index.get("sparse", False))


def export(engine, names: list[str] | None = None) -> dict:
    """A snapshot of some or all collections."""
    out = {}
    for name, c in sorted(engine.catalog.collections.items()):
        if names is None or name in names:
            documents = {r["_key"]: as_json(r) for r in c.df.orderBy("_key").collect()}
            out[name] = {"type": c.kind, "documents": documents}
            if c.indexes:
                out[name]["indexes"] = engine.indexes(name)
    return {"collections": out}
