"""The analytic tables as collections, and edges between them."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..engine import Engine

#: Key of each table. Fixed values.
KEYS_OF = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "labels": "doc_id", "benchmark": "item_id", "pages": "page_id", "embeddings": "vec_id"}
#: Edges by foreign key: name -> (table, key of the source, collection and column of the target). Fixed values.
EDGES_OF = {"customer_nation": ("customer", "c_custkey", "nation", "c_nationkey"), "nation_region": ("nation", "n_nationkey", "region", "n_regionkey"), "order_customer": ("orders", "o_orderkey", "customer", "o_custkey"), "supplier_nation": ("supplier", "s_suppkey", "nation", "s_nationkey")}


def engine_over(spark: SparkSession, folder: str, tables: list[str] | None = None) -> Engine:
    """An engine whose collections are the tables in a folder."""
    engine = Engine(spark)
    wanted = tables or [*KEYS_OF, "lineitem", "conversations", *EDGES_OF, "geo"]
    for name in wanted:
        if name in KEYS_OF:
            engine.register(name, spark.read.parquet(f"{folder}/{name}.parquet"), KEYS_OF[name])
        elif name == "lineitem":  # its numbers aren't unique; the key only names rows
            engine.register(name, spark.read.parquet(f"{folder}/{name}.parquet"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
        elif name == "conversations":
            engine.register(name, spark.read.parquet(f"{folder}/{name}.parquet"), F.concat_ws("-", "conv_id", "turn"))
        elif name in EDGES_OF:
            engine.register(name, edges(spark, folder, name), kind="edge")
        elif name == "geo":
            parts = [edges(spark, folder, n) for n in ("order_customer", "customer_nation", "nation_region")]
            engine.register(name, parts[0].unionByName(parts[1]).unionByName(parts[2]), kind="edge")
    return engine


def edges(spark: SparkSession, folder: str, name: str):
    table, key, target, column = EDGES_OF[name]
    df = spark.read.parquet(f"{folder}/{table}.parquet")
    confidence = F.lit(1.0)
    if table == "orders":
        confidence = F.lit(1.0) - F.pmod(F.col("o_orderkey"), F.lit(10)) / 20.0
    return df.select(
        F.concat(F.lit(f"{table}-"), F.col(key).cast("string")).alias("_key"),
        F.concat(F.lit(f"{table}/"), F.col(key).cast("string")).alias("_from"),
        F.concat(F.lit(f"{target}/"), F.col(column).cast("string")).alias("_to"),
        F.lit(f"of_{target}").alias("relation_type"),
        confidence.cast("double").alias("confidence"),
    )
