"""A graph kept up to date while chunks arrive.

Each micro-batch of chunks is built anew (:func:`..operators.construct.ingest`): what
was derived from a chunk before is replaced. A version remembers the stream (its
checkpoint) and the batch that made it, so a replayed batch is passed over; a new
stream on the same folder goes on from the newest version. One stream at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.construct import Space, ingest, materialise

PARTS = ("entities", "chunks", "mentions", "facts")


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame] | None:
    """The newest complete version of the graph in a folder."""
    _, done = versions(spark, folder)
    return {p: spark.read.parquet(f"{folder}/v{done[-1]}/{p}") for p in PARTS} if done else None


def versions(spark: SparkSession, folder: str) -> tuple[list[int], list[int]]:
    """All versions in a folder, and those that are complete; ascending."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at(folder)):
        return [], []
    names = [s.getPath().getName() for s in fs.listStatus(at(folder))]
    every = sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())
    return every, [n for n in every if fs.exists(at(f"{folder}/v{n}/DONE/_SUCCESS"))]


def store(spark: SparkSession, graph: dict[str, DataFrame], folder: str, source: str, number: int, keep: int = 2) -> None:
    """Write the next version, with the stream and the batch that it is from; it counts
    once this mark is there. Of older versions, ``keep`` complete ones stay."""
    every, done = versions(spark, folder)
    version = (every[-1] if every else -1) + 1
    for p in PARTS:
        graph[p].write.parquet(f"{folder}/v{version}/{p}")
    spark.createDataFrame([(source, number)], "source string, number long").coalesce(1).write.parquet(f"{folder}/v{version}/DONE")
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for old in [n for n in every if n not in done[-keep:]]:
        fs.delete(at(f"{folder}/v{old}"), True)


def follow(chunks: DataFrame, space: Space, folder: str, checkpoint: str) -> StreamingQuery:
    """Build the graph in ``folder`` from a stream of chunks (``id``, ``text``), with
    what is there now, and stop."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        _, done = versions(spark, folder)
        if done and (last := spark.read.parquet(f"{folder}/v{done[-1]}/DONE").first())["source"] == checkpoint and last["number"] >= number:
            return  # a replay of a batch that is in already
        # of a chunk that came twice in a batch, one text counts
        df = df.groupBy("id").agg(F.max("text").alias("text"))
        old = load(spark, folder)
        store(spark, ingest(old, df, space) if old else materialise(df, space), folder, checkpoint, number)

    return chunks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
