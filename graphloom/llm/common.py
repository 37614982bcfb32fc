"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a session on one machine names none (tests, a laptop) a temporary folder
    is made and set, so that later calls agree on it; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


ROWS = 1024


def saved(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage and survives lost executors, unlike a local checkpoint. Where it
    is known that there are about ``rows`` rows, no more tasks write than have
    :data:`ROWS` each: Hadoop's local file system launches ``chmod`` three times a file.
    """
    spark = df.sparkSession
    if rows is not None and (few := max(1, -(-rows // ROWS))) < partitions(spark):
        df = df.coalesce(few)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Python workers get at most 16 MB of rows at a time (one row, if that is
    larger), as they hold several times a batch. A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES or int(now.rstrip("b")) <= 0:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def forget() -> None:
    """What tokenizers have learned in this worker goes; it loads anew in a fifth of a second."""
    for module, cached in (("word_bpe", "word_encoder"), ("byte_bpe", "encoder")):
        if module := sys.modules.get(f"{__package__}.{module}"):
            getattr(module, cached).cache_clear()


def lean(run: Callable, keep: bool = False) -> Callable:
    """``run`` for ``mapInArrow``. Workers serve tasks of all operators in turn, so each task
    drops the tokenizers of others, unless told to ``keep`` them, and when it ends what
    allocators hold for later goes back to the system."""

    @functools.wraps(run)
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep:
            forget()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return each


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator reads; a null text becomes empty."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", *more, F.coalesce("text", F.lit("")).alias("text"))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, without decoding; null gives ``b""``."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column from numpy arrays, without a Python object per item."""
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
