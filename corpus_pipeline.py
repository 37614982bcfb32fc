"""A training-corpus pipeline: what is kept of ``documents``, packed.

Each stage works on all that the one before kept and returns the columns of
``documents``; the last returns the packed sequences. Stages write nothing
themselves: :func:`run` writes each result as Parquet in the shared folder and
reads it again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import packing, quality, simhash, suffix_tree
from graphloom.llm.common import saved

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of ``documents`` and no others, whatever a table adds."""
    return docs.select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    network = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _columns(quality.scores(_columns(docs), network).filter("score >= 0.3"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents (five-word shingles, 0.8) the one with
    the least doc_id."""
    return _columns(simhash.representatives(_columns(docs), size=5, similarity=0.8))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 20-word passages that occur earlier. A text
    without repeats stays as it is; one with nothing left is dropped."""
    cut = suffix_tree.dedup(_columns(docs), length=20, only_cut=True).filter("n_removed = 0 or n_removed < n_words")
    size = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return _columns(cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", size.alias("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [("quality classifier", keep_quality), ("SimHash near-dedup", drop_near_copies), ("substring dedup", cut_repeats), ("best-fit packing", pack)]
#: SQL can express none of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
