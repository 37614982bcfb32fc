"""The ten operators over their whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, fingerprint, license_scan, log_suffix, packing, pivots, quality, simhash, suffix_tree, wavelet
from .common import documents


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir)).drop("spans")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)


def op3_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.digest(wavelet.write(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1))


def op4_log_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_suffix.digest(documents(spark, sf_dir), length=400)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), size=3, bits=2)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edited(documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.digest(documents(spark, sf_dir), length=20)


def op10_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_byte_bpe, op3_wavelet_matrix, op4_log_suffix_arrays, op5_simhash, op6_best_fit_packing, op7_fingerprints, op8_quality, op9_suffix_trees, op10_pivot_index)}

#: SQL can't express the methods; each query is tested against brute force.
ORACLES: dict[str, str] = {}
