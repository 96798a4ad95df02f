"""Queries over the operators with production parameters, one opN_<name> each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import block_max, bm25_packing, centroid_lang, cut_index, line_crf, mixing, noisy_or, odd_sketch, oracles, piece_merges, pii_surrogates, pigeonhole_join, plane_store, suffix_dedup
from .common import load_documents


def op1_pigeonhole_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pigeonhole_join.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.93)


def op2_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return noisy_or.toxicity(load_documents(spark, sf_dir), labels, modulus=3, remainder=1, threshold=0.7)


def op3_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_packing.packed(load_documents(spark, sf_dir), window=1024, end_id=0)


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_surrogates.replaced(load_documents(spark, sf_dir), key="key of the query", count="n_mentions")


def op5_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return line_crf.quality(load_documents(spark, sf_dir), labels)


def op6_centroid_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_lang.languages(load_documents(spark, sf_dir), modulus=5, remainder=0)


def op7_suffix_lpf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(load_documents(spark, sf_dir), length=50, keep_text=False)


def op8_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.near_duplicates(load_documents(spark, sf_dir), size=2, percent=80)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(load_documents(spark, sf_dir), weights=(3, 1, 2), share=1.5, limit=2)


def op10_plane_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plane_store.round_trip(load_documents(spark, sf_dir), end_id=2)


def op11_cut_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_index.digests(load_documents(spark, sf_dir), seed=1)


def op12_piece_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_merges.round_trip(load_documents(spark, sf_dir))


def op13_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_max.ranked(load_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=50)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """Those without a fitted model, a tokenizer or a keyed stream."""
    return {"op1_pigeonhole_join": oracles.OP1, "op7_suffix_lpf": oracles.OP7, "op8_odd_sketch": oracles.OP8, "op9_mixing": oracles.OP9, "op11_cut_index": oracles.OP11, "op13_block_max": oracles.OP13}
