"""A training-data pipeline over documents, from the operators in quillgraph.llm.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All
but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import bm25_packing, centroid_lang, mixing, odd_sketch, pii_surrogates
from quillgraph.llm.common import materialize

#: The setting that holds the key of the surrogates, and the key without it; one of your own keeps them from being drawn by others.
PII_SETTING, PII_KEY = "spark.quillgraph.pii.key", "corpus pipeline"
#: No SQL states the classifier, the schedule and the packing; tests compare with plain versions.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (also those with a null or empty text) or too far from every learned language go.

    Each row is judged by its text alone, so equal rows stay or go together; all columns stay.
    If no row has a text with a letter and a lang, or the table is empty, nothing is left.
    """
    model = centroid_lang.train(docs)
    columns = docs.columns
    renamed = docs.toDF(*(c if c in ("text", "doc_id") else f"c{i}" for i, c in enumerate(columns)))
    kept = centroid_lang.predicted(renamed, model).where("not rejected")
    return kept.select(*(F.col(x).alias(c) for x, c in zip(renamed.columns, columns)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles one stays, one with the smallest doc_id of its group.

    Rows are told apart by row, not by id: those that share an id stay if their texts differ.
    Rows with a null id, a null or empty text or no word are linked with nothing and all stay.
    """
    return odd_sketch.deduplicated(docs, size=5, percent=80)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in text is replaced, n_chars follows; every row and column stays, null and empty texts as they are."""
    out = pii_surrogates.replaced(docs, key=spark.conf.get(PII_SETTING, PII_KEY))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut or repeated to their target weights; a null source is one of its own.

    Rows without a word have no size and are not taken; each of several equal rows is a row of
    its own; an empty table stays empty.
    """
    return mixing.mixed_documents(docs, weights=(3, 1, 2), share=1.5, limit=2)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 1024 ids, a row a piece; a null or empty text is its end id alone, equal rows are packed each, an empty table gives no piece."""
    return bm25_packing.packed(docs, window=1024, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id), ("near_dedup", near_dedup), ("pii", surrogates), ("mixing", mixed), ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
