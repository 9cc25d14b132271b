"""The corpus pipeline: documents through five operators, each stage written and read again.

toxicity -> exact duplicates -> near duplicates -> mix of sources -> tokens.
Each function takes (spark, docs, sf_dir); all but the last return the columns of
documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from merchantry.llm import bpe, exact, minhash, mixing, toxicity
from merchantry.llm.common import table, written
from merchantry.llm.queries import toxic_model


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on the labelled ones among ``docs``, does not reject."""
    conf = toxicity.ToxicConfig()
    return toxicity.drop_toxic(docs, toxic_model(docs, table(spark, sf_dir, "labels"), conf), conf)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.drop_exact_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and all that are linked with nothing: five-word shingles, similarity of 0.8."""
    return minhash.drop_near_duplicates(docs, minhash.NearConfig(words=5, percent=80))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row."""
    return bpe.encoded_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mixing", mixed),
    ("bpe", tokens),
]

#: A trained model, sketches, random rounding and a tokenizer are beyond SQL; tests/llm holds each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
