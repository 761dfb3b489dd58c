"""The corpus pipeline: quality rules, near-dedup, decontamination, secret redaction, source mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents. Columns that
a stage doesn't know, whatever their names, go along unread; an empty table gives an empty one.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from evidentia.llm import decontaminate, mixing, quality, secrets, simhash
from evidentia.session import load
from evidentia.staging import settle


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose source isn't rejected.

    A null or empty text fails; a null source is a source of its own; repeated rows each stay or go.
    """
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group that is alike in 0.8 or more of its five-word shingles.

    Texts that differ are told apart even under one doc_id; rows without a doc_id come last and go if
    an alike one stays; null and blank texts are alike; rows equal in every column are one.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts stay; repeated rows each stay or go."""
    return decontaminate.remove(docs, load(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by their kind and n_chars kept right. A null text stays null."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with its shard and place in the shard's order, sorted by both.

    Documents without words aren't taken; rows equal in every column are taken alike; a document taken
    in part has its first words; columns named mix_shard or mix_order come out with `_input` after it.
    """
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_redaction),
    ("source_mix", source_mix),
]

# SimHash and edit distance have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; a row for each copy of a document in the mix."""
    docs = load(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = settle(spark, partial(apply, spark, docs, sf_dir), name)
    return docs
