"""From raw documents to packed token sequences, in five stages.

Each stage takes all that the one before it kept and gives a DataFrame with the
columns of documents, the last one the packed pieces. ``run`` writes each
stage's result to the shared folder and reads it again, so a lost executor
costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.llm import hamming_join, line_rules, packing, passages, sanitise
from gleanspark.runtime import broadcast_if_small, materialize


def _measured(documents: DataFrame) -> DataFrame:
    """``n_chars``, where there is one, follows the text; a null text keeps what it had."""
    if "n_chars" not in documents.columns:
        return documents
    kind = documents.schema["n_chars"].dataType
    return documents.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go; boilerplate lines go from the others."""
    return _measured(line_rules.clean(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    Rows with a null id stay, and rows that share an id stay or go together.
    """
    verdict = hamming_join.near_duplicates(docs, size=5, share=80)
    kept = verdict.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = materialize(kept.where("not kept").select("doc_id"), "near-copies")
    return docs.join(broadcast_if_small(gone), "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has go from the later ones.

    All rows stay. Null texts, texts under 50 words and rows with a null id stay as they are; rows that share an id are
    one document, lose the same words and never repeat each other; a copy of an earlier document loses all its words.
    """
    found = passages.spans(passages.repeated_passages(docs))
    return _measured(passages.without_passages(docs, found))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced by their kinds.

    All rows stay. A null text stays null, a text without personal data as it is; equal texts are treated alike whatever
    their ids, and count once in the statistics.
    """
    return _measured(sanitise.sanitise(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 2048 tokens.

    Every row is a document of its own, with a null id or a repeated one too; a null or empty text is one token.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("personal_data", personal_data),
    ("packing", pack),
]

# Minwise signatures, compact windows and a tokenizer have no form in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
