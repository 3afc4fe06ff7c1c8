"""The corpus pipeline: toxicity, near-dedup, substring dedup, secrets, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.
All but the last return the columns of documents.  Rows of one doc_id are one document
and stay or go together; rows with a null doc_id are judged by their text alone and take
no part in deduplication.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, minhash, packing, queries, secrets, substring, toxicity


def counted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is one, as the length of the text that the stage left."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier chain finds toxic."""
    return toxicity.keep_clean(docs, queries.toxicity_chain(spark, docs, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id."""
    found = minhash.near_duplicates(docs)
    others = found.where("doc_id is not null and not kept").select("doc_id").distinct()
    # both sides grow with the corpus: one plan at every size
    return docs.join(others.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller doc_id has too."""
    return counted(substring.cleaned(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced."""
    return counted(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of all texts."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), separator=0, longest=1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeats),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Trained models and tokenizers have no SQL form; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        last, docs = docs, common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.discard(last)  # the next stage reads this one's rows only
    return STAGES[-1][1](spark, docs, sf_dir)
