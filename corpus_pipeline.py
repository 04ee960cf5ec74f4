"""A training-data pipeline over ``documents``: language, near-duplicates, personal data, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs.  All but the last return the columns of docs.  Counted as part of ``lectern.llm``.

In every stage an empty table gives an empty one, repeated rows are rows of their own (but for near-duplicates, where the
first stays), very long texts are read whole, and columns that the stage doesn't name stay as they are, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import language, mixing, pieces, pii, simhash
from lectern.llm.common import materialize, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a settled language go, so null and empty texts do.  Of languages with equal scores the first by
    name counts, and the document stays."""
    return language.accepted_documents(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays; of rows that repeat an id, the one with the least hash.
    Rows with a null id stay; null and empty texts are one group."""
    return simhash.first_of_each_group(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data gives way to its kind's mask, overlapping ones to that of the first; n_chars follows
    the text.  Null texts stay null."""
    return pii.redact_documents(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, stay or go so that the sources' words near their targets.  Those without words go; equally long
    documents of a shard are ranked by id; a null source is a source."""
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids): one row for each row of docs; a null text has no ids, and of segmentations with equal scores the
    operator's rule decides."""
    return pieces.encode_documents(docs)


STAGES = [
    ("language ID", language_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("PII", personal_data_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding", token_stage),
]

#: The language model and the transducers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{number}")
    return docs
