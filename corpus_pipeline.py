"""A training-corpus pipeline: quality, near duplicates, secrets, mixture, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkrag.llm import mixing, packing, partenum, quality, secretscan
from sparkrag.llm.common import documents, stored
from sparkrag.llm.queries import tokenizer_path
from sparkrag.shipping import ship


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade is at least one half."""
    ship(spark)
    return quality.select(docs, quality.fit(docs, documents(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of every class of documents linked by a Jaccard similarity of 0.8 or more of their 5-word shingles."""
    ship(spark)
    return partenum.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced."""
    ship(spark)
    return secretscan.redact(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at the rates that bring the domains' tokens to their targets."""
    return mixing.select(docs, documents(spark, sf_dir, "labels"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    ship(spark)
    return packing.digest(packing.pack(docs, tokenizer_path()))


STAGES = [
    ("quality", select_quality),
    ("near_copies", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_domains),
    ("packing", pack_sequences),
]

# Tokenizers, fits and classes have no SQL form; tests/llm holds run() against a plain version on sf0.001, and runs it on odd and empty tables.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is stored in the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
