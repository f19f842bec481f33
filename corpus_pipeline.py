"""The corpus pipeline: documents to tokens in five stages, each written and read again.

Every stage takes what the one before it kept, whole. The first three drop
documents, the fourth rewrites texts, and the last returns the digests of the
tokens; all but the last return the columns of documents.

A row without a text, or without a letter in it, goes in the first stage. Rows
without a doc_id take part in every stage; columns of any name pass through, nulls
too. Repeated rows of a kept document all stay. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.bpe import default_path, digest_tokens
from quire.llm.common import stored, table
from quire.llm.decontaminate import drop_contaminated
from quire.llm.jaccard_join import keep_one
from quire.llm.language_id import UNKNOWN, predict, train
from quire.llm.secrets import redact_secrets

#: A document whose best language is less likely than this is rejected, as one without letters is.
LEAST_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network tells."""
    seen = predict(docs, train(docs), extra=True, names=("__lang", "__score"))
    return seen.where((F.col("__lang") != UNKNOWN) & (F.col("__score") >= LEAST_SCORE)).drop("__lang", "__score")


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest doc_id, of each component of near copies."""
    return keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return redact_secrets(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of the tokens of each document."""
    return digest_tokens(docs, default_path())


STAGES = [
    ("language ID", language_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("benchmark decontamination", benchmark_stage),
    ("secret scans", secret_stage),
    ("BPE encoding and decoding", token_stage),
]

#: The recurrent network can't be written in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
