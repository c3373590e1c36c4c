"""The corpus pipeline: five stages over the table ``documents``, each one operator of ``tidemark.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written as Parquet and read again. All stages but the
last return the columns of ``documents``. Edge cases are those of the operators: null and empty texts pass the filters, a table without rows gives
none, repeated rows are treated alike. After ``mixing``, a document can stand in several rows (one for each epoch), so ids repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import jaccard, mixing, pii, tokens, toxicity
from tidemark.llm.shared import stored

#: The mixture's budget of the tokens that reach it, in percent, and how often a document may be taken.
MIX_PERCENT, MIX_EPOCHS = 90, 2


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least the toxicity threshold go."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard.deduplicated(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts give way to their kind in brackets."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture by target weights of domains, languages and sources."""
    return mixing.mixed_documents(docs, percent=MIX_PERCENT, max_epochs=MIX_EPOCHS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, as digests, with the round trip's."""
    return tokens.bpe_digests(docs, tokens.tokenizer_path(spark))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]
#: Fitted scores and byte-pair merges are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
