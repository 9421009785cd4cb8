"""A training corpus in five stages; each takes the documents that its predecessor kept.

All stages take nulls in any column, empty and very long texts, repeated rows, empty tables and
extra columns of any name, which pass through; each one's rules for them stand at its operator.
n_chars follows the text where the table has that column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratafind.llm import mixing, ngram_join, packing, pii, toxicity
from stratafind.llm.common import Workspace, free_names, table
from stratafind.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is 0.5 or more go."""
    (score,) = free_names(docs.columns, "_toxicity")
    scored = toxicity.toxicity(spark, docs, table(spark, sf_dir, "labels"), score)
    return scored.filter(F.col(score) < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group that five-word shingles link at 0.8."""
    return ngram_join.keep_one(spark, docs, k=5, num=80, den=100)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Validated numbers, dates and addresses become pseudonyms; n_chars follows the text."""
    out = pii.pseudonymise(docs, counted=False)
    if "n_chars" in docs.columns:
        size = F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.coalesce(size, F.col("n_chars")))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources get their target weights: documents repeat up to twice, some are left out."""
    return mixing.repeat_documents(spark, docs, (5.0, 2.0, 1.0), 1.5, 2.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 4096."""
    return packing.pack(spark, docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("pii", hide_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier, the pseudonyms and the tokenizer are not SQL. The tests hold run()'s rows against a plain
#: chain of the stages, of which only the classifier's verdicts are taken from the operator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read by the next."""
    work, docs = Workspace(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
