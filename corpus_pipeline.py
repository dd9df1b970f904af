"""From raw documents to token ids, in five stages.

Every stage but the last returns the columns of documents; what it drops is
gone for those after it. Each result is written as a table in the shared
folder and read again, so that a lost executor repeats one stage at most.
Stages that pass whole texts through Python bound their batches, for the rest of
the session.

In every stage a null text is an empty one, other columns may be null and pass
unchanged whatever they are called, texts are read whole at any length, and an
empty table gives an empty one. What each does with repeated rows and with texts
that are empty or blank is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inspectra.llm import bpe, decontam, exact_dedup, near, quality
from inspectra.llm.common import bounded_batches, stored, table
from inspectra.llm.queries import word_bpe_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal rows stay or go together; empty texts are judged like others."""
    bounded_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of equal texts stays, also of repeated rows, and of all texts that
    are empty or blank."""
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, also of repeated rows; all texts without
    words are one group."""
    return near.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated rows stay or go together; empty and blank texts stay."""
    bounded_batches(spark)
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row, repeated ones too; an empty text has no tokens."""
    bounded_batches(spark)
    return bpe.digests(bpe.encode(docs, word_bpe_path()))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact deduplication", exact_copies),
    ("SimHash near-deduplication", near_copies),
    ("benchmark decontamination", decontamination),
    ("BPE encoding", encoding),
]

#: SQL can't express these stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return docs
