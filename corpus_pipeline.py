"""A corpus in five stages: quality rules, near-dedup, decontamination, secrets, packing.

Each stage is a function of (spark, docs, sf_dir) that works on all rows the one before it kept; all
but the last return the columns of ``documents``. Rows are handled as the operators define it: null
and empty texts fail the quality rules, repeated rows are near duplicates of each other, an empty
table passes through, and further columns of ``docs``, whatever their names, stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyfacet.llm import decontam, neardup, packing, rules, secrets
from keyfacet.llm.common import Located, discard, materialize, table
from keyfacet.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a learned rule rejects."""
    return rules.keep_good(docs, rules.learn_from(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of near duplicates."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets that aren't widely copied examples are replaced by their kind."""
    at = Located(docs)
    return secrets.redact(at, secrets.scan_secrets(at))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: The stages learn a list, sign sets and run a tokenizer: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; each result is written and read again, then dropped once it is used."""
    docs, written = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if written is not None:
            discard(written)
        written = docs
    packed = STAGES[-1][1](spark, docs, sf_dir)  # the pieces are written by now
    discard(written)
    return packed
