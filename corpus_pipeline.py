"""The training-data pipeline: quality, exact dedup, near dedup, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the runner
writes it as Parquet and reads it back as the next stage's ``docs``, and then
deletes the tables that the stage left in the shared folder.

Defined results: a null text is an empty one, which the quality rules reject; a
document without doc_id passes all stages but exact dedup keeps it only where no
copy has one; of rows that repeat a doc_id and its text one stays; an empty table
gives an empty result; all stages but the last return the columns of documents,
and further ones, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, exact_dedup, near_dedup, packing, quality, secrets_scan
from millrace.llm._shared import materialize, read_table, sweep

#: Per cent of shared shingles from which two documents are near copies.
NEAR = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact_dedup.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of near copies the one with the smallest doc_id stays."""
    return near_dedup.keep_first(docs, NEAR)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; no document is dropped."""
    return secrets_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and place."""
    return packing.pack(docs, bpe.load_vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("minhash near-dedup", near_copies),
    ("secret scan", secrets),
    ("best-fit packing", pack),
]

#: Quantile sketches, the near-dedup forest, the random forest and the packing search have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        sweep(spark, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
