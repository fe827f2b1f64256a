"""The corpus pipeline: quality rules, SimHash near-dedup, substring dedup, PII, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents, with n_chars brought up to date where a text has changed.

All stages: rows with a null id go through them (quality judges them, the two dedup stages leave them alone); other columns may
hold nulls and have any names; very long texts are handled whole; an empty table gives an empty table. What each does with null
and empty texts, ties and repeated rows stands at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import op1_packing, op2_quality, op3_simhash, op4_substring, op10_pii
from lodestone.llm.common import discard, materialise, table


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the classifier rejects go; null and empty texts have no words and fail. Rows are
    judged one by one, so repeated rows fare alike, and a probability at the threshold passes."""
    return op2_quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the least id, under one id the text with the least hash, of rows equal
    in both one. Unlike texts under one id don't stand for each other. Texts without words (null, empty) are one group."""
    return op3_simhash.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A passage that several documents share stays in the first of them only, by id; rows equal in id and text are one document
    and lose the same. Null and empty texts stay; a document that nothing is left of goes."""
    return _counted(op4_substring.without_passages(docs, op4_substring.passages(docs)))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind. All rows stay, repeated ones too; a null text stays null, an empty one empty."""
    return _counted(op10_pii.redacted_documents(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row per piece of a document with its place; a null or empty text is the end id alone, and repeated rows
    have places of their own."""
    return op1_packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("pii", pii),
    ("best_fit_packing", packing),
]

#: Hashed features, fingerprints and alignments have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*written)  # what the stage before had returned
        written = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
