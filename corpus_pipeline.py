"""A cleaning pipeline over `documents`: STAGES in order, each on all rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm.line_dedup import line_dedup
from corvane.llm.line_quality import keep_clean
from corvane.llm.near_copies import drop_near_copies
from corvane.llm.packing import pack
from corvane.llm.pii import pii_surrogates
from corvane.llm.support import Stored, spread, table
from corvane.storage import scope


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that the rules reject; null and empty texts are rejected. Repeated rows are judged alike, null ids like others."""
    return keep_clean(docs)


def frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents share go from all rows. Repeated rows of an id count once and null ids for none; null text becomes empty, and no row goes."""
    return line_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest id. Candidates come by SimHash fingerprints, and by keys
    where those differ too much; sets of five-word shingles decide.

    Repeated rows of that id all stay, rows of null ids too. Texts without words are copies of each other.
    """
    return drop_near_copies(docs)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets give way to surrogates under the session's key, or one drawn for the run. Null texts stay null; repeated rows change alike."""
    return pii_surrogates(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, placed in sequences. Null text is empty; repeated rows are packed once each."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", frequent_lines),
    ("simhash_near_dedup", near_duplicates),
    ("pii_surrogates", surrogates),
    ("best_fit_packing", packed),
]

#: Fingerprints, surrogates and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. Between stages, documents are written to the shared folder and read again; what a stage stored goes with it.

    Each stage takes an empty table, texts of any length and columns of any names, and returns the columns that it got.
    """
    store = Stored(spark, "pipeline")
    docs = spread(table(spark, sf_dir, "documents"))
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before = store.last if k else None
        with scope():
            docs = store.cut(stage(spark, docs, sf_dir))
        if before:
            store.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
