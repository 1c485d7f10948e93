"""A corpus pipeline: language ID, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept.  All but the last return the columns of `documents`.

Defined results: a document whose text is null or has no letters goes with
language ID (so an empty text does); one whose source is null spreads no line
and is a source of its own in the mix; lang is only learned from, and may be
null; a null id is kept as such; of rows that share id and text one stays; an
empty table gives no rows; columns that documents does not have are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specblock.llm import decontamination, language_id, line_dedup, mixing, near_copies
from specblock.llm.common import read_table
from specblock.session import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose best language scores less resembles none of them.
MIN_LANGUAGE_SCORE = 0.2


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters or unlike every language of the labelled rows."""
    profiles = language_id.fit_profiles(docs)
    told = language_id.detect(docs, profiles, COLUMNS)
    return told.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that stand on many sites; every document stays."""
    kept = line_dedup.dedup_lines(docs, keep=["doc_id", "lang", "source"], spare_copies=True)
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, Jaccard 0.8 or more) stays."""
    return near_copies.one_of_each(docs).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    found = decontamination.contamination(docs, read_table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return found.where(~F.col("contaminated")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix and how many of their words it takes."""
    return mixing.mix(docs).where(F.col("taken") > 0)


STAGES = [
    ("language_id", keep_languages),
    ("line_dedup", drop_boilerplate),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
]

#: SQL cannot express rank-order profiles, fingerprints or hash-random order; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
