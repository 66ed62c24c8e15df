"""A training-data pipeline over ``documents``: each stage takes what its predecessor kept.

Every stage is a function of (spark, docs, sf_dir); its rows are written as Parquet in the shared
folder and read again as the next one's ``docs``. All but the last return the columns of
``documents``; texts that a stage changes keep their id, and ``n_chars`` follows them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import line_dedup, mixing, quality_rules, simhash
from strandloom.llm.queries import bpe_digests
from strandloom.session import stash

#: Texts are candidates if one of so many fingerprints differs in so many bits; 0.8 of the shingles alike means 10 of 64 bits on average.
NEAR_WORDS64, NEAR_RADIUS, NEAR_SHINGLE, NEAR_SIMILARITY = 3, 9, 5, 0.8
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no rule of the latest policy."""
    rows = quality_rules.ledger(docs)
    return rows.where(~quality_rules.fails(quality_rules.POLICIES[-1])).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that repeat across documents."""
    rows = line_dedup.dedup_lines(docs)
    return rows.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest id.

    Near duplicates share five-word shingles to a similarity of 0.8 or more, which prints find and the sets themselves confirm.
    """
    found = simhash.one_of_each(docs, radius=NEAR_RADIUS, shingle=NEAR_SHINGLE, similarity=NEAR_SIMILARITY, words64=NEAR_WORDS64)
    return found.select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights; a document is there once for each copy taken."""
    return mixing.mixed(mixing.plan_mix(docs)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the mix, one row for each copy."""
    return bpe_digests(docs, ["doc_id", "source"])


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("source mixing", mix), ("tokens", tokens)]
#: SimHash components and BPE have no SQL form; the tests hold run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
