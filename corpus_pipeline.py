"""From raw documents to token files, stage after stage.

Every stage takes what its predecessor kept, is written as Parquet and read
again. run() returns the digest of the written token files, one row per
document of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runscore.llm.leakage import without_leaks
from runscore.llm.mixture import mixed
from runscore.llm.near_copies import one_of_each
from runscore.llm.queries import END_ID, TOKENIZER
from runscore.llm.store import Scratch, read_table
from runscore.llm.token_files import token_digests, write_token_files
from runscore.llm.toxic_passages import fit_passages, without_toxic


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3 for toxicity; the model is fitted on the labelled ones among docs."""
    return without_toxic(docs, fit_passages(docs, read_table(spark, sf_dir, "labels")), 0.3)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return one_of_each(docs, width=5, num=80, den=100)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage."""
    return without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def weighted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixed(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents; doc_id, start, n_tokens and ids_crc32 read back from them."""
    path = Scratch(spark, "corpus-tokens").path("tokens")
    write_token_files(docs, path, TOKENIZER, END_ID)
    return token_digests(spark, path)


STAGES = [
    ("toxicity", not_toxic),
    ("near_copies", distinct),
    ("decontamination", decontaminated),
    ("mixture", weighted),
    ("token_files", tokenized),
]

ORACLE_SQL = None  # only the last two stages could be written in SQL; tests hold single operators against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "corpus-pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"{number}-{name}")
        if number:
            scratch.drop(f"{number - 1}-{STAGES[number - 1][0]}")
    return docs
