"""A corpus from documents to token ids, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents. No stage fails on nulls
in any column, on repeated rows or ids, or on an empty table, which gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinsift.llm import bpe, mixing, quality, simhash, substring
from kinsift.llm.common import read
from kinsift.storage import materialize


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores at least 0.7; the others go. Null and empty texts are scored like any; equal rows share their fate."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"), threshold=0.7)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest doc_id. Null, empty and wordless texts are one class; a class of null ids keeps one row."""
    return simhash.deduplicate(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller doc_id has too. Rows with null ids or texts stay as they are; a document all of whose words go goes."""
    return substring.cut_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: never where it has no words. A null source is a source."""
    return mixing.mixed(docs, weights=(5, 2, 1), share=1.5, most=2.0)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the text, their number, and digests of the ids and of what they decode to, for every row. A null text is the empty one."""
    return bpe.round_trip(docs, bpe.vocabulary(), with_ids=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("encode_bpe", encode_bpe),
]

#: SQL has neither XXH64 nor the classifier: tests compare run() with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
