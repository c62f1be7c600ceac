"""The corpus pipeline: language ID, near-dedup, substring dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's
docs.  All but the last return the columns of documents; the last returns the packed pieces.

Every stage works on rows: rows with one id, or without one, are judged each by their own text (two places where ids do
count are named below).  Texts of any length are taken whole.  An empty table gives an empty one.  Extra columns, whatever
their names, stay up to packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, langid, packing, simhash, substr
from tidemark.llm.common import made, materialize, release_since, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the labelled ones show; rejected ones go.

    Null texts and those without a letter go; null languages teach nothing, but their rows are judged like any other; a text
    as near to two languages stays, whichever it is given; repeated rows stay or go together.  Without a labelled row all go.
    """
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, that with the smallest id.

    Operator 1's contract binds: 4-word shingles, links at 4 bits.  Near copies further apart stay (README, known limits).
    Null, empty and word-less texts are one group; of rows that share the smallest id and the fingerprint the one with the smallest
    hash stays; a row without an id stays only if its group has no row with one; an id of two texts in two groups stays in both.
    """
    return simhash.keep_first(docs, words=4, most_bits=4)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that stand earlier are cut; documents of which nothing is left go.

    Earlier is a smaller id, null ids last.  Rows that share an id and a place in it are not earlier than one another, so
    equal rows with one id keep their words.  Null and empty texts and those shorter than a window stay as they are.
    """
    return substr.dedup_text(docs, window=20)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, row by row: a clean row stays beside a hit one of the same or no id.

    Null and word-less texts are clean; items without words hit nothing; an empty benchmark leaves all; equal rows go together.
    """
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts pack as the end token alone; repeated rows and rows without an id are packed each.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Language centroids and best-fit can't be put into SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents.  Once a stage's result is written, its own tables and the result before it are deleted."""
    docs, mark = table(spark, sf_dir, "documents"), len(made)
    for name, stage in STAGES:
        docs, path = materialize(stage(spark, docs, sf_dir), name)
        release_since(spark, mark, keep=(path,))
    return docs
