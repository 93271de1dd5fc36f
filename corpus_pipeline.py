"""The corpus pipeline: documents through the stages below, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. Tables that a stage needs besides
(the benchmark) are read from sf_dir. Nulls, empty tables and further columns: as each operator's module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm import decontaminate, langid, near_copies, pii, transducer
from panelloom.llm._common import Scratch, is_held_out, table
from panelloom.llm.token_file import public_path

#: Share of a text that its main language has at least.
MAIN_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents without a main language: null texts, texts without a letter, and texts of which no learned language has
    a share of `MAIN_SHARE`."""
    model = langid.fit(docs.where(~is_held_out()))
    return langid.keep_identified(docs, model, MAIN_SHARE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near duplicates (links: Jaccard similarity of five-word shingles of 0.8 or more),
    the one with the smallest id. Rows are told by id and text; rows without an id stay."""
    return near_copies.one_of_each(docs, size=5, similarity=0.8)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in angle brackets."""
    return pii.redact(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts: doc_id, lang, source, n_chars, ids and n_ids."""
    return transducer.encode(docs, public_path("piece_bpe_32k.model"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("personal_data", personal_data),
    ("pieces", pieces),
]

#: SQL has neither the language model nor the transducer; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.keep(docs, name)
    return docs
