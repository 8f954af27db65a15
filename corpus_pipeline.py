"""The corpus pipeline: five operators of cohortlens.llm applied in turn to ``documents``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that ``run`` writes
as Parquet to the shared folder and rereads as the next stage's docs.  All but
the last return the columns of documents.

1. quality_rules: documents that the strict policy rejects go.
2. line_dedup: repeated lines go from the texts; every document stays.
3. near_duplicates: of each SimHash class the document with the smallest id stays.
4. decontaminate: documents that overlap a benchmark item go.
5. sentencepiece: token ids, their number, and whether they decode to the text.

Nulls: a null text counts as empty (the quality rules reject it); rows that
share an id are one document where a stage decides by id, and a row without an
id is a document of its own, known by its text.  Empty texts are rejected; texts
of any length are worked on whole; ties are settled by the smaller id, then the
smaller text; repeated rows are judged alike (near_duplicates keeps one); empty
tables give an empty result; other columns pass through to the last stage,
whatever their names.
"""

from __future__ import annotations

from typing import Callable, List, Optional, Tuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import decontaminate as op5
from cohortlens.llm import line_dedup as op9
from cohortlens.llm import quality_rules as op8
from cohortlens.llm import sentencepiece_codec as op7
from cohortlens.llm import simhash as op10
from cohortlens.llm.common import read_table, stage_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the strict policy keeps; the row travels as one struct, so its names cannot clash."""
    row = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), "doc_id", "text")
    return op8.apply_policy(op8.ledger(row, keep=["_row"]), op8.STRICT).select("_row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op9.drop_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: its smallest id, and of its rows that share that id the one with the
    smallest text.  Of a class's rows without an id the one with the smallest text stays as well."""
    return op10.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op5.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and exact: the ids decode to the very text."""
    tokens = op7.encode(docs, decoded_col="decoded")
    return tokens.select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
                         F.col("decoded").eqNullSafe(F.col("text")).alias("exact"))


STAGES: List[Tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("sentencepiece", sentencepiece),
]

# SimHash classes and token ids cannot be written in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL: Optional[str] = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
