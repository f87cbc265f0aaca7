"""The corpus pipeline: five operators of pipelight.llm, one after another, over documents.

Each stage works on all that its predecessor kept and, but for the last, returns the columns of
documents.  Packing gives the pieces of the documents that remain and where they are placed.

Defined results, for each stage: a null text counts as an empty one (line dedup writes it as such);
null ids and nulls in other columns stay; rows that repeat an id and a text are each
judged, and near-duplicate removal keeps one of them; an empty table gives an empty result; further
columns, whatever their names, are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipelight.llm.common import cut, table
from pipelight.llm.decontamination import decontaminate
from pipelight.llm.line_dedup import line_dedup
from pipelight.llm.minhash_dedup import minhash_dedup
from pipelight.llm.packing import best_fit_packing
from pipelight.llm.toxicity import score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar predicts to be toxic go."""
    return score_toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that nearly repeat an earlier one go; n_chars follows the text.  Every document stays."""
    found = line_dedup(docs, keep=docs.columns)
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return found.select(*(new.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return minhash_dedup(docs, keep=docs.columns).where("kept").select("rest.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go, however small a part of them it is."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=docs.columns).where("n_hit = 0").select("rest.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that remain, packed into sequences."""
    return best_fit_packing(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", dedup_documents),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: SQL expresses neither the learned grammar nor the tokenizer.  tests/llm holds each stage against a brute-force
#: version of it on a small table, and run() against the stages applied one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
