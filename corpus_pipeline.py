"""A training-corpus pipeline of five stages over ``documents``.

Each stage takes what the one before has kept (``docs``) and the folder of the other
tables, and returns a DataFrame; all but the last return the columns of ``docs``:

1. quality_classifier: documents that the line field rejects go.
2. ngram_jaccard_join: of each group of near copies the smallest doc_id stays.
3. substring_dedup: words of 50-word passages that a smaller doc_id has are cut out.
4. benchmark_decontamination: words inside occurrences of test items are cut out.
5. best_fit_packing: what is left is packed into sequences of 4096 ids.

Null texts count as empty; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import op2_packing, op7_substrings, op8_quality, op9_ngram_join, op10_decontaminate
from quillspark.llm.durable import keep, release, tune, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op8_quality.accepted(docs, _table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op9_ngram_join.representatives(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_substrings.remove(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: A trained classifier and a packing plan have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again by the next.

    What a stage has written besides its output goes when the output is there.
    """
    docs = _table(spark, sf_dir, "documents")
    before = written(spark)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            spent = written(spark) - before
            docs = keep(docs)
            release(spark, spent)
    return docs
