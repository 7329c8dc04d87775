"""Every query of the library, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import book_queries, catalog, stream_queries, text_queries  # noqa: F401  (importing lists the queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every book rebuilt from its pages' lines: paragraphs, headings, ids and page offsets."""
    return catalog.QUERIES["pdf_book"](spark, sf_dir)


def queries() -> dict:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.SQL)
