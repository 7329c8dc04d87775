"""A bounded sample of labelled rows, and the held-out rule all classifiers share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .durable import keep

#: A fifth of all documents, by crc32 of the id as text, is never learnt from.
FOLDS = 5


def remainder(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def held_out(doc_id: str, fold: int = 0) -> Column:
    return F.coalesce(remainder(doc_id) == fold, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, *, doc_id: str = "doc_id", text: str = "text", balanced: bool = False) -> DataFrame:
    """i, text, y of at most ``most`` labelled documents outside the held-out fold, the first by a hash of the id.

    The bound is on learning only; whoever learns from it scores all rows. Only ids are
    chosen in one place; texts, of any length, stay in tasks and go to a table of their
    own. Null labels, ids and texts are left out; of several labels of one id the largest
    counts, of several texts the one with the smallest hash.
    """
    known = labels.select(F.col(doc_id).cast("long").alias("i"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and i is not null")
    known = known.groupBy("i").agg(F.max("y").alias("y")).where(remainder("i") != 0)
    order = (F.xxhash64("i"), F.col("i"))
    if balanced:  # the rarer class may take up to half of the rows
        half = most // 2
        rare = known.where("y = 1").orderBy(*order).limit(half)
        picked = rare.union(known.where("y = 0").orderBy(*order).limit(most - half))
    else:
        picked = known.orderBy(*order).limit(most)
    rows = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("text")).where("text is not null")
    rows = rows.join(F.broadcast(picked), "i")  # at most ``most`` ids
    return keep(rows.groupBy("i").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y")))


def share(labels: DataFrame, label: str) -> float:
    """The part of labels that are 1, outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("i"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and i is not null").where(remainder("i") != 0)
    return known.agg(F.avg("y")).first()[0] or 0.0


def verdict(scored: DataFrame, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
