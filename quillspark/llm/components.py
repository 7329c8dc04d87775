"""Connected components of a table of links (no graph on the driver).

Up to ``FEW`` links are solved by one task, as arrays: a star step over them would be
some thousand tasks of a few rows each at a few hundred shuffle partitions. More links
shrink to stars by shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .durable import free, keep

#: Links that one task holds, about 100 bytes each.
FEW = 1 << 20


def components(links: DataFrame, rounds: int = 60, few: int = FEW) -> DataFrame:
    """``links`` (a, b longs) -> node, component: the smallest node reachable, for every node with a link."""
    links = links.where("a <> b").select("a", "b")
    if links.count() <= few:
        return keep(links.coalesce(1).mapInArrow(_solved, "node long, component long"))
    return _stars(links, rounds)


def least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes of the links, ascending; the smallest node reachable from each).

    Each root is tied to the least root it has a link with, and every path is then cut
    short: of the roots with a link to another, at most half are left.
    """
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[left], root[right]
        apart = np.flatnonzero(x != y)
        if not len(apart):
            return nodes, nodes[root]
        left, right, x, y = left[apart], right[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if held:
        cols = least(*map(np.concatenate, zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], names=["node", "component"])


def _stars(links: DataFrame, rounds: int) -> DataFrame:
    """Large-star and small-star steps in turn: each node is tied to the smallest of its
    neighbours. Minima are pre-aggregated and joined back, so a node with very many
    links is never gathered in one task.
    """
    edges = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        before, edges = edges, keep(small)
        free(before)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("s")).first()
        if state == now:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    out = keep(stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
    free(edges)
    return out
