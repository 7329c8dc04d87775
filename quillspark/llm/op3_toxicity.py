"""Toxicity: a character n-gram linear classifier on naive Bayes log-count ratios.

Lower-cased character n-grams of three to six characters, present or absent, are
hashed into ``BUCKETS`` features. Naive Bayes gives each feature the log ratio of its
rates in toxic and other training documents; the features that tell most are kept,
scaled by their ratio, and weighted by logistic regression. Scoring is one pass over
the documents, where they are read: an n-gram hash, a table look-up, and a sum over
the distinct features that a document has.

Only texts are features. Learning takes a bounded sample of labelled rows
(``TRAIN_ROWS``), never of the held-out fold; scoring covers every whole text. Texts stay in
tasks: the driver gets the counts of at most ``BUCKETS`` features and, of each training
document, which of the ``FEATURES`` kept ones it has. Empty and null texts get the score of
no features. Without two classes to learn from, all scores are 0.0. Every row is scored
by itself, so rows of equal doc_id or text keep a row each, null ids too; features of
equal gain are taken in the order of their numbers. Only the two columns named are
read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import learn
from . import words as W

ORDERS = (3, 4, 5, 6)
BUCKETS = 1 << 20
FEATURES = 3000
TRAIN_ROWS = 10_000
THRESHOLD = 0.5
_CHUNK = 400_000


def _grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(feature, place) of every n-gram and the ends of the documents, by order."""
    parts = [" " + (t or "").lower().replace("\x00", " ").replace("\n", " ") + " " for t in texts]
    codes = np.frombuffer(("\x00".join(parts) + "\x00").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(codes == 0)
    mixed = W.mix(codes.astype(np.uint64) + np.uint64(0x1234567))
    for n in ORDERS:
        value = W.rolling(mixed, n)
        ok = np.ones(len(value), bool)
        for k in range(n):
            at = ends - k
            ok[at[(at >= 0) & (at < len(ok))]] = False
        at = np.flatnonzero(ok)
        yield ((value[at] + np.uint64(n)) >> np.uint64(64 - 20)).astype(np.int64), at, ends


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    i = size = 0
    for j, t in enumerate(texts):
        size += len(t or "")
        if size >= _CHUNK:
            yield i, j + 1
            i, size = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


def present(texts: list[str | None], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs; only features that ``keep`` marks."""
    found = []
    for feature, at, ends in _grams(texts):
        if keep is not None:
            ok = keep[feature]
            feature, at = feature[ok], at[ok]
        doc = np.searchsorted(ends, at)
        found.append(doc * BUCKETS + feature)
    both = np.unique(np.concatenate(found))  # by document; orders share features by chance
    return both // BUCKETS, both % BUCKETS


@dataclass
class Model:
    keep: np.ndarray  # bool by bucket
    weight: np.ndarray  # by bucket
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for i, j in _chunks(texts):
            doc, feature = present(texts[i:j], self.keep)
            out[i:j] += np.bincount(doc, self.weight[feature], minlength=j - i)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def counted(rows: DataFrame) -> np.ndarray:
    """(2, BUCKETS): in how many documents of each class (``y``) of ``rows`` a feature occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * BUCKETS, np.int64)
        for b in batches:
            texts, y = b.column("text").to_pylist(), b.column("y").to_numpy()
            for i, j in _chunks(texts):
                doc, feature = present(texts[i:j])
                counts += np.bincount(y[i:j][doc] * BUCKETS + feature, minlength=2 * BUCKETS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], names=["cell", "n"])

    cells = rows.select("text", "y").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * BUCKETS)
    out[cells.column(0).to_numpy()] = cells.column(1).to_numpy()
    return out.reshape(2, BUCKETS)


def chosen(counts: np.ndarray, positive: float, negative: float, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """(log ratio of the rates by feature; the numbers of those that tell most, ascending)."""
    ratio = np.log((counts[1] + 1) / (positive + 2)) - np.log((counts[0] + 1) / (negative + 2))
    gain = np.abs(counts[1] / positive - counts[0] / negative) * np.abs(ratio)
    gain[counts.sum(0) < 3] = 0
    top = np.argsort(-gain, kind="stable")[:features]
    return ratio, np.sort(top[gain[top] > 0])


def weighted(doc: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray, prior: float, width: int, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic weights and bias: cell k says that document doc[k] has feature at[k], of value x[k]."""
    importance = np.where(y == 1, prior / max(1, y.sum()), (1 - prior) / max(1, len(y) - y.sum()))
    w, bias = np.zeros(width), 0.0
    m1, m2 = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):  # Adam on the regularised mean log loss
        z = bias + np.bincount(doc, x * w[at], minlength=len(y))
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * importance
        grad = np.append(np.bincount(at, x * err[doc], minlength=width) + 1e-5 * w, err.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        step = 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def fit(rows: DataFrame, prior: float, features: int = FEATURES) -> Model | None:
    """From ``rows`` (text, y); ``prior``: the true share of toxic documents, where the rows hold another."""
    classes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    positive, negative = float(classes.get(1, 0)), float(classes.get(0, 0))
    if not positive or not negative:
        return None
    ratio, names = chosen(counted(rows), positive, negative, features)
    keep = np.zeros(BUCKETS, bool)
    keep[names] = True
    shipped = rows.sparkSession.sparkContext.broadcast((keep, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, of = shipped.value
        for b in batches:
            texts = b.column("text").to_pylist()
            cells: list[bytes] = []
            for i, j in _chunks(texts):
                doc, feature = present(texts[i:j], wanted)
                at = np.searchsorted(of, feature).astype("<u2")
                cut = np.searchsorted(doc, np.arange(j - i + 1))
                cells += [at[a:z].tobytes() for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(cells, pa.binary())], names=["y", "cells"])

    got = rows.select("text", "y").mapInArrow(run, "y int, cells binary").toArrow()
    cells = [np.frombuffer(c, "<u2") for c in got.column("cells").to_pylist()]
    y, at = got.column("y").to_numpy().astype(float), np.concatenate(cells).astype(np.int64)
    doc = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    w, bias = weighted(doc, at, ratio[names][at], y, prior, len(names))
    weight = np.zeros(BUCKETS)
    weight[names] = w * ratio[names]
    return Model(keep, weight, bias)


def score(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS, features: int = FEATURES) -> DataFrame:
    """doc_id and score of every document."""
    model = fit(learn.sample(docs, labels, label, rows, doc_id=doc_id, text=text, balanced=True), learn.share(labels, label), features)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value = np.zeros(b.num_rows)
            for i in range(0, b.num_rows if shipped.value else 0, 1024):
                value[i : i + 1024] = shipped.value.score(b.column("text").slice(i, 1024).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(value)], names=["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")


def report(docs: DataFrame, labels: DataFrame, **names) -> DataFrame:
    return learn.verdict(score(docs, labels, **names), THRESHOLD)
