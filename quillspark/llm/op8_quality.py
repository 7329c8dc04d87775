"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's state is scored from what the line and its two
neighbours look like (shares of character kinds, shape of words, repeats), states of
neighbouring lines from a learnt two by two table. Forward-backward gives each line's
marginal; a document's raw quality is their mean, weighted by line length, and a
one-dimensional logistic fit on the training documents maps it, with the share of its
worst lines, to a score.

Lines of a labelled document carry its label when learning. Learning takes a bounded
sample of labelled rows (at most ``TRAIN_ROWS`` with at most ``TRAIN_LINES`` lines together),
never of the held-out fold; scoring covers every line of every whole text. Texts stay in
tasks: only the features of the sample's lines come to the driver. The chain's messages are log odds, so all documents of
a chunk move line by line as arrays. Empty and null texts are one empty line. Without
two classes to learn from, all scores are 1.0 (nothing is known against a document).
Every row is scored by itself, so rows of equal doc_id or text keep a row each, null
ids too. Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import learn
from . import tokens as T
from . import words as W
from .durable import keep

#: Rows of the sample, and lines of all its rows together: a row with more than are left is passed over.
TRAIN_ROWS, TRAIN_LINES = 4000, 200_000
THRESHOLD = 0.3
_KINDS = 7
_KIND = np.zeros(256, np.int64)  # other punctuation and controls
_KIND[list(b"abcdefghijklmnopqrstuvwxyz")] = 1
_KIND[128:] = 1
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 2
_KIND[list(b"0123456789")] = 3
_KIND[list(b"#*$%&|<>")] = 4
_KIND[list(b" \t\r\x0b\x0c")] = 5
_KIND[list(b"!?")] = 6
_CHUNK = 1 << 20
#: Numbers that describe a line.
FEATURES = 22


def _counts(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bytes of each kind by line."""
    line = np.repeat(np.arange(len(starts)), ends - starts)
    at = np.arange(len(line)) + np.repeat(starts - (np.cumsum(ends - starts) - (ends - starts)), ends - starts)
    return np.bincount(line * _KINDS + _KIND[raw[at]], minlength=len(starts) * _KINDS).reshape(-1, _KINDS)


def lines(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bytes, features) of every line; a document has at least one."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(raw == 10)
    doc_of = np.searchsorted(offsets, breaks, "right") - 1
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    doc = np.sort(np.concatenate((np.arange(n), doc_of)), kind="stable")
    last = np.append(doc[1:] != doc[:-1], True)
    ends = np.where(last, offsets[1:][doc], np.append(starts[1:], 0) - 1)
    size = ends - starts
    kinds = _counts(raw, starts, ends)
    words = W.scan(raw, offsets, W.NOT_BLANK)
    hashes = words.hashes()
    owner = np.searchsorted(starts, words.starts, "right") - 1
    n_words = np.bincount(owner, minlength=len(starts))
    pair = np.unique(W.mix(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    distinct = np.bincount(owner[pair], minlength=len(starts))
    same = np.zeros(len(hashes), np.int64)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    echoes = np.bincount(owner, same, minlength=len(starts))
    whole = np.zeros(len(starts), np.uint64)
    np.add.at(whole, owner, hashes * (np.arange(len(hashes), dtype=np.uint64) - np.searchsorted(owner, owner).astype(np.uint64) + np.uint64(3)))
    key = W.mix(whole + doc.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    again = np.ones(len(starts), bool)
    again[np.unique(key, return_index=True)[1]] = False
    again &= n_words > 0
    short = np.bincount(owner, (words.ends - words.starts) <= 2, minlength=len(starts))
    chars, some = np.maximum(size, 1), np.maximum(n_words, 1)
    share = kinds / chars[:, None]
    seen = np.stack(
        [
            np.ones(len(starts)), size == 0, np.log1p(size) / 5, np.log1p(n_words) / 4, share[:, 0], share[:, 1], share[:, 2], share[:, 3], share[:, 4], share[:, 5], share[:, 6],
            share[:, 2] > 0.4, share[:, 4] > 0.02, share[:, 4] > 0.1, share[:, 6] > 0.02, kinds[:, 4] / some, distinct / some, (distinct / some < 0.5) & (n_words > 8), echoes / some, again, short / some, np.minimum(size / some / 10, 3),
        ],
        1,
    ).astype(np.float64)
    return doc, size, seen


def neighbours(doc: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the lines before and after it in its document."""
    before, after = np.zeros_like(seen), np.zeros_like(seen)
    same = (doc[1:] == doc[:-1])[:, None]
    before[1:], after[:-1] = seen[:-1] * same, seen[1:] * same
    return np.concatenate((seen, before, after), 1)


class Chain:
    """Log odds of a two-state chain, all documents at once."""

    def __init__(self, doc: np.ndarray):
        n = int(doc[-1]) + 1
        count = np.bincount(doc, minlength=n)
        first = np.cumsum(count) - count
        order = np.argsort(-count, kind="stable")
        live = np.searchsorted(-count[order], -np.arange(1, int(count.max()) + 1), "right")
        self.steps = [first[order[:k]] + t for t, k in enumerate(live.tolist())]  # line t of every document that has one
        self.n = len(doc)

    @staticmethod
    def _pass(odds: np.ndarray, table: np.ndarray) -> np.ndarray:
        """log of P(1|odds) / P(0|odds) after one move along ``table`` (log weights [from][to])."""
        return np.logaddexp(table[0, 1], table[1, 1] + odds) - np.logaddexp(table[0, 0], table[1, 0] + odds)

    def run(self, emission: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(forward with the line's own emission, backward without it), as log odds."""
        ahead, back = emission.copy(), np.zeros(self.n)
        for t in range(1, len(self.steps)):
            at = self.steps[t]
            ahead[at] += self._pass(ahead[at - 1], table)
        for t in range(len(self.steps) - 1, 0, -1):
            at = self.steps[t]
            back[at - 1] = self._pass(back[at] + emission[at], table.T)
        return ahead, back


@dataclass
class Model:
    weight: np.ndarray
    table: np.ndarray
    slope: np.ndarray

    def marginals(self, doc: np.ndarray, seen: np.ndarray) -> np.ndarray:
        ahead, back = Chain(doc).run(neighbours(doc, seen) @ self.weight, self.table)
        return 1 / (1 + np.exp(-np.clip(ahead + back, -30, 30)))

    def features(self, doc: np.ndarray, size: np.ndarray, seen: np.ndarray) -> np.ndarray:
        p = self.marginals(doc, seen)
        weight = size + 1.0
        total = np.bincount(doc, weight)
        mean = np.bincount(doc, weight * p) / total
        bad = np.bincount(doc, weight * (p < 0.5)) / total
        logit = np.clip(np.log(mean + 1e-4) - np.log(1 - mean + 1e-4), -8, 8)
        return np.stack([np.ones(len(mean)), logit, bad], 1)

    def score(self, doc: np.ndarray, size: np.ndarray, seen: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(doc, size, seen) @ self.slope, -30, 30)))


def _adam(grad, start: np.ndarray, rounds: int, rate: float) -> np.ndarray:
    x, m1, m2 = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, rounds + 1):
        g = grad(x)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        x = x - rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    return x


def fit(doc: np.ndarray, size: np.ndarray, seen: np.ndarray, y: np.ndarray, rounds: int = 150) -> Model | None:
    """From all lines (document, bytes, features) of the documents, whose labels are ``y``."""
    if not len(y) or y.min() == y.max():
        return None
    seen = seen.astype(np.float32)
    wide, chain = neighbours(doc, seen), Chain(doc)
    label = y[doc]
    follows = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    weight = (1.0 / np.bincount(doc))[doc] ** 0.5  # long documents count more, but not line by line
    k = wide.shape[1]

    def grad(x: np.ndarray) -> np.ndarray:
        w, table = x[:k], x[k:].reshape(2, 2)
        emission = (wide @ w.astype(np.float32)).astype(np.float64)
        ahead, back = chain.run(emission, table)
        p = 1 / (1 + np.exp(-np.clip(ahead + back, -30, 30)))
        g = wide.T @ (weight * (p - label)).astype(np.float32) / len(y) + 1e-4 * w
        # pairs of neighbouring lines
        a, b = ahead[follows - 1], back[follows] + emission[follows]
        joint = np.stack([np.full(len(a), table[0, 0]), table[0, 1] + b, table[1, 0] + a, table[1, 1] + a + b])
        joint = np.exp(joint - joint.max(0))
        joint /= joint.sum(0)
        seen_pairs = label[follows - 1] * 2 + label[follows]
        want = np.array([np.sum(weight[follows] * (seen_pairs == c)) for c in range(4)])
        return np.concatenate((g, ((joint * weight[follows]).sum(1) - want) / len(y) + 1e-2 * x[k:]))

    x = _adam(grad, np.zeros(k + 4), rounds, 0.1)
    model = Model(x[:k], x[k:].reshape(2, 2), np.array([0.0, 1.0, 0.0]))
    f = model.features(doc, size, seen)

    def outer(s: np.ndarray) -> np.ndarray:
        return f.T @ (1 / (1 + np.exp(-np.clip(f @ s, -30, 30))) - y) / len(y) + 1e-3 * s

    model.slope = _adam(outer, model.slope, 400, 0.05)
    return model


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS, most_lines: int = TRAIN_LINES) -> Model | None:
    @W.lean
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = W.utf8(b.column("text"))
            for i, j in W.chunks(offsets, _CHUNK):
                doc, size, seen = lines(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n = np.bincount(doc)
                both, ends = np.concatenate((size[:, None], seen), 1).astype("<f4"), np.cumsum(n)
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column("i"), part.column("y"), pa.array(n), pa.array([both[z - k : z].tobytes() for k, z in zip(n.tolist(), ends.tolist(), strict=True)], pa.binary())], names=["i", "y", "n", "lines"])

    seen = keep(learn.sample(docs, labels, label, rows, doc_id=doc_id, text=text).mapInArrow(read, "i long, y int, n long, lines binary"))
    left, picked = most_lines, []
    for r in seen.select("i", "n").orderBy(F.xxhash64("i"), "i").collect():  # at most ``rows`` numbers
        if r["n"] <= left:
            left -= r["n"]
            picked.append(r["i"])
    ids = docs.sparkSession.createDataFrame(pa.table({"i": pa.array(picked, pa.int64())}))  # of a list it would start Python workers of another kind, which stay
    got = seen.join(F.broadcast(ids), "i").orderBy("i").select("y", "lines").toArrow()
    parts = [np.frombuffer(x, "<f4").reshape(-1, 1 + FEATURES) for x in got.column("lines").to_pylist()]
    both = np.concatenate(parts) if parts else np.zeros((0, 1 + FEATURES), "<f4")
    return fit(np.repeat(np.arange(len(parts)), [len(x) for x in parts]), both[:, 0].astype(np.float64), both[:, 1:], got.column("y").to_numpy().astype(np.int64))


def scores(column: pa.Array, model: Model | None) -> np.ndarray:
    out = np.ones(len(column))
    if model is not None:
        raw, offsets = W.utf8(column)
        for i, j in W.chunks(offsets, _CHUNK):
            doc, size, seen = lines(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            out[i:j] = model.score(doc, size, seen)
    return out


def score(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """doc_id and score of every document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, doc_id=doc_id, text=text, **names))

    @W.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores(b.column("text"), model.value))], names=["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")


def report(docs: DataFrame, labels: DataFrame, **names) -> DataFrame:
    return learn.verdict(score(docs, labels, **names), THRESHOLD)


def accepted(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, text: str = "text", **names) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, all columns as they are."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, text=text, **names))

    @W.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.forget()
        for b in batches:
            yield b.filter(pa.array(scores(b.column(text), model.value) >= threshold))

    return docs.mapInArrow(run, docs.schema)
