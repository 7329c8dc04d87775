"""Substring dedup by fixed-block anchors.

Any run of 50 words holds a whole block of 25 words that starts at a multiple of 25
in its own document. So every document's non-overlapping blocks of 25 words are the
index, and every rolling run of 25 words of every document is a probe; a probe that
meets a block of another document is an anchor. Around anchors, windows of 50 words
are extended along the document as long as they occur elsewhere: per window the
smallest document that has it, and where that is smaller than its own, its words go.
Windows are judged on the input, so no order of removal matters.

Scale: blocks and probes travel as two to three bytes (``repeats``), windows only
near anchors, texts only of documents that lose words. No group is gathered: a window
shared by a third of all documents is pre-aggregated to its smallest document, and
joined back by window and a salt: the more rows a window has, the more salts (``HOT``).
Windows are compared by a 64-bit hash of their words: of n different windows near
anchors, about n * n / 2^65 pairs are taken for equal (one pair in 10^9 windows at 3 %).

Columns of ``docs`` may have any name. Null and empty texts have no words. Rows without doc_id are kept whole and remove
nothing elsewhere. Rows of equal doc_id never remove from each other; each row is
judged by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .durable import free_name, keep
from .repeats import Emitted, Filter, members, repeated, scramble

WINDOW = 50
#: (rows, salts): a window with more rows than that is joined back in so many parts.
HOT = ((2_000, 8), (16_000, 64), (128_000, 512), (1_024_000, 4096))


def _scanned(column: pa.Array) -> Iterator[tuple[int, int, W.Words, np.ndarray]]:
    raw, offsets = W.utf8(column)
    for i, j in W.chunks(offsets):
        words = W.scan(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], W.NOT_BLANK)
        yield i, j, words, words.hashes()


def anchors(docs: DataFrame, window: int = WINDOW) -> Filter:
    """A filter of the block hashes that another document probes with success."""
    block = (window + 1) // 2

    def emit(batches: Iterator[pa.RecordBatch]) -> Emitted:
        ordinal = 0
        for b in batches:
            for i, _, words, hashes in _scanned(b.column("text")):
                value, at = W.windows(words, hashes, block)
                doc = words.doc[at]
                yield value, doc + (ordinal + i), (at - words.first[doc]) % block == 0
            ordinal += b.num_rows

    return repeated(docs.select("text"), emit)


def _near(words: W.Words, hashes: np.ndarray, hits: Filter, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the windows that hold an anchor."""
    block = (window + 1) // 2
    value, at = W.windows(words, hashes, block)
    at = at[hits.has(value)] if len(value) else at
    if not len(at):
        return np.zeros(0, np.uint64), at
    mark = np.zeros(len(hashes) + 1, np.int64)
    first = words.first[words.doc[at]]
    np.add.at(mark, np.maximum(first, at - (window - block)), 1)
    np.add.at(mark, at + 1, -1)
    inside = np.cumsum(mark[:-1]) > 0
    value, at = W.windows(words, hashes, window)
    ok = inside[at]
    return value[ok], at[ok]


def repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row that loses words: row_key and starts, the sorted word positions of its removed windows."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    own = own.withColumn("row_key", F.xxhash64("doc_id", "text"))
    hits = docs.sparkSession.sparkContext.broadcast(anchors(own, window))

    def rows(levels: list[tuple[Filter, int]] | None):
        """Windows near anchors; with ``levels``, also their salt, row and place."""

        @W.lean
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, keys = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "row_key"))
                for i, _, words, hashes in _scanned(b.column("text")):
                    value, at = _near(words, hashes, hits.value, window)
                    if not len(at):
                        continue
                    doc = words.doc[at]
                    cols = {"window": pa.array(value.view(np.int64)), "doc_id": pa.array(ids[i + doc])}
                    if levels is not None:
                        cols["salt"] = pa.array(W.mix(keys[i + doc].view(np.uint64) + at.astype(np.uint64)).view(np.int64) & (_salts(value, levels) - 1))
                        cols |= {"row_key": pa.array(keys[i + doc]), "at": pa.array((at - words.first[doc]).astype(np.int32))}
                    yield pa.RecordBatch.from_pydict(cols)

        return emit

    near = own.mapInArrow(rows(None), "window long, doc_id long")
    least = keep(near.groupBy("window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")).where("least < most").drop("most"))
    most = least.agg(F.max("n")).first()[0] or 0
    levels = [(members(least.where(F.col("n") > n), "window"), salts) for n, salts in HOT if most > n]
    shipped = docs.sparkSession.sparkContext.broadcast(levels)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each window once for every salt that its rows can have."""
        for b in batches:
            n = _salts(b.column("window").to_numpy().view(np.uint64), shipped.value)
            salt = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            window, first = (np.repeat(b.column(c).to_numpy(), n) for c in ("window", "least"))
            for i in range(0, len(salt), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(window[i : i + 100_000]), pa.array(salt[i : i + 100_000]), pa.array(first[i : i + 100_000])], names=["window", "salt", "least"])

    def salted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return rows(shipped.value)(batches)

    told = least.select("window", "least").mapInArrow(spread, "window long, salt long, least long")
    gone = own.mapInArrow(salted, "window long, doc_id long, salt long, row_key long, at int").join(told.hint("merge"), ["window", "salt"]).where("doc_id > least")
    return gone.groupBy("row_key").agg(F.sort_array(F.collect_set("at")).alias("starts"))


def _salts(windows: np.ndarray, levels: list[tuple[Filter, int]]) -> np.ndarray:
    """In how many parts (a power of two) each window is joined; the same wherever it is asked."""
    out = np.ones(len(windows), np.int64)
    spread = scramble(windows.view(np.int64)) if levels else windows
    for found, salts in levels:
        out[found.has(spread)] = salts
    return out


def covered(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that starts at one of ``starts``."""
    mark = np.zeros(n + 1, np.int64)
    mark[starts] += 1
    ends = np.minimum(starts + window, n)
    np.add.at(mark, ends, -1)
    return np.cumsum(mark[:-1]) > 0


def _joined(docs: DataFrame, *, doc_id: str, text: str, window: int) -> tuple[DataFrame, DataFrame, str]:
    """(rows that may lose words, with their starts; rows that can't; the name of the column of starts)."""
    gone = keep(repeats(docs, doc_id=doc_id, text=text, window=window))
    some = docs.sparkSession.sparkContext.broadcast(members(gone, "row_key"))
    key, starts = free_name(docs.columns, "row_key"), free_name(docs.columns, "starts")
    keyed = docs.withColumn(key, F.xxhash64(F.col(doc_id).cast("long"), F.col(text)))

    def part(wanted: bool):
        @W.lean
        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ok = some.value.has(scramble(b.column(key).to_numpy(zero_copy_only=False)))
                yield b.filter(pa.array(ok == wanted))

        return keyed.mapInArrow(pick, keyed.schema)

    return part(True).join(gone.select(F.col("row_key").alias(key), F.col("starts").alias(starts)), key, "left"), part(False), starts


def _cut(make, window: int):
    @W.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts = b.column("starts") if "starts" in b.schema.names else None
            yield make(b, starts, window)

    return run


def _digest(b: pa.RecordBatch, starts: pa.Array | None, window: int) -> pa.RecordBatch:
    n_words, removed, sha = [], [], []
    for i, j, words, _ in _scanned_plain(b.column("text")):
        data, first = words.raw.tobytes(), words.first
        for d in range(j - i):
            a, z = int(first[d]), int(first[d + 1])
            kept = _kept(words, a, z, starts[i + d].values if starts is not None and starts[i + d].is_valid else None, window)
            n_words.append(z - a)
            removed.append(z - a - len(kept))
            sha.append(hashlib.sha256(b" ".join([data[x:y] for x, y in zip(words.starts[kept].tolist(), words.ends[kept].tolist(), strict=True)])).hexdigest())
    return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _scanned_plain(column: pa.Array) -> Iterator[tuple[int, int, W.Words, None]]:
    raw, offsets = W.utf8(column)
    for i, j in W.chunks(offsets):
        yield i, j, W.scan(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], W.NOT_BLANK), None


def _kept(words: W.Words, a: int, z: int, starts: pa.Array | None, window: int) -> np.ndarray:
    if starts is None or not len(starts):
        return np.arange(a, z)
    return a + np.flatnonzero(~covered(starts.to_numpy(zero_copy_only=False).astype(np.int64), z - a, window))


def report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, and the SHA-256 of the kept words joined by one space."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    some, rest, _ = _joined(own, doc_id="doc_id", text="text", window=window)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    run = _cut(_digest, window)
    return some.select("doc_id", "text", "starts").mapInArrow(run, schema).unionByName(rest.select("doc_id", "text").mapInArrow(run, schema))


def remove(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated words taken out of their texts.

    A text that loses words becomes its kept words joined by one space; others stay as they are.
    """
    columns = docs.columns
    some, rest, told = _joined(docs, doc_id=doc_id, text=text, window=window)

    @W.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, starts = b.column(text).to_pylist(), b.column(told)
            for i, j, words, _ in _scanned_plain(b.column(text)):
                data, first = words.raw.tobytes(), words.first
                for d in range(j - i):
                    if starts[i + d].is_valid and len(starts[i + d].values):
                        kept = _kept(words, int(first[d]), int(first[d + 1]), starts[i + d].values, window)
                        texts[i + d] = b" ".join([data[x:y] for x, y in zip(words.starts[kept].tolist(), words.ends[kept].tolist(), strict=True)]).decode()
            yield pa.RecordBatch.from_arrays([pa.array(texts, b.column(text).type) if c == text else b.column(c) for c in columns], names=columns)

    return some.select(*columns, told).mapInArrow(run, docs.schema).unionByName(rest.select(*columns))
