"""Benchmark decontamination by Wu-Manber search over words.

Test items become windows of ``width`` words (an item of fewer words is one
window). Windows of one length form a matcher: a *shift table* says, for the block
formed by the last two words under the cursor, how far the cursor may move without
passing an occurrence; a shift of zero opens the *suffix bucket* of that block,
whose windows are compared word for word, bytes against bytes. Documents are cut
into lanes of equal length whose cursors all move at once, so the skipping search
runs as array operations.

Scale: documents are scanned where they are read, without a shuffle. Items are
read, compiled and sent in blocks of bounded bytes, one at a time, so the driver holds
one block; only with more than one block are the per-block findings joined by document.

Null and empty texts have no words: no hit, no item. Repeated items or windows all
count; a null item id is left out of the lists. Rows with equal ids are told apart
when there is one block of items; with several, equal ids would be merged, so an
internal row key is used.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .durable import free_name

WIDTH = 10
ITEM_BLOCK_BYTES = 8 << 20
_LANE = 256
_TABLE_BITS = 16
_HIT = "__hit_words"


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return W.mix(a * np.uint64(0x9FB21C651E98DF25) + b)


@dataclass
class Matcher:
    """All windows of one length."""

    length: int
    shift: np.ndarray  # by block
    keys: np.ndarray  # sorted hashes of whole windows, the order of the suffix buckets
    texts: list[bytes]
    items: list[list[int]]
    block_words: int = field(default=2)

    @classmethod
    def compile(cls, length: int, windows: dict[bytes, tuple[np.ndarray, set[int]]]) -> Matcher:
        block = min(2, length)
        texts = list(windows)
        table = np.stack([windows[t][0] for t in texts])
        shift = np.full(1 << _TABLE_BITS, length - block + 1, np.int64)
        for end in range(block, length + 1):  # a later block has a smaller shift and wins
            at = cls._slot(table[:, end - block : end])
            shift[at] = np.minimum(shift[at], length - end)
        keys = cls._whole(table)
        order = np.argsort(keys, kind="stable")
        return cls(length, shift, keys[order], [texts[i] for i in order], [sorted(windows[texts[i]][1]) for i in order], block)

    @staticmethod
    def _slot(block: np.ndarray) -> np.ndarray:
        value = block[:, 0] if block.shape[1] == 1 else _pair(block[:, 0], block[:, 1])
        return (value >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    @staticmethod
    def _whole(table: np.ndarray) -> np.ndarray:
        """The suffix bucket's hash stands first, so that equal suffixes are neighbours."""
        n = table.shape[1]
        suffix = table[:, -1] if n == 1 else _pair(table[:, -2], table[:, -1])
        rest = np.zeros(len(table), np.uint64)
        for k in range(n):
            rest = _pair(rest, table[:, k])
        return (suffix & np.uint64(0xFFFFFFFF00000000)) | (rest >> np.uint64(32))

    def search(self, words: W.Words, hashes: np.ndarray) -> list[tuple[int, int]]:
        """(word position, window number) of every occurrence."""
        first = words.first
        last = np.repeat(first[1:], words.counts)  # end of each word's document
        lanes = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= self.length:
                lanes.append(np.arange(a, b - self.length + 1, _LANE))
        if not lanes:
            return []
        at = np.concatenate(lanes)
        end = np.minimum(at + _LANE, last[at] - self.length + 1)
        found = []
        while len(at):
            tail = at + self.length
            slot = self._slot(np.stack([hashes[tail - k] for k in range(self.block_words, 0, -1)], 1))
            step = self.shift[slot]
            stop = np.flatnonzero(step == 0)
            if len(stop):
                found.append(at[stop])
                step = np.maximum(step, 1)
            at = at + step
            live = at < end
            at, end = at[live], end[live]
        if not found:
            return []
        spots = np.concatenate(found)
        whole = self._whole(np.stack([hashes[spots + k] for k in range(self.length)], 1))
        k = np.searchsorted(self.keys, whole)
        ok = k < len(self.keys)
        ok[ok] = self.keys[k[ok]] == whole[ok]
        out = []
        for p, j in zip(spots[ok].tolist(), k[ok].tolist(), strict=True):
            here = b" ".join(words.raw[words.starts[p + i] : words.ends[p + i]].tobytes() for i in range(self.length))
            key = self.keys[j]
            while j < len(self.keys) and self.keys[j] == key:
                if self.texts[j] == here:
                    out.append((p, j))
                    break
                j += 1
        return out


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = W.utf8(column)
    return W.LOWER[raw], offsets


def compile_items(items: list[tuple[int | None, str | None]], width: int = WIDTH) -> list[Matcher]:
    """A matcher for each length of window."""
    raw, offsets = lowered(pa.array([t for _, t in items], pa.large_string()))
    words = W.scan(raw, offsets, W.ALNUM)
    hashes, texts, first = words.hashes(), words.texts(), words.first
    by_length: dict[int, dict[bytes, tuple[np.ndarray, set[int]]]] = defaultdict(dict)
    for k, (item, _) in enumerate(items):
        a, b = int(first[k]), int(first[k + 1])
        n = min(width, b - a)
        for p in range(a, b - n + 1 if n else a):
            _, ids = by_length[n].setdefault(b" ".join(texts[p : p + n]), (hashes[p : p + n], set()))
            if item is not None:
                ids.add(item)
    return [Matcher.compile(n, w) for n, w in sorted(by_length.items())]


def _findings(column: pa.Array, matchers: list[Matcher]) -> Iterator[tuple[int, np.ndarray, set[int]]]:
    """For each text its number of words, the positions of hit words, and the items found."""
    raw, offsets = lowered(column)
    for i, j in W.chunks(offsets):
        words = W.scan(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], W.ALNUM)
        hashes = words.hashes()
        cover = np.zeros(len(hashes) + 1, np.int64)
        items: dict[int, set[int]] = defaultdict(set)
        for m in matchers:
            for p, k in m.search(words, hashes):
                cover[p] += 1
                cover[p + m.length] -= 1
                items[int(words.doc[p])].update(m.items[k])
        hit = np.cumsum(cover[:-1]) > 0
        first = words.first
        for d in range(j - i):
            a, b = first[d], first[d + 1]
            yield int(b - a), np.flatnonzero(hit[a:b]), items.get(d, set())


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int | None, str | None]]]:
    """The stated test items, streamed to the driver a partition at a time, in blocks of bounded bytes."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("t is not null")
    for r in rows.toLocalIterator():
        if block and size + len(r.t) > ITEM_BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += len(r.t)
    if block:
        yield block


def _shipped(benchmark: DataFrame, item_id: str, text: str, width: int) -> list[Broadcast]:
    """The compiled blocks, each written out before the next is read."""
    sc = benchmark.sparkSession.sparkContext
    return [sc.broadcast(compile_items(block, width)) for block in _blocks(benchmark, item_id, text)]


def search(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """Per document: doc_id, n_words, hit_words (positions), item_ids (sorted).

    Both tables may be empty; columns beyond those named are ignored.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, n_words long, hit_words array<int>, item_ids array<long>"
    parts = []
    blocks = _shipped(benchmark, item_id, item_text, width) or [docs.sparkSession.sparkContext.broadcast([])]
    if len(blocks) > 1:
        from .durable import keep

        own = keep(own.withColumn("row", F.expr("uuid()")))
        schema = "row string, " + schema
    for shipped in blocks:

        @W.lean
        def scan(batches: Iterator[pa.RecordBatch], shipped=shipped, keyed=len(blocks) > 1) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = list(_findings(b.column("text"), shipped.value))
                cols = {"row": b.column("row")} if keyed else {}
                cols |= {"doc_id": b.column("doc_id"), "n_words": pa.array([n for n, _, _ in found], pa.int64()), "hit_words": pa.array([h for _, h, _ in found], pa.list_(pa.int32())), "item_ids": pa.array([sorted(s) for _, _, s in found], pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_pydict(cols)

        parts.append(own.mapInArrow(scan, schema))
    if len(parts) == 1:
        return parts[0]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    merged = merged.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hit_words")).alias("hit_words"), F.flatten(F.collect_list("item_ids")).alias("item_ids"))
    return merged.select("doc_id", "n_words", F.array_distinct("hit_words").alias("hit_words"), F.array_sort(F.array_distinct("item_ids")).alias("item_ids"))


def report(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """The digest of ``search``: counts, a hash of the item list, and the verdict."""
    found = search(docs, benchmark, **names)
    ids = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with every hit word cut out of its text; all columns stay.

    Text between hits is kept as it was; a document without hits is unchanged. Every
    block of items is searched in the unchanged text, whose words are cut out once.
    """
    blocks = _shipped(benchmark, "item_id", "text", width)
    hit_words = free_name(docs.columns, _HIT)
    out = docs if len(blocks) < 2 else docs.withColumn(hit_words, F.array().cast("array<int>"))
    for n, shipped in enumerate(blocks, 1):

        @W.lean
        def step(batches: Iterator[pa.RecordBatch], shipped=shipped, before=n > 1, last=n == len(blocks)) -> Iterator[pa.RecordBatch]:
            for b in batches:
                k = b.schema.get_field_index(text)
                column = b.column(k)
                hits = [set(hit.tolist()) for _, hit, _ in _findings(column, shipped.value)]
                if before:
                    hits = [hit.union(more) for hit, more in zip(hits, b.column(hit_words).to_pylist(), strict=True)]
                if last:
                    texts = [_without(t, hit) if hit else t for t, hit in zip(column.to_pylist(), hits, strict=True)]
                    done = {text: pa.array(texts, column.type)}
                else:
                    done = {hit_words: pa.array([sorted(hit) for hit in hits], b.schema.field(hit_words).type)}
                names = [x for x in b.schema.names if x != hit_words or not last]
                yield pa.RecordBatch.from_arrays([done.get(x, b.column(x)) for x in names], names=names)

        out = out.mapInArrow(step, docs.schema if n == len(blocks) else out.schema)
    return out


def _without(text: str, hit: set[int]) -> str:
    """``text`` less the words at these places; a blank stays where a run was cut."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    words = W.scan(data, np.array([0, len(raw)]), W.ALNUM)
    parts, at, run = [], 0, False
    for k, (a, b) in enumerate(zip(words.starts.tolist(), words.ends.tolist(), strict=True)):
        if k in hit:
            if not run:
                parts.append(raw[at:a])
            at, run = b, True
        else:
            run = False
    parts.append(raw[at:])
    return b"".join(parts).decode().strip()
