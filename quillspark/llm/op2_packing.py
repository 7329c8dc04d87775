"""Best-fit packing: pattern packing by non-negative least squares.

Only a histogram of piece lengths (at most ``capacity`` numbers, however many
documents there are) reaches the driver. There, lengths are put into coarse classes;
all patterns of up to ``PATTERN_DOCS`` classes that fill a sequence are enumerated;
non-negative least squares fits how often to repeat each pattern so that the
histogram is used up; counts are rounded down and taken while pieces last; what is
left is packed best-fit, longest first, into the gaps of pattern sequences and then
into new ones, on whole groups of like sequences at a time. The outcome says, per
length, which ranks go where. Executors rank their pieces by length (counts per
bucket, then a rank inside each bucket, so that no length is gathered in one task)
and look their place up.

Documents longer than ``capacity`` are cut into full pieces and a rest. Null and
empty texts are one id, the end. Equal ids stay rows of their own. An empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import tokens as T
from . import words as W
from .durable import keep, slices

CAPACITY = 4096
CLASSES = 32
PATTERN_DOCS = 4


def enumerate_patterns(classes: int = CLASSES, most: int = PATTERN_DOCS) -> np.ndarray:
    """Rows of class counts: up to ``most`` classes (1-based, class c fills c/classes) whose sum is ``classes``."""
    rows = []
    for n in range(1, most + 1):
        for combo in combinations_with_replacement(range(1, classes + 1), n):
            if sum(combo) == classes:
                row = np.zeros(classes)
                for c in combo:
                    row[c - 1] += 1
                rows.append(row)
    return np.array(rows)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """min |a x - b| with x >= 0: active sets as Lawson and Hanson have them."""
    m, n = a.shape
    x, free = np.zeros(n), np.zeros(n, bool)
    gram, target = a.T @ a, a.T @ b
    tol = 1e-9 * max(1.0, np.abs(target).max(initial=0))
    for _ in range(rounds):
        slope = target - gram @ x
        slope[free] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= tol or free.sum() >= m:
            break
        free[j] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if s[free].min() > 0:
                x = s
                break
            bad = free & (s <= 0)
            step = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x = x + step * (s - x)
            free &= x > 1e-12
            x[~free] = 0
            if not free.any():
                break
    return x


class Plan:
    """Groups of like sequences: (how many, lengths of the pieces in order)."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.groups: list[tuple[int, tuple[int, ...]]] = []
        left = {n: c for n, c in histogram.items() if c > 0}
        if full := left.pop(capacity, 0):
            self.groups.append((full, (capacity,)))
        gaps = self._patterns(left)
        self._residual(left, gaps)

    def _patterns(self, left: dict[int, int]) -> dict[int, list[tuple[int, tuple[int, ...]]]]:
        """Takes pattern sequences out of ``left``; returns them by free room."""
        width = self.capacity // CLASSES
        gaps: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
        if not left or width < 1:
            return gaps
        of = lambda n: -(-n // width)
        by_class: dict[int, list[int]] = defaultdict(list)
        for n in sorted(left):
            by_class[of(n)].append(n)
        want = np.array([sum(left[n] for n in by_class.get(c + 1, ())) for c in range(CLASSES)], float)
        table = enumerate_patterns()
        repeat = np.floor(nnls(table.T, want)).astype(int)
        for k in np.argsort(-repeat):
            todo = int(repeat[k])
            need = [c + 1 for c in range(CLASSES) for _ in range(int(table[k][c]))]
            while todo > 0:
                picked, use, room = [], defaultdict(int), self.capacity
                for c in reversed(need):  # the longest that is left of each class
                    while by_class[c] and not left[by_class[c][-1]]:
                        by_class[c].pop()
                    n = next((n for n in reversed(by_class[c]) if left[n] > use.get(n, 0)), None)
                    if n is None:
                        break
                    if len(picked) == len(need) - 1:  # the last one fills what the coarse classes leave
                        n = next((k for k in range(room, n, -1) if left.get(k, 0) > use.get(k, 0)), n)
                    picked.append(n)
                    use[n] += 1
                    room -= n
                if len(picked) < len(need):
                    break
                times = min([todo, *(left[n] // u for n, u in use.items())])
                for n, u in use.items():
                    left[n] -= times * u
                todo -= times
                gaps[room].append((times, tuple(picked)))
        return gaps

    def _residual(self, left: dict[int, int], gaps: dict[int, list[tuple[int, tuple[int, ...]]]]) -> None:
        room = np.zeros(self.capacity + 1, bool)
        room[[r for r, g in gaps.items() if g]] = True

        def add(r: int, group: tuple[int, tuple[int, ...]]) -> None:
            gaps[r].append(group)
            room[r] = True

        for n in sorted((n for n, c in left.items() if c > 0), reverse=True):
            count = left[n]
            while count:
                fit = np.flatnonzero(room[n:])
                if not len(fit):
                    per = self.capacity // n
                    whole, rest = divmod(count, per)
                    if whole:
                        add(self.capacity - per * n, (whole, (n,) * per))
                    if rest:
                        add(self.capacity - rest * n, (1, (n,) * rest))
                    break
                r = n + int(fit[0])
                times, pieces = gaps[r].pop()
                if not gaps[r]:
                    room[r] = False
                per = min(r // n, max(1, count // times))
                used = min(times, count // per)
                if used < times:
                    add(r, (times - used, pieces))
                add(r - per * n, (used, pieces + (n,) * per))
                count -= used * per
        for group in gaps.values():
            self.groups += group

    def places(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By length: first ranks, first sequence ids, offsets of runs of equal pieces."""
        runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        rank: dict[int, int] = defaultdict(int)
        sequence = 0
        for times, pieces in self.groups:
            offset = 0
            for n in pieces:
                runs[n].append((rank[n], sequence, offset))
                rank[n] += times
                offset += n
            sequence += times
        return {n: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for n, r in runs.items()}

    @property
    def sequences(self) -> int:
        return sum(t for t, _ in self.groups)


def pieces(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; ids themselves aren't kept."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    @W.lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = T.encoder(vocabulary)
        for b in batches:
            rows = []
            keys = b.column("doc_id").to_pylist()
            for i, ids, sizes in enc.parts(b.column("text")):
                raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(sizes)
                for key, begin, end in zip(keys[i : i + len(sizes)], (ends - sizes).tolist(), ends.tolist(), strict=True):
                    for k, at in enumerate(range(begin, end, capacity)):
                        to = min(end, at + capacity)
                        rows.append((key, k, at - begin, to - at, zlib.crc32(raw[4 * at : 4 * to])))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
            pa.default_memory_pool().release_unused()  # texts of a batch before the next comes
        T.forget()  # a worker that waits holds no tables

    return own.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, *, capacity: int = CAPACITY, **names) -> DataFrame:
    """Every piece with its sequence_id and offset."""
    buckets = 4 * slices(docs.sparkSession)
    cut = pieces(docs, capacity=capacity, **names).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    cut = keep(cut)
    counts = keep(cut.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = docs.sparkSession.sparkContext.broadcast(Plan(histogram, capacity).places())
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = cut.withColumn("inside", inside).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inside"))

    @W.lean
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                first, seq, off = places.value[n]
                k = np.searchsorted(first, rank[at], "right") - 1
                sequence[at], offset[at] = seq[k] + rank[at] - first[k], off[k]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
