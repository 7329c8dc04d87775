"""Which 64-bit values occur in two documents or more, without moving any text.

Map tasks send each value once per chunk of documents, cut into slices of the value
space: sorted 32-bit keys as differences, byte plane by byte plane, which shuffle
compression takes to two or three bytes a value. The task of a slice finds the keys
met twice and returns them as its own segment of one Bloom filter, whose size is
bounded. Filters only let too much through, never too little, so whoever uses one
stays exact; as data outgrow the filter, more passes and the work after it grows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .durable import slices
from .words import lean, mix

#: Bits of a filter over all slices: 16 MB, and for more values up to 128 MB, never more.
FILTER_BITS, MOST_BITS = 1 << 27, 1 << 30
#: Values held by a map task before it sends them.
CHUNK_VALUES = 500_000
MARKED, SEVERAL = 1, 2

#: What a map function yields: values, the number of their document, and which are marked.
Emitted = Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _planes(keys: np.ndarray) -> bytes:
    """Sorted 32-bit keys as byte planes of their differences."""
    diff = np.diff(keys.astype(np.int64), prepend=0).astype("<u4")
    return np.ascontiguousarray(diff.view(np.uint8).reshape(-1, 4).T).tobytes()


def _keys(planes: bytes) -> np.ndarray:
    parts = np.frombuffer(planes, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(parts.T).view("<u4").ravel().astype(np.uint64), dtype=np.uint64)


def slice_of(values: np.ndarray, n: int) -> np.ndarray:
    return ((values >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _rows(values: np.ndarray, docs: np.ndarray, marked: np.ndarray, n: int, named: bool = False) -> pa.RecordBatch:
    """One row a slice; ``named``: with the number of each value's (least) document."""
    at = (slice_of(values, n) << np.uint64(32)) | (values & np.uint64(0xFFFFFFFF))
    order = np.argsort(at)
    at, docs, marked = at[order], docs[order], marked[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    several = np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first)
    flags = np.logical_or.reduceat(marked, first).astype(np.uint8) * MARKED + several.astype(np.uint8) * SEVERAL
    at = at[first]
    piece = (at >> np.uint64(32)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1], [True])))
    low = at & np.uint64(0xFFFFFFFF)
    keys = [_planes(low[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    bits = [np.packbits(np.unpackbits(flags[a:b, None], axis=1, count=2, bitorder="little"), bitorder="little").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
    least = np.minimum.reduceat(docs, first).astype("<i8") if named else np.zeros(0, "<i8")
    names = [least[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(piece[cut[:-1]], pa.int32()), pa.array(keys, pa.binary()), pa.array(bits, pa.binary()), pa.array(names, pa.binary())], names=["slice", "keys", "flags", "docs"])


def _found(keys: list[bytes], flags: list[bytes], docs: list[bytes] | None = None) -> np.ndarray:
    """Keys that are marked somewhere and come from two documents.

    Without ``docs``, a key of two chunks is taken to come from two documents.
    """
    packed = []
    for k, f in zip(keys, flags, strict=True):
        value = _keys(k)
        bits = np.unpackbits(np.frombuffer(f, np.uint8), bitorder="little")[: 2 * len(value)].reshape(-1, 2)
        packed.append((value << np.uint64(2)) | (bits[:, 0] | bits[:, 1] << 1).astype(np.uint64))
    every = np.concatenate(packed)
    packed.clear()
    if docs is None:
        every.sort()
    else:
        order = np.argsort(every)
        every = every[order]
    key = every >> np.uint64(2)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    flag = np.bitwise_or.reduceat(every & np.uint64(3), first)
    if docs is None:
        apart = np.diff(np.append(first, len(key))) > 1
    else:
        named = np.concatenate([np.frombuffer(d, "<i8") for d in docs])[order]
        apart = np.minimum.reduceat(named, first) != np.maximum.reduceat(named, first)
    return key[first][((flag & np.uint64(MARKED)) > 0) & (apart | ((flag & np.uint64(SEVERAL)) > 0))]


class Filter:
    """A Bloom filter whose segments belong to slices."""

    def __init__(self, n: int, bits: int = FILTER_BITS):
        self.n, self.bits = n, max(64, bits // n // 8 * 8)
        self.data = np.zeros(n * self.bits // 8, np.uint8)

    @staticmethod
    def spots(low: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        spread = mix(low + np.uint64(0x51ED270B))
        return tuple(((half * np.uint64(bits)) >> np.uint64(32)).astype(np.int64) for half in (spread >> np.uint64(32), spread & np.uint64(0xFFFFFFFF)))

    @classmethod
    def segment(cls, low: np.ndarray, n: int, bits: int = FILTER_BITS) -> bytes:
        own = max(64, bits // n // 8 * 8)
        on = np.zeros(own, bool)
        for s in cls.spots(low, own):
            on[s] = True
        return np.packbits(on, bitorder="little").tobytes()

    def put(self, piece: int, segment: bytes) -> None:
        size = self.bits // 8
        self.data[piece * size : (piece + 1) * size] |= np.frombuffer(segment, np.uint8)

    def has(self, values: np.ndarray) -> np.ndarray:
        base = slice_of(values, self.n).astype(np.int64) * self.bits
        ok = np.ones(len(values), bool)
        for s in self.spots(values & np.uint64(0xFFFFFFFF), self.bits):
            at = base + s
            ok &= (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        return ok


def repeated(docs: DataFrame, emit: Callable[[Iterator[pa.RecordBatch]], Emitted], *, single: bool = False, named: bool = False, values: int = 0) -> Filter:
    """A filter of the values that ``emit`` gives for two documents, at least once marked.

    With ``single``, of all marked values. With ``named``, numbers of documents hold over all
    tasks and travel along; without, they only tell documents of one task apart. ``values``: about how many values there are, where known.
    """
    n, total = slices(docs.sparkSession), min(MOST_BITS, max(FILTER_BITS, 1 << (2 * values).bit_length()))

    @lean
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in emit(batches):
            held.append(part)
            size += len(part[0])
            if size >= CHUNK_VALUES:
                yield _rows(*map(np.concatenate, zip(*held, strict=True)), n, named)
                held, size = [], 0
        if size:
            yield _rows(*map(np.concatenate, zip(*held, strict=True)), n, named)

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        keys, flags = table.column("keys").to_pylist(), table.column("flags").to_pylist()
        low = np.unique(np.concatenate([_keys(k) for k in keys])) if single else _found(keys, flags, table.column("docs").to_pylist() if named else None)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([Filter.segment(low, n, total)], pa.binary())})

    out = Filter(n, total)
    segments = docs.mapInArrow(send, "slice int, keys binary, flags binary, docs binary").groupBy("slice").applyInArrow(gather, "slice int, bits binary")
    for row in segments.collect():  # as many bytes as the filter has
        out.put(row["slice"], bytes(row["bits"]))
    return out


def members(df: DataFrame, column: str) -> Filter:
    """A filter of the values of a column of longs."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Emitted:
        for b in batches:
            v = scramble(b.column(column).drop_null().to_numpy(zero_copy_only=False))
            yield v, np.zeros(len(v), np.int64), np.ones(len(v), bool)

    return repeated(df.select(column), emit, single=True)


def scramble(longs: np.ndarray) -> np.ndarray:
    """Longs as evenly spread values."""
    return mix(np.ascontiguousarray(longs, np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
