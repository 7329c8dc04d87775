"""Words and their 64-bit hashes, straight from Arrow's UTF-8 buffers.

Texts stay bytes: a table of 256 entries says which bytes belong to words (every
byte of a multi-byte character has the high bit set, so byte tables are exact for
the classes used here). Nulls are empty texts. Work goes in chunks of whole
documents so that memory follows the chunk and the longest text, not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa

_SPACES = b" \t\n\x0b\x0c\r"

#: Bytes of words that end at blanks: everything but 0x20 and 0x09-0x0D.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[list(_SPACES)] = False
#: Bytes of words made of digits, letters and all above ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
ALNUM[128:] = True
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_ROLL = 0xD6E8FEB86659FD93
#: Bytes hashed at a time; their arrays stay in a core's cache.
_BLOCK = 1 << 16
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a worker gives back what it holds unused: an executor keeps more workers than it has cores, and all but those at work only wait."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


def give_back() -> None:
    """To the system: what Arrow's pool and the C library's heap have free (glibc keeps up to 64 MB otherwise)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes and their offsets (one more than there are texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, size: int = 1 << 18, most: int = 1 << 9) -> Iterator[tuple[int, int]]:
    """Ranges of documents of up to ``size`` bytes and ``most`` documents; one longer text is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = max(i + 1, min(j, i + most, n))
        yield i, j
        i = j


@dataclass
class Words:
    """Byte ranges of the words of some documents, in order."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    counts: np.ndarray  # words of each document

    @property
    def first(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.counts)))

    def hashes(self) -> np.ndarray:
        """One 64-bit hash a word, equal for equal bytes wherever they stand."""
        n = len(self.starts)
        out = np.empty(n, np.uint64)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + _BLOCK, "right")))
            lo, hi = int(self.starts[i]), int(self.ends[j - 1])
            power, inverse = _power(hi - lo + 1)
            value = np.empty(hi - lo + 1, np.uint64)
            np.multiply(_BYTE[self.raw[lo:hi]], power[: hi - lo], out=value[:-1])
            value[-1] = 0
            at = np.empty(2 * (j - i), np.int64)
            at[::2], at[1::2] = self.starts[i:j] - lo, self.ends[i:j] - lo
            out[i:j] = np.add.reduceat(value, at)[::2] * inverse[at[::2]]
            i = j
        return mix(out + (self.ends - self.starts).astype(np.uint64))

    def texts(self) -> list[bytes]:
        data = self.raw.tobytes()
        return [data[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]


def scan(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """The maximal runs of bytes that ``table`` marks, never across documents."""
    n = len(raw)
    inside = table[raw] if n else np.zeros(0, bool)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    lead = inside.copy()
    lead[1:] &= ~inside[:-1] | cut[1:n]
    tail = inside.copy()
    tail[:-1] &= ~inside[1:] | cut[1:n]
    starts = np.flatnonzero(lead)
    counts = np.diff(np.searchsorted(starts, offsets))
    return Words(raw, starts, np.flatnonzero(tail) + 1, np.repeat(np.arange(len(offsets) - 1), counts), counts)


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` neighbouring words, documents aside."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    power = lambda k: np.uint64(pow(_ROLL, k, 2**64))
    out: np.ndarray | None = None
    have, step, size = 0, hashes, 1
    rest = width
    while rest:
        if rest & 1:
            if out is None:
                out, have = step, size
            else:
                n = len(hashes) - have - size + 1
                out, have = out[:n] * power(size) + step[have : have + n], have + size
        rest >>= 1
        if rest:
            step = step[: len(step) - size] * power(size) + step[size:]
            size *= 2
    return mix(out[: len(hashes) - width + 1].copy())


def windows(words: Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and word positions of all runs of ``width`` words inside one document."""
    value = rolling(hashes, width)
    if not len(value):
        return value, np.zeros(0, np.int64)
    same = np.flatnonzero(words.doc[: len(value)] == words.doc[width - 1 :])
    return value[same], same


class Seen:
    """Entry numbers, from 1 on, of 64-bit hashes met before: two tables of slots lead to them.

    The tables grow with the entries, up to ``2 ** slot_bits`` slots each.
    """

    def __init__(self, slot_bits: int = 22):
        self._most, self._bits, self.n = slot_bits, min(slot_bits, 16), 1
        self._key = np.zeros(1 << 12, np.uint64)
        self._slots = [np.zeros(1 << self._bits, np.int32) for _ in range(2)]

    def _spots(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shift = np.uint64(64 - self._bits)
        return (hashes >> shift).astype(np.int64), ((hashes << np.uint64(self._bits)) >> shift).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Entries, 0 for hashes not known."""
        one, two = self._spots(hashes)
        found = self._slots[0][one]
        found[self._key[found] != hashes] = 0
        rest = np.flatnonzero(found == 0)
        other = self._slots[1][two[rest]]
        other[self._key[other] != hashes[rest]] = 0
        found[rest] = other
        return found

    def hash(self, entry: np.ndarray) -> np.ndarray:
        return self._key[entry]

    def add(self, hashes: np.ndarray) -> np.ndarray:
        """New entries in order; a hash that loses its slots is not known any more."""
        n = self.n + len(hashes)
        if n > len(self._key):
            self._key = np.resize(self._key, max(n, 2 * len(self._key)))
        self._key[self.n : n] = hashes
        entry = np.arange(self.n, n, dtype=np.int32)
        self.n = n
        if 4 * n > 1 << self._bits and self._bits < self._most:
            self._bits = min(self._most, (4 * n).bit_length())
            self._slots = [np.zeros(1 << self._bits, np.int32) for _ in range(2)]
            self._put(np.arange(1, n, dtype=np.int32))
        else:
            self._put(entry)
        return entry

    def _put(self, entry: np.ndarray) -> None:
        one, two = self._spots(self._key[entry])
        free = self._slots[0][one] == 0
        self._slots[0][one[free]] = entry[free]
        late = np.flatnonzero(self._slots[0][one] != entry)  # a slot that is taken: the other table
        self._slots[1][two[late]] = entry[late]
