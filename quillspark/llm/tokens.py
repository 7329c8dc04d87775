"""Token ids of whole texts, with the tokenizers library and a cache of units.

Words repeat far more often than texts do. The pre-tokenizer never looks across blanks,
nor across a border of a Latin letter run and ASCII punctuation without apostrophes, so
a text's ids are those of such units, one after the other. A word with any other byte is
a unit by itself. Units are cut and hashed in Arrow's buffers (``words``), plain ones in
lower case, looked up by their 64-bit hashes in a table of units met before, and a
text's ids are gathered from there as arrays; only units that are new go through the
library, many in one call. Special tokens in a text become their own ids, as the library
has it by default. The tables are emptied at a bounded number of units.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from . import words as W

END_ID = 1
#: Units that a worker remembers.
CACHE_UNITS = 1_500_000
_SLOT_BITS = 22
#: New plain units of one call.
_TOGETHER = 512

_BLANK, _LETTER, _MARK, _ODD = 0, 1, 2, 3
#: By byte: blank, ASCII letter, ASCII punctuation other than apostrophes and '<' (which may open a special token), or other.
_KIND = np.full(256, _ODD, np.uint8)
_KIND[~W.NOT_BLANK] = _BLANK
_KIND[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = _LETTER
_KIND[list(b"!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~")] = _MARK
#: Second bytes of the two-byte letters from U+00C0 to U+00FF, all but the signs of times and division.
_LEAD = 0xC3
_SECOND = np.zeros(256, bool)
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False
_SECOND_LOWER = np.arange(256, dtype=np.uint8)
_SECOND_LOWER[0x80:0x9F] += 0x20


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary lies on this machine; each worker looks for itself."""
    import public_tokenizers

    return public_tokenizers.path(name)


def units(raw: np.ndarray, offsets: np.ndarray) -> tuple[W.Words, np.ndarray]:
    """(units of some documents in order, in lower case where plain; which are plain)."""
    kind = _KIND[raw]
    lead = np.flatnonzero(raw[:-1] == _LEAD) if len(raw) else np.zeros(0, np.int64)
    lead = lead[_SECOND[raw[lead + 1]]]
    low = W.LOWER[raw]
    kind[lead] = kind[lead + 1] = _LETTER
    low[lead + 1] = _SECOND_LOWER[raw[lead + 1]]
    words = W.scan(raw, offsets, W.NOT_BLANK)
    odd = np.concatenate(([0], np.cumsum(kind == _ODD)))
    odd = np.flatnonzero(odd[words.ends] > odd[words.starts])
    if len(odd):  # words that stay whole and as they are
        size = words.ends[odd] - words.starts[odd]
        at = np.arange(int(size.sum())) + np.repeat(words.starts[odd] - (np.cumsum(size) - size), size)
        kind[at], low[at] = _ODD, raw[at]
    border = np.zeros(len(raw) + 1, bool)
    border[1:-1] = kind[1:] != kind[:-1]
    border[words.starts] = border[words.ends] = True
    inside = kind != _BLANK
    starts = np.flatnonzero(border[:-1] & inside)
    ends = np.flatnonzero(border[1:] & inside) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return W.Words(low, starts, ends, np.repeat(np.arange(len(offsets) - 1), counts), counts), kind[starts] != _ODD


class Encoder:
    def __init__(self, path: str | None = None, most: int = CACHE_UNITS):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._own = Tokenizer.from_file(path or vocabulary())
        self._most = most
        self._ends = np.zeros(self._own.get_vocab_size() + 1, bool)
        self._ends[[i for t, i in self._own.get_vocab().items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        """Entry 0 is the end id."""
        self._seen, self._used = W.Seen(_SLOT_BITS), 1
        self.start, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.ids[0], self.size[0] = END_ID, 1

    def entries(self, found: W.Words, plain: np.ndarray) -> np.ndarray:
        """The entry of each unit: ``ids[start[e] : start[e] + size[e]]`` are its ids. Good until the next call."""
        if self._seen.n > self._most:
            self._clear()
        hashes = found.hashes()
        entry = self._seen.find(hashes)
        lost = np.flatnonzero(entry == 0)
        if len(lost):
            fresh, at = np.unique(hashes[lost], return_index=True)
            at = lost[at]
            order = np.argsort(~plain[at], kind="stable")  # plain ones first
            n = int(plain[at].sum())
            ids, size = self._plain(found, at[order[:n]])
            odd = self._own.encode_batch_fast([found.raw[a:z].tobytes().decode() for a, z in zip(found.starts[at[order[n:]]].tolist(), found.ends[at[order[n:]]].tolist(), strict=True)], add_special_tokens=False)
            odd_ids = [np.array(e.ids, np.uint32) for e in odd]
            new = np.empty(len(fresh), np.int64)
            new[order] = self._add(fresh[order], np.concatenate([*ids, *odd_ids, np.zeros(0, np.uint32)]), np.concatenate([*size, np.array([len(x) for x in odd_ids], np.int64)]))
            entry[lost] = new[np.searchsorted(fresh, hashes[lost])]
        return entry

    def _plain(self, found: W.Words, at: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids, and ids a unit: each plain unit is one pre-token, so it ends at the first id that ends a word."""
        ids, sizes = [], []
        for i in range(0, len(at), _TOGETHER):
            a, z = found.starts[at[i : i + _TOGETHER]], found.ends[at[i : i + _TOGETHER]]
            wide = z - a + 1
            last = np.cumsum(wide)
            where = np.arange(int(last[-1])) + np.repeat(a - (last - wide), wide)
            joined = found.raw[np.minimum(where, len(found.raw) - 1)]
            joined[last - 1] = 32
            got = np.array(self._own.encode_batch_fast([joined.tobytes().decode()], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(self._ends[got]) + 1
            if len(cuts) != len(a):  # never seen; then one by one
                each = [np.array(e.ids, np.uint32) for e in self._own.encode_batch_fast([found.raw[x:y].tobytes().decode() for x, y in zip(a.tolist(), z.tolist(), strict=True)], add_special_tokens=False)]
                got, cuts = np.concatenate(each), np.cumsum([len(x) for x in each])
            ids.append(got)
            sizes.append(np.diff(cuts, prepend=0))
        return ids, sizes

    def _add(self, hashes: np.ndarray, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        entry = self._seen.add(hashes)
        n, used = self._seen.n, self._used + len(ids)
        if n > len(self.size):
            self.start, self.size = (np.resize(x, max(n, 2 * len(x))) for x in (self.start, self.size))
        if used > len(self.ids):
            self.ids = np.resize(self.ids, max(used, 2 * len(self.ids)))
        self.ids[self._used : used] = ids
        self.size[entry] = size
        self.start[entry] = self._used + np.cumsum(size) - size
        self._used = used
        return entry

    def parts(self, column: pa.Array, end: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of some texts, ids a text), a bounded number of bytes or one text at a time."""
        raw, offsets = W.utf8(column)
        for i, j in W.chunks(offsets):
            found, plain = units(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            entry, counts = self.entries(found, plain).astype(np.int64), found.counts
            if end:
                whole = np.zeros(len(entry) + j - i, np.int64)
                mask = np.ones(len(whole), bool)
                counts = counts + 1
                mask[np.cumsum(counts) - 1] = False
                whole[mask] = entry
                entry = whole
            size = self.size[entry]
            last = np.cumsum(size, dtype=np.int64)
            ids = self.ids[np.arange(int(last[-1]) if len(last) else 0) + np.repeat(self.start[entry] - (last - size), size)]
            ends = np.concatenate(([0], last))[np.concatenate(([0], np.cumsum(counts)))]
            yield i, ids, np.diff(ends)

    def ids_bytes(self, texts: Iterable[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without an end id."""
        out = []
        for _, ids, sizes in self.parts(pa.array(texts, pa.large_string()), end=False):
            raw, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(sizes)
            out += [raw[a:z] for a, z in zip((ends - 4 * sizes).tolist(), ends.tolist(), strict=True)]
        return out

    def ends(self, size: int) -> np.ndarray:
        """By id: does it end a word."""
        out = np.zeros(size, bool)
        out[: len(self._ends)] = self._ends[:size]
        return out


@cache
def encoder(path: str | None = None) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def forget() -> None:
    """Frees a worker's encoders: operators that don't encode call it where they begin, as workers are used again."""
    encoder.cache_clear()
