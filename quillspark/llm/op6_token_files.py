"""Token-id files: an adaptive context-mixing range coder over ids.

A file is a row of *stretches*, each of whole documents in ascending id order, kept
as Parquet rows so that any store Spark writes to can hold them. A stretch has a
directory of its documents and blocks of up to ``LANES * STEPS`` ids. Every block
starts from nothing, carries checksums of its code and of its ids, and can be read
without any other block.

In a block, ids lie in lanes of neighbouring ids, one lane a row of a matrix, which
is coded column by column. The model holds what the columns before have shown: for
order 2 and order 1 the id last seen after the same two or one ids, for order 0 the
counts of all ids. An id's odds are the mixture of the three,

    P(id) = w0 * P0(id) + w1 * [id is the order-1 guess] + w2 * [id is the order-2 guess],

and drive one step of a range coder. The weights adapt by state (no guess, order 1 only,
two guesses that differ, two that agree) to how often each order was right there. The
model learns at the columns of ``MARKS``, from all columns before, through the whole
lane, so that all lanes of many blocks pass through the range coder as arrays.

Ids may be any below ``MOST_IDS``; larger ones raise ValueError. Empty and null texts are
documents of one id, the end. Documents with equal ids stay rows of their own, ordered
by a hash of their text; documents without an id come first. An empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import tokens as T
from .durable import keep, slices

LANES, STEPS = 256, 128
BLOCK = LANES * STEPS
STRETCH = 16 * BLOCK
MAGIC = b"QSB2"
HEAD = "<4sIIIII"
HEAD_BYTES = struct.calcsize(HEAD)
#: Columns before which the model learns from all columns so far.
MARKS = (1, 2, 4, 8, 16, 32, 64, 96)
#: The alphabet of a block is a multiple of ``GROUP`` ids, from ``LEAST_IDS`` on.
GROUP, LEAST_IDS, MOST_IDS = 256, 1 << 16, 1 << 21
#: Files whose starts are broadcast: one row a file, so at most so many rows.
MOST_FILES = 1 << 18
#: Blocks that are coded together; their tables should fit a core's cache.
_AT_ONCE = 16
_SLOTS = 1 << 15
_GAIN = 48
#: Up to 7 slots begin among 256 values: those of told ids are over ``_GAIN`` wide, an id 0 may be 1 wide.
_NEAR_BITS = (2, 1, 0)
_WEIGHT_BITS = 10
_WHOLE = 1 << _WEIGHT_BITS
_TOP = np.uint64(1 << 32)
_MASK = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


class Model:
    """The predictions of some blocks at once; ``block`` says whose lane it is.

    An id that a block has shown has a *slot*, a number over all blocks; slot 0 is none. All tables are by slot,
    so they are as long as what was shown, not as the alphabet, and mostly stay in a core's cache. An id without a slot
    has a count of 1, so order-0 sums are closed forms: before an id lie its number and ``_GAIN`` for each telling of
    a smaller id. Sums run on from block to block, so one sorted list serves all.
    """

    def __init__(self, block: np.ndarray, ids: int, told: np.ndarray | None = None):
        """``told``: all ids to come, column by column, for a coder that has them."""
        n, self.blocks, self.ids = len(block), int(block[-1]) + 1, ids
        #: of what is below ``_WHOLE`` times a block's order-0 sum
        self.kind = np.int32 if (ids + _GAIN * BLOCK) * _WHOLE < 1 << 31 else np.int64
        self.block, self.base, self.base2, self.base8 = block, block * ids, block * _SLOTS, block * 8
        self.edges = np.searchsorted(block, np.arange(self.blocks + 1))
        self.slot = np.zeros(self.blocks * ids, np.int32)
        # whatever indexes a table is of 64 bits, as numpy would make it so each time
        self.past = np.zeros((STEPS + 2, n), np.uint32)  # ids by column, after two columns of zeros
        self.at = np.zeros((STEPS + 1, n), np.int64)  # their slots, after one
        self.place = np.zeros((STEPS, n), np.int64)  # of their contexts in ``after2``
        self.events = np.zeros((STEPS, n), np.uint8)
        self.keys, self.order = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.count, self.after1, self.after2 = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(self.blocks * _SLOTS, np.int32)
        #: by state: times seen, order 1 right (order 2 not), order 2 right
        self.seen = np.tile(np.array([[8, 0, 0], [8, 3, 0], [8, 1, 2], [8, 0, 5]], np.int64), (self.blocks, 1, 1))
        known = np.zeros(self.blocks * ids, bool)
        known[::ids] = True
        for ids_ in () if told is None else told:
            known[self.base + ids_] = True
        self._add(np.flatnonzero(known))
        self.at[0] = self.slot[self.base]
        for t, ids_ in enumerate(() if told is None else told):
            self.past[t + 2], self.at[t + 1] = ids_, self.slot.take(self.base + ids_)
        self._sum()

    def _add(self, keys: np.ndarray) -> None:
        """Slots for sorted new keys, which are ``block * ids + id``."""
        new = np.arange(len(self.count), len(self.count) + len(keys))
        where = np.searchsorted(self.keys, keys)
        self.keys, self.order = np.insert(self.keys, where, keys), np.insert(self.order, where, new)
        self.slot[keys] = new
        self.count, self.after1 = np.append(self.count, np.zeros_like(new)), np.append(self.after1, np.zeros_like(new))

    def _sum(self) -> None:
        n = self.count[self.order]
        ends = np.cumsum(n) * _GAIN
        self.sums = (self.keys + ends - _GAIN * n).astype(np.int32)
        self.wides = (1 + _GAIN * n).astype(self.kind)
        at = np.searchsorted(self.keys, np.arange(self.blocks) * self.ids)
        start = np.append(self.sums[at], len(self.slot) + ends[-1])
        self.start, whole = start[:-1].astype(np.int32)[self.block], np.diff(start)
        own = np.repeat(start[:-1], np.diff(np.append(at, len(n))))
        self.cum, self.wide = np.zeros(len(self.count), self.kind), np.zeros(len(self.count), self.kind)
        self.cum[self.order], self.wide[self.order] = self.sums - own, self.wides
        self.total = (whole[self.block] << _WEIGHT_BITS).astype(np.uint64)
        part = (_WHOLE - 32) * self.seen[:, :, 1:] // self.seen[:, :, :1]
        w1, w2 = np.zeros((self.blocks, 8), np.int64), np.zeros((self.blocks, 8), np.int64)
        w1[:, [1, 3]], w2[:, [2, 3]] = part[:, 1:3, 0], part[:, [2, 2], 1]
        w1[:, 7] = part[:, 3].sum(1)  # guesses that agree are one
        self.weight0 = (_WHOLE - w1 - w2).astype(self.kind).ravel()
        self.mass1, self.mass2 = ((whole[:, None] * w).astype(self.kind).ravel() for w in (w1, w2))

    def index(self) -> None:
        """For ``find``: the last slot that begins no later than each 256th value."""
        self.first = np.cumsum(np.bincount((self.sums + 255) >> 8, minlength=int(self.sums[-1] + self.wides[-1] + self.ids >> 8) + 2)) - 1
        self.reach = np.append(self.sums, np.full(2 << _NEAR_BITS[0], np.iinfo(np.int32).max, np.int32))

    def find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(id, slot, begin, width) where each lane's order-0 value lies. Slots are wide, so few begin among 256 values."""
        whole = value + self.start
        j = self.first.take(whole >> 8)
        for bit in _NEAR_BITS:
            j += (self.reach.take(j + (1 << bit)) <= whole).view(np.uint8) << np.uint8(bit)
        whole -= self.sums.take(j)
        wide = self.wides.take(j)
        known = whole < wide
        past = np.maximum(whole - wide + 1, 0)  # ids after the slot's
        past += (self.keys.take(j) - self.base).astype(self.kind)
        return past, self.order.take(j) * known, value - whole * known, np.where(known, wide, 1)

    def guess(self, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Column t's order-1 and order-2 guesses (slots), which there are (1, 2, and 4 if they agree), weight of order 0, masses."""
        two, one = self.past[t], self.past[t + 1]
        place = self.place[t]
        # of bits that 32-bit products have, too
        np.add(self.base2, (two * np.uint32(40503) + one * np.uint32(30011) >> np.uint32(3)) & np.uint32(_SLOTS - 1), out=place)
        g1, g2 = self.after1.take(self.at[t]), self.after2.take(place).astype(np.int64)
        some2 = g2 > 0
        which = (g1 > 0).view(np.uint8) | some2.view(np.uint8) << np.uint8(1) | ((g1 == g2) & some2).view(np.uint8) << np.uint8(2)
        at = self.base8 + which
        return g1, g2, which, self.weight0.take(at), self.mass1.take(at), self.mass2.take(at)

    def learn(self, since: int, t: int) -> None:
        """From the columns ``since`` to t, of which an id of slot 0 is new. Later columns win."""
        now = self.at[since + 1 : t + 1].ravel()
        new = np.flatnonzero(now == 0)
        if len(new):
            keys = (self.base + self.past[since + 2 : t + 2]).ravel()[new]
            fresh = np.sort(keys)
            self._add(fresh[np.append(True, fresh[1:] != fresh[:-1])])
            now[new] = self.slot[keys]
        self.count += np.bincount(now, minlength=len(self.count))
        for c in range(since, t):
            self.after1[self.at[c]] = self.at[c + 1]
            self.after2[self.place[c]] = self.at[c + 1]
        hits = np.array([np.bincount(self.events[since:t, a:z].ravel(), minlength=32) for a, z in zip(self.edges[:-1], self.edges[1:], strict=True)]).reshape(-1, 4, 8)
        every, right1, right2 = hits.sum(1), hits[:, 1], hits[:, 2] + hits[:, 3]
        for which, state in ((0, 0), (1, 1), (2, 2), (3, 2)):
            self.seen[:, state] += np.stack((every[:, which], right1[:, which], right2[:, which]), 1)
        self.seen[:, 3, 0] += every[:, 7]
        self.seen[:, 3, 2] += right1[:, 7] + right2[:, 7]
        self._sum()


def _lanes(n: int) -> int:
    return max(1, -(-n // STEPS))


def _emit(low: np.ndarray, span: np.ndarray, out: np.ndarray, used: np.ndarray) -> None:
    """Settled upper halves of ``low`` leave to ``out``, at the places ``used``; a carry that could still come is ruled out by a smaller span."""
    idx = np.flatnonzero(span < _TOP)
    if len(idx):
        lo = low.take(idx)
        rg = _shrunk(lo, span.take(idx))
        at = used.take(idx)
        out[at] = (lo >> _32).astype(np.uint32)
        used[idx] = at + 1
        low[idx], span[idx] = lo << _32, rg << _32


def _shrunk(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    return np.where((low ^ (low + span)) >= _TOP, (~low + np.uint64(1)) & _MASK, span)


def _alphabet(ids: np.ndarray) -> int:
    most = max(LEAST_IDS, -(-(int(ids.max(initial=0)) + 1) // GROUP) * GROUP)
    if most > MOST_IDS:
        raise ValueError(f"ids of {MOST_IDS} and more can't be coded")
    return most


def encode_blocks(parts: list[np.ndarray], alphabet: int) -> list[bytes]:
    """A coded block for each array of at most ``BLOCK`` ids."""
    lanes = [_lanes(len(p)) for p in parts]
    block = np.repeat(np.arange(len(parts)), lanes)
    ids = np.zeros((sum(lanes), STEPS), np.int64)
    at = 0
    for p, k in zip(parts, lanes, strict=True):
        ids[at : at + k].reshape(-1)[: len(p)] = p
        at += k
    n = len(ids)
    model = Model(block, alphabet, np.ascontiguousarray(ids.T))
    low, span = np.zeros(n, np.uint64), np.full(n, 2**64 - 1, np.uint64)
    out, used = np.zeros((n, STEPS + 8), np.uint32), np.arange(n) * (STEPS + 8)
    learnt = 0
    for t in range(STEPS):
        if t in MARKS:
            model.learn(learnt, t)
            learnt = t
        now = model.at[t + 1]
        g1, g2, which, w0, mass1, mass2 = model.guess(t)
        hit1, hit2 = g1 == now, g2 == now
        begin = w0 * model.cum.take(now) + mass1 * (g1 < now) + mass2 * (g2 < now)  # slots are in the order of ids here
        freq = w0 * model.wide.take(now) + mass1 * hit1 + mass2 * hit2
        r = span // model.total
        low += r * begin.astype(np.uint64)
        span = r * freq.astype(np.uint64)
        _emit(low, span, out.reshape(-1), used)
        model.events[t] = which | hit1.view(np.uint8) << np.uint8(3) | hit2.view(np.uint8) << np.uint8(4)
    out.reshape(-1)[used] = ((low + _MASK) >> _32).astype(np.uint32)
    used += 1 - np.arange(n) * (STEPS + 8)
    blocks, at = [], 0
    live = np.arange(out.shape[1]) < used[:, None]
    for p, k in zip(parts, lanes, strict=True):
        code = used[at : at + k].astype("<u2").tobytes() + out[at : at + k][live[at : at + k]].astype("<u4").tobytes()
        blocks.append(struct.pack(HEAD, MAGIC, len(p), alphabet, len(code), zlib.crc32(code), zlib.crc32(p.astype("<u4").tobytes())) + code)
        at += k
    return blocks


def decode_blocks(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block, all of one alphabet; a block whose checksums differ raises ValueError."""
    heads = [struct.unpack_from(HEAD, b) for b in blocks]
    lanes = [_lanes(h[1]) for h in heads]
    n = sum(lanes)
    block = np.repeat(np.arange(len(blocks)), lanes)
    words = np.zeros((n, STEPS + 10), np.uint32)  # two and one a step are read at most
    at = 0
    for b, (magic, _, alphabet, size, crc, _), k in zip(blocks, heads, lanes, strict=True):
        code = b[HEAD_BYTES : HEAD_BYTES + size]
        if magic != MAGIC or alphabet != heads[0][2] or alphabet > MOST_IDS or len(code) != size or zlib.crc32(code) != crc:
            raise ValueError("damaged block")
        sizes = np.frombuffer(code, "<u2", k).astype(np.int64)
        flat = np.frombuffer(code, "<u4", int(sizes.sum()), 2 * k)
        row = np.repeat(np.arange(k), sizes)
        words[at + row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        at += k
    model = Model(block, heads[0][2])
    model.index()
    same_size = np.uint32 if model.kind is np.int32 else np.uint64
    low, span = np.zeros(n, np.uint64), np.full(n, 2**64 - 1, np.uint64)
    value, used = (words[:, 0].astype(np.uint64) << _32) | words[:, 1], np.arange(n) * (STEPS + 10) + 2
    learnt = 0
    for t in range(STEPS):
        if t in MARKS:
            model.learn(learnt, t)
            model.index()
            learnt = t
        g1, g2, which, w0, mass1, mass2 = model.guess(t)
        r = span // model.total
        v = np.minimum((value - low) // r, model.total - np.uint64(1)).astype(model.kind)
        # how far behind the begin of each guess; one that is missing has no mass and no width, so nothing lies in it
        cum1, cum2 = model.cum.take(g1), model.cum.take(g2)
        below = cum2 < cum1
        far1, far2 = v - (w0 * cum1 + mass2 * below), v - (w0 * cum2 + mass1 * ~below)
        wide1, wide2 = w0 * model.wide.take(g1) + mass1, w0 * model.wide.take(g2) + mass2
        hit1 = far1.view(same_size) < wide1.view(same_size)
        hit2 = (far2.view(same_size) < wide2.view(same_size)) & ~hit1
        before = mass1 * (far1 >= wide1) + mass2 * (far2 >= wide2)
        # below 2^53, so the quotient of floats has the right whole part
        spot = ((v - before) / w0).astype(np.int32)
        np.copyto(spot, cum1, where=hit1)
        np.copyto(spot, cum2, where=hit2)
        model.past[t + 2], model.at[t + 1], cum, wide = model.find(spot)
        low += r * (w0 * cum + before).astype(np.uint64)
        span = r * (w0 * wide + mass1 * hit1 + mass2 * hit2).astype(np.uint64)
        idx = np.flatnonzero(span < _TOP)
        if len(idx):
            lo = low.take(idx)
            rg = _shrunk(lo, span.take(idx))
            at = used.take(idx)
            value[idx] = (value.take(idx) << _32) | words.take(at)
            used[idx] = at + 1
            low[idx], span[idx] = lo << _32, rg << _32
        model.events[t] = which | hit1.view(np.uint8) << np.uint8(3) | hit2.view(np.uint8) << np.uint8(4)
    ids = model.past[2:].T
    out, at = [], 0
    for (_, size, _, _, _, crc), k in zip(heads, lanes, strict=True):
        got = ids[at : at + k].reshape(-1)[:size].astype("<u4")
        if zlib.crc32(got.tobytes()) != crc:
            raise ValueError("a block's ids differ from its checksum")
        out.append(got)
        at += k
    return out


def pack(ids: np.ndarray) -> bytes:
    """A stretch's blocks, one after the other."""
    parts, alphabet = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)], _alphabet(ids)
    return b"".join(b for i in range(0, len(parts), _AT_ONCE) for b in encode_blocks(parts[i : i + _AT_ONCE], alphabet))


def unpack(data: bytes) -> np.ndarray:
    blocks, at = [], 0
    while at < len(data):
        end = at + HEAD_BYTES + struct.unpack_from(HEAD, data, at)[3]
        blocks.append(data[at:end])
        at = end
    got = [a for i in range(0, len(blocks), _AT_ONCE) for a in decode_blocks(blocks[i : i + _AT_ONCE])]
    return np.concatenate(got) if got else np.zeros(0, "<u4")


def write(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """The written files: file, stretch int, first long, doc_ids, lengths array<long>, n_tokens long, code binary.

    ``first``: the ids of the file before the stretch. Documents are range partitioned, so
    file k holds smaller ids than file k+1; a lost executor costs the files it was writing,
    which Spark's committer writes again.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = own.repartitionByRange(slices(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, count, before = T.encoder(vocabulary), TaskContext.get().partitionId(), 0, 0
        held, names, sizes, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"file": pa.array([part], pa.int32()), "stretch": pa.array([count], pa.int32()), "first": pa.array([before], pa.int64()), "doc_ids": pa.array([names], pa.list_(pa.int64())), "lengths": pa.array([sizes], pa.list_(pa.int64())), "n_tokens": pa.array([size], pa.int64()), "code": pa.array([pack(np.concatenate(held))], pa.binary())})

        for b in batches:
            keys = b.column("doc_id").to_pylist()
            for i, ids, many in enc.parts(b.column("text")):
                ends = np.cumsum(many)
                for key, n, end in zip(keys[i : i + len(many)], many.tolist(), ends.tolist(), strict=True):
                    if held and size + n > STRETCH:
                        yield flush()
                        held, names, sizes, size, count, before = [], [], [], 0, count + 1, before + size
                    held.append(ids[end - n : end])
                    names.append(key)
                    sizes.append(n)
                    size += n
        if held:
            yield flush()

    return keep(ordered.mapInArrow(code, "file int, stretch int, first long, doc_ids array<long>, lengths array<long>, n_tokens long, code binary"))


def starts(files: DataFrame) -> DataFrame:
    """file, base: the ids of all files before, one row a file."""
    by_file = files.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    return by_file.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("base"))


def read(files: DataFrame, *, ids: bool = True) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, and ids as packed bytes.

    Without ``ids`` they are decoded and checked alike, and stay in the task.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ends = np.cumsum(row["lengths"])
                begin = ends - row["lengths"]
                raw = memoryview(unpack(row["code"]).astype("<u4", copy=False)).cast("B")
                cuts = [raw[4 * a : 4 * z] for a, z in zip(begin.tolist(), ends.tolist(), strict=True)]
                cols = {"doc_id": pa.array(row["doc_ids"], pa.int64()), "start": pa.array(begin + (row["first"] + row["base"]), pa.int64()), "n_tokens": pa.array(row["lengths"], pa.int64()), "ids_crc32": pa.array([zlib.crc32(c) for c in cuts], pa.int64())}
                yield pa.RecordBatch.from_pydict(cols | ({"ids": pa.array(map(bytes, cuts), pa.binary())} if ids else {}))

    base = starts(files)
    base = F.broadcast(base) if slices(files.sparkSession) <= MOST_FILES else base.hint("merge")
    return files.join(base, "file").select("first", "base", "doc_ids", "lengths", "code").mapInArrow(back, schema)


def report(docs: DataFrame, **names) -> DataFrame:
    return read(write(docs, **names), ids=False)
