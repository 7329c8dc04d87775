"""Language-model scores from a small causal self-attention model, trained in numpy.

Tokens are words and ends of texts; the model reads each as its first subword id
(``tokens``). One attention layer looks back over a window of ``CONTEXT + STRIDE`` tokens;
windows overlap by ``CONTEXT`` tokens, so each token is scored once, with context, and all
windows of a batch go through masked attention as arrays. Its output is a class of
subword ids: the commonest ids are classes of their own, the end is one, and the rest
share classes of ids that stand near the same common ids, apart for ids that end a word
and that don't. Within a class, tokens have their corpus odds, over all training documents:

    P(token | context) = P(class | context) * (c + 0.5) / M(class)

where c is the token's count and M(class) the sum of c + 0.5 over the class's words, and
0.5 more for a word that training has not seen. So what the model adds to the base score is
the log ratio of P(class | context) to the class's share of the corpus, and every word's
count, seen or unseen, enters both alike.

Corpus counts of words, classes and neighbours cover every training document, and attention
learns from every training token once: documents are dealt to ``ROUNDS`` rounds of growing
share; in each, tasks stream their windows, placed as they are for scoring, through
gradient steps, and their weights are averaged (64 at a time, level by level).

Counts of the ``TOP_WORDS`` commonest words go to all executors (a fixed bound); rarer words
wait in the row for a shuffled join with the counts, so no vocabulary is ever gathered.
Words are told apart by 64-bit hashes.

Null and empty texts are one token, the end. Rows of equal doc_id are scored each by
itself. Without training documents every score is that of the untrained model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import learn
from . import tokens as T
from . import words as W
from .durable import keep

HELD_OUT = 1
TOP_WORDS = 1 << 18
CONTEXT, STRIDE, WIDTH = 8, 24, 16
LEN = CONTEXT + STRIDE
OWN, SHARED = 64, 48
#: One more class: the end of a text.
CLASSES = OWN + SHARED + 1
INPUTS, COMMON_INPUTS = 4096, 3072
#: Subword ids are below this; the last stands for the end.
VOCABULARY = 1 << 16
END = VOCABULARY - 1
#: Shares of the training documents by round.
ROUNDS = (0.05, 0.2, 1.0)
BATCH, RATE = 64, 0.02
NEAR = 6
#: Weights that one task averages.
_FAN_IN = 64
#: Windows whose arrays stay in a core's cache.
_BATCH_WINDOWS = 128
#: Windows that are built at a time for training.
_PART_WINDOWS = 20_000
#: Places whose neighbours are counted at a time, so that arrays stay in a core's cache.
_PLACES = 1 << 14
#: Rows of one batch of word counts.
_ROWS = 500_000
#: Words whose first id a worker remembers.
_REMEMBERED = 2_000_000
END_HASH = np.uint64(0xE2D0_E2D0_E2D0_E2D0)


class Reader:
    """Tokens of texts, as hashes and as first subword ids."""

    def __init__(self, path: str | None = None, hashes: np.ndarray | None = None, first: np.ndarray | None = None):
        """``hashes`` and ``first``: words known from the start, as entries 1, 2, ..."""
        self._encoder, self._given = T.encoder(path), (hashes, first)
        self._clear()

    def _clear(self) -> None:
        self._seen = W.Seen(T._SLOT_BITS)
        self._first = np.full(1 << 16, END, np.uint16)
        hashes, first = self._given
        if hashes is not None and len(hashes):
            self._put(self._seen.add(hashes), first)

    def _put(self, entry: np.ndarray, first: np.ndarray) -> None:
        if self._seen.n > len(self._first):
            self._first = np.resize(self._first, max(self._seen.n, 2 * len(self._first)))
        self._first[entry] = first

    @property
    def full(self) -> bool:
        """Whether the next texts begin with no entries but those known from the start."""
        return self._seen.n > _REMEMBERED

    def words(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, first ids) of some entries."""
        return np.where(entry == 0, END_HASH, self._seen.hash(entry)), np.where(entry == 0, END, self._first[entry])

    def read(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, hash of every token, its entry, its first id, tokens a text), some texts at a time.

        The end is entry 0. A word without any id counts as the end id.
        """
        raw, offsets = W.utf8(column)
        for i, j in W.chunks(offsets, 1 << 20):  # every chunk counts its ids over the whole vocabulary
            if self.full:
                self._clear()
            words = W.scan(W.LOWER[raw[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i], W.NOT_BLANK)
            hashes = words.hashes()
            entry = self._seen.find(hashes)
            lost = np.flatnonzero(entry == 0)
            if len(lost):
                fresh, at = np.unique(hashes[lost], return_index=True)
                new = self._seen.add(fresh)
                self._put(new, self._firsts(words, lost[at]))
                entry[lost] = new[np.searchsorted(fresh, hashes[lost])]
            counts = words.counts + 1
            word = np.ones(len(entry) + j - i, bool)
            word[np.cumsum(counts) - 1] = False
            every, told = np.full(len(word), END_HASH), np.zeros(len(word), np.int64)
            every[word], told[word] = hashes, entry
            ids = self._first[told].astype(np.int64)
            ids[~word] = END
            yield i, every, told, ids, counts

    def _firsts(self, words: W.Words, at: np.ndarray) -> np.ndarray:
        """First ids of some words, each encoded as a text of its own."""
        size = words.ends[at] - words.starts[at]
        last = np.cumsum(size)
        data = words.raw[np.arange(int(last[-1])) + np.repeat(words.starts[at] - (last - size), size)]
        column = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.concatenate(([0], last)).astype(np.int64).tobytes()), pa.py_buffer(data.tobytes()))
        out = [np.zeros(0, np.uint16)]
        for _, ids, sizes in self._encoder.parts(column, end=False):
            begin = np.cumsum(sizes) - sizes
            out.append(np.where(sizes > 0, np.append(ids, T.END_ID)[begin], T.END_ID).astype(np.uint16))
        return np.concatenate(out)


@dataclass
class Table:
    """Subword ids: their model input, their class, and log M of it."""

    input: np.ndarray
    cls: np.ndarray
    log_mass: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, types: np.ndarray, near: np.ndarray, ends: np.ndarray) -> Table:
        """By first id: tokens, distinct words, how often near each of the OWN commonest, and does it end a word."""
        rank = ranks(counts)
        spread = (np.arange(len(counts)) * 40503) % (INPUTS - COMMON_INPUTS - 1)
        inputs = np.where(rank < COMMON_INPUTS, rank, COMMON_INPUTS + spread)
        mass = counts + 0.5
        classes = rank.copy()
        half = SHARED // 2
        for k, kind in enumerate((False, True)):
            rest = np.flatnonzero((rank >= OWN) & (ends == kind))
            classes[rest] = OWN + k * half + _clusters(near[rest], mass[rest], half)
        classes[END] = CLASSES - 1
        total = np.bincount(classes, counts + 0.5 * types, minlength=CLASSES) + 0.5
        return cls(inputs, classes, np.log(total).astype(np.float32))


def ranks(counts: np.ndarray) -> np.ndarray:
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    return rank


def _clusters(near: np.ndarray, mass: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means of the directions of smoothed square roots, weighted by mass."""
    if not len(near):
        return np.zeros(0, np.int64)
    whole = near.sum(0) + 1.0
    x = np.sqrt(near + 4.0 * whole / whole.sum())
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    weight = np.sqrt(mass)
    busy = np.flatnonzero(mass > 0.5)  # ids never met follow the others
    if not len(busy):
        return np.arange(len(mass)) % k
    met, x_met, weight = mass[busy], x[busy], weight[busy]
    centre = x_met[np.argsort(-met, kind="stable")[:: max(1, min(len(met), 40 * k) // k)][:k]]
    for _ in range(rounds):
        which = np.argmax(x_met @ centre.T, 1)
        total = np.zeros((len(centre), x.shape[1]))
        np.add.at(total, which, x_met * weight[:, None])
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(norm > 0, total / np.maximum(norm, 1e-9), centre)
    return np.argmax(x @ centre.T, 1)


START = INPUTS - 1
_SHAPES = {"emb": (INPUTS, WIDTH), "pos": (LEN, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "o": (WIDTH, WIDTH), "out": (WIDTH, CLASSES), "bias": (CLASSES,)}
_MASK = np.triu(np.full((LEN, LEN), -1e9, np.float32), 1)
_SEEN = np.tril(np.ones((LEN, LEN), np.float32))


def initial(share: np.ndarray | None = None, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights before learning, which give every class about its ``share``, whatever the context."""
    rng = np.random.default_rng(seed)
    scale = {"emb": 0.3, "out": 0.02}
    p = {k: (np.zeros(s) if k == "bias" else rng.normal(0, scale.get(k, 0.15), s)).astype(np.float32) for k, s in _SHAPES.items()}
    if share is not None:
        p["bias"][:] = np.log(share)
    return p


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in _SHAPES])


def shaped(x: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in _SHAPES.items():
        n = int(np.prod(s))
        out[k], at = x[at : at + n].reshape(s).astype(np.float32, copy=False), at + n
    return out


def _forward(p: dict, x_in: np.ndarray, pad: np.ndarray):
    """``x_in`` (windows, LEN) inputs; ``pad`` marks places before the text."""
    x = p["emb"][x_in] + p["pos"]
    q, k, v = x @ p["q"], x @ p["k"], x @ p["v"]
    s = q @ k.transpose(0, 2, 1) * np.float32(WIDTH**-0.5) + _MASK
    if pad.any():
        s = s + (pad * np.float32(-1e4))[:, None, :]
    s -= s.max(2, keepdims=True)
    a = np.exp(s)
    a /= a.sum(2, keepdims=True)
    o = a @ v
    return x, q, k, v, a, o, x + o @ p["o"]


def _weights(q: np.ndarray, k: np.ndarray, pad: np.ndarray, told: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights of all places, one row for each place from ``told`` on, not normed; their sums).

    Exponents are held within 60, so none needs its row's greatest. A row without any place has weights of 0.
    """
    a = q @ k.transpose(0, 2, 1)
    np.clip(a, -60, 60, out=a)
    np.exp(a, out=a)
    a *= _SEEN[told:]
    if pad.any():
        a *= (~pad).astype(a.dtype)[:, None, :]
    return a, np.maximum(_row_sums(a), np.float32(1e-30))


def _row_sums(m: np.ndarray) -> np.ndarray:
    """As a column; by BLAS, as numpy's own sums of short rows take several times as long."""
    return m.reshape(-1, m.shape[-1]) @ np.ones((m.shape[-1], 1), m.dtype)


def _logits(p: dict, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exponents of the classes, within 60; the states with a place of 1 for the bias)."""
    h = np.concatenate((h, np.ones((len(h), 1), h.dtype)), 1)
    z = h @ np.concatenate((p["out"], p["bias"][None]))
    return np.clip(z, -60, 60, out=z), h


def _states(p: dict, x_in: np.ndarray, pad: np.ndarray) -> np.ndarray:
    """What ``_forward`` gives for the places that are scored; the others are context only."""
    x = p["emb"].take(x_in, 0)
    x += p["pos"]
    own = x[:, CONTEXT:].reshape(-1, WIDTH)
    q = (own @ (p["q"] * np.float32(WIDTH**-0.5))).reshape(len(x), -1, WIDTH)
    kv = (x.reshape(-1, WIDTH) @ np.concatenate((p["k"], p["v"]), 1)).reshape(len(x), -1, 2 * WIDTH)
    a, whole = _weights(q, kv[..., :WIDTH], pad, CONTEXT)
    o = (a @ kv[..., WIDTH:]).reshape(-1, WIDTH)
    o /= whole
    return own + o @ p["o"]


def gradient(p: dict, x_in: np.ndarray, target: np.ndarray, pad: np.ndarray, told: int = 0) -> dict[str, np.ndarray]:
    """Of the mean loss at the places from ``told`` on; those before are context only, so they ask nothing."""
    x = p["emb"].take(x_in, 0)
    x += p["pos"]
    b, n = x.shape[0], x.shape[1] - told
    two = lambda m: m.reshape(-1, m.shape[-1])
    every, own = two(x), two(x[:, told:])
    scale = np.float32(WIDTH**-0.5)
    ask, side = p["q"] * scale, np.concatenate((p["k"], p["v"]), 1)
    q, kv = (own @ ask).reshape(b, n, WIDTH), (every @ side).reshape(b, -1, 2 * WIDTH)
    k, v = kv[..., :WIDTH], kv[..., WIDTH:]
    a, whole = _weights(q, k, pad, told)
    o = two(a @ v)
    o /= whole
    d, h = _logits(p, own + o @ p["o"])
    np.exp(d, out=d)
    live = (~pad[:, told:]).astype(np.float32).ravel()
    live /= max(1.0, float(live.sum()))
    d *= live[:, None] / _row_sums(d)
    d[np.arange(len(d)), target[:, told:].ravel()] -= live
    last = h.T @ d  # of ``out``, and of the bias
    dh = d @ p["out"].T
    do = dh @ p["o"].T
    d_o = o.T @ dh
    do /= whole
    ds = do.reshape(q.shape) @ v.transpose(0, 2, 1)
    ds -= np.einsum("ij,ij->i", do, o).reshape(b, n, 1)
    ds *= a
    dkv = np.empty_like(kv)
    np.matmul(ds.transpose(0, 2, 1), q, out=dkv[..., :WIDTH])
    np.matmul(a.transpose(0, 2, 1), do.reshape(q.shape), out=dkv[..., WIDTH:])
    dq, dkv = two(ds @ k), two(dkv)
    dx = (dkv @ side.T).reshape(x.shape)
    dh += dq @ ask.T
    dx[:, told:] += dh.reshape(q.shape)
    order = np.argsort(x_in, axis=None)
    cell = x_in.ravel()[order]
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    emb = np.zeros((INPUTS, WIDTH), dx.dtype)
    emb[cell[first]] = np.add.reduceat(two(dx)[order], first)
    side = every.T @ dkv
    return {"emb": emb, "pos": dx.sum(0), "q": own.T @ dq * scale, "k": side[:, :WIDTH], "v": side[:, WIDTH:], "o": d_o, "out": last[:-1], "bias": last[-1]}


class Adam:
    """Gradient steps over windows that come in parts."""

    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self._all, self._rate, self._n = flat(p).astype(np.float32), rate, 0
        self._m1, self._m2 = np.zeros_like(self._all), np.zeros_like(self._all)

    @property
    def p(self) -> dict[str, np.ndarray]:
        """Views of the weights as they stand."""
        return shaped(self._all)

    def steps(self, windows: np.ndarray, table: Table) -> None:
        """One pass over rows of LEN + 1 ids; -1 is before or after the text."""
        p, m1, m2 = self.p, self._m1, self._m2
        for i in range(0, len(windows), BATCH):
            self._n += 1
            w = windows[i : i + BATCH]
            x_in = np.where(w[:, :-1] < 0, START, table.input[np.maximum(w[:, :-1], 0)])
            g = flat(gradient(p, x_in, table.cls[np.maximum(w[:, 1:], 0)], w[:, 1:] < 0, CONTEXT))
            m1 *= 0.9
            m1 += 0.1 * g
            m2 *= 0.99
            g *= g
            g *= 0.01
            m2 += g
            np.sqrt(m2, out=g)
            part = float(np.sqrt(1 - 0.99**self._n))  # a numpy scalar would take ``g`` through 64 bits
            g += 1e-6 * part
            np.divide(m1, g, out=g)
            g *= self._rate * part / (1 - 0.9**self._n)
            self._all -= g


def id_scores(p: dict[str, np.ndarray], table: Table, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log P(class | context) - log M(class) of every id, natural; ``sizes``: ids of each text."""
    first = np.cumsum(sizes) - sizes
    per = -(-sizes // STRIDE)
    text = np.repeat(np.arange(len(sizes)), per)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * STRIDE
    out = np.empty(len(ids), np.float32)
    reach = np.arange(LEN) - CONTEXT
    for i in range(0, len(text), _BATCH_WINDOWS):
        t, s = text[i : i + _BATCH_WINDOWS], start[i : i + _BATCH_WINDOWS]
        place = s[:, None] + reach  # of the id to tell, in its text
        pad = place < 0
        before = np.maximum(first[t][:, None] + place - 1, 0)
        x_in = np.where(place <= 0, START, table.input[ids[np.minimum(before, len(ids) - 1)]])
        h = _states(p, x_in, pad).reshape(-1, WIDTH)
        at = (first[t][:, None] + place[:, CONTEXT:]).ravel()
        live = np.flatnonzero((place[:, CONTEXT:] < sizes[t][:, None]).ravel())
        at = at[live]
        z, _ = _logits(p, h if len(live) == len(h) else h[live])
        told = ids[at]
        hit = z[np.arange(len(at)), table.cls[told]]
        out[at] = hit - np.log(_row_sums(np.exp(z, out=z))[:, 0]) - table.log_mass[table.cls[told]]
    return out


def _gather(own: DataFrame, path: str | None) -> DataFrame:
    """From every training document: kind 0 word counts, kind 1 id counts, kind 2 all its first ids and a draw for its round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(path)
        names = ["kind", "key", "n", "first", "ids"]
        met, seen = np.zeros(1 << 16, np.int64), np.zeros(VOCABULARY, np.int64)

        def rows(kind, key, n, first=None, ids=None):
            none = lambda x, t: pa.array(x, t) if x is not None else pa.nulls(len(key), t)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key, pa.int64()), none(n, pa.int64()), none(first, pa.int32()), none(ids, pa.binary())], names=names)

        def told():
            at = np.flatnonzero(met)
            for i in range(0, len(at), _ROWS):
                part = at[i : i + _ROWS]
                hashes, first = reader.words(part)
                yield rows(0, hashes.view(np.int64), met[part], first)

        for b in batches:
            draw = b.column("draw").to_numpy()
            for i, _, entry, ids, counts in reader.read(b.column("text")):
                some = np.bincount(entry)
                if len(some) > len(met):
                    met = np.concatenate((met, np.zeros(max(len(some), len(met)), np.int64)))
                met[: len(some)] += some
                seen += np.bincount(ids, minlength=VOCABULARY)
                ends = np.cumsum(counts)
                short = ids.astype("<u2")
                yield rows(2, draw[i : i + len(counts)], counts, None, [short[z - n : z].tobytes() for n, z in zip(counts.tolist(), ends.tolist(), strict=True)])
                if reader.full:  # before its entries are given to other words
                    yield from told()
                    met[:] = 0
        yield from told()
        at = np.flatnonzero(seen)
        yield rows(1, at, seen[at])

    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)).alias("draw")
    return own.select("text", draw).mapInArrow(run, "kind int, key long, n long, first int, ids binary")


def windows(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Rows of LEN + 1 ids that tell every id of every text once, at the last STRIDE places; -1 is outside the text."""
    ids = np.frombuffer(b"".join(texts), "<u2").astype(np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) // 2
    first = np.cumsum(sizes) - sizes
    per = -(-sizes // STRIDE)
    text = np.repeat(np.arange(len(sizes)), per)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * STRIDE
    reach = np.arange(LEN + 1) - CONTEXT - 1
    for i in range(0, len(text), _PART_WINDOWS):
        t = text[i : i + _PART_WINDOWS]
        place = start[i : i + _PART_WINDOWS, None] + reach
        inside = (place >= 0) & (place < sizes[t][:, None])
        yield np.where(inside, ids[np.where(inside, first[t][:, None] + place, 0)], -1)


def _mean(weights: DataFrame) -> tuple[float, np.ndarray] | None:
    """The mean of all rows (task, n, weights) by n, no more than _FAN_IN of them in one task."""
    schema = "task int, n double, weights binary"

    def mean(key: tuple, rows: pa.Table) -> pa.Table:
        n = rows.column("n").to_numpy()
        total = sum(np.frombuffer(w, "<f4").astype(np.float64) * k for w, k in zip(rows.column("weights").to_pylist(), n, strict=True)) / n.sum()
        return pa.table({"task": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([float(n.sum())]), "weights": pa.array([total.astype("<f4").tobytes()], pa.binary())})

    weights = keep(weights)
    tasks = weights.agg(F.max("task")).first()[0]
    if tasks is None:
        return None
    while tasks:
        weights = weights.withColumn("task", (F.col("task") / _FAN_IN).cast("int")).groupBy("task").applyInArrow(mean, schema)
        tasks //= _FAN_IN
    row = weights.first()
    return row["n"], np.frombuffer(bytes(row["weights"]), "<f4")


def _fit(found: DataFrame, table: Table, rounds: tuple[float, ...]) -> dict[str, np.ndarray]:
    """Round r learns from the documents drawn between the shares of rounds r - 1 and r."""
    spark = found.sparkSession
    params, low = initial(np.exp(table.log_mass)), 0
    for r, share in enumerate(rounds):
        high = int(1_000_000 * share)
        shipped = spark.sparkContext.broadcast((params, table, RATE / (1 + r)))

        def local(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            p, t, rate = shipped.value
            fit, n = Adam(p, rate), 0
            for b in batches:
                for part in windows(b.column("ids").to_pylist()):
                    fit.steps(part[np.random.default_rng(len(part)).permutation(len(part))], t)
                    n += len(part)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([float(n)]), pa.array([flat(fit.p).astype("<f4").tobytes()], pa.binary())], names=["task", "n", "weights"])

        mine = found.where((F.col("kind") == 2) & (F.col("key") >= low) & (F.col("key") < high))
        got = _mean(mine.select("ids").mapInArrow(local, "task int, n double, weights binary"))
        params, low = shaped(got[1]) if got else params, high
    return params


def add_near(total: np.ndarray, texts: list[bytes], own: np.ndarray) -> None:
    """Adds to cells (id, common id) how often the two stand within NEAR places; ``own``: places of common ids, else -1."""
    raw, offsets = b"".join(texts), np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
    for i, j in W.chunks(offsets, 1 << 20):
        sizes = np.diff(offsets[i : j + 1]) // 2
        # NEAR places of no text on both sides
        ids, text = np.zeros(int(sizes.sum()) + 2 * NEAR, np.int64), np.full(int(sizes.sum()) + 2 * NEAR, -1, np.int32)
        ids[NEAR:-NEAR] = np.frombuffer(raw, "<u2", int(sizes.sum()), int(offsets[i]))
        text[NEAR:-NEAR] = np.repeat(np.arange(j - i, dtype=np.int32), sizes)
        common = own.take(ids)
        common[:NEAR] = common[-NEAR:] = -1
        every = np.flatnonzero(common >= 0)
        ids *= OWN
        for k in range(0, len(every), _PLACES):
            at = every[k : k + _PLACES]
            column, mine = common.take(at), text.take(at)
            for step in (*range(-NEAR, 0), *range(1, NEAR + 1)):
                there = at + step
                cells = ids.take(there)
                cells += column
                np.add.at(total, cells[text.take(there) == mine], 1)


def _near(found: DataFrame, rank: np.ndarray) -> np.ndarray:
    """How often each id stands within NEAR places of each of the OWN commonest, in all training texts."""
    shipped = found.sparkSession.sparkContext.broadcast(np.where(rank < OWN, rank, -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY * OWN, np.int64)
        for b in batches:
            add_near(total, b.column("ids").to_pylist(), shipped.value)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["cell", "n"])

    cells = found.where("kind = 2").select("ids").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(VOCABULARY * OWN)
    out[cells.column(0).to_numpy()] = cells.column(1).to_numpy()
    return out.reshape(VOCABULARY, OWN)


def _top(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, counts and first ids of all words that occur at least so often that no more than ``most`` do."""
    spread = counts.groupBy("c").count().orderBy(F.desc("c"))
    total, least = 0, 1 << 62
    for row in spread.limit(most).collect():
        if total + row["count"] > most:
            break
        total, least = total + row["count"], row["c"]
    rows = counts.where(F.col("c") >= least).select("h", "c", "first").toArrow()
    return rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy(), rows.column(2).to_numpy().astype(np.uint16)


@dataclass
class Model:
    """What is learnt: attention weights, the classes, and counts of all words (a table) and of the commonest."""

    params: dict[str, np.ndarray]
    table: Table
    counts: DataFrame  # h, c, first
    tokens: int
    types: int
    top: tuple[np.ndarray, np.ndarray, np.ndarray]


def train(own: DataFrame, vocabulary: str | None = None, rounds: tuple[float, ...] = ROUNDS) -> Model:
    """From all rows of ``own`` (doc_id, text)."""
    found = keep(_gather(own, vocabulary))
    counts = keep(found.where("kind = 0").groupBy(F.col("key").alias("h")).agg(F.sum("n").alias("c"), F.max("first").alias("first")))
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ids, types = np.zeros(VOCABULARY, np.int64), np.zeros(VOCABULARY, np.int64)
    for row in found.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).collect():  # one row an id of the vocabulary
        ids[row["key"]] = row["n"]
    for row in counts.groupBy("first").count().collect():
        types[row["first"]] = row["count"]
    table = Table.of(ids, types, _near(found, ranks(ids)), T.encoder(vocabulary).ends(VOCABULARY))
    return Model(_fit(found, table, rounds), table, counts, int(whole["n"]), int(whole["v"]), _top(counts, TOP_WORDS))


def score(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", fold: int = HELD_OUT, vocabulary: str | None = None, rounds: tuple[float, ...] = ROUNDS, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Without a ``model``, one is trained on the documents outside the held-out fold.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("held_out", learn.held_out("doc_id", fold))
    model = model or train(own.where(~F.col("held_out")).select("doc_id", "text"), vocabulary, rounds)
    floor = float(np.log10(model.tokens + 0.5 * (model.types + 1)))
    shipped = spark.sparkContext.broadcast((model.params, model.table, model.top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, t, (top_h, top_c, top_first) = shipped.value
        order = np.argsort(-top_c, kind="stable")
        reader = Reader(vocabulary, top_h[order], top_first[order])
        known = np.concatenate(([0], top_c[order]))  # by entry; later entries are rarer words
        end_c = int(top_c[top_h == END_HASH].sum())
        logs = np.log10(known + 0.5)
        for b in batches:
            for i, hashes, entry, ids, words in reader.read(b.column("text")):
                part = b.slice(i, len(words))
                text_of = np.repeat(np.arange(len(words)), words)
                gain = id_scores(p, t, ids, words).astype(np.float64) / np.log(10) + floor
                common = (entry > 0) & (entry < len(known)) | ((entry == 0) & (end_c > 0))
                at = np.where(common, entry, 0)
                count, log = known[at], logs[at]
                count[entry == 0], log[entry == 0] = end_c, np.log10(end_c + 0.5)
                total = lambda x: np.bincount(text_of, x, minlength=len(words))  # noqa: B023, E731
                rest = np.flatnonzero(~common)
                cut = np.searchsorted(rest, np.concatenate(([0], np.cumsum(words))))
                late = pa.LargeListArray.from_arrays(pa.array(cut, pa.int64()), pa.array(hashes[rest].view(np.int64))).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(words), pa.array(total(count > 0).astype(np.int64)), pa.array(total((log - floor) * common)), pa.array(total(gain)), late],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base", "gain", "rest"],
                )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, gain double, rest array<long>"
    scored = keep(own.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    loose = scored.select("row", F.explode("rest").alias("h")).groupBy("row", "h").agg(F.count("*").alias("n"))
    met = loose.join(model.counts.select("h", "c").hint("merge"), "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    late = met.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("n") * (F.log10(F.col("c") + 0.5) - F.lit(floor))).alias("b"))
    base = F.col("base") + F.coalesce("b", F.lit(0.0))
    return scored.drop("rest").join(late, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("gain")).alias("score")
    )
