"""N-gram Jaccard join by PartEnum signatures.

A document's set holds its distinct shingles of five lower-cased words. Documents of
equal sets are one class, held by its smallest doc_id.

*Lone shingles.* A shingle that no other class has is a difference to every partner. So
sets of which more than a quarter is lone (at similarity 0.75) have no link, and drop
out; all others go on with their shared shingles and the number of their lone ones.

*Signatures.* Sets are joined in bands of size: band j holds sizes up to U(j), and
instance j joins sets of band j with those of bands j and j-1, which covers every
similar pair. Such a pair differs in at most k(j) shingles. Instance j cuts the shingle
domain into n1 partitions and each of those into ``SUB`` sub-partitions, and enumerates,
in every partition, the subsets that leave ``LEFT_OUT`` sub-partitions out: one signature
for the content of each. With n1 * (LEFT_OUT + 1) > k(j), some partition of a similar pair
differs in LEFT_OUT places at most, so one of its subsets is the same in both. Instances
have a few partitions more than that (``slack``): a set with empty subsets in no more
partitions than the slack leaves those out, since one of the pair's equal subsets lies
in another partition; a set with more of them emits them too.

*Candidates.* A signature shared by several sets is a bucket. In a round some members of
each bucket are hubs, and all members are compared with the hubs, unless they are known
to be in one component already, or too different by a bound: lone shingles are differences,
and so are the places where the *sketches* of the shared shingles differ, which hold the
parities of their counts in ``64 * WORDS_OF_SKETCH`` buckets. Large sets would fill a sketch,
so partitions lie in groups of about ``GROUP``, and each group has a sketch of its own. A pair
is compared over a signature only if the sketches of that signature's group differ in no more
places than the group's share of the differences allowed. That loses no pair: let a similar
pair differ in D <= T shared shingles, let L of the n1 partitions be left out as empty, and let
a group of P partitions pass if it differs in (T + 2L) * P / n1 places at most. A group
without an equal signature differs in 2 * (P - L') places, L' of the L being its own, which is
no less than that share less 2 * L', since T + 2L < 2 * n1. If no group both passed and had an
equal signature, the groups would differ in more than T places together. Then hubs leave the bucket, components are drawn anew, and buckets with one component left are
settled. Rounds take 16, 256, ... hubs a bucket until no bucket is left, so a group of
copies settles after a few comparisons a member and no link between components is lost.
A first pass over one in ``SAMPLE`` signatures only ties most copies together early; it
decides nothing by itself.

Null and empty texts have no set and no link. One to four words are one shingle. Rows
without doc_id have no link and no component. Rows of equal doc_id are one document
for links. Shingles are compared by 54 bits of a hash, so two sets of n shingles meet by
chance in about n * n / 2^54 places; equal sets are told by 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import tokens as T
from . import words as W
from .components import components
from .durable import free, keep, spent, sweep
from .repeats import Emitted, Filter, members, repeated, scramble

WORDS = 5
PERCENT = 75
#: Sub-partitions of a partition, and how many of them a subset leaves out.
SUB, LEFT_OUT = 4, 1
SUBSETS = tuple(combinations(range(SUB), LEFT_OUT))
#: One signature in so many takes part in the first pass.
SAMPLE = 16
#: Each round takes so many times more hubs a bucket.
GROWTH = 16
#: Members of a hub that one task compares.
SALT_MEMBERS = 512
#: 64-bit words of a sketch, and partitions that one sketch covers.
WORDS_OF_SKETCH = 4
GROUP = 16
SKETCH = tuple(f"s{k}" for k in range(WORDS_OF_SKETCH))
_BITS = np.uint64(54)
_SET = np.uint64((1 << 54) - 1)
_PLANES = 7


def _shingles(column: pa.Array, width: int = WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, document within the chunk, shingle) by chunk, sorted and distinct."""
    raw, offsets = W.utf8(column)
    for i, j in W.chunks(offsets):
        words = W.scan(W.LOWER[raw[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i], W.NOT_BLANK)
        hashes = words.hashes()
        value, at = W.windows(words, hashes, width)
        parts, docs = [value], [words.doc[at]]
        for n in range(1, width):  # shorter documents: the whole sequence
            few = np.flatnonzero(words.counts == n)
            if len(few):
                start = words.first[few]
                whole = W.rolling(hashes, n)[start]
                parts.append(W.mix(whole + np.uint64(n)))
                docs.append(few)
        key = (np.concatenate(docs).astype(np.uint64) << _BITS) | (np.concatenate(parts) >> np.uint64(10))
        key = np.unique(key)
        yield i, (key >> _BITS).astype(np.int64), key & _SET


def _starts(doc: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)


def _classes(doc: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, size, 63-bit hash of the set)."""
    first = _starts(doc)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(doc)))
    value = W.mix(np.add.reduceat(W.mix(shingle + np.uint64(77)), first) + size.astype(np.uint64))
    return doc[first], size, (value >> np.uint64(1)).astype(np.int64)


def bands(percent: int = PERCENT, most: int = 1 << 40) -> np.ndarray:
    """U(j): the largest size of each band; a similar set is in the same or in a neighbouring one."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, out[-1] * 100 // percent))
    return np.array(out)


def differences(sizes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """In how many shingles two similar sets of so many shingles together can differ."""
    return sizes * (100 - percent) // (100 + percent)


def partitions(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n1, slack) for sets that differ in at most k shingles."""
    least = k // (LEFT_OUT + 1) + 1
    slack = 1 + least // 8
    return least + slack, slack


class _Instance:
    """The partitions of every set in one of its two instances; step 0 is that of its own band."""

    def __init__(self, doc: np.ndarray, shingle: np.ndarray, size: np.ndarray, step: int, percent: int):
        upper = bands(percent)
        self.band = np.searchsorted(upper, size) + step
        k = differences(2 * upper[self.band], percent)
        n, slack = partitions(k)
        n = self.n = np.where(k > 0, n, 0)  # sets that may not differ are equal: one class
        self.base = np.cumsum(n) - n
        self.live = np.flatnonzero(k[doc] > 0)
        at = doc[self.live]
        first = W.mix(shingle[self.live] + np.uint64(1_000_003))
        self.spot = self.base[at] * SUB + (first % (n[at] * SUB).astype(np.uint64)).astype(np.int64)
        full = np.zeros(int(n.sum()) * SUB, bool)
        full[self.spot] = True
        full = full.reshape(-1, SUB)
        self.owner = np.repeat(np.arange(len(n)), n)
        self.place = np.arange(len(self.owner)) - self.base[self.owner]
        empty = np.stack([~np.delete(full, q, 1).any(1) for q in SUBSETS], 1)
        hollow = np.bincount(self.owner, empty.any(1), minlength=len(n)).astype(np.int64)
        thin = hollow > slack
        self.emit = ~empty | thin[self.owner][:, None]
        self.left_out = np.where(thin, 0, hollow)
        # groups of partitions: how many a set has, where its own begin, and that of each partition
        self.groups = np.where(n > 0, np.maximum(n // GROUP, 1), 0)
        self.group_base = np.cumsum(self.groups) - self.groups
        self.group = self.place * self.groups[self.owner] // np.maximum(n[self.owner], 1)


def signatures(doc: np.ndarray, shingle: np.ndarray, size: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, ordinal of the set, is it of the instance's own band).

    ``doc`` numbers the sets from 0, in order, for each of their shared shingles; ``size``
    counts all shingles of each set.
    """
    return _signatures(doc, shingle, size, percent)[:3]


def _signatures(doc: np.ndarray, shingle: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``signatures``, and the place (2 * group + step) of each."""
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int32))]
    content = W.mix(shingle + np.uint64(12_345))
    for step in (0, 1):
        x = _Instance(doc, shingle, size, step, percent)
        if not len(x.live):
            continue
        held = np.zeros(len(x.owner) * SUB, np.uint64)
        np.add.at(held, x.spot, content[x.live])
        held = held.reshape(-1, SUB)
        band = W.mix(x.band.astype(np.uint64) + np.uint64(0xB5AD4ECE))[x.owner]
        place = x.place.astype(np.uint64) * np.uint64(len(SUBSETS))
        whole = held.sum(1, dtype=np.uint64)
        for c, q in enumerate(SUBSETS):
            ok = np.flatnonzero(x.emit[:, c])
            rest = whole[ok] - held[ok][:, q].sum(1, dtype=np.uint64)
            out.append((W.mix(rest + W.mix(band[ok] + place[ok] + np.uint64(c))), x.owner[ok], np.full(len(ok), step == 0), (2 * x.group[ok] + step).astype(np.int32)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def local_sketches(doc: np.ndarray, shingle: np.ndarray, size: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, ...]:
    """(ordinal of the set, place, partitions of the group, of the instance, those left out, words of the sketch) by set and group."""
    out = [tuple(np.zeros(0, np.int64) for _ in range(5 + WORDS_OF_SKETCH))]
    for step in (0, 1):
        x = _Instance(doc, shingle, size, step, percent)
        if not len(x.live):
            continue
        total = int(x.groups.sum())
        owner = np.repeat(np.arange(len(x.n)), x.groups)
        every = x.group_base[x.owner] + x.group
        at = every[x.spot // SUB]
        order = np.argsort(at, kind="stable")
        begins = _starts(at[order])
        words = np.zeros((WORDS_OF_SKETCH, total), np.int64)  # groups without a shingle too
        words[:, at[order][begins]] = sketches(shingle[x.live][order], begins)
        place = 2 * (np.arange(total) - x.group_base[owner]) + step
        out.append((owner, place, np.bincount(every, minlength=total), x.n[owner], x.left_out[owner], *words))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _inventory(own: DataFrame, width: int) -> DataFrame:
    """doc_id, n, node (the hash of the set) of every document."""

    @W.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.forget()
        for b in batches:
            n, node = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for i, doc, shingle in _shingles(b.column("text"), width):
                which, size, value = _classes(doc, shingle)
                n[i + which], node[i + which] = size, value
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(node, mask=n == 0)], names=["doc_id", "n", "node"])

    return own.mapInArrow(run, "doc_id long, n long, node long")


def _pack(shingles: np.ndarray) -> bytes:
    """A sorted set as byte planes of its values; the upper planes compress well."""
    return np.ascontiguousarray(shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_PLANES].T).tobytes()


def _unpack(planes: bytes | pa.Buffer) -> np.ndarray:
    parts = np.frombuffer(planes, np.uint8).reshape(_PLANES, -1)
    out = np.zeros((parts.shape[1], 8), np.uint8)
    out[:, :_PLANES] = parts.T
    return out.view("<u8").ravel()


def sketches(shingle: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
    """By word, the parities of each set's shingles by bucket; no set is empty."""
    bucket = W.mix(shingle + np.uint64(271_828)) % np.uint64(64 * WORDS_OF_SKETCH)
    word, bit = bucket >> np.uint64(6), np.uint64(1) << (bucket & np.uint64(63))
    return [np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), begins).view(np.int64) for k in range(WORDS_OF_SKETCH)]


def _candidates(own: DataFrame, found: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """node, size, lone, shingles of the classes that can have a link: their shared shingles, packed."""
    spark = own.sparkSession
    texts = own.where("doc_id is not null")
    total = found.agg(F.sum("n")).first()[0] or 0
    wanted = spark.sparkContext.broadcast(members(reps, "rep"))

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
        """Texts that stand for a class, and a few more by chance."""
        for b in batches:
            yield b.filter(pa.array(wanted.value.has(scramble(b.column("doc_id").to_numpy(zero_copy_only=False))))).column("text")

    def emit(batches: Iterator[pa.RecordBatch]) -> Emitted:
        ordinal = 0
        for text in picked(batches):
            for i, doc, shingle in _shingles(text, width):
                yield W.mix(shingle), doc + (ordinal + i), np.ones(len(shingle), bool)
            ordinal += len(text)

    shared = spark.sparkContext.broadcast(repeated(texts, emit, values=total))

    @W.lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text in picked(batches):
            for _, doc, shingle in _shingles(text, width):
                which, size, node = _classes(doc, shingle)
                if not len(which):
                    continue
                ok = shared.value.has(W.mix(shingle))
                k = np.searchsorted(which, doc)
                lone = size - np.bincount(k[ok], minlength=len(which))
                stay = np.flatnonzero((100 * lone <= (100 - percent) * size) & (lone < size))
                keeps = np.zeros(len(which), bool)
                keeps[stay] = True
                rest = shingle[ok & keeps[k]]
                if not len(rest):
                    continue
                ends = np.cumsum((size - lone)[stay])
                begins = ends - (size - lone)[stay]
                cols = [node[stay], size[stay], lone[stay]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array([_pack(rest[a:z]) for a, z in zip(begins.tolist(), ends.tolist(), strict=True)], pa.binary())], names=["node", "size", "lone", "shingles"])

    sets = texts.mapInArrow(cut, "node long, size long, lone long, shingles binary")
    out = keep(sets.dropDuplicates(["node"]))
    spent(wanted, shared)
    return out


def _unpacked(batches: Iterator[pa.RecordBatch], bound: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, row of each shingle, shingle, size), a bounded number of shingles at a time."""
    for b in batches:
        size = np.array([len(x) // _PLANES for x in b.column("shingles").to_pylist()], np.int64)
        ends, i = np.cumsum(size), 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + bound, "right")))
            part = b.slice(i, j - i)
            sets = [_unpack(x.as_buffer()) for x in part.column("shingles")]
            yield part, np.repeat(np.arange(j - i), size[i:j]), np.concatenate(sets), part.column("size").to_numpy()
            i = j


def _entries(sets: DataFrame, percent: int, pick) -> DataFrame:
    """sig, node, part, mine, place: a row for each signature that ``pick`` keeps."""
    carried = ["node", "part"]

    @W.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, *given in _unpacked(batches):
            value, who, mine, place = _signatures(*given, percent)
            ok = np.flatnonzero(pick(value))
            cols = [pa.array(part.column(c).to_numpy(zero_copy_only=False)[who[ok]]) for c in carried]
            yield pa.RecordBatch.from_arrays([pa.array(value[ok].view(np.int64)), *cols, pa.array(mine[ok]), pa.array(place[ok])], names=["sig", *carried, "mine", "place"])

    return sets.mapInArrow(run, "sig long, node long, part long, mine boolean, place int")


def _facts(sets: DataFrame, percent: int) -> DataFrame:
    """node, place, size, lone, parts, cuts, gone, sketch: what ``_possible`` asks of a set at a place."""
    names = ["parts", "cuts", "gone", *SKETCH]

    @W.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, *given in _unpacked(batches):
            who, place, *told = local_sketches(*given, percent)
            node, size, lone = (pa.array(part.column(c).to_numpy(zero_copy_only=False)[who]) for c in ("node", "size", "lone"))
            yield pa.RecordBatch.from_arrays([node, pa.array(place.astype(np.int32)), size, lone, *map(pa.array, told)], names=["node", "place", "size", "lone", *names])

    return sets.mapInArrow(run, f"node long, place int, size long, lone long, {', '.join(f'{c} long' for c in names)}")


def _open(entries: DataFrame) -> DataFrame:
    """The entries of buckets in which two components could still be linked."""
    crowded = entries.groupBy("sig").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.max("mine").alias("any")).where("low < high and any").select("sig")
    return entries.join(crowded.hint("merge"), "sig")


def _possible(percent: int, hub: str) -> Column:
    """Can a set be similar to the hub, whose columns begin with ``hub``, and is this signature one to compare them by.

    Lone shingles are differences; of the rest, so are the places where the sketches differ, and the gap of the sizes.
    Of the differences that are left to shared shingles, the group of this signature may hold its share only.
    """
    col, both = F.col, lambda c: col(c) + col(hub + c)
    apart = sum((F.bit_count(col(c).bitwiseXOR(col(hub + c))) for c in SKETCH[1:]), F.bit_count(col(SKETCH[0]).bitwiseXOR(col(hub + SKETCH[0])))).cast("long")
    gap = F.abs((col("size") - col("lone")) - (col(hub + "size") - col(hub + "lone")))
    most = both("size") * (100 - percent) - both("lone") * (100 + percent)
    share = most + F.greatest(col("gone"), col(hub + "gone")) * (2 * (100 + percent))
    return (F.greatest(apart, gap) * (100 + percent) <= most) & (apart * col("cuts") * (100 + percent) <= share * col("parts"))


def _round(entries: DataFrame, facts: DataFrame, hubs: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs a: hub, b to compare; entries without the hubs; the table that both come from).

    The hub of a first round (``hubs`` 1) is the bucket's member with the fewest lone
    shingles. Later, hubs are drawn by a hash of the node, so that a set is hub in all its
    buckets or in few; a bucket of no more members than ``hubs`` has all of them.
    """
    told = ("size", "lone", "gone", *SKETCH)
    names = ["node", "part", *told]
    if hubs == 1:
        rows = entries.join(facts, ["node", "place"])
        first = F.struct((-F.floor(F.col("lone") * 1000 / F.col("size"))).alias("share"), F.col("size"), *(F.col(c) for c in names if c != "size"))
        stats = rows.where("mine").groupBy("sig").agg(F.max(first).alias("top"))
        tagged = rows.join(stats.select("sig", *(F.col(f"top.{c}").alias(f"hub_{c}") for c in names)).hint("merge"), "sig").where("node <> hub_node")
        pairs = tagged.where("part <> hub_part").where(_possible(percent, "hub_"))
        return pairs.select(F.col("hub_node").alias("a"), F.col("node").alias("b")).distinct(), tagged.select(*entries.columns), entries
    stats = entries.where("mine").groupBy("sig").agg(F.count("*").alias("n"))
    draw = F.pmod(F.xxhash64("node", F.lit(hubs)), F.lit(1_000_000)) * F.col("n") < F.lit(1_000_000 * hubs)
    tagged = keep(entries.join(stats.hint("merge"), "sig").withColumn("hub", F.col("mine") & draw).drop("n"))
    rows = tagged.join(facts, ["node", "place"])
    chosen = rows.where("hub").select("sig", *(F.col(c).alias(f"hub_{c}") for c in names))
    met = rows.join(chosen.hint("merge"), "sig").where("node <> hub_node and part <> hub_part and (not hub or node > hub_node)").where(_possible(percent, "hub_"))
    return met.select(F.col("hub_node").alias("a"), F.col("node").alias("b")).distinct(), tagged.where("not hub").select(*entries.columns), tagged


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a: hub, b) whose sets reach the similarity.

    Sets travel to their hub's task, which holds one hub's set at a time; hubs of many
    members are salted and their set goes to every salt.
    """
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_MEMBERS).cast("int").alias("salts"))
    spread = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    hubs = salts.select("a", F.col("a").alias("node"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("hub"))
    asked = spread.select("a", F.col("b").alias("node"), "salt", F.lit(False).alias("hub")).union(hubs.select("a", "node", "salt", "hub"))
    rows = asked.join(sets.select("node", "size", "shingles").hint("merge"), "node").repartition("a", "salt").sortWithinPartitions("a", "salt", F.desc("hub"))

    @W.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own, own_size = None, None, 0
        for b in batches:
            left, right = [], []
            for a, node, hub, size, planes in zip(*(b.column(c).to_pylist() for c in ("a", "node", "hub", "size")), b.column("shingles"), strict=True):
                got = _unpack(planes.as_buffer())
                if hub:
                    centre, own, own_size = a, got, size
                elif a == centre:
                    met = len(np.intersect1d(own, got, assume_unique=True))
                    if 100 * met >= percent * (own_size + size - met):
                        left.append(a)
                        right.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return rows.select("a", "node", "hub", "size", "shingles").mapInArrow(run, "a long, b long")


class _Links:
    """The links found so far, and the component of every set that has one."""

    def __init__(self, sets: DataFrame, percent: int):
        self.sets, self.percent = sets, percent
        self.facts = keep(_facts(sets, percent))
        self.found = self.parts = None

    def compare(self, pairs: DataFrame) -> None:
        pairs = keep(pairs)
        if not pairs.isEmpty():
            fresh = keep(_verified(pairs, self.sets, self.percent))
            if not fresh.isEmpty():
                # links of a component so far are its stars: only those and what is new are joined
                before = self.parts
                known = fresh if before is None else fresh.union(before.select(F.col("node").alias("a"), F.col("component").alias("b")))
                self.parts = components(known)
                free(before)
            free(fresh)
        free(pairs)

    def settle(self, entries: DataFrame, hubs: int) -> DataFrame:
        """One round over ``entries``, a table that goes; the entries still open."""
        pairs, rest, source = _round(entries, self.facts, hubs, self.percent)
        self.compare(pairs)
        rest = keep(_open(self.labelled(rest)))
        free(entries, source)
        sweep(entries.sparkSession)
        return rest

    def labelled(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the part of their node."""
        if self.parts is None:
            return rows.withColumn("part", F.col("node"))
        return rows.drop("part").join(self.parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")


def links(own: DataFrame, found: DataFrame, width: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(classes: node and its smallest doc_id rep; components: node, component)."""
    spark = own.sparkSession
    classes = keep(found.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep")))
    sets = _candidates(own, found, classes, width, percent)
    sweep(spark)
    state = _Links(sets, percent)
    every = np.uint64(SAMPLE)
    some = keep(_open(_entries(state.labelled(sets), percent, lambda v: v % every == 0)))
    for hubs in (1, GROWTH):
        if some.isEmpty():
            break
        some = state.settle(some, hubs)

    def emit(batches: Iterator[pa.RecordBatch]) -> Emitted:
        for part, *given in _unpacked(batches):
            value, who, mine = signatures(*given, percent)
            yield value, part.column("part").to_numpy()[who], mine

    # signatures of two components, found by their parts' numbers: what copies share among themselves stays away
    labelled = state.sets = keep(state.labelled(sets))
    free(sets)
    sweep(spark)
    shared = spark.sparkContext.broadcast(repeated(labelled, emit, named=True))
    rest, hubs = keep(_entries(labelled, percent, lambda v: shared.value.has(v))), GROWTH
    spent(shared)
    while not rest.isEmpty():
        rest, hubs = state.settle(rest, hubs), hubs * GROWTH
    free(rest, state.facts)
    return classes, state.parts if state.parts is not None else spark.range(0).select(F.col("id").alias("node"), F.col("id").alias("component"))


def groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = keep(_inventory(own, width))
    classes, parts = links(own, found, width, percent)
    named = classes.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    least = named.groupBy("part").agg(F.min("rep").alias("component_id"))
    ids = named.join(least, "part").select("node", "component_id")
    return found.join(ids.hint("merge"), "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, *, doc_id: str = "doc_id", **names) -> DataFrame:
    """``docs`` without the documents whose group has a smaller doc_id; rows without id stay.

    Of equal ids one row stays: that whose JSON has the smallest SHA-256.
    """
    ids = groups(docs, doc_id=doc_id, **names).where("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    key = F.col(doc_id).cast("long")
    left = docs.join(ids, key == F.col("__gone"), "left_anti")
    again = keep(docs.groupBy(key.alias("__again")).count().where("__again is not null and count > 1").select("__again"))
    if again.isEmpty():
        return left
    whole = F.struct(*left.columns)
    repeated = left.join(again, key == F.col("__again"), "left_semi").groupBy(key).agg(F.min_by(whole, F.sha2(F.to_json(whole), 256)).alias("row"))
    return left.join(again, key == F.col("__again"), "left_anti").unionByName(repeated.select("row.*"))
