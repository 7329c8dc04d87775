import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import op2_packing, op4_lm_score, op6_token_files, op8_quality, op9_ngram_join
from quillspark.llm import words as W
from quillspark.llm.repeats import Filter, _found, _keys, _planes, _rows
from quillspark.llm.tokens import Encoder, vocabulary

TEXTS = ["a b  c a b c", "", None, "é é\n x", " ", "zz", "a b c " * 40, "x" * 3_000_000]


def test_words_match_the_pattern():
    raw, offsets = W.utf8(pa.array(TEXTS))
    found = W.scan(raw, offsets, W.NOT_BLANK)
    want = [re.findall(r"[^\x20\x09-\x0d]+", t or "") for t in TEXTS]
    assert [x.decode() for x in found.texts()] == [x for w in want for x in w]
    assert found.counts.tolist() == [len(w) for w in want]


def test_hashes_tell_words_and_windows_apart():
    raw, offsets = W.utf8(pa.array(TEXTS[:-1]))
    found = W.scan(raw, offsets, W.NOT_BLANK)
    hashes, texts = found.hashes(), found.texts()
    assert len(set(zip(texts, hashes.tolist(), strict=True))) == len(set(texts)) == len(set(hashes.tolist()))
    for width in (1, 2, 3, 5, 25, 50):
        value, at = W.windows(found, hashes, width)
        pairs = {(tuple(texts[p : p + width]), int(v)) for v, p in zip(value, at, strict=True)}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_pieces_encode_as_whole_texts():
    from tokenizers import Tokenizer

    own, e = Tokenizer.from_file(vocabulary()), Encoder()
    rng = random.Random(5)
    alphabet = [*"abcXYZ 's't !?.,-%_^`~{}[]()\"#1234567890<>=\n\té×÷ÉßKİΣσς中文 😀", "́", "̸", "\u0085", "\x1c", " ", "don't", "</w>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "hello <|endoftext|> world"]
    for _ in range(4000):
        x = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(e.ids_bytes([x])[0], "<u4").tolist() == own.encode(x, add_special_tokens=False).ids
    assert e.ids_bytes([None, ""]) == [b"", b""]
    assert np.frombuffer(e.ids_bytes(["hello <|endoftext|> world"])[0], "<u4").tolist() == [3306, 49407, 1002]


def test_encoder_forgets_and_keeps_its_slots_apart(monkeypatch):
    from quillspark.llm import tokens

    monkeypatch.setattr(tokens, "_SLOT_BITS", 6)
    small, large = Encoder(most=300), Encoder()
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5))) for _ in range(50)) for _ in range(60)]
    want = [np.array(x.ids, "<u4").tobytes() for x in large._own.encode_batch(texts, add_special_tokens=False)]
    assert [small.ids_bytes([t])[0] for t in texts] == want == large.ids_bytes(texts)


def test_tables_of_known_hashes_follow_their_entries():
    """A few words in a worker take little memory; many are all found, whatever the tables grew by."""
    room = lambda seen: sum(x.nbytes for x in seen._slots)
    assert room(Encoder()._seen) < 1 << 20
    hashes = W.mix(np.arange(1, 300_001, dtype=np.uint64))
    seen, entry = W.Seen(), []
    for part in np.array_split(hashes, 37):
        entry.append(seen.add(part))
    assert np.concatenate(entry).tolist() == list(range(1, 300_001))
    found = seen.find(hashes)
    assert ((found == np.arange(1, 300_001)) | (found == 0)).all() and (found == 0).mean() < 0.01
    assert room(seen) < 1 << 25 and not seen.find(W.mix(np.arange(400_000, 500_000, dtype=np.uint64))).any()


def test_workers_give_back_what_arrow_holds(monkeypatch):
    calls = []

    class Pool:
        def release_unused(self):
            calls.append(1)

    monkeypatch.setattr(W.pa, "default_memory_pool", Pool)
    assert list(W.lean(lambda batches: batches)(iter([pa.record_batch({"a": [1]})])))[0].num_rows == 1
    assert calls == [1]


def test_workers_give_back_what_the_heap_holds(monkeypatch):
    calls = []

    class Library:
        def malloc_trim(self, pad):
            calls.append(pad)

    monkeypatch.setattr(W.ctypes, "CDLL", lambda name: Library())
    assert list(W.lean(lambda batches: batches)(iter([1, 2]))) == [1, 2]
    assert calls == [0]
    monkeypatch.setattr(W.ctypes, "CDLL", lambda name: object())  # a C library without it
    assert list(W.lean(lambda batches: batches)(iter([3]))) == [3]


def test_hashes_of_words_do_not_know_their_block():
    words = [b"x" * n for n in (1, 70_000, 5, 66_000, 3)] + [b"w%d" % i for i in range(30_000)]
    raw = np.frombuffer(b" ".join(words), np.uint8)
    whole = W.scan(raw, np.array([0, len(raw)]), W.NOT_BLANK).hashes()
    for k in (0, 1, 2, 3, 4, 5, 9_000, 30_004):
        own = np.frombuffer(words[k], np.uint8)
        assert W.scan(own, np.array([0, len(own)]), W.NOT_BLANK).hashes()[0] == whole[k]


def test_coded_ids_near_both_ends_and_next_to_each_other():
    """Guesses that agree, differ, lie next to each other, or are missing beside the first and the last id."""
    r = np.random.default_rng(4)
    last = op6_token_files.LEAST_IDS - 1
    for few in ([0], [last], [0, last], [0, 1, last - 1, last], [7, 8, 9]):
        parts = [r.choice(few, int(n)) for n in r.integers(1, 6000, 5)] + [np.arange(last - 300, last + 1)]
        back = op6_token_files.decode_blocks(op6_token_files.encode_blocks(parts, op6_token_files.LEAST_IDS))
        assert all((a == b).all() for a, b in zip(parts, back, strict=True))


@pytest.mark.parametrize("n", [1, 2, 127, 128, 129, 5000, op6_token_files.BLOCK + 3])
@pytest.mark.parametrize("high", [2, 49408, 65536, 200_000])
def test_range_coder_round_trip(n, high):
    ids = np.random.default_rng(n).integers(0, high, n)
    assert (op6_token_files.unpack(op6_token_files.pack(ids)) == ids).all()


def test_coded_bytes_stay_and_tables_hold_only_told_ids():
    """Codes are those of the coder with tables over the whole alphabet; order-0 sums are the plain ones of counts."""
    ids = np.concatenate((np.arange(3000) * 7919 % 50021, np.tile(np.arange(50), 2000), np.arange(20000) ** 2 % 997, [65535, 0, 0, 1]))
    assert zlib.crc32(op6_token_files.pack(ids)) == 149863310
    assert zlib.crc32(op6_token_files.pack(np.array([0, 70000, op6_token_files.MOST_IDS - 1, 5] * 50))) == 2212721627
    r, size, lanes = np.random.default_rng(8), op6_token_files.LEAST_IDS, np.repeat(np.arange(3), 8)
    told = np.stack([r.choice([0, 1, 2, 3, 500, size - 2, size - 1, *range(900, 960)], 24) for _ in range(op6_token_files.MARKS[3])])
    model, counts = op6_token_files.Model(lanes, size), np.ones((3, size), np.int64)
    for t, now in enumerate(told):
        model.guess(t)
        model.past[t + 2], model.at[t + 1] = now, model.slot[model.base + now]
        np.add.at(counts, (lanes, now), op6_token_files._GAIN)
    model.learn(0, len(told))
    model.index()
    assert len(model.cum) <= len(np.unique(lanes * size + told)) + 1 + 3  # none, and an id 0 of each block
    for _ in range(40):
        ends = counts.cumsum(1)[lanes]
        value = (r.random(24) * ends[:, -1]).astype(np.int32)
        edge = np.array([ends[k, r.choice(told[:, k])] for k in range(24)])
        value = np.where(r.random(24) < 0.5, np.clip(edge - r.integers(0, 60, 24), 0, ends[:, -1] - 1), value).astype(np.int32)
        want = np.array([np.searchsorted(e, v, "right") for e, v in zip(ends, value, strict=True)])
        got, _, begin, wide = model.find(value)
        assert (got == want).all() and (wide == counts[lanes, want]).all() and (begin == ends[np.arange(24), want] - wide).all()


def test_range_coder_compresses_and_finds_damage():
    data = op6_token_files.pack(np.tile(np.arange(50), 2000))
    assert len(data) < 25_000
    for at in (0, 30, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            op6_token_files.unpack(bytes(bad))
    blocks = op6_token_files.encode_blocks([np.arange(300), np.arange(7)], op6_token_files.LEAST_IDS)
    assert op6_token_files.decode_blocks(blocks[1:])[0].tolist() == list(range(7))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4096), max_size=300))
def test_plan_places_every_piece(lengths):
    hist = Counter(lengths)
    plan = op2_packing.Plan(hist)
    placed = Counter()
    for times, pieces in plan.groups:
        assert sum(pieces) <= 4096
        for n in pieces:
            placed[n] += times
    assert placed == hist


def test_plan_is_tight():
    rng = np.random.default_rng(0)
    lengths = np.clip(np.exp(rng.normal(6.5, 1.2, 20_000)), 1, 4096).astype(int)
    plan = op2_packing.Plan(Counter(lengths.tolist()))
    assert plan.sequences <= 1.01 * lengths.sum() / 4096 + 1


def test_nnls_finds_exact_counts():
    a = np.array([[1.0, 0, 2], [0, 1, 1]])
    assert np.allclose(a @ op2_packing.nnls(a, np.array([5.0, 4])), [5, 4])


def test_slices_find_repeats():
    rng = np.random.default_rng(1)
    one, two = rng.integers(0, 2**64 - 1, 5000, dtype=np.uint64), rng.integers(0, 2**64 - 1, 5000, dtype=np.uint64)
    two[:100] = one[:100]
    n = 3
    out = Filter(n)
    tables = [_rows(v, np.full(len(v), k), np.arange(len(v)) < 60, n).to_pydict() for k, v in enumerate((one, two))]
    for s in range(n):
        keys = [t["keys"][t["slice"].index(s)] for t in tables]
        flags = [t["flags"][t["slice"].index(s)] for t in tables]
        out.put(s, Filter.segment(_found(keys, flags), n))
    assert out.has(one[:60]).all() and out.has(one[100:]).mean() < 0.01 and out.has(one[60:100]).mean() < 0.1
    # with numbers of documents, a value that one document sends twice is not shared
    sent = [_rows(v, np.full(len(v), doc), np.ones(len(v), bool), 1, True).to_pydict() for v, doc in ((one, -5), (one, -5), (two, 9))]
    low = _found([t["keys"][0] for t in sent], [t["flags"][0] for t in sent], [t["docs"][0] for t in sent])
    assert low.tolist() == sorted(set((one[:100] & np.uint64(2**32 - 1)).tolist()))
    keys = np.sort(rng.integers(0, 2**32, 999, dtype=np.uint64))
    assert (_keys(_planes(keys)) == keys).all()


def _sets(texts):
    _, doc, shingle = next(op9_ngram_join._shingles(pa.array(texts)))
    return doc, shingle


@settings(max_examples=150, deadline=None)
@given(st.integers(4, 300), st.floats(0, 1), st.integers(0, 2**31), st.sampled_from([75, 60, 90]))
def test_similar_sets_share_a_signature(n, lost, seed, percent):
    """Sets as far apart as similar ones may be; what only one of them has may count as lone."""
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 2**54, 2 * n, dtype=np.uint64)
    cut = int(lost * n * (100 - percent) / 100)
    one = np.unique(pool[:n])
    two = np.unique(np.concatenate((one[cut:], pool[n : n + rng.integers(0, cut + 1)])))
    met = len(np.intersect1d(one, two))
    for lone in (False, True):
        sets = [np.intersect1d(one, two)] * 2 if lone else [one, two]
        value, who, mine = op9_ngram_join.signatures(np.repeat([0, 1], [len(x) for x in sets]), np.concatenate(sets), np.array([len(one), len(two)]), percent)
        if 100 * met >= percent * (len(one) + len(two) - met) and cut:
            shared = set(value[who == 0].tolist()) & set(value[who == 1].tolist())
            assert shared & set(value[mine].tolist())


def test_sketches_never_tell_more_than_the_difference():
    rng = np.random.default_rng(3)
    pool = np.unique(rng.integers(0, 2**54, 900, dtype=np.uint64))
    for cut in (0, 5, 60, 400):
        one, two = pool[: len(pool) - cut], pool[cut // 2 :]
        words = op9_ngram_join.sketches(np.concatenate((one, two)), np.array([0, len(one)]))
        apart = sum(((int(w[0]) ^ int(w[1])) & (2**64 - 1)).bit_count() for w in words)
        differ = len(np.setxor1d(one, two))
        assert apart <= differ and apart >= min(differ, 100) // 2


def test_chain_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    doc, e, table = np.array([0, 0, 0, 0, 1]), rng.normal(size=5), rng.normal(size=(2, 2))
    ahead, back = op8_quality.Chain(doc).run(e, table)
    total = np.zeros((4, 2))
    for k in range(16):
        y = [(k >> i) & 1 for i in range(4)]
        w = np.exp(sum(e[i] * y[i] for i in range(4)) + sum(table[y[i - 1], y[i]] for i in range(1, 4)))
        for i in range(4):
            total[i, y[i]] += w
    assert np.allclose(1 / (1 + np.exp(-(ahead + back)))[:4], total[:, 1] / total.sum(1))
    assert np.isclose(ahead[4] + back[4], e[4])


def test_attention_gradient():
    p = {k: v.astype(np.float64) for k, v in op4_lm_score.initial().items()}
    rng = np.random.default_rng(0)
    x, t = rng.integers(0, 50, (2, op4_lm_score.LEN)), rng.integers(0, op4_lm_score.CLASSES, (2, op4_lm_score.LEN))
    pad = np.zeros(t.shape, bool)
    pad[0, :3] = True

    def loss(p):
        h = op4_lm_score._forward(p, x, pad)[-1]
        z = h @ p["out"] + p["bias"]
        z = z - z.max(2, keepdims=True)
        logp = z - np.log(np.exp(z).sum(2, keepdims=True))
        b, s = np.indices(t.shape)
        return -(logp[b, s, t] * ~pad).sum() / (~pad).sum()

    g = op4_lm_score.gradient(p, x, t, pad)
    for key in p:
        at = tuple(np.unravel_index(np.argmax(np.abs(g[key])), g[key].shape))
        up, down = ({k: v.copy() for k, v in p.items()} for _ in (0, 1))
        up[key][at] += 1e-4
        down[key][at] -= 1e-4
        assert np.isclose((loss(up) - loss(down)) / 2e-4, g[key][at], rtol=2e-2, atol=1e-5), key


def test_gradient_of_told_places_takes_no_whole_pass(monkeypatch):
    """Context places are looked at but ask nothing; the gradient is that of a whole pass whose loss leaves them out."""
    p = {k: v.astype(np.float64) for k, v in op4_lm_score.initial().items()}
    rng, told = np.random.default_rng(1), op4_lm_score.CONTEXT
    x, t = rng.integers(0, 50, (3, op4_lm_score.LEN)), rng.integers(0, op4_lm_score.CLASSES, (3, op4_lm_score.LEN))
    pad = np.zeros(t.shape, bool)
    pad[0, :11] = pad[1, 20:] = True
    live = ~pad & (np.arange(t.shape[1]) >= told)

    def loss(p, whole=op4_lm_score._forward):
        z = whole(p, x, pad)[-1] @ p["out"] + p["bias"]
        logp = z - np.log(np.exp(z).sum(2, keepdims=True))
        return -np.take_along_axis(logp, t[:, :, None], 2)[live].mean()

    monkeypatch.setattr(op4_lm_score, "_forward", None)
    g = op4_lm_score.gradient(p, x, t, pad, told)
    for key in p:
        at = tuple(np.unravel_index(np.argmax(np.abs(g[key])), g[key].shape))
        up, down = ({k: v.copy() for k, v in p.items()} for _ in (0, 1))
        up[key][at] += 1e-4
        down[key][at] -= 1e-4
        assert np.isclose((loss(up) - loss(down)) / 2e-4, g[key][at], rtol=2e-2, atol=1e-5), key


def test_gradient_adds_only_rows_that_occur(monkeypatch):
    """Inputs that repeat add up, without a pass over all cells of the table; places outside and large exponents stay finite."""
    rng, told = np.random.default_rng(2), op4_lm_score.CONTEXT
    p = {k: v.astype(np.float64) for k, v in op4_lm_score.initial().items()}
    x, t = rng.integers(0, 9, (4, op4_lm_score.LEN)), rng.integers(0, op4_lm_score.CLASSES, (4, op4_lm_score.LEN))
    pad = np.zeros(x.shape, bool)
    pad[0, :told], pad[1, -9:] = True, True
    apart = [op4_lm_score.gradient(p, x[i : i + 1], t[i : i + 1], pad[i : i + 1], told) for i in range(4)]
    share = (~pad[:, told:]).sum(1) / (~pad[:, told:]).sum()
    monkeypatch.setattr(np, "bincount", None)
    whole = op4_lm_score.gradient(p, x, t, pad, told)
    for k in p:
        assert np.allclose(whole[k], sum(g[k] * w for g, w in zip(apart, share, strict=True)), rtol=1e-4, atol=1e-9), k
    assert not whole["emb"][9:].any() and whole["emb"][:9].all()
    steep = {k: v.astype(np.float32) * (300 if k in ("q", "k", "out") else 1) for k, v in p.items()}
    assert all(np.isfinite(g).all() for g in op4_lm_score.gradient(steep, x, t, pad).values())


def test_neighbours_stay_in_their_text(monkeypatch):
    monkeypatch.setattr(op4_lm_score, "_PLACES", 50)  # many parts
    r, own, near = np.random.default_rng(6), np.full(op4_lm_score.VOCABULARY, -1), op4_lm_score.NEAR
    own[[3, 5, op4_lm_score.END]] = 0, 1, op4_lm_score.OWN - 1
    texts = [r.choice([0, 3, 5, 9, op4_lm_score.END], n).astype("<u2") for n in (1, 0, 2, 40, 700, 6, 7)]
    want = np.zeros((op4_lm_score.VOCABULARY, op4_lm_score.OWN), np.int64)
    for x in texts:
        for i in range(len(x)):
            for j in range(max(0, i - near), min(len(x), i + near + 1)):
                if i != j and own[x[j]] >= 0:
                    want[x[i], own[x[j]]] += 1
    total = np.zeros(want.size, np.int64)
    op4_lm_score.add_near(total, [x.tobytes() for x in texts], own)
    op4_lm_score.add_near(total, [], own)
    assert (total == want.ravel()).all() and want.sum() > 1000


def test_reader_tells_words_by_entry():
    texts = pa.array(["Red green red", "", None, "blue 12 blue red " + " ".join(f"w{i}" for i in range(3000))])
    reader, counts = op4_lm_score.Reader(), Counter()
    for _, hashes, entry, ids, _ in reader.read(texts):
        met = np.bincount(entry)
        at = np.flatnonzero(met)
        told, first = reader.words(at)
        counts.update(dict(zip(told.tolist(), met[at].tolist(), strict=True)))
        assert (told[np.searchsorted(at, entry)] == hashes).all() and (first[np.searchsorted(at, entry)] == ids).all()
    raw = np.frombuffer(b"red", np.uint8)
    assert counts[int(W.scan(raw, np.array([0, 3]), W.NOT_BLANK).hashes()[0])] == 3 and counts[int(op4_lm_score.END_HASH)] == 4
    assert len(counts) == 3000 + 5 and not reader.full


def test_windows_score_each_id_as_one_pass_does():
    p = op4_lm_score.initial()
    near = np.zeros((op4_lm_score.VOCABULARY, op4_lm_score.OWN))
    counts = np.arange(op4_lm_score.VOCABULARY)[::-1] % 97
    table = op4_lm_score.Table.of(counts, counts // 3, near, np.zeros(op4_lm_score.VOCABULARY, bool))
    ids = np.random.default_rng(2).integers(0, 500, 77)
    both = op4_lm_score.id_scores(p, table, ids, np.array([70, 7]))
    assert np.allclose(both[70:], op4_lm_score.id_scores(p, table, ids[70:], np.array([7])), atol=1e-5)
    mass = np.bincount(table.cls, counts + 0.5 * (counts // 3), minlength=op4_lm_score.CLASSES) + 0.5
    assert np.allclose(np.exp(table.log_mass), mass, rtol=1e-4)


def test_windows_tell_every_id_once():
    texts = [np.arange(n, dtype="<u2") + 1 for n in (1, 24, 25, 1300)]
    w = np.concatenate(list(op4_lm_score.windows([t.tobytes() for t in texts])))
    told = w[:, op4_lm_score.CONTEXT + 1 :]
    assert sorted(told[told >= 0].tolist()) == sorted(np.concatenate(texts).tolist())
    assert all(r[k] in (r[k + 1] - 1, -1) for r in w for k in range(op4_lm_score.LEN) if r[k + 1] > 1)


def test_classes_of_the_output():
    # 7bc4542 had cut these to 48 and 32
    assert (op4_lm_score.OWN, op4_lm_score.SHARED) == (64, 48)
    near = np.zeros((op4_lm_score.VOCABULARY, op4_lm_score.OWN))
    counts = np.arange(op4_lm_score.VOCABULARY)[::-1]
    table = op4_lm_score.Table.of(counts, counts, near, np.zeros(op4_lm_score.VOCABULARY, bool))
    assert np.bincount(table.cls)[:64].tolist() == [1] * 64


def _apart(one, two):
    return sum(((int(x) ^ int(y)) & (1 << 64) - 1).bit_count() for x, y in zip(one, two))


def _met(one, two, lone=(0, 0), percent=75):
    """Over how many equal signatures the sets are compared, and how many they have."""
    doc, every, size = np.repeat([0, 1], [len(one), len(two)]), np.concatenate((one, two)), np.array([len(one) + lone[0], len(two) + lone[1]])
    sig, who, mine, place = op9_ngram_join._signatures(doc, every, size, percent)
    owner, at, parts, cuts, gone, *words = op9_ngram_join.local_sketches(doc, every, size, percent)
    facts = {(a, b): (p, n, g, w) for a, b, p, n, g, w in zip(owner.tolist(), at.tolist(), parts.tolist(), cuts.tolist(), gone.tolist(), zip(*(w.tolist() for w in words)))}
    met = equal = 0
    left = {s: (p, m) for s, p, m in zip(sig[who == 0].tolist(), place[who == 0].tolist(), mine[who == 0].tolist())}
    for s, p, m in zip(sig[who == 1].tolist(), place[who == 1].tolist(), mine[who == 1].tolist()):
        if s in left and (m or left[s][1]):
            (parts_, n, g, w), (parts2, n2, g2, w2) = facts[0, left[s][0]], facts[1, p]
            assert (parts_, n) == (parts2, n2)
            apart = _apart(w, w2)
            most = int(size.sum()) * (100 - percent) - sum(lone) * (100 + percent)
            equal += 1
            met += apart * n * (100 + percent) <= (most + 2 * max(g, g2) * (100 + percent)) * parts_
    return met, equal


def test_ngram_local_sketches_lose_no_similar_pair():
    """Pairs as different as a link allows, spread over the groups or heaped in few of them."""
    r = np.random.default_rng(21)
    for k in range(60):
        n = int(r.integers(60, 3000))
        base = np.unique(r.integers(0, 1 << 54, 2 * n, dtype=np.uint64))
        if k % 2:  # what differs lies in a few groups of partitions
            base = base[np.argsort(op9_ngram_join.W.mix(base + np.uint64(1_000_003)) % np.uint64(64), kind="stable")]
        else:
            base = r.permutation(base)
        lone = (int(r.integers(0, 4)), int(r.integers(0, 4)))
        cut = 2 * n * 25 // 175 - sum(lone)
        added = int(r.integers(0, cut // 2 + 1))
        one, two = base[added:n], np.concatenate((base[:added], base[added : n - (cut - 2 * added)])) if k % 3 else base[cut - added : n]
        apart = len(np.setxor1d(one, two)) + sum(lone)
        if apart * 175 > (len(one) + len(two) + sum(lone)) * 25:
            continue
        assert _met(np.sort(one), np.sort(two), lone)[0] > 0, (k, n)


def test_ngram_large_unlike_sets_do_not_meet():
    """They share a third, so many signatures are equal, and too much for one sketch of a whole set to tell."""
    r = np.random.default_rng(22)
    shared = r.integers(0, 1 << 54, 2000, dtype=np.uint64)
    one, two = (np.unique(np.concatenate((shared, r.integers(0, 1 << 54, 2000, dtype=np.uint64)))) for _ in range(2))
    whole = op9_ngram_join.sketches(np.concatenate((one, two)), np.array([0, len(one)]))
    assert _apart(*zip(*whole)) * 175 < (len(one) + len(two)) * 25
    met, equal = _met(one, two)
    assert equal > 10 and met == 0
