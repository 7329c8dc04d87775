"""Whole operators against brute force on a small fixture with nulls, ties, copies and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import op1_url_filters, op2_packing, op3_toxicity, op4_lm_score, op5_quality_rules, op6_token_files, op7_substrings, op8_quality, op9_ngram_join, op10_decontaminate
from quillspark.llm.components import components
from quillspark.llm.durable import spent

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, h long, row_key long, component_id long, node long"
rng = random.Random(11)
VOCAB = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def prose(n, r):
    return " ".join(r.choice(VOCAB) + r.choice(["", "", "", ",", ".\n"]) for _ in range(n))


def fixture_rows():
    r = random.Random(4)
    passage = prose(70, r)
    rows = [prose(r.randint(60, 200), r) for _ in range(25)]
    rows += [rows[0], rows[0], rows[1].upper(), None, "", " \n ", "one", "one", "Two Words", "x " * 120]
    rows += [f"{prose(40, r)} {passage} {prose(30, r)}" for _ in range(6)]
    base = prose(180, r).split(" ")
    for k in range(8):
        copy = list(base)
        copy[20 * k] = f"edit{k}"
        rows.append(" ".join(copy))
    rows.append(prose(6000, r))
    return [(i * 3 + 1, t, ["en", "de", None][i % 3], "s", len(t or ""), 0, 1, 2, 3, 4) for i, t in enumerate(rows)]


ROWS = fixture_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", t or "")


def low(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def test_op7_matches_brute_force(docs):
    first = {}
    for i, t, *_ in ROWS:
        w = words(t)
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p : p + 50]), i)
    got = {r.doc_id: r for r in op7_substrings.report(docs).collect()}
    removed = 0
    for i, t, *_ in ROWS:
        w, gone = words(t), set()
        for p in range(len(w) - 49):
            if first[tuple(w[p : p + 50])] < i:
                gone.update(range(p, p + 50))
        kept = [x for p, x in enumerate(w) if p not in gone]
        removed += len(gone)
        assert (got[i].n_words, got[i].n_removed) == (len(w), len(gone))
        assert got[i].kept_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()
    assert removed > 500 and len(got) == len(ROWS)


def test_op7_remove_keeps_columns_and_null_ids(spark, docs):
    out = op7_substrings.remove(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    same = prose(60, random.Random(1))
    rows = spark.createDataFrame([(None, same), (5, same), (5, same), (9, same)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in op7_substrings.report(rows).collect()) == [(0, 0), (5, 0), (5, 0), (9, 60)]


def test_op7_hot_windows_are_salted(spark, monkeypatch):
    """Windows of many rows go in parts; results are those of one part."""
    monkeypatch.setattr(op7_substrings, "HOT", ((5, 8), (40, 64)))
    r = random.Random(31)
    common = prose(80, r)
    rows = [(i, f"{prose(r.randint(0, 40), r)} {common} {prose(r.randint(0, 40), r)}") for i in range(1, 61)] + [(100 + i, f"{prose(20, r)} {common[:400]}") for i in range(6)]
    got = {x.doc_id: x.n_removed for x in op7_substrings.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    first = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p : p + 50]), i)
    for i, t in rows:
        w = words(t)
        assert got[i] == len({q for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < i for q in range(p, p + 50)})
    assert sum(got.values()) > 4000


def test_clashing_columns_keep_their_values(spark):
    """Columns of the input named as the operators name their own come back unchanged."""
    same, n = prose(70, random.Random(1)), 4
    cols = ["row_key", "starts", "gone", "again", "node", "part", "window", "host", "n_active", "blocked", "__hit_words", "h", "score"]
    rows = [(i, same if i < 3 else f"{same} more {i}", *(100 * i + k for k in range(len(cols)))) for i in range(1, n + 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` long" for c in cols))
    want = {r[0]: r[2:] for r in rows}
    bench = spark.createDataFrame([(1, same)], "item_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, n + 1)], "doc_id long, quality int, toxic int")
    for out in (op7_substrings.remove(df), op9_ngram_join.representatives(df), op10_decontaminate.clean(df, bench), op8_quality.accepted(df, labels)):
        assert out.columns == df.columns
        got = {r.doc_id: tuple(r)[2:] for r in out.collect()}
        assert got and all(got[i] == want[i] for i in got)
    caps = spark.createDataFrame([("http://ok.org/x", 5, "mine", 7, "also"), ("http://ok.org/x", 5, "mine", 7, "also"), (None, None, "m", None, None)], "url string, fetched_at int, host string, n_active int, blocked string")
    entries = spark.createDataFrame([("l", "ok.org", "add", 1)], "list string, pattern string, action string, at int")
    out = op1_url_filters.evaluate(caps, entries)
    assert out.columns == [*caps.columns, "host_", "n_active_", "active_pattern", "active_lists", "blocked_"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("http://ok.org/x", 5, "mine", 7, "also", "ok.org", 1, "ok.org", "l", True)] * 2 + [(None, None, "m", None, None, None, 0, None, None, False)], key=str)
    assert [tuple(x) for x in op1_url_filters.kept(caps, entries).collect()] == [(None, None, "m", None, None)]


def components_of(rows):
    sets = {}
    for i, t in rows:
        w = words(low(t))
        sets[i] = {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    part = {i: i for i in sets}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                part[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_op9_matches_brute_force(docs):
    want = components_of([(i, t) for i, t, *_ in ROWS])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op9_ngram_join.groups(docs).collect()}
    assert got == want and sum(i != c for i, (_, c) in want.items()) >= 10
    left = op9_ngram_join.representatives(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_op9_chains_of_near_copies(spark):
    r, base, rows = random.Random(8), None, []
    base = prose(150, r).split(" ")
    for k in range(12):
        for _ in range(4):
            base[r.randrange(150)] = f"n{r.random()}"
        rows.append((k + 1, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in op9_ngram_join.groups(df).collect()} == components_of(rows)


def test_op9_group_of_unequal_copies(spark, monkeypatch):
    """Copies of one text, some too far from the first hubs and some from every other."""
    monkeypatch.setattr(op9_ngram_join, "GROWTH", 2)
    r = random.Random(12)
    base, rows = prose(120, r).split(" "), []
    for k in range(60):
        copy = list(base)
        for _ in range(r.randint(0, 9)):
            copy[r.randrange(120)] = r.choice(base) if k % 2 else f"n{r.random()}"
        rows.append((k + 1, " ".join(copy)))
    want = components_of(rows)
    assert len({c for _, c in want.values()}) > 5
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in op9_ngram_join.groups(df).collect()} == want


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(30, 31), (31, 30), (40, 40)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert all(got[i] == 1 for i in range(1, 21)) and got[31] == 30 and got[30] == 30


def test_few_links_take_few_tasks(spark):
    """Not some shuffles for every step, which at many partitions is mostly files and logs of empty tasks."""
    r = random.Random(5)
    order = [r.randrange(-(2**62), 2**62) for _ in range(60)]
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(59) if i % 7] + [(5, 5)], "a long, b long")
    spark.sparkContext.setJobGroup("few links", "")
    got = {r.node: r.component for r in components(links).collect()}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    told = spark.sparkContext.statusTracker()
    stages = {i for job in told.getJobIdsForGroup("few links") for i in told.getJobInfo(job).stageIds}
    assert sum(told.getStageInfo(i).numTasks for i in stages) <= 3 * links.rdd.getNumPartitions() + 3
    assert got == {r.node: r.component for r in components(links, few=0).collect()} and len(got) == 59 and len(set(got.values())) == 9


def test_no_links_have_no_components(spark):
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_broadcasts_of_links_are_gone(spark, docs, monkeypatch):
    sent = []
    monkeypatch.setattr(op9_ngram_join, "spent", lambda *x: (sent.extend(x), spent(*x)))
    op9_ngram_join.groups(docs).count()
    assert len(sent) == 3 and all(x._jbroadcast is None or not x._jbroadcast.isValid() for x in sent)


def test_op10_matches_brute_force(spark, docs, monkeypatch):
    texts = {i: t for i, t, *_ in ROWS}
    items = [(1, " ".join(words(texts[4])[3:20])), (2, "one"), (10, "nowhere to be found at all"), (3, None), (4, ""), (5, texts[7].upper()), (1, "two words"), (6, " ".join(words(texts[4])[3:20]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    alnum = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    want = {}
    for i, t in texts.items():
        w, hit, found = alnum(t), set(), set()
        for k, s in items:
            v = alnum(s)
            n = min(10, len(v))
            for q in range(len(v) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[q : q + n]:
                        hit.update(range(p, p + n))
                        found.add(str(k))
        want[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    read = lambda: {r[0]: tuple(r)[1:] for r in op10_decontaminate.report(docs, bench).collect()}
    assert read() == want and sum(v[4] for v in want.values()) >= 4
    monkeypatch.setattr(op10_decontaminate, "ITEM_BLOCK_BYTES", 40)  # several blocks of items
    assert read() == want
    clean = op10_decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns
    again = op10_decontaminate.search(clean.where("doc_id = 4"), bench).first()
    assert again.n_words == want[4][0] - want[4][1]


def test_op6_report_keeps_ids_in_the_task(spark, docs):
    """It reads every id back, but sends none to the JVM, where nobody asks for them."""
    files = op6_token_files.write(docs)
    plan = op6_token_files.report(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert [x for x in plan.splitlines() if "MapInArrow" in x] and not [x for x in plan.splitlines() if "MapInArrow" in x and " ids#" in x]
    whole, slim = op6_token_files.read(files), op6_token_files.read(files, ids=False)
    assert sorted(whole.drop("ids").collect()) == sorted(slim.collect())
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens for r in whole.collect())


def test_op2_and_op6(spark, docs):
    from tokenizers import Tokenizer

    from quillspark.llm.tokens import vocabulary

    t = Tokenizer.from_file(vocabulary())
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x, *_ in ROWS}
    at = 0
    got = {r.doc_id: r for r in op6_token_files.report(docs).collect()}
    for i in sorted(ids):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids[i]), zlib.crc32(ids[i].tobytes()))
        at += len(ids[i])
    rows = op2_packing.pack(docs).collect()
    spans = {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 4096 * r.piece and r.ids_crc32 == zlib.crc32(part.tobytes()) and len(part) == r.length
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in spans.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 4096
    assert sum(r.length for r in rows) == at and len(spans) <= at // 4096 + 2


def test_op5_counts(spark, docs):
    got = {r.doc_id: r for r in op5_quality_rules.report(docs).collect()}
    assert len(got) == len(ROWS)
    for i, t, *_ in ROWS:
        w, t = words(t), t or ""
        seen = {}
        for p in range(len(w) - 7):
            seen.setdefault(tuple(w[p : p + 8]), []).append(p)
        rep = {q for v in seen.values() if len(v) > 1 for p in v for q in range(p, p + 8)}
        lines = [x for x in t.split("\n") if words(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep)), i
        assert r.base_failed == (len(w) < 20 or 100 * len(rep) > 30 * len(w)) and not (r.base_failed and r.kept)


def test_op1_intervals(spark):
    d = lambda n: F.timestamp_seconds(F.lit(n * 86400))  # noqa: E731, F841
    entries = spark.createDataFrame([("l", "bad.org", "add", 10), ("l", "bad.org", "remove", 20), ("l", "bad.org", "add", 30), ("l", "bad.org", "add", 31), ("m", "x.com/a/", "add", 5), ("m", "x.com/a/", "remove", 5), ("l", None, "add", 1), ("n", "ok.net/p/", "add", 1)], "list string, pattern string, action string, at int")
    urls = [("http://www.bad.org/z", 9, False), ("http://www.bad.org:80/z", 10, True), ("https://u@BAD.org", 20, False), ("https://bad.org./", 99, True), ("https://notbad.org/", 99, False), ("http://x.com/a/b", 50, False), ("http://ok.net/p/q?x", 2, True), ("http://ok.net/pp/q", 2, False), (None, 5, False), ("", 5, False), ("http://bad.org", None, False), ("junk", 9, False)]
    caps = spark.createDataFrame([(i, u, t) for i, (u, t, _) in enumerate(urls)], "i int, url string, fetched_at int")
    out = {r.i: r.blocked for r in op1_url_filters.evaluate(caps, entries).collect()}
    assert out == {i: want for i, (_, _, want) in enumerate(urls)}
    assert op1_url_filters.kept(caps, entries.limit(0)).count() == len(urls)


def test_op3_and_op8_learn(spark):
    r, rows, labels = random.Random(2), [], []
    for i in range(400):
        t, toxic, good = prose(r.randint(30, 90), r), int(i % 5 == 0), int(i % 3 > 0)
        if toxic:
            t = t.replace(" ", " wretchedfool ", 1)
        if not good:
            t = re.sub(r" ", "### ", t)
        rows.append((i, t))
        labels.append((i, good, toxic))
    rows += [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (5000, None, None)], "doc_id long, quality int, toxic int")
    for op, column in ((op3_toxicity, 2), (op8_quality, 1)):
        got = {x.doc_id: x for x in op.report(docs, lab).collect()}
        assert len(got) == 402 and all(0 <= x.score <= 1 and x.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, x in got.items())
        held = [row for row in labels if got[row[0]].held_out]
        assert sum(got[row[0]].predicted == row[column] for row in held) >= 0.95 * len(held)
    assert op8_quality.accepted(docs, lab).columns == docs.columns
    assert {x.score for x in op3_toxicity.score(docs, lab.limit(0)).collect()} == {0.0}
    assert {x.score for x in op8_quality.score(docs, lab.limit(0)).collect()} == {1.0}


def test_op3_counts_ratios_and_scores(spark):
    """Feature counts, log ratios and scores, recomputed a document at a time."""
    r = random.Random(5)
    texts = [prose(r.randint(5, 30), r) + (" dreadfulness" if i % 4 == 0 else "") for i in range(80)] + ["", "x", "long " * 60_000]
    y = [int(i % 4 == 0) for i in range(len(texts))]
    rows = spark.createDataFrame(list(zip(texts, y, strict=True)), "text string, y int").repartition(3)
    features = [set(op3_toxicity.present([t])[1].tolist()) for t in texts]
    counts = op3_toxicity.counted(rows)
    want = np.zeros_like(counts)
    for f, k in zip(features, y, strict=True):
        want[k, list(f)] += 1
    assert (counts == want).all()
    n1, n0 = sum(y), len(y) - sum(y)
    ratio, names = op3_toxicity.chosen(counts, n1, n0, 200)
    for f in names[:20]:
        assert np.isclose(ratio[f], np.log((want[1, f] + 1) / (n1 + 2)) - np.log((want[0, f] + 1) / (n0 + 2)))
    gain = lambda f: abs(want[1, f] / n1 - want[0, f] / n0) * abs(ratio[f])
    rest = [f for f in set().union(*features) - set(names.tolist()) if want[:, f].sum() >= 3]
    assert len(names) == 200 and min(map(gain, names)) >= max(map(gain, rest)) - 1e-12
    model = op3_toxicity.fit(rows, 0.25, 200)
    assert set(np.flatnonzero(model.keep).tolist()) == set(names.tolist())
    for t, f, got in zip(texts, features, model.score(texts), strict=True):
        z = model.bias + sum(model.weight[k] for k in f if model.keep[k])
        assert np.isclose(got, 1 / (1 + np.exp(-np.clip(z, -30, 30))))
    assert sum((model.score(texts) >= 0.5) == np.array(y)) >= len(y) - 3


def test_op8_document_scores_match_enumeration(spark):
    """Marginals by summing over all paths, then their mean by length, and the outer fit."""
    from itertools import product

    import pyarrow as pa

    r = random.Random(6)
    rng = np.random.default_rng(1)
    model = op8_quality.Model(rng.normal(0, 1, 3 * op8_quality.FEATURES), rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 3))
    texts = ["\n".join(prose(r.randint(0, 8), r) + r.choice(["", " ###"]) for _ in range(r.randint(1, 6))) for _ in range(12)] + ["", "one\n\none"]
    got = op8_quality.scores(pa.array(texts), model)
    for t, value in zip(texts, got, strict=True):
        raw = np.frombuffer(t.encode(), np.uint8)
        doc, size, seen = op8_quality.lines(raw, np.array([0, len(raw)]))
        e = op8_quality.neighbours(doc, seen) @ model.weight
        paths = {p: np.exp(sum(e[i] for i, x in enumerate(p) if x) + sum(model.table[a, b] for a, b in zip(p, p[1:]))) for p in product((0, 1), repeat=len(e))}  # noqa: B905
        m = np.array([sum(v for p, v in paths.items() if p[i]) for i in range(len(e))]) / sum(paths.values())
        w = size + 1.0
        mean, bad = (w * m).sum() / w.sum(), (w * (m < 0.5)).sum() / w.sum()
        logit = np.clip(np.log(mean + 1e-4) - np.log(1 - mean + 1e-4), -8, 8)
        assert np.isclose(value, 1 / (1 + np.exp(-(model.slope @ [1, logit, bad]))), rtol=1e-6)


def test_learning_takes_long_documents_and_bounds_lines(spark):
    rows = [(i, ("good words here\n" if i % 2 else "### $$$ ***\n") * (20_000 if i < 4 else 3)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    from quillspark.llm import learn

    got = {r.i: len(r.text) for r in learn.sample(docs, labels, "quality", 100).collect()}
    assert got == {i: len(t) for i, t in rows if zlib.crc32(str(i).encode()) % 5}
    small = op8_quality.train(docs, labels, most_lines=150)  # the long ones are passed over, the others learnt from
    assert small is not None and op8_quality.train(docs, labels, most_lines=3) is None


def test_op4_scores_match_brute_force(docs, monkeypatch):
    """Counts, base and model score, each token told by itself from its own window."""
    from collections import Counter
    from math import log10

    from tokenizers import Tokenizer

    from quillspark.llm import learn
    from quillspark.llm.tokens import vocabulary

    o, own = op4_lm_score, Tokenizer.from_file(vocabulary())
    monkeypatch.setattr(o, "TOP_WORDS", 50)
    w = {i: [*words(low(t)), None] for i, t, *_ in ROWS}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in w}
    c = Counter(x for i in w if not held[i] for x in w[i])
    n, floor = sum(c.values()), log10(sum(c.values()) + 0.5 * (len(c) + 1))
    model = o.train(docs.where(~learn.held_out("doc_id", 1)).select("doc_id", "text"), None, (0.3, 1.0))
    first = {x: (own.encode(x, add_special_tokens=False).ids or [1])[0] if x is not None else o.END for x in {x for v in w.values() for x in v}}
    cls = {x: int(model.table.cls[first[x]]) for x in first}
    mass = np.full(o.CLASSES, 0.5)
    for x, k in c.items():
        mass[cls[x]] += k + 0.5
    p = {k: v.astype(float) for k, v in model.params.items()}

    def told(seq, t):
        begin = t // o.STRIDE * o.STRIDE - o.CONTEXT
        places = range(max(0, begin), t + 1)
        x = np.array([p["emb"][model.table.input[first[seq[q - 1]]] if q else o.START] + p["pos"][q - begin] for q in places])
        a = np.exp((x[-1] @ p["q"]) @ (x @ p["k"]).T / o.WIDTH**0.5)
        z = (x[-1] + (a / a.sum()) @ (x @ p["v"]) @ p["o"]) @ p["out"] + p["bias"]
        z -= z.max()
        return float(z[cls[seq[t]]] - np.log(np.exp(z).sum())) / np.log(10)

    got = {r.doc_id: r for r in o.score(docs, model=model).collect()}
    assert len(got) == len(ROWS)
    for i in w:
        r, base = got[i], sum(log10(c[x] + 0.5) - floor for x in w[i])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w[i]), sum(c[x] > 0 for x in w[i]), n)
        assert abs(r.base_score - base) < 1e-6 * len(w[i])
        if len(w[i]) < 300:
            want = sum(told(w[i], t) + log10(c[x] + 0.5) - log10(mass[cls[x]]) for t, x in enumerate(w[i]))
            assert abs(r.score - want) < 2e-4 * len(w[i])


def test_op4_beats_its_base(spark):
    """Texts of two languages: context tells which, counts don't."""
    r = random.Random(9)
    tongues = [["".join(r.choice(a) for _ in range(r.randint(2, 5))) for _ in range(60)] for a in ("abcde", "vwxyz")]
    rows = [(i, " ".join(r.choice(tongues[i % 2]) for _ in range(60))) for i in range(900)]
    got = op4_lm_score.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (got[0] - got[1]) / got[2] > 0.15


def test_op4_learns_from_every_id(spark):
    # ids of one long text stand next to each other more often than any sample of it shows
    lines = [(2, " ".join(["red blue"] * 900)), (5, " ".join(["green"] * 700))]
    df = spark.createDataFrame(lines, "doc_id long, text string")
    found = op4_lm_score._gather(df, None).cache()
    rows = found.where("kind = 2").collect()
    ids = [np.frombuffer(bytes(r.ids), "<u2").astype(int) for r in rows]
    assert sorted(len(x) for x in ids) == [701, 1801] and all(0 <= r.key < 1_000_000 for r in rows)
    seen = np.bincount(np.concatenate(ids), minlength=op4_lm_score.VOCABULARY)
    near = op4_lm_score._near(found, op4_lm_score.ranks(seen))
    rank, want = op4_lm_score.ranks(seen), np.zeros_like(near)
    for x in ids:
        for k in range(1, op4_lm_score.NEAR + 1):
            for a, b in ((x[:-k], x[k:]), (x[k:], x[:-k])):
                ok = rank[b] < op4_lm_score.OWN
                np.add.at(want, (a[ok], rank[b[ok]]), 1)
    assert (near == want).all() and near.sum() > 0


def test_op10_cuts_all_blocks_from_the_same_text(spark, monkeypatch):
    w = [f"w{k}" for k in range(30)]
    # the windows of both items overlap; cutting the first would leave words 14 to 19 and make "w3 w20" neighbours
    items = [(1, " ".join(w[4:14])), (2, " ".join(w[8:20])), (3, "w3 w20")]
    df = spark.createDataFrame([(1, " ".join(w)), (2, "w3 x"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    cut = lambda: {r.doc_id: r.text for r in op10_decontaminate.clean(df, bench).collect()}
    want = {1: " ".join(w[:4]) + "  " + " ".join(w[20:]), 2: "w3 x", 3: None}
    tidy = lambda d: {k: t and t.split() for k, t in d.items()}
    assert tidy(cut()) == tidy(want)
    monkeypatch.setattr(op10_decontaminate, "ITEM_BLOCK_BYTES", 40)
    assert len(list(op10_decontaminate._blocks(bench, "item_id", "text"))) > 1 and tidy(cut()) == tidy(want)


def test_op9_keeps_one_of_repeated_rows(spark):
    r = random.Random(3)
    a, b = prose(90, r), prose(90, r)
    rows = [(1, a, "x"), (1, a, "x"), (2, a, "x"), (3, b, "x"), (3, b, "y"), (None, b, "x"), (None, b, "x"), (4, None, "x"), (4, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = [(x.doc_id, x.text) for x in op9_ngram_join.representatives(df).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (3, b), (4, None), (None, b), (None, b)], key=str)


def test_op1_deep_folders(spark):
    at = "timestamp'2024-05-01 00:00:00'"
    deep = "h.org/" + "".join(f"f{k}/" for k in range(12))
    captures = spark.sql(f"select 1 as page_id, 'http://{deep}x.html' as url, {at} as fetched_at union all select 2, 'http://h.org/f0/x.html', {at}")
    entries = spark.sql(f"select 'l' as list, '{deep}' as pattern, 'add' as action, timestamp'2024-01-01 00:00:00' as at")
    assert [r.page_id for r in op1_url_filters.kept(captures, entries).collect()] == [2]


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    runs = [op2_packing.pack(empty), op3_toxicity.report(empty, lab), op4_lm_score.score(empty), op5_quality_rules.report(empty), op6_token_files.report(empty), op7_substrings.report(empty), op8_quality.report(empty, lab), op9_ngram_join.groups(empty), op10_decontaminate.report(empty, bench), op1_url_filters.report(spark.createDataFrame([], "page_id long, url string, html string"))]
    assert all(r.count() == 0 for r in runs)


def _tables(spark, folder, docs, labels, bench, extra=""):
    spark.createDataFrame(docs, "doc_id long, text string" + extra).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as C

    _tables(spark, tmp_path, [], [], [])
    assert C.run(spark, str(tmp_path)).count() == 0


def test_pipeline_of_repeated_rows_and_clashing_columns(spark, tmp_path):
    """Without labels and test items: repeated rows and copies go but for one, other columns stay."""
    import corpus_pipeline as C

    r = random.Random(17)
    one, two = prose(70, r), prose(70, r)
    rows = [(1, one, 11, 21), (1, one, 11, 21), (2, one, 12, 22), (3, two, 13, 23), (None, two, 14, 24), (4, None, 15, 25), (4, "", 16, 26)]
    _tables(spark, tmp_path, rows, [], [], ", node long, row_key long")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in C.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path)).cache()
    got = sorted(map(tuple, docs.collect()), key=str)
    assert [x for x in got if x[0] in (1, 2, 3)] == [(1, one, 11, 21), (3, two, 13, 23)]
    assert (None, two, 14, 24) in got and sum(x[0] == 4 for x in got) == 1
    assert C.run(spark, str(tmp_path)).count() == len(got)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as C

    r = random.Random(3)
    bench = prose(20, r)
    texts = [prose(80, r) for _ in range(40)]
    texts += [texts[0], texts[1] + " tail", f"{prose(60, r)} {bench} {prose(10, r)}", None] + [re.sub(" ", "### ", prose(60, r)) for _ in range(20)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int("###" not in (t or "")), 0) for i, t in enumerate(texts) if t], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in C.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        docs = out.cache()
    kept = {x.doc_id: x.text for x in docs.collect()}
    assert 40 not in kept and 41 not in kept and not any("###" in (t or "") for t in kept.values())
    assert bench not in kept[42] and all(kept[i] == texts[i] for i in range(40) if i in kept)
    packed = C.run(spark, str(tmp_path))
    assert {x.doc_id for x in packed.collect()} == set(kept)


def test_waiting_workers_hold_no_encoder(spark):
    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    op2_packing.T.forget()
    batch = pa.record_batch({"doc_id": pa.array([1], pa.int64()), "text": ["one word"]})
    assert [b.num_rows for b in op2_packing.pieces(Docs())(iter([batch]))] == [1]
    assert op2_packing.T.encoder.cache_info().currsize == 0


def test_no_workers_of_a_second_kind(spark, monkeypatch):
    """A frame from a Python list goes through a Python RDD, for which executors start a daemon and workers besides those of Arrow."""
    rows = [(i, f"text {i}\n" * (1 + i % 3), i % 2) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = docs.drop("text")

    def refused(*a, **b):
        raise AssertionError("a Python RDD")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    assert op8_quality.train(docs, labels) is not None
    assert op8_quality.train(docs, labels.where("false")) is None
    alone = docs.where("doc_id < 3")
    assert sorted((r["doc_id"], r["component_id"]) for r in op9_ngram_join.groups(alone).collect()) == [(0, 0), (1, 1), (2, 2)]
