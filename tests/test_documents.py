import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import books as B
from quillspark.operators import pages as P
from quillspark.operators import paragraphs as G
from quillspark.sources import epub, xhtml
from quillspark.sources import recognised as C
from quillspark.streaming import jobs as J


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s")).alias("r")).first().r


@pytest.mark.parametrize(("text", "low", "high"), [("The quick brown fox jumped over it.", 0, 0.1), ("w4s 1t thr bcdfg qwrtp xzcvb", 0.4, 1), ("", 0, 0)])
def test_garble(spark, text, low, high):
    assert low <= one(spark, T.garble_score, text) <= high


def test_cache_keys_and_misses(spark):
    png = bytes.fromhex("89504e470d0a1a0a010203")
    pages = spark.createDataFrame([(1, png), (2, b"other")], "page int, png binary")
    keyed = pages.withColumn("key", C.cache_key("engine", F.col("png"), ["en"]))
    assert keyed.where("page = 1").first().key == hashlib.sha256(b"engine\0" + png + b"\0en").hexdigest()
    assert [r.page for r in C.misses(keyed, keyed.where("page = 1").select("key")).collect()] == [2]
    assert C.misses(keyed, keyed, fresh=True).count() == 2


def test_recognise_runs_a_plugged_engine(spark):
    pages = spark.createDataFrame([("b", 1, b"p1"), ("b", 2, None)], "book_id string, page int, png binary")

    def engine(png, languages):
        if png is None:
            raise ValueError("no image")
        return [{"text": png.decode() + languages[0], "label": "text", "x": 0.1, "y": 0.1, "w": 0.5, "h": 0.1}]

    rows = C.recognise(pages, lambda: engine, ["en"]).orderBy("page").collect()
    assert [(r.page, r.pos, r.text, r.error) for r in rows] == [(1, 0, "p1en", None), (2, None, None, "no image")]


def test_utf16_length(spark):
    assert one(spark, T.utf16_length, "a😀b") == 4


def test_printed_pages_and_furniture(spark):
    lines = [("b", p, n, t, 41.0, y, 100.0, 10.0, 10.0) for p in range(1, 5) for n, (t, y) in enumerate([("Running Head", 10.0), (f"body {'x' * p}", 200.0), (str(p + 8), 470.0)])]
    df = spark.createDataFrame(lines, "book_id string, page int, line_no int, text string, x double, y double, w double, h double, size double")
    pages = spark.createDataFrame([("b", p, 484.0) for p in range(1, 5)], "book_id string, page int, height double")
    marked = P.furniture(df, pages)
    assert {r.page: r.printed for r in P.printed_pages(marked).collect()} == {1: 9, 2: 10, 3: 11, 4: 12}
    assert P.body_lines(marked).count() == 4
    assert P.furniture(df.where("page < 3"), pages.where("page < 3")).where("role is not null").count() == 0


def test_break_offset(spark):
    rows = spark.createDataFrame([(["x" * 29, "tail"],)], "t array<string>")
    j = rows.select(G.join_lines(F.transform("t", lambda t, i: F.struct(t.alias("text"), (i + 30).cast("int").alias("page"), F.lit(False).alias("keeps")))).alias("j")).first().j
    assert [(p.page, p.at) for p in j.pages] == [(30, None), (31, 30)]


def test_drop_cap(spark):
    paras = spark.createDataFrame([("b", 1, "paragraph", "A", 31, 1, None), ("b", 2, "paragraph", "lice was", 10, 1, None)], "book_id string, para long, kind string, text string, size long, page int, pages array<struct<page:int,at:int>>")
    size = spark.createDataFrame([("b", 10)], "book_id string, body_size long")
    assert [r.text for r in G.drop_caps(paras, size).collect()] == ["Alice was"]


def test_unique_ids_avoid_all_used(spark):
    rows = spark.createDataFrame([("b", i, "heading", t) for i, t in enumerate(["x", "x-2", "x", "x"])], "book_id string, pos long, type string, text string")
    assert [r.id for r in B.unique_ids(rows).orderBy("pos").collect()] == ["x", "x-2", "x-3", "x-4"]


def test_estimate(spark):
    reports = spark.createDataFrame([("b", 1, "native"), ("b", 2, "scanned"), ("b", 3, "no-text"), ("b", 4, "scanned")], "book_id string, page int, verdict string")
    assert P.cost(reports, reports, 5000.0).first().total_ms == 12120
    assert P.cost(reports, reports, 5000.0, every=True).first().total_ms == 17000
    assert P.cost(reports, reports, None).first().total_ms is None


BOOK = {"title": "T & t", "language": "en", "author": "A", "content": [
    {"type": "heading", "level": 1, "text": "One *x*", "id": "one", "page": 1}, {"type": "text", "text": r"see [it](#one) and $a_b$ \* done", "page": 1},
    {"type": "quote", "text": "said", "page": 2}, {"type": "list", "ordered": True, "items": [[{"type": "text", "text": "i"}]], "page": 2},
    {"type": "table", "rows": [["a", "b"], ["c", ""]], "page": 2}, {"type": "image", "file": "assets/p.png", "page": 3},
], "footnotes": {"n1": {"label": "1", "blocks": [{"type": "text", "text": "note"}]}}}


def test_epub_round_trip():
    data = epub.write(BOOK, {"assets/p.png": b"png"})
    assert data == epub.write(BOOK, {"assets/p.png": b"png"}) and data[30:38] == b"mimetype"
    book, assets, warnings = epub.read(data)
    assert assets == {"assets/p.png": b"png"} and not warnings
    for got, want in zip(book["content"], BOOK["content"], strict=True):
        assert got == want
    assert book["footnotes"] == BOOK["footnotes"] and book["title"] == BOOK["title"] and book["author"] == "A"
    with pytest.raises(ValueError, match="missing assets"):
        epub.write(BOOK, {})


def test_known_compounds_keep_their_hyphen(spark):
    lines = spark.createDataFrame([("b", 1, 1, 0, "a red-"), ("b", 1, 1, 1, "hot *con-*"), ("b", 1, 1, 2, "*sider*")], "book_id string, para int, page int, line_no int, t string")
    known = spark.createDataFrame([("b", "red-hot")], "book_id string, compound string")
    rows = G.kept_hyphens(lines, known).groupBy("para").agg(F.array_sort(F.collect_list(F.struct("line_no", F.col("t").alias("text"), "page", "keeps"))).alias("r"))
    assert rows.select(G.join_lines(F.col("r"))["text"]).first()[0] == "a red-hot *consider*"


def test_dominant_size_of_runs(spark):
    rows = spark.createDataFrame([([("ab", 12.0), ("abc", 9.6), ("c", 10.2)],)], "runs array<struct<text:string,size:double>>")
    assert rows.select(P.dominant_size(F.col("runs"))).first()[0] == 10


def test_group_lines_keeps_style(spark):
    spans = spark.createDataFrame([("b", 1, 10.0, 50.0, 20.0, 10.0, 10.0, "two", True, False), ("b", 1, 12.0, 5.0, 20.0, 10.0, 10.0, "one ", False, False)], "book_id string, page int, y double, x double, w double, h double, size double, text string, italic boolean, bold boolean")
    line = P.group_lines(spans).select("text", "size", G.line_dialect(F.col("runs")).alias("d")).first()
    assert tuple(line) == ("one two", 10.0, "one *two*")


def test_spanning_blocks_have_a_first_page(spark):
    rows = spark.createDataFrame([("b", 0, 7, None), ("b", 1, None, [(5, None), (6, 9)]), ("b", 2, None, None)], "book_id string, arrival int, page int, pages array<struct<page:int,at:int>>")
    done = B.ordered(rows)
    assert [r.arrival for r in done.orderBy("pos").collect()] == [2, 1, 0]
    images = spark.createDataFrame([("b", 1, 5), ("b", 2, 4)], "book_id string, image_id int, page int")
    assert {r.image_id: r.after for r in B.place_images(images, done).collect()} == {1: 1, 2: -1}


def test_breaks_and_annotations_in_texts():
    out = epub.block_html({"type": "text", "text": r"ab\*c *de* f"}, {}, [(3, 8), (8, 9), (20, 10)])
    mark = lambda p: f'<span epub:type="pagebreak" id="page-{p}" role="doc-pagebreak" aria-label="{p}"/>'
    assert out == f"<p>ab{mark(8)}*c <em>d{mark(9)}e</em> f{mark(10)}</p>"
    out = epub.block_html({"type": "text", "text": "say *oui* now", "annotations": [{"start": 4, "end": 9, "language": "fr"}]})
    assert out == '<p>say <span xml:lang="fr" lang="fr"><em>oui</em></span> now</p>'
    with pytest.raises(ValueError):
        epub.block_html({"type": "text", "text": "say *oui* now", "annotations": [{"start": 5, "end": 9}]})


def test_books_of_other_makers(spark):
    import io
    import zipfile

    page = lambda body: f'<html xmlns:epub="http://www.idpf.org/2007/ops"><body>{body}</body></html>'
    files = {
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>',
        "O/c.opf": '<package><metadata><title>T</title></metadata><manifest><item id="a" href="a.xhtml"/><item id="b" href="t/b.xhtml"/><item id="c" href="c.png" properties="cover-image"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>',
        "O/a.xhtml": page('<div><p id="Fig_1">one <span epub:type="pagebreak" aria-label="7"/>two</p><p id="fig-1">see <a href="t/b.xhtml#Fig_1">there</a> <a href="#gone">lost</a></p></div>'),
        "O/t/b.xhtml": page('<blockquote id="Fig_1">said<footer>who</footer></blockquote><table><caption>cap</caption><tr><td>x</td></tr></table>'),
        "O/c.png": "png",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    book, assets, warnings = epub.read(out.getvalue())
    got = [(b["type"], b.get("id"), b.get("page")) for b in book["content"]]
    assert got == [("text", "fig-1", None), ("text", "fig-1-2", 7), ("quote", "fig-1-3", 7), ("table", None, 7)]
    assert book["content"][1]["text"] == "see [there](#fig-1-3) lost" and book["content"][2]["attribution"] == "who" and book["content"][3]["caption"] == "cap"
    assert assets == {"c.png": b"png"} and book["cover"] == "c.png" and any("gone" in w for w in warnings)


def test_books_are_written_with_assets_and_errors(spark, tmp_path):
    import json

    from quillspark.sources import folders

    good = json.dumps(BOOK)
    books = spark.createDataFrame([(1, good), (2, good), (3, "{")], "book_id long, json string")
    assets = spark.createDataFrame([(1, "assets/p.png", bytearray(b"png"))], "book_id long, path string, content binary")
    got = {r.book_id: r for r in epub.write_books(books, assets).collect()}
    assert got[1].epub and got[1].error is None and got[2].epub is None and "missing assets" in got[2].error and got[3].error
    assert "missing assets" in epub.write_books(books.where("book_id = 1")).first().error
    root = tmp_path.as_uri() + "/books"
    done = {r.book_id: r for r in folders.write(books.where("book_id < 3"), assets, root).collect()}
    assert done[1].n_assets == 1 and done[1].bytes == len(good.encode()) + 3 and done[2].error is not None and done[1].error is None
    back, files = folders.read(spark, root)
    assert [(r.book_id, json.loads(r.json)) for r in back.collect()] == [(1, BOOK)]
    assert [(r.book_id, r.path, bytes(r.content)) for r in files.collect()] == [(1, "assets/p.png", b"png")]


def test_recognition_by_a_process_and_by_micro_batches(spark, tmp_path):
    import sys

    from quillspark.sources import recognised

    script = "import sys, json\nfor line in sys.stdin:\n    r = json.loads(line)\n    print(json.dumps({'id': r['id'], 'regions': [{'text': 'n' + str(len(r['png'])), 'label': 'text'}]} if r['png'] != 'YmFk' else {'id': r['id'], 'error': 'unreadable'}), flush=True)"
    make = recognised.process_engine([sys.executable, "-c", script])
    rows = spark.createDataFrame([("b", 1, bytearray(b"abc")), ("b", 2, bytearray(b"bad"))], "book_id string, page int, png binary")
    got = {r.page: (r.text, r.error) for r in recognised.recognise(rows, make, ["en"]).collect()}
    assert got == {1: ("n4", None), 2: (None, "unreadable")}
    source, cache = str(tmp_path / "in"), str(tmp_path / "cache")
    rows.write.parquet(source)
    for _ in range(2):  # the second run finds all that can be found in the cache
        stream = spark.readStream.schema(rows.schema).parquet(source)
        recognised.recognise_stream(stream, make, ["en"], "e1", cache, str(tmp_path / "c1")).awaitTermination()
    assert [(r.page, r.text) for r in spark.read.parquet(cache).where("error is null").collect()] == [(1, "n4")]


def test_shapes_of_books():
    from quillspark.functions.contract import issues, walk

    assert issues(BOOK) == []
    text = lambda **more: {"type": "text", "text": "t"} | more
    book = lambda *blocks, **more: {"title": "T", "language": "en", "content": list(blocks)} | more
    wrong = [
        (book(text(id="Bad Id")), "content/0/id"), (book(text(page=0)), "content/0/page"), (book(text(page=True)), "content/0/page"), (book(text(page=1, pages=[{"page": 1}, {"page": 2, "at": 3}])), "content/0/pages"),
        (book(text(pages=[{"page": 1, "at": 2}, {"page": 2, "at": 3}])), "content/0/pages/0/at"), (book(text(pages=[{"page": 1}])), "content/0/pages"), (book({"type": "poem"}), "content/0/type"), (book({"type": "heading", "level": 7, "text": ""}), "content/0/level"),
        (book({"type": "list", "ordered": False, "items": [[text(extra=1)]]}), "content/0/items/0/0/extra"), (book({"type": "table", "rows": [["a", 1]]}), "content/0/rows/0/1"), (book({"type": "formula", "tex": None}), "content/0/display"),
        (book(title=""), "title"), (book(language="e"), "language"), ([], ""), (book(footnotes={"n": {"label": "", "blocks": []}}), "footnotes/n/label"), (book(text(text="*open")), "content/0/text"), (book({"type": "table", "rows": [["[^n]"]]}), "content/0/rows/0/0"),
        (book(text(id="a"), footnotes={"a": {"label": "1", "blocks": [text()]}}), "footnotes/a"),
    ]
    for value, path in wrong:
        assert path in ["/".join(map(str, p)) for p, _ in issues(value)], (value, issues(value))
    assert ["/".join(map(str, p)) for p, _ in walk(book({"type": "list", "ordered": True, "items": [[text()], [text()]]}))] == ["content/0", "content/0/items/0/0", "content/0/items/1/0"]


def test_command_line(spark, tmp_path, capsys):
    import json

    from quillspark import __main__ as cli
    from quillspark.sources import folders

    books = spark.createDataFrame([(1, json.dumps(BOOK)), (2, json.dumps(BOOK | {"title": ""}))], "book_id long, json string")
    assets = spark.createDataFrame([(k, "assets/p.png", bytearray(b"png")) for k in (1, 2)], "book_id long, path string, content binary")
    root = (tmp_path / "books").as_uri()
    folders.write(books, assets, root).collect()
    assert cli.main(["validate", root]) == 1 and "2: title" in capsys.readouterr().err
    assert cli.main(["pack", root, (tmp_path / "out").as_uri()]) == 0
    assert cli.main(["unpack", (tmp_path / "out").as_uri(), (tmp_path / "again").as_uri()]) == 0
    assert sorted(p.name for p in (tmp_path / "again").iterdir()) == ["1", "2"] and (tmp_path / "again/1/assets/p.png").read_bytes() == b"png"
    assert {r.folder: r.n_files for r in folders.sizes(spark, root).collect()} == {"1": 2, "2": 2}
    assert cli.main(["pack"]) == 2


def test_dim_roles_and_selections(spark):
    rows = spark.createDataFrame([("footnote-source",), ("artifact",), ("caption",), (None,)], "role string")
    assert [r[0] for r in rows.select(B.dim(F.col("role"))).collect()] == [True, True, False, False]


def test_edits_of_blocks(spark):
    schema = "book_id string, pos int, type string, text string, tex string, caption string"
    rows = spark.createDataFrame([("b", 0, "text", "old", None, None), ("b", 1, "image", None, None, "cap"), ("b", 2, "formula", None, "x", None)], schema)
    edits = spark.createDataFrame([("b", 0, "new"), ("b", 1, "  "), ("b", 2, "y")], "book_id string, pos int, edited string")
    assert [tuple(r)[3:] for r in B.write_back(rows, edits).orderBy("pos").collect()] == [("new", None, None), (None, None, None), (None, "y", None)]
    assert [(r.pos, r.type) for r in B.remove(rows, F.col("pos") == 1).orderBy("pos").collect()] == [(0, "text"), (1, "formula")]
    other = spark.createDataFrame([("b", 1, "text", "in place", None, None)], schema)
    assert [r.text for r in B.replace(rows, other).orderBy("pos").collect()] == ["old", "in place", None]


def test_telling_regions_and_image_bytes(spark):
    from quillspark.operators import regions as R
    from quillspark.sources import recognised

    rows = spark.createDataFrame([("a", "text"), (" ", "text"), ("", "Image"), (None, "seal"), (None, None)], "text string, label string")
    assert [r[0] for r in rows.select(R.telling(F.col("text"), F.col("label"))).collect()] == [True, False, True, True, False]
    files = spark.createDataFrame([("p", bytearray(b"good")), ("q", bytearray(b"bad")), ("r", bytearray(b"unread"))], "path string, content binary")
    wanted = spark.createDataFrame([("p", 3), ("p", 1), ("p", 3), ("q", 1)], "path string, page int")

    def make():
        def read(content, pages):
            if content != b"good":
                raise ValueError("damaged")
            return [{"page": p, "y": 1.0, "w": 30.0, "h": 30.0, "png": b"png"} for p in pages]

        return read

    got = recognised.image_bytes(files, wanted, make).orderBy("path", "page").collect()
    assert [(r.path, r.page, r.error) for r in got] == [("p", 1, None), ("p", 3, None), ("q", None, "damaged")] and len({r.hash for r in got[:2]}) == 1


def test_frames_need_no_whole_channel(spark):
    chunks = spark.createDataFrame([("c", 1, "ab"), ("c", 2, "c\n\nd\ne"), ("c", 3, "f\n"), ("c", 4, "left"), ("d", 1, "x")], "channel string, seq int, data string")
    assert sorted((r.channel, r.line_no, r.line) for r in J.frames(chunks).collect()) == [("c", 0, "abc"), ("c", 2, "d"), ("c", 3, "ef")]


def test_loose_html():
    got = list(xhtml.blocks("<body><p>a <b>bold<br>x</b> &amp; *<p>next<ul><li>i<li>j</ul><script>var t='</p>'</script><h2 id=A1>T</h2><div id=d><p>in</p></div>"))
    assert [b["type"] for b in got] == ["text", "text", "list", "heading", "text"]
    assert got[0]["text"] == r"a **bold x** & \*" and got[2]["items"] == ["i", "j"] and got[3]["id"] == "a1" and got[4]["id"] == "d"


def test_tables(spark):
    assert one(spark, T.html_table, "<table><tr><td>a<td>b</tr><tr><td>c</table>") == [["a", "b"], ["c", ""]]
    assert one(spark, T.html_table, "<table><tr><td colspan='2'>a</td></tr></table>") is None
    assert one(spark, T.prose, r"$5 and $ \tau $ or $x") == r"\$5 and $\tau$ or \$x"


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "book_id string, page int, verdict string, chars int")
    assert P.verdict_counts(empty).count() == 0 and P.suggested_page(empty).count() == 0 and P.page_runs(empty).count() == 0


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "stage", 10), (1, 2, "done", 20), (2, 3, "error", 15)], "job int, event_id int, type string, s int").select("job", "event_id", "type", F.timestamp_seconds("s").alias("ts"))
    rows.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))
    q = J.latest(stream).writeStream.outputMode("update").format("memory").queryName("last_events").start()
    q.processAllAvailable()
    q.stop()
    assert {r.job: r.type for r in spark.table("last_events").collect()} == {1: "done", 2: "error"}


def test_queries_match_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from quillspark import registry

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for name in ("documents", "lineitem", "part", "conversations", "orders", "pages", "events", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    sql = registry.oracle_sql()
    for name in ("verdict_counts", "furniture", "paragraph_bounds", "heading_merge", "caption_bind", "region_blocks", "prose", "page_spec_strict"):
        df = registry.queries()[name](spark, sf)
        r = con.execute(sql[name])
        names = [d[0] for d in r.description]
        assert sorted(map(str, (tuple(x[c] for c in names) for x in df.collect()))) == sorted(map(str, r.fetchall())), name


def test_blocks_and_frames_hold_whole_texts(spark):
    from quillspark import registry
    from quillspark.plans import synthetic

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")).collect()
    got = {(r.book_id, r.pos): r.text for r in synthetic.blocks(spark, sf).collect()}
    assert got == {(r.conv_id, r.turn): r.text for r in rows} and max(map(len, got.values())) > 30
    sent = {}
    for r in sorted(rows, key=lambda r: r.turn):
        sent[r.conv_id] = sent.get(r.conv_id, "") + r.text + ("\n" if r.turn % 2 else "")
    want = sorted((c, line) for c, t in sent.items() for line in t.split("\n")[:-1] if line)
    assert sorted((r.channel, r.line) for r in registry.queries()["frame_reassembly"](spark, sf).collect()) == want


def test_scan_spans_returns_every_page(spark):
    from quillspark import registry

    sf = "/root/testdata/sf0.001"
    pages = [r[0] for r in spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").cast("int")).collect()]
    assert sorted(r.page for r in registry.queries()["scan_spans"](spark, sf).collect()) == sorted(pages)


def test_format_units_rounds_and_keeps_nulls(spark, tmp_path):
    """Prices whose hundredfold falls just below a whole number, and none at all."""
    duckdb = pytest.importorskip("duckdb")
    from quillspark import registry

    prices = [1029.12, 1039.36, 1049.6, 1285.12, 2186.24, 4289.28, 10485.76, 75462.67, 1001.91, 1.005, 0.0, None]
    assert any(x is not None and int(x * 100) != round(x * 100) for x in prices)
    spark.createDataFrame(list(enumerate(prices)), "o_orderkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = [tuple(x) for x in registry.queries()["format_units"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(con.execute(registry.oracle_sql()["format_units"]).fetchall())


def test_caption_bind_places_missing_keys_as_its_sql(spark, tmp_path):
    """Several rows of one place, some without part, supplier or position, in an order that only sorting settles."""
    duckdb = pytest.importorskip("duckdb")
    from quillspark import registry

    draw = random.Random(3)
    some = lambda n: draw.choice([None, *range(n)])
    rows = [(draw.randrange(40), some(7), some(8), some(8)) for _ in range(900)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute("SET threads=1")  # on more, DISTINCT ON takes any row of a place
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = [tuple(x) for x in registry.queries()["caption_bind"](spark, str(tmp_path)).collect()]
    want = con.execute(registry.oracle_sql()["caption_bind"]).fetchall()
    assert sorted(map(str, got)) == sorted(map(str, want)) and any(r[3] for r in want)
