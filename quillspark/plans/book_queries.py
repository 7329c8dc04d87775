"""Queries of paragraphs, regions, blocks and books."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import contract as C
from ..functions import inline as I
from ..functions import text as T
from ..operators import books as B
from ..operators import pages as P
from ..operators import paragraphs as G
from ..operators import regions as R
from ..session import keep
from . import synthetic as S
from . import text_queries as Q
from .catalog import query, table

_BLOCKS = f"WITH {S.BLOCKS_SQL}"


def _kept_marked(spark, sf_dir):
    """Marked lines as a table: several steps read them."""
    return keep(Q._marked(spark, sf_dir).select("book_id", "page", "line_no", "text", "x", "y", "w", "h", "size", "runs", "height", "role"))


def _bounded(marked):
    body = P.body_lines(marked)
    return G.bounds(body, P.body_metrics(body))


_BOUNDS = f"""{Q._METRICS}, br AS (SELECT bd.*, mt.*, lp.height, x >= body_left + 20 AND w < modal_width * 0.5 AND NOT regexp_matches(flat, '\\p{{L}}') AS sep, floor(size + 0.5) AS dom FROM bd JOIN mt USING (book_id) JOIN lp USING (book_id, page)),
bn AS (SELECT *, coalesce(lag(page) OVER k IS NULL OR sep OR lag(sep) OVER k OR x >= body_left + 4 OR (lag(page) OVER k = page AND y - lag(y) OVER k > modal_gap * 1.7) OR dom <> lag(dom) OVER k OR (lag(page) OVER k <> page AND lag(y) OVER k + lag(h) OVER k < lag(height) OVER k * 0.7) OR lag(w) OVER k < modal_width * 0.6, true) AS is_new FROM br WINDOW k AS (PARTITION BY book_id ORDER BY page, line_no)),
pn AS (SELECT *, sum(CAST(is_new AS INT)) OVER (PARTITION BY book_id ORDER BY page, line_no) AS para FROM bn)""".replace("\\\\p", "\\p")


@query("paragraph_bounds", f"{_BOUNDS} SELECT book_id, page, line_no, is_new, CAST(para AS BIGINT) AS para FROM pn")
def paragraph_bounds(spark, sf_dir):
    return _bounded(_kept_marked(spark, sf_dir)).select("book_id", "page", "line_no", "is_new", "para")


def _paragraphs(marked):
    return G.unwrap(_bounded(marked), P.printed_pages(marked), P.compound_evidence(marked))


# Line texts in the dialect, and how a fold would join them, for one-style lines (columns e: escaped text, italic).
_ESCAPED = f"regexp_replace(regexp_replace(regexp_replace(text, '[{T.BLANK}]+', ' ', 'g'), '([\\*$\\[\\]^])', '\\\\\\1', 'g'), '^ | $', '', 'g')"
_EVIDENCE = rf"ev AS (SELECT DISTINCT book_id, lower(m) AS compound FROM (SELECT book_id, unnest(regexp_extract_all(regexp_replace(t, '\p{{L}}+-\p{{L}}+$', ''), '\p{{L}}+-\p{{L}}+')) AS m FROM (SELECT book_id, {Q._LINE} AS t FROM ln)))"


def _folded(source: str, group: str) -> str:
    """SQL: rows of ``source`` joined by ``group``, as a string aggregate over what each line leaves."""
    return rf"""ne AS (SELECT *, lead(e) OVER w AS e2, coalesce(lead(italic) OVER w, false) AS it2, coalesce(lag(italic) OVER w, false) AS it0 FROM {source} WINDOW w AS (PARTITION BY book_id, {group} ORDER BY page, line_no)),
hy AS (SELECT *, e2 IS NOT NULL AND suffix(e, '-') AND (NOT italic OR it2) AS hard, lower(regexp_extract(e, '(\p{{L}}+)-$', 1) || '-' || CASE WHEN it2 AND NOT italic THEN '' ELSE regexp_extract(e2, '^(\p{{L}}+)', 1) END) AS compound FROM ne),
kp AS (SELECT hy.*, hard AND ev.compound IS NOT NULL AS keeps FROM hy LEFT JOIN ev ON hy.book_id = ev.book_id AND hy.compound = ev.compound),
jo AS (SELECT *, CASE WHEN italic AND NOT it0 THEN '*' ELSE '' END || CASE WHEN hard AND NOT keeps THEN left(e, length(e) - 1) ELSE e END || CASE WHEN italic AND NOT it2 THEN '*' ELSE '' END || CASE WHEN e2 IS NULL OR hard THEN '' ELSE ' ' END AS piece FROM kp)"""


_PARAS = (
    rf"""{_BOUNDS}, nu AS (SELECT book_id, page, CAST(arg_min(num, line_no) AS INT) AS printed FROM (SELECT *, regexp_extract(flat, '(?:^|\s)([0-9]{{1,4}})(?:\s|$)', 1) AS num FROM fu WHERE role = 'furniture') WHERE num <> '' GROUP BY ALL),
{_EVIDENCE}, es AS (SELECT pn.*, coalesce(printed, page) AS shown, {_ESCAPED} AS e FROM pn LEFT JOIN nu USING (book_id, page)),
{_folded('es', 'para')},
pa AS (SELECT book_id, para, CASE WHEN bool_or(sep) THEN 'separator' ELSE 'paragraph' END AS kind, string_agg(piece, '' ORDER BY page, line_no) AS text, CAST(arg_min(dom, page * 1000000 + line_no) AS BIGINT) AS size, count(DISTINCT shown) AS n_shown, min(shown) AS shown FROM jo GROUP BY book_id, para)"""
)


@query("unwrap", _PARAS + " SELECT book_id, CAST(para AS BIGINT) AS para, kind, text, size, CASE WHEN n_shown = 1 THEN shown END AS page, CASE WHEN n_shown > 1 THEN n_shown END AS n_pages FROM pa")
def unwrap(spark, sf_dir):
    return _paragraphs(_kept_marked(spark, sf_dir)).select("book_id", "para", "kind", "text", "size", "page", F.when(F.col("pages").isNotNull(), F.size("pages")).cast("long").alias("n_pages"))


@query("dehyphenate", rf"WITH {S.LINES_SQL}, {_EVIDENCE}, es AS (SELECT * EXCLUDE (italic), false AS italic, {_ESCAPED} AS e FROM ln), {_folded('es', 'page')} SELECT book_id, page, string_agg(piece, '' ORDER BY line_no) AS text FROM jo GROUP BY ALL")
def dehyphenate(spark, sf_dir):
    """Every page's lines as one plain paragraph."""
    lines = S.lines(spark, sf_dir)
    plain = lines.select("book_id", F.col("page").alias("para"), "page", "line_no", T.strip(T.escape_dialect(F.regexp_replace("text", f"[{T.BLANK}]+", " "))).alias("t"))
    told = G.kept_hyphens(plain, P.compound_evidence(lines))
    rows = told.groupBy("book_id", "page").agg(F.array_sort(F.collect_list(F.struct("line_no", F.col("t").alias("text"), "page", "keeps"))).alias("rows"))
    return rows.select("book_id", "page", G.join_lines(F.col("rows"))["text"].alias("text"))


_THIRDS = "SELECT book_id, page, line_no, " + ", ".join(f"regexp_replace(x{k}, '[{T.BLANK}]+', ' ', 'g') AS x{k}" for k in (1, 2, 3)) + " FROM (SELECT book_id, page, line_no, left(text, length(text) // 3) AS x1, substring(text, length(text) // 3 + 1, length(text) // 3) AS x2, substring(text, 2 * (length(text) // 3) + 1) AS x3 FROM ln)"
_ESC = lambda x: rf"regexp_replace({x}, '([\*$\[\]^])', '\\\1', 'g')"


def _styled(x: str, m: str) -> str:
    core = f"trim({x}, ' ')"
    return f"CASE WHEN {core} = '' THEN {x} ELSE regexp_extract({x}, '^( *)', 1) || '{m}' || {_ESC(core)} || '{m}' || regexp_extract({x}, '( *)$', 1) END"


@query("line_dialect", f"WITH {S.LINES_SQL}, th AS ({_THIRDS}) SELECT book_id, page, line_no, trim({_ESC('x1')} || CASE line_no % 3 WHEN 0 THEN {_styled('x2', '*')} || {_styled('x3', '***')} WHEN 1 THEN {_styled('(x2 || x3)', '**')} ELSE {_styled('x2', '***')} || {_ESC('x3')} END, ' ') AS text FROM th")
def line_dialect(spark, sf_dir):
    """Every line as three runs: the second and third styled by line number, alike in a third of the lines."""
    n, k = F.char_length("text"), F.col("line_no") % 3
    third = F.floor(n / 3).cast("int")
    parts = (F.substring("text", F.lit(1), third), F.substring("text", third + 1, third), F.substring("text", 2 * third + 1, n))
    styles = ((F.lit(False), F.lit(False)), (k != 1, k != 0), (k == 0, k != 2))
    runs = F.array(*(F.struct(t.alias("text"), i.alias("italic"), b.alias("bold")) for t, (i, b) in zip(parts, styles, strict=True)))
    return S.lines(spark, sf_dir).select("book_id", "page", "line_no", G.line_dialect(runs).alias("text"))


# Paragraph-like rows with varied sizes, for the outline operators.
_OUT = "l_orderkey % 30 AS book_id, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS para, CASE WHEN l_partkey % 11 = 0 THEN 'separator' ELSE 'paragraph' END AS kind, CASE WHEN l_suppkey % 3 = 0 THEN 'A' WHEN l_suppkey % 5 = 0 THEN 'over-' ELSE 'words here' END AS text, CAST(CASE WHEN l_suppkey % 3 = 0 THEN 30 ELSE 10 + l_suppkey % 7 END AS BIGINT) AS size, CAST(l_orderkey AS INT) AS page, CAST(10 AS BIGINT) AS body_size"
_OUT_SQL = f"WITH oa AS (SELECT *, row_number() OVER (PARTITION BY para ORDER BY text, size, kind) AS dup FROM (SELECT {_OUT} FROM lineitem)), ot AS (SELECT * EXCLUDE (dup) FROM oa WHERE dup = 1)"


def _outline(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr(*S._split(_OUT))
    first = rows.withColumn("dup", F.row_number().over(Window.partitionBy("para").orderBy("text", "size", "kind"))).where("dup = 1").drop("dup")
    return first.withColumn("pages", F.lit(None).cast("array<struct<page:int,at:int>>"))


_CAPS = f"""{_OUT_SQL}, c1 AS (SELECT *, coalesce(length(text) <= 2 AND size >= 20 AND lead(kind) OVER w = 'paragraph', false) AS cand, row_number() OVER w AS n FROM ot WINDOW w AS (PARTITION BY book_id ORDER BY para)),
c2 AS (SELECT *, n - sum(CAST(cand AS INT)) OVER (PARTITION BY book_id ORDER BY para) AS island FROM c1),
c3 AS (SELECT *, cand AND row_number() OVER (PARTITION BY book_id, island, cand ORDER BY para) % 2 = 1 AS takes FROM c2),
c4 AS (SELECT *, coalesce(lag(takes) OVER w, false) AS taken, lag(text) OVER w AS before, lag(page) OVER w AS before_page FROM c3 WINDOW w AS (PARTITION BY book_id ORDER BY para)),
dc AS (SELECT book_id, para, kind, CASE WHEN taken THEN before || text ELSE text END AS text, size, CASE WHEN taken THEN before_page ELSE page END AS page FROM c4 WHERE NOT takes)"""


def _capped(spark, sf_dir):
    rows = _outline(spark, sf_dir)
    return G.drop_caps(rows.drop("body_size"), rows.select("book_id", "body_size").distinct())


@query("drop_caps", f"{_CAPS} SELECT * FROM dc")
def drop_caps(spark, sf_dir):
    return _capped(spark, sf_dir).select("book_id", "para", "kind", "text", "size", "page")


_LEVELS = f"{_CAPS}, rk AS (SELECT book_id, size, row_number() OVER (PARTITION BY book_id ORDER BY size DESC) AS r FROM (SELECT DISTINCT book_id, size FROM dc WHERE size >= 12.5)), lv AS (SELECT dc.* EXCLUDE (kind), CASE WHEN kind = 'separator' THEN 'separator' WHEN r IS NOT NULL THEN 'heading' ELSE 'paragraph' END AS kind, CASE WHEN kind <> 'separator' AND r IS NOT NULL THEN CAST(least(r, 6) AS INT) END AS level FROM dc LEFT JOIN rk USING (book_id, size))"


@query("heading_levels", f"{_LEVELS} SELECT book_id, para, kind, level FROM lv")
def heading_levels(spark, sf_dir):
    return G.heading_levels(_capped(spark, sf_dir)).select("book_id", "para", "kind", "level")


@query("heading_merge", f"{_LEVELS}, m1 AS (SELECT *, CASE WHEN kind = 'heading' AND lag(kind) OVER w = 'heading' AND lag(page) OVER w = page THEN 0 ELSE 1 END AS new FROM lv WINDOW w AS (PARTITION BY book_id ORDER BY para)), m2 AS (SELECT *, sum(new) OVER (PARTITION BY book_id ORDER BY para) AS g FROM m1) SELECT book_id, min(para) AS para, any_value(kind) AS kind, min(level) AS level, replace(string_agg(text, ' ' ORDER BY para), '- ', '-') AS text FROM m2 GROUP BY book_id, g")
def heading_merge(spark, sf_dir):
    return G.merge_headings(G.heading_levels(_capped(spark, sf_dir))).select("book_id", "para", "kind", "level", "text")


_SPANS = "l_orderkey % 60 AS book_id, CAST(l_orderkey AS INT) AS page, CAST(l_linenumber AS DOUBLE) * 12 + CAST(l_partkey % 2 AS DOUBLE) / 10 AS y, CAST(l_partkey % 500 AS DOUBLE) AS x, CAST(20 AS DOUBLE) AS w, CAST(10 AS DOUBLE) AS h, CAST(10 AS DOUBLE) AS size, concat('t', CAST(l_partkey AS STRING)) AS text"


@query("group_lines", f"SELECT book_id, page, CAST(row_number() OVER (PARTITION BY book_id, page ORDER BY y) - 1 AS INT) AS line_no, x, y, w, h, text FROM (SELECT book_id, page, k, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(h) AS h, string_agg(text, '' ORDER BY x, text) AS text FROM (SELECT *, floor(y / 12) AS k FROM (SELECT {_SPANS} FROM lineitem)) GROUP BY book_id, page, k)")
def group_lines(spark, sf_dir):
    return P.group_lines(table(spark, sf_dir, "lineitem").selectExpr(*S._split(_SPANS))).drop("size", "runs")


@query("scan_spans", f"SELECT book_id, page, x, y, text FROM (SELECT {_SPANS} FROM lineitem)")
def scan_spans(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(*S._split(_SPANS)).select("book_id", "page", "x", "y", "text")


# Regions


@query("crop_rects", "SELECT l_orderkey, l_linenumber, l, t, w, h FROM (SELECT l_orderkey, l_linenumber, CAST(greatest(0, floor(x * 600 + 0.5)) AS INT) AS l, CAST(greatest(0, floor(y * 800 + 0.5)) AS INT) AS t, CAST(least(600, floor((x + 0.4) * 600 + 0.5)) - greatest(0, floor(x * 600 + 0.5)) AS INT) AS w, CAST(least(800, floor((y + hh) * 800 + 0.5)) - greatest(0, floor(y * 800 + 0.5)) AS INT) AS h FROM (SELECT l_orderkey, l_linenumber, (l_partkey % 100) / 100.0::DOUBLE AS x, (l_suppkey % 97) / 97.0::DOUBLE AS y, (l_partkey % 5) / 1000.0::DOUBLE AS hh FROM lineitem)) WHERE w >= 2 AND h >= 2")
def crop_rects(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_partkey") % 100) / 100.0).alias("x"), ((F.col("l_suppkey") % 97) / 97.0).alias("y"), ((F.col("l_partkey") % 5) / 1000.0).alias("hh"))
    rect = R.crop_rect(F.col("x"), F.col("y"), F.lit(0.4), F.col("hh"), F.lit(600), F.lit(800))
    return rows.withColumn("r", rect).where("r is not null").select("l_orderkey", "l_linenumber", F.col("r.left").alias("l"), F.col("r.top").alias("t"), F.col("r.width").alias("w"), F.col("r.height").alias("h"))


@query("region_normalise", "SELECT l_orderkey, l_linenumber, least(a, c) / 1000.0::DOUBLE AS x, least(b, d) / 2000.0::DOUBLE AS y, (greatest(a, c) - least(a, c)) / 1000.0::DOUBLE AS w, (greatest(b, d) - least(b, d)) / 2000.0::DOUBLE AS h FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 1000 AS DOUBLE) AS a, CAST(l_suppkey AS DOUBLE) AS b, CAST(l_suppkey * 7 % 1000 AS DOUBLE) AS c, CAST(l_partkey % 2000 AS DOUBLE) AS d FROM lineitem)")
def region_normalise(spark, sf_dir):
    points = F.array(*(F.col(c).cast("double") for c in ("a", "b", "c", "b", "c", "d", "a", "d")))
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey % 1000 AS a", "l_suppkey AS b", "l_suppkey * 7 % 1000 AS c", "l_partkey % 2000 AS d")
    return rows.select("l_orderkey", "l_linenumber", R.normalise(points, F.lit(1000.0), F.lit(2000.0)).alias("r")).select("l_orderkey", "l_linenumber", "r.*")


_FIG = "((label_no IN (6) AND text_no = 1) OR (label_no = 8 AND text_no NOT IN (1, 4, 5))) AND h >= 0.02"


@query("figure_regions", f"WITH {S.REGIONS_SQL} SELECT page, pos FROM rg WHERE {_FIG}")
def figure_regions(spark, sf_dir):
    return R.prepared(S.regions(spark, sf_dir)).where(R.is_figure()).select("page", "pos")


_KIND = f"""CASE WHEN label_no IN (3, 4, 5) THEN (CASE WHEN text_no <> 1 THEN 'text' END) WHEN {_FIG} THEN 'image' WHEN text_no = 1 THEN NULL
WHEN label_no = 9 THEN 'formula' WHEN label_no = 8 THEN (CASE WHEN text_no IN (4, 5) THEN 'table' ELSE 'text' END) WHEN label_no = 10 THEN 'list' WHEN label_no IN (1, 2) THEN 'heading'
WHEN label_no = 0 AND text_no = 2 THEN 'heading' ELSE 'text' END"""
_ROLE = f"CASE WHEN type <> 'text' THEN NULL WHEN label_no = 3 THEN 'running-header' WHEN label_no = 4 THEN 'running-footer' WHEN label_no = 5 THEN 'page-number' WHEN label_no = 7 THEN 'caption' WHEN label_no = 8 THEN 'table-source' WHEN label_no = 11 THEN 'footnote-source' END"
_MAPPED = f"WITH {S.REGIONS_SQL}, rb AS (SELECT *, {_KIND} AS type FROM rg), rr AS (SELECT *, {_ROLE} AS role FROM rb WHERE type IS NOT NULL)"


@query("region_blocks", f"{_MAPPED} SELECT page, pos, type, role, CASE WHEN type = 'heading' THEN (CASE WHEN label_no = 1 THEN 1 ELSE 2 END) END AS level FROM rr")
def region_blocks(spark, sf_dir):
    return R.to_blocks(S.regions(spark, sf_dir)).select("page", "pos", "type", "role", "level")


_TOUCH = "coalesce({c}.type = 'text' AND {c}.role = 'caption' AND {f}.type = 'image' AND least({c}.x + {c}.w, {f}.x + {f}.w) - greatest({c}.x, {f}.x) >= {c}.w * 0.5 AND greatest({f}.y - ({c}.y + {c}.h), {c}.y - ({f}.y + {f}.h)) < 0.05, false)"
_CAPROWS = "l_orderkey % 50 AS book_id, l_orderkey AS page, CAST(l_linenumber AS INT) AS pos, CASE WHEN l_partkey % 2 = 0 THEN 'image' ELSE 'text' END AS type, CASE WHEN l_partkey % 2 = 1 AND l_suppkey % 4 <> 0 THEN 'caption' END AS role, concat('c', CAST(l_partkey AS STRING)) AS text, CAST(0.1 AS DOUBLE) AS x, CAST(l_linenumber AS DOUBLE) / 10 AS y, CAST(0.5 AS DOUBLE) AS w, CAST(5 + l_suppkey % 4 AS DOUBLE) / 100 AS h"
_CAP_SQL = f"""WITH c0 AS (SELECT DISTINCT ON (page, pos) * FROM (SELECT {_CAPROWS} FROM lineitem ORDER BY l_partkey, l_suppkey)),
c1 AS (SELECT page, pos, {{'type': type, 'role': role, 'x': x, 'y': y, 'w': w, 'h': h}} AS me, text FROM c0),
c2 AS (SELECT *, lead(me) OVER k AS n1, lag(me) OVER k AS p1, lag(me, 2) OVER k AS p2 FROM c1 WINDOW k AS (PARTITION BY page ORDER BY pos)),
c3 AS (SELECT *, {_TOUCH.format(c='me', f='n1')} AS r, {_TOUCH.format(c='me', f='p1')} AS l0, {_TOUCH.format(c='p2', f='p1')} AS o FROM c2),
c4 AS (SELECT *, NOT r AND l0 AND NOT o AS l FROM c3),
c5 AS (SELECT *, CASE WHEN lag(r) OVER k THEN lag(text) OVER k WHEN lead(l) OVER k THEN lead(text) OVER k END AS caption FROM c4 WINDOW k AS (PARTITION BY page ORDER BY pos))
SELECT page, pos, me.type AS type, caption FROM c5 WHERE NOT r AND NOT l"""


@query("caption_bind", _CAP_SQL)
def caption_bind(spark, sf_dir):
    first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(F.asc_nulls_last("l_partkey"), F.asc_nulls_last("l_suppkey"))
    rows = table(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(first)).where("k = 1").selectExpr(*S._split(_CAPROWS))
    return R.bind_captions(rows).select("page", "pos", "type", "caption")


@query("asset_names", "SELECT l_orderkey, l_linenumber, concat('assets/fig-', CAST(l_linenumber AS VARCHAR), '-', substr(sha1(concat(CAST(l_linenumber AS VARCHAR), '|', printf('%.4f', x), ',', printf('%.4f', y), ',0.5000,0.2500')), 1, 12), '.png') AS file FROM (SELECT l_orderkey, l_linenumber, (l_partkey % 8) / 8.0::DOUBLE AS x, (l_suppkey % 16) / 16.0::DOUBLE AS y FROM lineitem)")
def asset_names(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.crop_name(F.col("l_linenumber"), (F.col("l_partkey") % 8) / 8.0, (F.col("l_suppkey") % 16) / 16.0, F.lit(0.5), F.lit(0.25)).alias("file"))


# Blocks and books


@query("demoted", f"{_BLOCKS} SELECT book_id, pos, coalesce(role = 'running-header', false) AS demoted FROM bl")
def demoted(spark, sf_dir):
    return S.blocks(spark, sf_dir).select("book_id", "pos", B.demoted(F.col("role")).alias("demoted"))


@query("editable_text", f"{_BLOCKS} SELECT book_id, pos, CASE WHEN type IN ('heading', 'text', 'quote') THEN text WHEN type = 'formula' THEN id WHEN type = 'image' THEN coalesce(role, '') END AS editable FROM bl")
def editable_text(spark, sf_dir):
    return S.blocks(spark, sf_dir).select("book_id", "pos", B.editable_text(F.col("type"), F.col("text"), F.col("role"), F.col("id")).alias("editable"))


@query("describe_block", f"{_BLOCKS} SELECT book_id, pos, CASE type WHEN 'heading' THEN concat('h', level) WHEN 'text' THEN coalesce(role, 'paragraph') WHEN 'image' THEN 'figure' ELSE type END AS kind, CASE type WHEN 'image' THEN '(image, no caption)' WHEN 'formula' THEN coalesce(id, '(image)') ELSE text END AS shown FROM bl")
def describe_block(spark, sf_dir):
    none = F.lit(None)
    d = B.describe(F.col("type"), F.col("level"), F.col("role"), F.col("text"), none.cast("string"), none.cast("array<array<string>>"), F.col("id"), F.lit(0))
    return S.blocks(spark, sf_dir).select("book_id", "pos", d.alias("d")).select("book_id", "pos", "d.kind", F.col("d.text").alias("shown"))


@query("block_order", f"{_BLOCKS} SELECT book_id, pos AS arrival, CAST(row_number() OVER (PARTITION BY book_id ORDER BY coalesce(CASE WHEN pos % 4 <> 3 THEN 10 - page END, 0), pos) - 1 AS INT) AS pos FROM bl")
def block_order(spark, sf_dir):
    rows = S.blocks(spark, sf_dir).select("book_id", F.col("pos").alias("arrival"), F.expr("CASE WHEN pos % 4 <> 3 THEN 10 - page END").alias("page"))
    return B.ordered(rows).select("book_id", "arrival", "pos")


@query("image_order", f"SELECT book_id, image_id, y, rank() OVER (PARTITION BY book_id ORDER BY page, y) AS place FROM (SELECT {S.IMAGES} FROM lineitem)")
def image_order(spark, sf_dir):
    return B.image_order(S.images(spark, sf_dir)).select("book_id", "image_id", "y", "place")


@query("image_asof", f"{_BLOCKS}, im AS (SELECT c_custkey % 300 AS book_id, CAST(c_custkey % 9 AS INT) AS page, c_custkey AS image_id FROM customer) SELECT im.book_id, im.image_id, im.page, CAST(coalesce(max(bl.pos), -1) AS BIGINT) AS after FROM im LEFT JOIN bl ON bl.book_id = im.book_id AND bl.page <= im.page GROUP BY ALL")
def image_asof(spark, sf_dir):
    im = table(spark, sf_dir, "customer").selectExpr("c_custkey % 300 AS book_id", "CAST(c_custkey % 9 AS INT) AS page", "c_custkey AS image_id")
    return B.place_images(im, S.blocks(spark, sf_dir))


@query("heading_ids", f"{_BLOCKS}, sg AS (SELECT book_id, pos, coalesce(nullif(regexp_replace(substr({Q._SLUG}, 1, 40), '^-+|-+$', '', 'g'), ''), 'section') AS s FROM bl WHERE type = 'heading') SELECT book_id, CAST(pos AS BIGINT) AS pos, CASE WHEN n = 1 THEN s ELSE concat(s, '-', n) END AS id FROM (SELECT *, row_number() OVER (PARTITION BY book_id, s ORDER BY pos) AS n FROM sg)")
def heading_ids(spark, sf_dir):
    return B.unique_ids(S.blocks(spark, sf_dir))


@query("pagebreaks", f"{_BLOCKS} SELECT book_id, page, min(pos) AS pos FROM bl GROUP BY book_id, page")
def pagebreaks(spark, sf_dir):
    return B.page_breaks(S.blocks(spark, sf_dir).select("book_id", "pos", F.lit(0).alias("span_no"), "page")).select("book_id", "page", "pos")


@query("page_carry", f"{_BLOCKS} SELECT book_id, pos, last_value(CASE WHEN pos % 3 = 1 THEN page END IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY pos) AS current_page FROM bl")
def page_carry(spark, sf_dir):
    return B.carry_page(S.blocks(spark, sf_dir).withColumn("break_page", F.expr("CASE WHEN pos % 3 = 1 THEN page END"))).select("book_id", "pos", "current_page")


@query("toc_tree", f"{_BLOCKS}, hd AS (SELECT * FROM bl WHERE type = 'heading' AND level <= 3 AND id IS NOT NULL) SELECT h.book_id, h.pos, h.level, max(p.pos) AS parent_pos FROM hd h LEFT JOIN hd p ON p.book_id = h.book_id AND p.pos < h.pos AND p.level < h.level GROUP BY ALL")
def toc_tree(spark, sf_dir):
    return B.contents_tree(S.blocks(spark, sf_dir)).select("book_id", "pos", "level", "parent_pos")


@query("duplicate_ids", f"{_BLOCKS} SELECT book_id, pos, id FROM (SELECT *, row_number() OVER (PARTITION BY book_id, id ORDER BY pos) AS n FROM bl WHERE id IS NOT NULL) WHERE n > 1")
def duplicate_ids(spark, sf_dir):
    return B.duplicate_ids(S.blocks(spark, sf_dir))


def _notes(spark, sf_dir):
    return S.blocks(spark, sf_dir).select("book_id").distinct().withColumn("id", F.concat(F.lit("n-"), (F.col("book_id") % 4).cast("string")))


@query("id_universe", f"{_BLOCKS} SELECT book_id, id FROM bl WHERE id IS NOT NULL UNION SELECT book_id, concat('n-', CAST(book_id % 4 AS VARCHAR)) FROM bl")
def id_universe(spark, sf_dir):
    return B.id_universe(S.blocks(spark, sf_dir), _notes(spark, sf_dir))


@query("dangling_links", f"{_BLOCKS}, un AS (SELECT book_id, id FROM bl WHERE id IS NOT NULL UNION SELECT book_id, concat('n-', CAST(book_id % 4 AS VARCHAR)) FROM bl), lk AS (SELECT book_id, pos, CASE WHEN pos % 2 = 0 THEN 'link' ELSE 'noteref' END AS kind, CASE WHEN pos % 2 = 0 THEN concat('id-', CAST(pos % 7 AS VARCHAR)) ELSE concat('n-', CAST(pos % 4 AS VARCHAR)) END AS target FROM bl) SELECT * FROM lk WHERE (kind = 'link' AND (book_id, target) NOT IN (SELECT (book_id, id) FROM un)) OR (kind = 'noteref' AND target <> concat('n-', CAST(book_id % 4 AS VARCHAR)))")
def dangling_links(spark, sf_dir):
    blocks = S.blocks(spark, sf_dir)
    links = blocks.selectExpr("book_id", "pos", "CASE WHEN pos % 2 = 0 THEN 'link' ELSE 'noteref' END AS kind", "CASE WHEN pos % 2 = 0 THEN concat('id-', CAST(pos % 7 AS STRING)) ELSE concat('n-', CAST(pos % 4 AS STRING)) END AS target")
    return B.dangling(links, B.id_universe(blocks, _notes(spark, sf_dir)), _notes(spark, sf_dir))


@query("referenced_assets", f"{_BLOCKS} SELECT DISTINCT book_id, file AS path FROM bl WHERE file IS NOT NULL UNION SELECT DISTINCT book_id, 'assets/cover.png' FROM bl WHERE book_id % 2 = 0")
def referenced_assets(spark, sf_dir):
    blocks = S.blocks(spark, sf_dir)
    books = blocks.select("book_id").distinct().withColumn("cover", F.when(F.col("book_id") % 2 == 0, "assets/cover.png"))
    return B.referenced_assets(books, blocks.withColumn("image", F.lit(None).cast("string")))


def _assets(spark, sf_dir):
    return S.blocks(spark, sf_dir).where("book_id % 3 <> 0 and file is not null").select("book_id", F.col("file").alias("path")).distinct()


@query("missing_assets", f"{_BLOCKS} SELECT DISTINCT book_id, file AS path FROM bl WHERE file IS NOT NULL AND book_id % 3 = 0")
def missing_assets(spark, sf_dir):
    wanted = S.blocks(spark, sf_dir).where("file is not null").select("book_id", F.col("file").alias("path")).distinct()
    return B.missing_assets(wanted, _assets(spark, sf_dir))


@query("block_union", f"{_BLOCKS} SELECT book_id, pos, type FROM bl WHERE type <> 'image' OR book_id % 3 <> 0")
def block_union(spark, sf_dir):
    blocks = S.blocks(spark, sf_dir)
    both = blocks.where("pos % 2 = 0").unionByName(blocks.where("pos % 2 <> 0"))
    return B.drop_refused(both, _assets(spark, sf_dir)).select("book_id", "pos", "type")


@query("image_dedup", f"SELECT DISTINCT book_id, page, hash, concat('assets/img-', hash, '.png') AS file FROM (SELECT {S.IMAGES} FROM lineitem)")
def image_dedup(spark, sf_dir):
    return B.image_dedup(S.images(spark, sf_dir)).select("book_id", "page", "hash", "file")


@query("annotation_issues", f"{_BLOCKS} SELECT book_id, pos, substr(text, 2, 3) AS selected FROM bl WHERE substr(text, 2, 3) <> 'he ' AND text <> ''")
def annotation_issues(spark, sf_dir):
    rows = S.blocks(spark, sf_dir).where("text <> ''").select("book_id", "pos", "text", F.lit(1).alias("start"), F.lit(4).alias("end"), F.lit("he ").alias("matches"))
    return B.annotation_issues(rows).select("book_id", "pos", "selected")


_JSON = """concat('{"type":"', CASE turn % 4 WHEN 0 THEN 'heading' WHEN 1 THEN 'text' WHEN 2 THEN 'image' ELSE 'poem' END, '"', CASE WHEN turn % 4 = 0 THEN concat(',"level":', CAST(conv_id % 9 AS STRING)) ELSE '' END, CASE WHEN conv_id % 3 <> 0 THEN ',"text":"t"' ELSE '' END, CASE WHEN conv_id % 5 = 0 THEN ',"page":0' WHEN conv_id % 5 = 1 THEN ',"page":3,"pages":[{"page":3,"at":1},{"page":4}]' ELSE '' END, CASE WHEN conv_id % 7 = 0 THEN ',"id":"Bad Id"' ELSE '' END, '}')"""


@query("schema_issues", """WITH c AS (SELECT conv_id AS book_id, turn AS pos, turn % 4 AS k, conv_id % 9 AS l, conv_id % 3 <> 0 AS t, conv_id % 5 AS p, conv_id % 7 = 0 AS i FROM conversations)
SELECT book_id, pos, 'type' AS issue FROM c WHERE k = 3 UNION ALL SELECT book_id, pos, 'unknown:text' FROM c WHERE k = 2 AND t UNION ALL SELECT book_id, pos, 'level' FROM c WHERE k = 0 AND l NOT BETWEEN 1 AND 6
UNION ALL SELECT book_id, pos, 'text' FROM c WHERE k IN (0, 1) AND NOT t UNION ALL SELECT book_id, pos, 'file' FROM c WHERE k = 2 UNION ALL SELECT book_id, pos, 'page' FROM c WHERE p = 0
UNION ALL SELECT book_id, pos, 'id' FROM c WHERE i UNION ALL SELECT book_id, pos, unnest(['page-or-pages', 'pages-first-at', 'pages-at']) FROM c WHERE p = 1""")
def schema_issues(spark, sf_dir):
    return B.schema_issues(table(spark, sf_dir, "conversations").selectExpr("conv_id AS book_id", "turn AS pos", f"{_JSON} AS json"))


@query("walk_blocks", "SELECT conv_id AS book_id, concat('content/', CAST(turn AS VARCHAR)) AS path, CASE WHEN turn % 5 = 0 THEN 'list' ELSE 'text' END AS type FROM conversations UNION ALL SELECT conv_id, concat('content/', CAST(turn AS VARCHAR), '/items/', CAST(k AS VARCHAR), '/0'), 'quote' FROM conversations, (VALUES (0), (1)) t(k) WHERE turn % 5 = 0 UNION ALL SELECT DISTINCT conv_id, 'footnotes/n/blocks/0', 'text' FROM conversations")
def walk_blocks(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    quote = F.array(F.struct(F.lit("quote").alias("type"), text.alias("text")))
    listed = F.when(F.col("turn") % 5 == 0, F.array(quote, quote))
    block = F.struct(F.when(F.col("turn") % 5 == 0, "list").otherwise("text").alias("type"), F.when(F.col("turn") % 5 != 0, text).alias("text"), listed.alias("items"))
    content = F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"])
    notes = F.struct(F.struct(F.lit("1").alias("label"), F.array(F.struct(F.lit("text").alias("type"), F.lit("t").alias("text"))).alias("blocks")).alias("n"))
    books = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("book_id")).agg(F.to_json(F.struct(content.alias("content"), notes.alias("footnotes"))).alias("json"))
    return C.book_blocks(books).select("book_id", "path", "type")


@query("book_issues", """WITH n AS (SELECT conv_id AS book_id, turn, coalesce(text, '') AS t, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)
SELECT book_id, concat('content/', CAST(turn AS VARCHAR), '/id') AS path, 'id a is used twice' AS issue FROM n WHERE turn % 4 = 0 AND turn > 0 AND book_id % 7 <> 0
UNION ALL SELECT book_id, concat('content/', CAST(turn AS VARCHAR), '/text'), 'no place b' FROM n WHERE turn % 4 = 1 AND book_id % 7 <> 0
UNION ALL SELECT book_id, concat('content/', CAST(turn AS VARCHAR), '/text'), 'no footnote c' FROM n WHERE turn % 4 = 2 AND book_id % 7 <> 0
UNION ALL SELECT book_id, concat('content/', CAST(turn AS VARCHAR), '/annotations/0'), 'the offsets select another text' FROM n WHERE turn % 4 = 3 AND book_id % 7 <> 0 AND substr(t, 3, 3) <> 'and'
UNION ALL SELECT book_id, concat('content/', CAST(turn AS VARCHAR), '/page'), 'expected an integer from 1' FROM n WHERE book_id % 7 = 0""")
def book_issues(spark, sf_dir):
    """Books with planted faults; where pages are of wrong shape, nothing else is looked at."""
    kind, text = F.col("turn") % 4, T.escape_dialect(F.coalesce("text", F.lit("")))
    plain = F.coalesce("text", F.lit(""))
    shown = F.when(kind == 1, F.concat(text, F.lit(" [x](#b)"))).when(kind == 2, F.concat(text, F.lit(" [^c]"))).otherwise(text)
    annotation = F.array(F.struct(F.lit(2).alias("start"), F.lit(5).alias("end"), F.lit("and").alias("matches")))
    block = F.struct(F.lit("text").alias("type"), F.when(kind == 0, "a").alias("id"), F.when(kind == 3, F.translate(plain, "\\*$[]^", "......")).otherwise(shown).alias("text"), F.when(kind == 3, annotation).alias("annotations"), F.when(F.col("conv_id") % 7 == 0, 0).alias("page"))
    content = F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"])
    books = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("book_id")).agg(F.to_json(F.struct(F.lit("T").alias("title"), F.lit("en").alias("language"), content.alias("content"))).alias("json"))
    return C.book_issues(books)


@query("block_edit", f"{_BLOCKS} SELECT book_id, pos, CASE WHEN pos % 4 = 0 AND lead(pos) OVER w IS NOT NULL THEN lead(pos) OVER w WHEN lag(pos) OVER w % 4 = 0 THEN lag(pos) OVER w ELSE pos END AS new_pos FROM bl WINDOW w AS (PARTITION BY book_id ORDER BY pos)")
def block_edit(spark, sf_dir):
    return B.move(S.blocks(spark, sf_dir), F.col("pos") % 4 == 0).select("book_id", "pos", "new_pos")


@query("book_stats", f"{_BLOCKS} SELECT book_id, count(*) AS n_blocks, count(*) FILTER (type = 'heading') AS n_headings, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM bl GROUP BY book_id")
def book_stats(spark, sf_dir):
    return B.stats(S.blocks(spark, sf_dir))


@query("recent_docs", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 3")
def recent_docs(spark, sf_dir):
    return B.recent(table(spark, sf_dir, "orders").select("o_orderkey"), 3, "o_orderkey")


@query("selection_ops", "SELECT o_orderkey, CASE WHEN o_custkey % 6 + 1 = 3 THEN '1,2,4,5,6' WHEN o_custkey % 2 = 0 THEN '1,2,3,4,5,6' ELSE '1,2,3,4,5,6' END AS all_but, array_to_string(list_sort(list_distinct(list_filter([1, 2, 3, 4], lambda x: x <> o_custkey % 6 + 1) || CASE WHEN o_custkey % 6 + 1 > 4 THEN [o_custkey % 6 + 1] ELSE [] END)), ',') AS toggled FROM orders")
def selection_ops(spark, sf_dir):
    page = (F.col("o_custkey") % 6 + 1).cast("int")
    whole = F.array(*map(F.lit, range(1, 7)))
    some = F.array(*map(F.lit, range(1, 5)))
    toggle = P.toggled(some, page)
    text = lambda a: F.array_join(F.array_sort(a).cast("array<string>"), ",")
    return table(spark, sf_dir, "orders").select("o_orderkey", text(F.when(page == 3, P.all_but(whole, page)).otherwise(whole)).alias("all_but"), text(toggle).alias("toggled"))


@query("request_checks", "SELECT o_orderkey, o_orderkey % 2 = 0 AS id_ok, o_custkey % 5 > 0 AS page_ok, o_totalprice / 100000 BETWEEN 0.2 AND 3 AS scale_ok, o_orderkey % 3 <> 0 AS file_ok, o_custkey % 4 <> 0 AS pages_ok FROM orders")
def request_checks(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 2 = 0 THEN '123e4567-e89b-42d3-a456-426614174000' ELSE 'x' END AS id", "CAST(o_custkey % 5 AS DOUBLE) AS page", "o_totalprice / 100000 AS scale", "CASE WHEN o_orderkey % 3 = 0 THEN 'a/b.png' ELSE 'fig-1.png' END AS file", "CASE WHEN o_custkey % 4 = 0 THEN CAST(array() AS ARRAY<INT>) ELSE array(1, 2) END AS pages")
    return B.request_checks(rows).select("o_orderkey", "id_ok", "page_ok", "scale_ok", "file_ok", "pages_ok")


@query("book_json")
def book_json(spark, sf_dir):
    """One JSON text a book, blocks in order."""
    one = F.struct("pos", F.struct("type", F.when(F.col("type") == "heading", F.col("level")).alias("level"), "text", "role", "id", "page", "file").alias("block"))
    content = F.transform(F.array_sort(F.collect_list(one)), lambda x: x["block"])
    return S.blocks(spark, sf_dir).groupBy("book_id").agg(content.alias("content")).select("book_id", F.to_json(F.struct(F.concat(F.lit("Book "), F.col("book_id").cast("string")).alias("title"), F.lit("en").alias("language"), "content", F.create_map().cast("map<string,string>").alias("footnotes"))).alias("json"))


_BOOK = (
    rf"""{_PARAS},
tn AS (SELECT *, sum(length(piece)) OVER w - length(piece) AS spot, coalesce(lag(shown) OVER w, -1) AS before FROM jo WINDOW w AS (PARTITION BY book_id, para ORDER BY page, line_no)),
tu AS (SELECT book_id, para, '[' || string_agg('{{"page":' || shown || CASE WHEN before = -1 THEN '' ELSE ',"at":' || spot END || '}}', ',' ORDER BY page, line_no) || ']' AS pages, count(*) AS turns FROM tn WHERE shown <> before GROUP BY book_id, para),
fs AS (SELECT book_id, CAST(m AS BIGINT) AS body_size FROM {Q._FIRST('floor(size + 0.5)', '(SELECT *, page * 1000000 + line_no AS pos FROM fu WHERE role IS NULL)', 'greatest(1, length(text))')}),
ot AS (SELECT pa.book_id, pa.para, kind, text, size, CASE WHEN turns = 1 THEN shown END AS page, CASE WHEN turns > 1 THEN pages END AS pages, body_size FROM pa JOIN tu USING (book_id, para) JOIN fs USING (book_id)),
c1 AS (SELECT *, coalesce(length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) <= 2 AND length(text) <= 4 AND size >= body_size * 2 AND lead(kind) OVER w = 'paragraph', false) AS cand, row_number() OVER w AS n FROM ot WINDOW w AS (PARTITION BY book_id ORDER BY para)),
c2 AS (SELECT *, n - sum(CAST(cand AS INT)) OVER (PARTITION BY book_id ORDER BY para) AS island FROM c1),
c3 AS (SELECT *, cand AND row_number() OVER (PARTITION BY book_id, island, cand ORDER BY para) % 2 = 1 AS takes FROM c2),
c4 AS (SELECT *, coalesce(lag(takes) OVER w, false) AS taken, lag(text) OVER w AS text0, lag(page) OVER w AS page0 FROM c3 WINDOW w AS (PARTITION BY book_id ORDER BY para)),
dc AS (SELECT book_id, para, kind, CASE WHEN taken THEN text0 || text ELSE text END AS text, size, CASE WHEN taken AND pages IS NULL THEN coalesce(page0, page) ELSE page END AS page, pages, body_size FROM c4 WHERE NOT takes),
rk AS (SELECT book_id, size, row_number() OVER (PARTITION BY book_id ORDER BY size DESC) AS r FROM (SELECT DISTINCT book_id, size FROM dc WHERE size >= body_size * 1.25)),
lv AS (SELECT dc.* EXCLUDE (kind), CASE WHEN kind = 'separator' THEN 'separator' WHEN r IS NOT NULL THEN 'heading' ELSE 'paragraph' END AS kind, CASE WHEN kind <> 'separator' AND r IS NOT NULL THEN CAST(least(r, 6) AS INT) END AS level FROM dc LEFT JOIN rk USING (book_id, size)),
m1 AS (SELECT *, CASE WHEN kind = 'heading' AND lag(kind) OVER w = 'heading' AND lag(page) OVER w = page THEN 0 ELSE 1 END AS new FROM lv WINDOW w AS (PARTITION BY book_id ORDER BY para)),
m2 AS (SELECT *, sum(new) OVER (PARTITION BY book_id ORDER BY para) AS g, lead(new) OVER (PARTITION BY book_id ORDER BY para) AS next_new FROM m1),
mg AS (SELECT book_id, min(para) AS pos, arg_min(kind, para) AS kind, min(level) AS level, string_agg(text || CASE WHEN coalesce(next_new, 1) = 0 AND NOT suffix(text, '-') THEN ' ' ELSE '' END, '' ORDER BY para) AS text, any_value(page) AS page, any_value(pages) AS pages FROM m2 GROUP BY book_id, g),
sg AS (SELECT *, coalesce(nullif(regexp_replace(substr({Q._SLUG}, 1, 40), '^-+|-+$', '', 'g'), ''), 'section') AS s FROM mg),
hd AS (SELECT *, row_number() OVER (PARTITION BY book_id, s ORDER BY pos) AS k FROM sg WHERE kind = 'heading')
SELECT sg.book_id, CAST(sg.pos AS BIGINT) AS pos, sg.kind, sg.level, sg.text, CASE WHEN k = 1 THEN hd.s ELSE hd.s || '-' || k END AS id, sg.page, sg.pages FROM sg LEFT JOIN hd USING (book_id, pos)"""
)


@query("pdf_book", _BOOK)
def pdf_book(spark, sf_dir):
    """Lines to an outline: paragraphs, headings and ids of every book."""
    marked = _kept_marked(spark, sf_dir)
    sized = keep(G.drop_caps(_paragraphs(marked), P.body_font_size(marked)))
    blocks = keep(G.merge_headings(G.heading_levels(sized)).withColumn("pos", F.col("para")))
    ids = B.unique_ids(blocks.withColumn("type", F.col("kind")))
    return blocks.join(ids, ["book_id", "pos"], "left").select("book_id", "pos", "kind", "level", "text", "id", "page", F.to_json("pages").alias("pages"))


# Inline dialect


_ESC_TEXT = r"regexp_replace(coalesce(text, ''), '([\\*$\[\]^])', '\\\1', 'g')"
_TOLD = f"WITH di AS (SELECT conv_id, turn, coalesce(text, '') AS text, concat('*em* and **', CAST(conv_id AS VARCHAR), '** [^n-', CAST(turn AS VARCHAR), '] [x *y*](#a-', CAST(turn AS VARCHAR), ') $a_', CAST(turn AS VARCHAR), '$ ', {_ESC_TEXT}, CASE WHEN turn % 4 = 0 THEN ' *open' ELSE '' END) AS s FROM conversations)"


def _told(spark, sf_dir):
    """Marks of every kind before the whole text of a turn; every fourth is left open."""
    n, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    parts = ("*em* and **", n, "** [^n-", turn, "] [x *y*](#a-", turn, ") $a_", turn, "$ ", T.escape_dialect(F.coalesce("text", F.lit(""))), F.when(F.col("turn") % 4 == 0, " *open").otherwise(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("s"))


@query("inline_nodes", f"{_TOLD} SELECT conv_id, turn, CASE WHEN turn % 4 <> 0 THEN 'em,text,text,strong,text,text,noteref,text,link,text,em,text,text,math,text' END AS kinds, turn % 4 = 0 AS failed FROM di")
def inline_nodes(spark, sf_dir):
    parsed = _told(spark, sf_dir).withColumn("r", I.parse_udf()(F.col("s")))
    return parsed.select("conv_id", "turn", F.array_join(F.transform("r.nodes", lambda n: n["kind"]), ",").alias("kinds"), F.col("r.error").isNotNull().alias("failed"))


@query("inline_roundtrip", f"{_TOLD} SELECT conv_id, turn, CASE WHEN turn % 4 <> 0 THEN s END AS again FROM di")
def inline_roundtrip(spark, sf_dir):
    return _told(spark, sf_dir).select("conv_id", "turn", I.roundtrip_udf()(F.col("s")).alias("again"))


@query("plain_text", f"{_TOLD} SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN s ELSE concat('em and ', CAST(conv_id AS VARCHAR), '  x y a_', CAST(turn AS VARCHAR), ' ', text) END AS plain FROM di")
def plain_text(spark, sf_dir):
    return _told(spark, sf_dir).select("conv_id", "turn", I.plain_udf()(F.col("s")).alias("plain"))


@query("inline_issues", f"{_TOLD} SELECT conv_id, turn, CAST(length(s) - 5 AS INT) AS offset FROM di WHERE turn % 4 = 0")
def inline_issues(spark, sf_dir):
    parsed = _told(spark, sf_dir).withColumn("r", I.parse_udf()(F.col("s")))
    return parsed.where("r.error is not null").select("conv_id", "turn", "r.offset")


@query("prose_documents")
def prose_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.prose(F.coalesce("text", F.lit(""))).alias("prose"))
