"""Queries of the scalar functions and of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import pages as P
from ..sources import recognised
from . import synthetic as S
from .catalog import query, table

_WS = T.BLANK
_DOC = "documents"


def _docs(spark, sf_dir, **columns):
    return table(spark, sf_dir, _DOC).select("doc_id", *(c.alias(k) for k, c in columns.items()))


def _text():
    return F.coalesce(F.col("text"), F.lit(""))


_TQ = "coalesce(text, '')"
_LINE = rf"regexp_replace(regexp_replace({_TQ}, '[{_WS}]+', ' ', 'g'), '^ | $', '', 'g')"


@query("escape_dialect", rf"SELECT doc_id, regexp_replace({_TQ}, '([\\*$\[\]^])', '\\\1', 'g') AS escaped FROM documents")
def escape_dialect(spark, sf_dir):
    return _docs(spark, sf_dir, escaped=T.escape_dialect(_text()))


@query("collapse_ws", rf"SELECT doc_id, {_LINE} AS flat FROM documents")
def collapse_ws(spark, sf_dir):
    return _docs(spark, sf_dir, flat=T.collapse(_text()))


@query("line_text", f"WITH {S.LINES_SQL} SELECT book_id, page, line_no, {_LINE} AS flat FROM ln")
def line_text(spark, sf_dir):
    return S.lines(spark, sf_dir).select("book_id", "page", "line_no", T.line_text(F.col("text")).alias("flat"))


@query("furniture_key", f"WITH {S.LINES_SQL} SELECT book_id, page, line_no, lower(regexp_replace({_LINE}, '[0-9]+', '#', 'g')) AS key FROM ln")
def furniture_key(spark, sf_dir):
    return S.lines(spark, sf_dir).select("book_id", "page", "line_no", T.furniture_key(F.col("text")).alias("key"))


@query("caps_lines", rf"WITH {S.LINES_SQL} SELECT book_id, page, line_no, regexp_matches(text, '\p{{Lu}}') AND NOT regexp_matches(text, '\p{{Ll}}') AS caps, regexp_matches(text, '\p{{Lu}}') AND NOT regexp_matches(text, '\p{{Ll}}') AND regexp_matches(text, '[0-9]') AS head FROM ln")
def caps_lines(spark, sf_dir):
    return S.lines(spark, sf_dir).select("book_id", "page", "line_no", T.all_caps(F.col("text")).alias("caps"), T.running_head(F.col("text")).alias("head"))


_GARBLE = rf"""
tok AS (SELECT doc_id, unnest(regexp_split_to_array({_TQ}, '[{_WS}]+')) AS raw FROM documents),
st AS (SELECT doc_id, regexp_replace(regexp_replace(raw, '^[^\p{{L}}\p{{N}}]+', ''), '[^\p{{L}}\p{{N}}]+$', '') AS t FROM tok WHERE regexp_matches(raw, '\p{{L}}')),
odd AS (SELECT doc_id, CASE WHEN t = '' THEN 0 WHEN contains(t, chr(65533)) THEN 1 WHEN regexp_matches(t, '\p{{L}}[0-9]|[0-9]\p{{L}}') THEN 1
  WHEN length(t) > 3 AND regexp_matches(t, '^\p{{Latin}}+$') AND NOT regexp_matches(lower(t), '[{T.VOWELS}]') THEN 1
  WHEN length(regexp_replace(t, '[\p{{L}}\p{{N}}''’\-]', '', 'g')) / length(t) > 0.3 THEN 1 ELSE 0 END AS o FROM st),
gs AS (SELECT d.doc_id, coalesce(sum(o) / count(o), 0.0) AS garble FROM documents d LEFT JOIN odd USING (doc_id) GROUP BY d.doc_id)"""


@query("garble_score", f"WITH {_GARBLE} SELECT doc_id, CAST(garble AS DOUBLE) AS garble FROM gs")
def garble_score(spark, sf_dir):
    return _docs(spark, sf_dir, garble=T.garble_score(_text()))


_VERDICT = rf"""{_GARBLE},
rp AS (SELECT d.doc_id, d.source AS book_id, length(regexp_replace({_TQ}, '[{_WS}]+', '', 'g')) AS chars, (d.doc_id % 10) / 10.0 AS cov, garble FROM documents d JOIN gs USING (doc_id)),
vd AS (SELECT *, CASE WHEN cov > 0.8 THEN 'scanned' WHEN chars < 20 THEN (CASE WHEN cov > 0.3 THEN 'scanned' ELSE 'no-text' END) WHEN garble > 0.4 THEN 'scanned' ELSE 'native' END AS verdict FROM rp)"""


def _reports(spark, sf_dir):
    rows = table(spark, sf_dir, _DOC).select(F.col("source").alias("book_id"), F.col("doc_id").alias("page"), ((F.col("doc_id") % 10) / 10.0).alias("image_coverage"))
    texts = table(spark, sf_dir, _DOC).select(F.col("source").alias("book_id"), F.col("doc_id").alias("page"), "text")
    return P.reports(rows, texts)


@query("page_verdict", f"WITH {_VERDICT} SELECT book_id, doc_id AS page, verdict, CAST(chars AS INTEGER) AS chars, CAST(cov AS DOUBLE) AS image_coverage, CAST(garble AS DOUBLE) AS garble FROM vd")
def page_verdict(spark, sf_dir):
    return _reports(spark, sf_dir)


@query("verdict_counts", f"WITH {_VERDICT} SELECT book_id, count(*) FILTER (verdict = 'native') AS native, count(*) FILTER (verdict = 'scanned') AS scanned, count(*) FILTER (verdict = 'no-text') AS no_text FROM vd GROUP BY book_id")
def verdict_counts(spark, sf_dir):
    return P.verdict_counts(_reports(spark, sf_dir))


@query("needs_ocr", f"WITH {_VERDICT} SELECT book_id, doc_id AS page FROM vd WHERE verdict = 'scanned'")
def needs_ocr(spark, sf_dir):
    return P.needs_recognition(_reports(spark, sf_dir)).select("book_id", "page")


@query("native_only", f"WITH {_VERDICT} SELECT book_id, doc_id AS page FROM vd WHERE verdict = 'native' AND doc_id % 4 <> 0")
def native_only(spark, sf_dir):
    r = _reports(spark, sf_dir)
    return P.native_only(r, r.where("page % 4 = 0")).select("book_id", "page")


@query("usable_pages", f"WITH {_VERDICT}, u AS (SELECT book_id, count(*) AS n_pages, count(*) FILTER (verdict = 'native' OR doc_id % 20 = 9) AS n_usable, count(*) FILTER (verdict = 'scanned' AND doc_id % 20 <> 9) AS n_warnings FROM vd GROUP BY book_id) SELECT *, 2 * n_usable >= n_pages AS accepted FROM u")
def usable_pages(spark, sf_dir):
    r = _reports(spark, sf_dir)
    return P.usable(r, r.where("page % 20 = 9"))


@query("suggested_page", f"WITH {_VERDICT}, n AS (SELECT book_id, count(*) AS n FROM vd GROUP BY book_id), s AS (SELECT v.book_id, doc_id, CASE WHEN verdict = 'scanned' THEN 100 ELSE 0 END + least(chars, 1200) / 120 - abs(doc_id - (n + 1) / 2) / greatest(1, n) AS score, verdict FROM vd v JOIN n USING (book_id)), b AS (SELECT book_id, arg_max(doc_id, (score, -doc_id)) AS p FROM s WHERE verdict <> 'no-text' GROUP BY book_id) SELECT n.book_id, coalesce(p, 1) AS suggested_page FROM n LEFT JOIN b USING (book_id)")
def suggested_page(spark, sf_dir):
    return P.suggested_page(_reports(spark, sf_dir))


@query("cost_estimate", f"WITH {_VERDICT}, c AS (SELECT book_id, count(*) FILTER (verdict = 'scanned') AS scanned, count(*) FILTER (verdict = 'native') AS native, count(*) FILTER (verdict = 'no-text') AS blank FROM vd WHERE doc_id % 3 <> 1 GROUP BY book_id) SELECT *, scanned AS recognised, CAST(2000 + native * 120 + scanned * 5000.0 AS DOUBLE) AS total_ms FROM c")
def cost_estimate(spark, sf_dir):
    r = _reports(spark, sf_dir)
    return P.cost(r, r.where("page % 3 <> 1"), 5000.0)


_ZONE = "CASE WHEN y < height * 0.18 THEN 'top' WHEN y + h > height * 0.78 THEN 'bottom' END"
_ZONED = f"WITH {S.LINES_SQL}, zn AS (SELECT ln.*, {_ZONE} AS zone, lower(regexp_replace({_LINE}, '[0-9]+', '#', 'g')) AS key, {_LINE} AS flat FROM ln JOIN lp USING (book_id, page)), fc AS (SELECT book_id, zone, key, count(DISTINCT page) AS n_pages FROM zn WHERE zone IS NOT NULL GROUP BY ALL), bt AS (SELECT book_id, count(*) AS total FROM lp GROUP BY book_id), fu AS (SELECT zn.*, n_pages, CASE WHEN total >= 3 AND zone IS NOT NULL AND (n_pages >= greatest(3, ceil(total * 0.3)) OR (regexp_matches(flat, '\\p{{Lu}}') AND NOT regexp_matches(flat, '\\p{{Ll}}') AND (n_pages >= 3 OR regexp_matches(flat, '[0-9]')))) THEN 'furniture' END AS role FROM zn JOIN bt USING (book_id) LEFT JOIN fc USING (book_id, zone, key))".replace("\\\\p", "\\p")


@query("page_zones", f"WITH {S.LINES_SQL} SELECT book_id, page, line_no, {_ZONE} AS zone FROM ln JOIN lp USING (book_id, page)")
def page_zones(spark, sf_dir):
    rows = S.lines(spark, sf_dir).join(S.pages(spark, sf_dir), ["book_id", "page"])
    return rows.select("book_id", "page", "line_no", P.zone(F.col("y"), F.col("h"), F.col("height")).alias("zone"))


@query("furniture_counts", f"{_ZONED} SELECT book_id, zone, key, n_pages FROM fc")
def furniture_counts(spark, sf_dir):
    return P.furniture_counts(S.lines(spark, sf_dir), S.pages(spark, sf_dir))


def _marked(spark, sf_dir):
    return P.furniture(S.lines(spark, sf_dir), S.pages(spark, sf_dir))


@query("furniture", f"{_ZONED} SELECT book_id, page, line_no, role FROM fu")
def furniture(spark, sf_dir):
    return _marked(spark, sf_dir).select("book_id", "page", "line_no", "role")


@query("printed_pages", f"{_ZONED} SELECT book_id, page, CAST(arg_min(num, line_no) AS INTEGER) AS printed FROM (SELECT *, regexp_extract(flat, '(?:^|\\s)([0-9]{{1,4}})(?:\\s|$)', 1) AS num FROM fu WHERE role = 'furniture') WHERE num <> '' GROUP BY book_id, page".replace("\\\\s", "\\s"))
def printed_pages(spark, sf_dir):
    return P.printed_pages(_marked(spark, sf_dir))


@query("body_lines", f"{_ZONED} SELECT book_id, page, line_no FROM fu WHERE role IS NULL AND flat <> ''")
def body_lines(spark, sf_dir):
    return P.body_lines(_marked(spark, sf_dir)).select("book_id", "page", "line_no")


_BODY = f"{_ZONED}, bd AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page, line_no) AS pos FROM fu WHERE role IS NULL AND flat <> '')"
_FIRST = lambda value, source, weight="1": f"(SELECT book_id, arg_max(v, (n, -p)) AS m FROM (SELECT book_id, {value} AS v, sum({weight}) AS n, min(pos) AS p FROM {source} GROUP BY 1, 2) GROUP BY book_id)"
_METRICS = f"{_BODY}, gp AS (SELECT book_id, pos, CASE WHEN lag(page) OVER k = page THEN y - lag(y) OVER k END AS g FROM bd WINDOW k AS (PARTITION BY book_id ORDER BY pos)), mt AS (SELECT a.book_id, CAST(a.m AS BIGINT) AS body_left, CAST(b.m AS BIGINT) AS modal_width, CAST(coalesce(nullif(c.m, 0), 12) AS BIGINT) AS modal_gap FROM {_FIRST('floor(x + 0.5)', 'bd')} a JOIN {_FIRST('floor(w / 10 + 0.5) * 10', 'bd')} b USING (book_id) LEFT JOIN {_FIRST('floor(g + 0.5)', '(SELECT * FROM gp WHERE g > 0)')} c USING (book_id))"


@query("body_metrics", f"{_METRICS} SELECT * FROM mt")
def body_metrics(spark, sf_dir):
    return P.body_metrics(P.body_lines(_marked(spark, sf_dir)))


@query("body_font_size", f"{_ZONED} SELECT book_id, CAST(m AS BIGINT) AS body_size FROM {_FIRST('floor(size + 0.5)', '(SELECT *, page * 1000000 + line_no AS pos FROM fu WHERE role IS NULL)', 'greatest(1, length(text))')}")
def body_font_size(spark, sf_dir):
    return P.body_font_size(_marked(spark, sf_dir))


@query("mode_first_seen", "SELECT book_id, CAST(arg_max(v, (n, -p)) AS BIGINT) AS mode, CAST(max(n) AS BIGINT) AS n FROM (SELECT l_suppkey AS book_id, CAST(l_quantity AS BIGINT) AS v, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS p FROM lineitem GROUP BY 1, 2) GROUP BY book_id")
def mode_first_seen(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("book_id"), F.col("l_quantity").cast("long").alias("v"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return P.first_mode(rows, ["book_id"], "v", "pos")


_PLANTED = " UNION ALL SELECT * FROM (VALUES ('planted', 1, 0, 'a red-hot iron and a red-'), ('planted', 1, 1, 'hot poker, well-known'), ('planted', 2, 0, 'Über-mensch is kept')) t(book_id, page, line_no, text)"


@query("compound_evidence", rf"WITH {S.LINES_SQL}, al AS (SELECT book_id, page, line_no, text FROM ln {_PLANTED}), ft AS (SELECT book_id, {_LINE} AS t FROM al) SELECT DISTINCT book_id, lower(m) AS compound FROM (SELECT book_id, unnest(regexp_extract_all(regexp_replace(t, '\p{{L}}+-\p{{L}}+$', ''), '\p{{L}}+-\p{{L}}+')) AS m FROM ft)")
def compound_evidence(spark, sf_dir):
    planted = spark.sql("SELECT * FROM VALUES ('planted', 1, 0, 'a red-hot iron and a red-'), ('planted', 1, 1, 'hot poker, well-known'), ('planted', 2, 0, 'Über-mensch is kept') AS t(book_id, page, line_no, text)")
    return P.compound_evidence(S.lines(spark, sf_dir).select("book_id", "page", "line_no", "text").unionByName(planted))


@query("page_runs", "SELECT book_id, min(page) AS first_page, max(page) AS last_page, count(*) AS n_pages FROM (SELECT *, page - row_number() OVER (PARTITION BY book_id ORDER BY page) AS island FROM (SELECT DISTINCT l_suppkey AS book_id, l_partkey AS page FROM lineitem)) GROUP BY book_id, island")
def page_runs(spark, sf_dir):
    return P.page_runs(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("book_id"), F.col("l_partkey").alias("page")))


@query("page_select", "SELECT l_orderkey AS book_id, CAST(l_linenumber AS INTEGER) AS page, true AS found FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) WHERE l_linenumber IN (2, 4) UNION ALL SELECT o, p, false FROM (SELECT DISTINCT l_orderkey AS o FROM lineitem), (VALUES (2), (4)) t(p) WHERE (o, p) NOT IN (SELECT (l_orderkey, CAST(l_linenumber AS INTEGER)) FROM lineitem)")
def page_select(spark, sf_dir):
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").cast("int").alias("page")).distinct()
    wanted = pages.select("book_id").distinct().select("book_id", F.explode(F.array(F.lit(2), F.lit(4))).alias("page"))
    found, lacking = P.select_pages(pages, wanted)
    return found.withColumn("found", F.lit(True)).unionByName(lacking.withColumn("found", F.lit(False)))


_SPEC = "concat(CAST(o_orderkey % 7 + 1 AS STRING), CASE WHEN o_custkey % 5 = 0 THEN ',x' WHEN o_custkey % 5 = 1 THEN '-2' ELSE concat(',', CAST(o_orderkey % 9 AS STRING), '-', CAST(o_orderkey % 9 + o_orderkey % 7 + 1 AS STRING)) END)"
_SPEC_ROWS = f"sp AS (SELECT o_orderkey, {_SPEC} AS spec FROM orders), pt AS (SELECT *, unnest(string_split(spec, ',')) AS part FROM sp), bn AS (SELECT *, TRY_CAST(regexp_extract(part, '^([0-9]+)(?:-([0-9]+))?$', 1) AS INTEGER) AS a, TRY_CAST(coalesce(nullif(regexp_extract(part, '^([0-9]+)(?:-([0-9]+))?$', 2), ''), regexp_extract(part, '^([0-9]+)(?:-([0-9]+))?$', 1)) AS INTEGER) AS b FROM pt)"


def _specs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_SPEC).alias("spec"))


@query("page_spec_strict", f"WITH {_SPEC_ROWS}, ok AS (SELECT o_orderkey, bool_and(coalesce(a >= 1 AND b >= a AND b - a <= 10000, false)) AS ok FROM bn GROUP BY ALL) SELECT o_orderkey, CASE WHEN any_value(ok) THEN array_to_string(list_sort(list_distinct(flatten(list(generate_series(a, b))))), ',') END AS pages FROM bn JOIN ok USING (o_orderkey) GROUP BY o_orderkey")
def page_spec_strict(spark, sf_dir):
    return _specs(spark, sf_dir).select("o_orderkey", F.array_join(T.page_spec_strict(F.col("spec")).cast("array<string>"), ",").alias("pages"))


@query("page_spec_lenient", f"WITH {_SPEC_ROWS} SELECT o_orderkey, array_to_string(list_sort(list_distinct(flatten(list(CASE WHEN a IS NULL OR least(b, 6) < greatest(a, 1) THEN [] ELSE generate_series(greatest(a, 1), least(b, 6)) END)))), ',') AS pages FROM bn GROUP BY o_orderkey")
def page_spec_lenient(spark, sf_dir):
    return _specs(spark, sf_dir).select("o_orderkey", F.array_join(T.page_spec_lenient(F.col("spec"), F.lit(6)).cast("array<string>"), ",").alias("pages"))


@query("image_coverage", f"WITH im AS (SELECT {S.IMAGES} FROM lineitem), a AS (SELECT book_id, page, sum(greatest(0, w) * greatest(0, h)) AS area FROM im GROUP BY ALL), p AS (SELECT DISTINCT book_id, page FROM im UNION SELECT DISTINCT book_id, 99 FROM im) SELECT book_id, page, CAST(least(1.0, coalesce(area, 0) / (612.0 * 792.0)) AS DOUBLE) AS image_coverage FROM p LEFT JOIN a USING (book_id, page)")
def image_coverage(spark, sf_dir):
    im = S.images(spark, sf_dir)
    pages = im.select("book_id", "page").union(im.select("book_id", F.lit(99))).distinct().withColumns({"width": F.lit(612.0), "height": F.lit(792.0)})
    return P.image_coverage(im, pages)


@query("content_images", f"SELECT image_id, page, w, h FROM (SELECT {S.IMAGES} FROM lineitem) WHERE w >= 24 AND h >= 24")
def content_images(spark, sf_dir):
    return P.content_images(S.images(spark, sf_dir)).select("image_id", "page", "w", "h")


@query("page_fonts", "SELECT l_suppkey AS page, array_to_string(list_sort(list(DISTINCT concat('Font-', l_returnflag, CASE WHEN l_linestatus = 'O' THEN '-Italic' ELSE '-Bold' END))), ',') AS fonts FROM lineitem GROUP BY l_suppkey")
def page_fonts(spark, sf_dir):
    font = F.concat(F.lit("Font-"), "l_returnflag", F.when(F.col("l_linestatus") == "O", "-Italic").otherwise("-Bold"))
    return P.fonts(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), font.alias("font"))).select("page", F.array_join("fonts", ",").alias("fonts"))


@query("font_style", "SELECT l_orderkey, l_linenumber, f, regexp_matches(f, '(?i)italic|oblique|-it\\b|-ital\\b') AS italic, regexp_matches(f, '(?i)bold|black|heavy|-bd\\b|semib') AS bold FROM (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN 'Times-It' WHEN 1 THEN 'Arial-Black' WHEN 2 THEN 'Foo-SemiBoldOblique' WHEN 3 THEN 'Gotham-Bd' ELSE 'Plain' END AS f FROM lineitem)".replace("\\\\b", "\\b"))
def font_style(spark, sf_dir):
    f = F.expr("CASE l_linenumber % 5 WHEN 0 THEN 'Times-It' WHEN 1 THEN 'Arial-Black' WHEN 2 THEN 'Foo-SemiBoldOblique' WHEN 3 THEN 'Gotham-Bd' ELSE 'Plain' END")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", f.alias("f")).select("*", T.italic(F.col("f")).alias("italic"), T.bold(F.col("f")).alias("bold"))


_SLUG = f"regexp_replace(lower({_TQ}), '[^a-z0-9]+', '-', 'g')"


@query("slug", f"SELECT doc_id, coalesce(nullif(regexp_replace(substr({_SLUG}, 1, 40), '^-+|-+$', '', 'g'), ''), 'section') AS slug FROM documents")
def slug(spark, sf_dir):
    return _docs(spark, sf_dir, slug=T.slug(_text()))


@query("sanitize_id", f"SELECT doc_id, coalesce(nullif(regexp_replace({_SLUG}, '^-+|-+$', '', 'g'), ''), 'x') AS clean FROM documents")
def sanitize_id(spark, sf_dir):
    return _docs(spark, sf_dir, clean=T.sanitize_id(_text()))


@query("id_valid", "SELECT c_custkey, regexp_matches(c_name, '^[a-z0-9]+(-[a-z0-9]+)*$') AS plain, regexp_matches(lower(replace(c_name, '#', '-')), '^[a-z0-9]+(-[a-z0-9]+)*$') AS lowered FROM customer")
def id_valid(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.id_valid(F.col("c_name")).alias("plain"), T.id_valid(F.lower(F.replace("c_name", F.lit("#"), F.lit("-")))).alias("lowered"))


@query("escape_xml", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS escaped FROM pages")
def escape_xml(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.escape_xml(F.col("html")).alias("escaped"))


@query("normalize_src", "SELECT page_id, regexp_replace(concat(CASE page_id % 3 WHEN 0 THEN '../' WHEN 1 THEN './../' ELSE '' END, 'images/', CAST(page_id AS VARCHAR)), '^(?:\\.\\.?/)+', '') AS src FROM pages".replace("\\\\.", "\\."))
def normalize_src(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.normalize_src(F.expr("concat(CASE page_id % 3 WHEN 0 THEN '../' WHEN 1 THEN './../' ELSE '' END, 'images/', CAST(page_id AS STRING))")).alias("src"))


@query("download_name", "SELECT p_partkey, concat(regexp_replace(concat(p_name, '.v', CAST(p_size AS VARCHAR), '.pdf'), '\\.[^.]+$', ''), '.epub') AS name FROM part".replace("\\\\.", "\\."))
def download_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.download_name(F.concat("p_name", F.lit(".v"), F.col("p_size").cast("string"), F.lit(".pdf")), "epub").alias("name"))


@query("media_type", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/svg+xml' WHEN 3 THEN 'text/css' WHEN 4 THEN 'image/gif' END AS media FROM part")
def media_type(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.media_type(F.expr("concat('a.b/', p_name, CASE p_partkey % 6 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.svg' WHEN 3 THEN '.css' WHEN 4 THEN '.Gif' ELSE '.exe' END)")).alias("media"))


@query("tail_text", f"SELECT doc_id, right({_TQ}, 200) AS tail FROM documents")
def tail_text(spark, sf_dir):
    return _docs(spark, sf_dir, tail=F.right(_text(), F.lit(200)))


_MS = "CAST(o_totalprice * 100 AS BIGINT)"


@query("format_units", f"""SELECT o_orderkey,
CASE WHEN n <= 0 THEN '0 B' WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B' WHEN n < 1048576 THEN CAST(CAST(floor(n / 1024.0 + 0.5) AS BIGINT) AS VARCHAR) || ' KB' WHEN n < 10 * 1048576 THEN printf('%.1f', floor(n / 1048576.0 * 10 + 0.5) / 10) || ' MB' ELSE CAST(CAST(floor(n / 1048576.0 + 0.5) AS BIGINT) AS VARCHAR) || ' MB' END AS bytes,
CASE WHEN t >= 3600 THEN CAST(t // 3600 AS VARCHAR) || ':' || lpad(CAST((t // 60) % 60 AS VARCHAR), 2, '0') ELSE CAST(t // 60 AS VARCHAR) END || ':' || lpad(CAST(t % 60 AS VARCHAR), 2, '0') AS clock,
CASE WHEN n < 1000 THEN 'under a second' WHEN t < 10 THEN printf('%.1f', floor(n / 100 + 0.5) / 10) || ' sec' WHEN t < 60 THEN CAST(t AS VARCHAR) || ' sec' WHEN m < 60 THEN CAST(m AS VARCHAR) || ' min' WHEN r = 0 THEN CAST(hh AS VARCHAR) || ' h' WHEN r = 60 THEN CAST(hh + 1 AS VARCHAR) || ' h' ELSE CAST(hh AS VARCHAR) || ' h ' || CAST(r AS VARCHAR) || ' min' END AS duration
FROM (SELECT *, m // 60 AS hh, CAST(floor((m - (m // 60) * 60) / 5 + 0.5) * 5 AS BIGINT) AS r FROM (SELECT *, CAST(floor(t / 60 + 0.5) AS BIGINT) AS m FROM (SELECT o_orderkey, {_MS} AS n, CAST(floor({_MS} / 1000 + 0.5) AS BIGINT) AS t FROM orders)))""")
def format_units(spark, sf_dir):
    # as the SQL's cast does: to the nearest, ties to even (Spark's own cast cuts)
    n = F.rint(F.col("o_totalprice") * 100).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.format_bytes(n).alias("bytes"), T.format_clock(n).alias("clock"), T.format_duration(n).alias("duration"))


@query("sniff_kind", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'epub' WHEN 1 THEN 'book' WHEN 2 THEN 'book' WHEN 3 THEN 'empty' ELSE 'pdf' END AS kind FROM part")
def sniff_kind(spark, sf_dir):
    head = F.expr("CASE p_partkey % 5 WHEN 0 THEN X'504B0304' WHEN 1 THEN X'7B22' WHEN 3 THEN X'' ELSE X'25504446' END")
    name = F.expr("concat(p_name, CASE WHEN p_partkey % 5 = 2 THEN '.JSON' ELSE '.pdf' END)")
    return table(spark, sf_dir, "part").select("p_partkey", T.sniff_kind(name, head).alias("kind"))


# A page's picture stands for two parts, so that a cache of some parts also serves others.
_PNG = "concat(p_name, '/', CAST(p_partkey // 2 AS VARCHAR))"
_KEY = f"sha256(encode('engine-1') || '\\x00'::BLOB || encode({_PNG}) || '\\x00'::BLOB || encode('en,de'))"


def _keyed(spark, sf_dir):
    png = F.encode(F.concat("p_name", F.lit("/"), F.floor(F.col("p_partkey") / 2).cast("string")), "UTF-8")
    return table(spark, sf_dir, "part").select("p_partkey", recognised.cache_key("engine-1", png, ["en", "de"]).alias("key"))


@query("cache_keys", f"SELECT p_partkey, {_KEY} AS key FROM part")
def cache_keys(spark, sf_dir):
    return _keyed(spark, sf_dir)


@query("cache_misses", f"SELECT p_partkey FROM part WHERE {_PNG} NOT IN (SELECT {_PNG} FROM part WHERE p_partkey % 3 = 0)")
def cache_misses(spark, sf_dir):
    rows = _keyed(spark, sf_dir)
    return recognised.misses(rows, rows.where("p_partkey % 3 = 0")).select("p_partkey")


@query("decode_entities", "SELECT page_id, replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&') || '€A&bogus;' AS decoded FROM pages")
def decode_entities(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.decode_entities(F.concat("html", F.lit("&#8364;&#x41;&bogus;"))).alias("decoded"))


def _golden(name: str, make, cases: list[tuple[str, str | None]]):
    """Texts with known results, dealt over a table's rows: the SQL side only looks the result up."""
    quote = lambda s, slash: "NULL" if s is None else "'" + (s.replace("\\", "\\\\") if slash else s).replace("'", "\\'" if slash else "''") + "'"
    wanted = ", ".join(f"({i}, {quote(want, False)})" for i, (_, want) in enumerate(cases))

    @query(name, f"SELECT p_partkey, v AS result FROM part JOIN (VALUES {wanted}) t(i, v) ON p_partkey % {len(cases)} = i")
    def run(spark, sf_dir):
        given = F.lit(None).cast("string")
        for i, (text, _) in enumerate(cases):
            given = F.when(F.col("p_partkey") % len(cases) == i, F.lit(text)).otherwise(given)
        return table(spark, sf_dir, "part").select("p_partkey", given.alias("g")).select("p_partkey", make(F.col("g")).alias("result"))

    return run


_grid = lambda c: F.to_json(c)
_golden("tex_body", T.tex_body, [("$$x^2$$", "x^2"), (r"\[ a+b \]", "a+b"), (r"\(q\)", "q"), ("$ k $", "k"), ("plain", "plain"), ("", "")])
_golden("tex_span", lambda c: T.tex_span(c).cast("string"), [("k", "true"), (r"\tau", "true"), ("5 and ", "false"), ("", "false"), ("x\\", "false"), ("a_b", "true"), ("word", "false")])
_golden("prose", T.prose, [("costs $5 and $10 now", r"costs \$5 and \$10 now"), (r"let $ \tau $ be", r"let $\tau$ be"), ("a * b [c]", r"a \* b \[c\]"), ("two\n lines", "two lines"), ("$5 then $k$", r"\$5 then $k$"), ("", ""), ("end $", r"end \$")])
_golden("markdown_table", lambda c: _grid(T.markdown_table(c)), [("| a | b |\n|---|---|\n| 1 | 2 |", '[[" a "," b "],[" 1 "," 2 "]]'.replace('" a "', '"a"').replace('" b "', '"b"').replace('" 1 "', '"1"').replace('" 2 "', '"2"')), ("a|b\nc", None), ("no pipes\nhere", None), ("a|b\nc|d", '[["a","b"],["c","d"]]')])
_golden("html_table", lambda c: _grid(T.html_table(c)), [("<table><tr><td>a<td>b</tr><tr><td>c</table>", '[["a","b"],["c",""]]'), ("<table><tr><td colspan=2>a</td></tr></table>", None), ("<table><tr><th>x &amp; y</th><td>$5</td></tr></table>", '[["x & y","\\\\$5"]]'), ("none", None), ("<table><tr><td></td></tr></table>", None)])
_golden("table_grid", lambda c: F.to_json(T.table_rows(c)), [("<table><tr><td>p</td></tr></table>", '[["p"]]'), ("x|y\n1|2", '[["x","y"],["1","2"]]'), ("text", None)])
_golden("list_items", lambda c: F.concat(F.to_json(T.list_items(c)), T.list_ordered(c).cast("string")), [("1. one\n2) two", '["one","two"]true'), ("- a\n\n• b", '["a","b"]false'), ("* c", '["c"]false')])
