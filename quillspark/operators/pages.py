"""Pages and lines: verdicts, routing, running heads, printed page numbers, metrics.

Tables: ``pages`` (book_id, page, width, height, image_coverage), ``lines`` (book_id,
page, line_no, text, x, y, w, h, size, and runs: text, italic, bold, size of each styled
run, where known). All windows are partitioned by book, so a chain
of these operators needs one exchange by ``book_id``; counts are pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T

VERDICTS = ("native", "scanned", "no-text")
TOP_ZONE, BOTTOM_ZONE = 0.18, 0.78
FURNITURE_SHARE = 0.3
STARTUP_MS, NATIVE_MS = 2000, 120


def zone(y: Column, h: Column, height: Column) -> Column:
    return F.when(y < height * TOP_ZONE, "top").when(y + h > height * BOTTOM_ZONE, "bottom")


def page_text(lines: DataFrame) -> DataFrame:
    """One row a page: its lines' texts in order, joined by a space."""
    return lines.groupBy("book_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("text"))


def reports(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """book_id, page, verdict, chars, image_coverage, garble of every page."""
    joined = pages.select("book_id", "page", "image_coverage").join(texts, ["book_id", "page"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    scored = joined.withColumns({"chars": T.visible_chars(F.col("text")), "garble": T.garble_score(F.col("text"))})
    return scored.select("book_id", "page", T.verdict(F.col("image_coverage"), F.col("chars"), F.col("garble")).alias("verdict"), "chars", "image_coverage", "garble")


def verdict_counts(reports_: DataFrame, by: str = "book_id") -> DataFrame:
    return reports_.groupBy(by).agg(*(F.count_if(F.col("verdict") == v).alias(v.replace("-", "_")) for v in VERDICTS))


def select_pages(pages: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages asked for, asked-for pages that don't exist)."""
    asked = wanted.select("book_id", "page").distinct()
    return pages.join(asked, ["book_id", "page"], "left_semi"), asked.join(pages, ["book_id", "page"], "left_anti")


def needs_recognition(reports_: DataFrame, every: bool = False) -> DataFrame:
    keep = F.col("verdict") == "scanned"
    return reports_.where(keep | (F.col("verdict") == "native") if every else keep)


def native_only(reports_: DataFrame, recognised: DataFrame) -> DataFrame:
    return reports_.where("verdict = 'native'").join(recognised.select("book_id", "page"), ["book_id", "page"], "left_anti")


def usable(reports_: DataFrame, recognised: DataFrame) -> DataFrame:
    """Per book: pages, usable pages, warnings, and whether at least half can be used."""
    seen = reports_.join(recognised.select("book_id", "page", F.lit(True).alias("done")).distinct(), ["book_id", "page"], "left")
    good = F.coalesce(F.col("done"), F.lit(False)) | (F.col("verdict") == "native")
    agg = seen.groupBy("book_id").agg(F.count("*").alias("n_pages"), F.count_if(good).alias("n_usable"), F.count_if(~good & (F.col("verdict") != "no-text")).alias("n_warnings"))
    return agg.withColumn("accepted", 2 * F.col("n_usable") >= F.col("n_pages"))


def furniture_counts(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages on which each zone line occurs."""
    zoned = _zoned(lines, pages).where("zone is not null")
    return zoned.select("book_id", "zone", "key", "page").distinct().groupBy("book_id", "zone", "key").agg(F.count("*").alias("n_pages"))


def _zoned(lines: DataFrame, pages: DataFrame) -> DataFrame:
    with_height = lines.join(pages.select("book_id", "page", "height"), ["book_id", "page"])
    return with_height.withColumns({"zone": zone(F.col("y"), F.col("h"), F.col("height")), "key": T.furniture_key(F.col("text"))})


def furniture(lines: DataFrame, pages: DataFrame, share: float = FURNITURE_SHARE) -> DataFrame:
    """``lines`` with role 'furniture' on running heads, feet and page numbers."""
    totals = pages.groupBy("book_id").agg(F.count("*").alias("total"))
    zoned = _zoned(lines, pages).join(totals, "book_id").join(furniture_counts(lines, pages), ["book_id", "zone", "key"], "left")
    text = T.line_text(F.col("text"))
    often = F.col("n_pages") >= F.greatest(F.lit(3), F.ceil(F.col("total") * share))
    rule = often | (T.all_caps(text) & (F.col("n_pages") >= 3)) | T.running_head(text)
    role = F.when((F.col("total") >= 3) & F.col("zone").isNotNull() & F.coalesce(rule, F.lit(False)), "furniture")
    return zoned.select(*lines.columns, "height", "zone", "key", "n_pages", role.alias("role"))


def printed_pages(marked: DataFrame) -> DataFrame:
    """The number on the first furniture line of a page that shows one."""
    number = F.regexp_extract(T.line_text(F.col("text")), r"(?:^|\s)([0-9]{1,4})(?:\s|$)", 1)
    rows = marked.where("role = 'furniture'").withColumn("number", number).where("number <> ''")
    return rows.groupBy("book_id", "page").agg(F.min_by(F.col("number").cast("int"), "line_no").alias("printed"))


def body_lines(marked: DataFrame) -> DataFrame:
    return marked.where(F.col("role").isNull() & (T.line_text(F.col("text")) != ""))


def first_mode(df: DataFrame, by: list[str], value: str, order: str, weight: Column | None = None) -> DataFrame:
    """The commonest value of each group; of equals the one seen first."""
    counted = df.groupBy(*by, value).agg(F.sum(weight if weight is not None else F.lit(1)).cast("long").alias("n"), F.min(order).alias("first"))
    return counted.groupBy(*by).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias("mode"), F.max("n").alias("n"))


def body_metrics(body: DataFrame) -> DataFrame:
    """Left edge, modal width and modal line gap of each book's body, in one pass over its lines."""
    w = Window.partitionBy("book_id").orderBy("page", "line_no")
    gap = F.when((F.lag("page").over(w) == F.col("page")) & (F.col("y") > F.lag("y").over(w)), F.col("y") - F.lag("y").over(w))
    seen = {"left": F.col("x"), "width": F.col("w") / 10, "gap": F.col("gap")}
    values = body.withColumn("gap", gap).select("book_id", (F.col("page").cast("long") * 1_000_000 + F.col("line_no")).alias("pos"), F.explode(F.array(*(F.struct(F.lit(k).alias("k"), T.round_half_up(v).alias("v")) for k, v in seen.items()))).alias("m"))
    modes = first_mode(values.select("book_id", "pos", "m.k", "m.v").where("v is not null"), ["book_id", "k"], "v", "pos")
    by = modes.groupBy("book_id").agg(*(F.max(F.when(F.col("k") == k, F.col("mode"))).alias(k) for k in seen))
    return by.select("book_id", F.col("left").alias("body_left"), (F.col("width") * 10).alias("modal_width"), F.coalesce(F.nullif("gap", F.lit(0)), F.lit(12)).alias("modal_gap"))


def dominant_size(runs: Column) -> Column:
    """The rounded size that carries most of a line's text; of equals the first."""
    weight = lambda r: F.greatest(F.lit(1), T.utf16_length(r["text"]))
    sizes = F.array_distinct(F.transform(runs, lambda r: T.round_half_up(r["size"])))
    total = lambda v: F.aggregate(F.filter(runs, lambda r: T.round_half_up(r["size"]) == v), F.lit(0), lambda n, r: n + weight(r).cast("int"))
    return F.array_max(F.transform(sizes, lambda v, i: F.struct(total(v).alias("n"), (-i).alias("i"), v.alias("v"))))["v"]


def body_font_size(marked: DataFrame) -> DataFrame:
    """The rounded size that carries most text."""
    size = T.round_half_up(F.col("size"))
    if "runs" in marked.columns:
        marked = marked.select("book_id", "page", "line_no", "role", F.explode("runs").alias("r")).select("*", "r.size", "r.text")
    rows = marked.where(F.col("role").isNull()).withColumns({"v": size, "pos": F.col("page").cast("long") * 1_000_000 + F.col("line_no")})
    return first_mode(rows, ["book_id"], "v", "pos", F.greatest(F.lit(1), T.utf16_length(F.col("text")))).select("book_id", F.col("mode").alias("body_size"))


def compound_evidence(lines: DataFrame) -> DataFrame:
    """Hyphenated compounds that occur before the end of a line, lower-cased."""
    text = T.line_text(F.col("text"))
    inner = F.regexp_replace(text, r"\p{L}+-\p{L}+\z", "")
    return lines.select("book_id", F.explode(F.regexp_extract_all(inner, F.lit(r"(\p{L}+-\p{L}+)"), F.lit(1))).alias("m")).select("book_id", F.lower("m").alias("compound")).distinct()


def image_coverage(images: DataFrame, pages: DataFrame) -> DataFrame:
    area = images.groupBy("book_id", "page").agg(F.sum(F.greatest(F.lit(0.0), F.col("w")) * F.greatest(F.lit(0.0), F.col("h"))).alias("area"))
    return pages.join(area, ["book_id", "page"], "left").select("book_id", "page", F.when(F.col("width") * F.col("height") > 0, F.least(F.lit(1.0), F.coalesce("area", F.lit(0.0)) / (F.col("width") * F.col("height")))).otherwise(0.0).alias("image_coverage"))


def content_images(images: DataFrame) -> DataFrame:
    return images.where("w >= 24 and h >= 24")


def page_runs(pages: DataFrame) -> DataFrame:
    """Runs of neighbouring page numbers: first, last and length."""
    island = F.col("page") - F.row_number().over(Window.partitionBy("book_id").orderBy("page"))
    return pages.select("book_id", "page").distinct().withColumn("island", island).groupBy("book_id", "island").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("n_pages")).drop("island")


def cost(reports_: DataFrame, selected: DataFrame, ms_per_page: float | None, every: bool = False) -> DataFrame:
    """Pages by verdict in a selection, and the estimated milliseconds (null if unknown)."""
    own = reports_.join(selected.select("book_id", "page").distinct(), ["book_id", "page"], "left_semi")
    n = own.groupBy("book_id").agg(F.count_if(F.col("verdict") == "scanned").alias("scanned"), F.count_if(F.col("verdict") == "native").alias("native"), F.count_if(~F.col("verdict").isin("scanned", "native")).alias("blank"))
    recognised = F.col("scanned") + (F.col("native") if every else 0)
    native = F.lit(0) if every else F.col("native")
    known = F.lit(ms_per_page).cast("double")
    total = STARTUP_MS + native * NATIVE_MS + recognised * F.coalesce(known, F.lit(0.0))
    return n.withColumns({"recognised": recognised, "total_ms": F.when((recognised > 0) & known.isNull(), None).otherwise(total)})


def suggested_page(reports_: DataFrame) -> DataFrame:
    """A page worth a trial: scanned, full of text, near the middle; 1 without any."""
    n = reports_.groupBy("book_id").agg(F.count("*").alias("n"))
    score = F.when(F.col("verdict") == "scanned", 100).otherwise(0) + F.least(F.col("chars"), F.lit(1200)) / 120 - F.abs(F.col("page") - (F.col("n") + 1) / 2) / F.greatest(F.lit(1), F.col("n"))
    best = reports_.join(n, "book_id").where("verdict <> 'no-text'").groupBy("book_id").agg(F.max_by("page", F.struct(score, -F.col("page"))).alias("p"))
    return n.join(best, "book_id", "left").select("book_id", F.coalesce("p", F.lit(1)).alias("suggested_page"))


def group_lines(spans: DataFrame) -> DataFrame:
    """Spans of a page as visual lines: a span joins the line whose first span's baseline is near.

    Anchored on a line's first span, so a fold over the page's sorted spans. ``runs`` keeps
    the spans' styles (``italic``, ``bold``, where given), ``size`` is the dominant one.
    """
    style = [F.col(c) if c in spans.columns else F.lit(False).alias(c) for c in ("italic", "bold")]
    runs = spans.groupBy("book_id", "page").agg(F.array_sort(F.collect_list(F.struct("y", "x", "w", "h", "size", "text", *style))).alias("runs"))
    run_type = "struct<x:double,text:string,italic:boolean,bold:boolean,size:double>"
    line_type = f"array<struct<y:double,x:double,x1:double,h:double,runs:array<{run_type}>>>"
    kept = lambda r: F.array(F.struct(*(r[c].alias(c) for c in ("x", "text", "italic", "bold", "size"))))

    def step(lines: Column, r: Column) -> Column:
        last = F.get(lines, F.size(lines) - 1)
        fresh = F.struct(r["y"].alias("y"), r["x"].alias("x"), (r["x"] + r["w"]).alias("x1"), r["h"].alias("h"), kept(r).alias("runs"))
        joined = F.struct(last["y"].alias("y"), F.least(last["x"], r["x"]).alias("x"), F.greatest(last["x1"], r["x"] + r["w"]).alias("x1"), F.greatest(last["h"], r["h"]).alias("h"), F.concat(last["runs"], kept(r)).alias("runs"))
        near = F.abs(r["y"] - last["y"]) < F.greatest(r["size"], F.lit(6.0)) * 0.5
        return F.when((F.size(lines) > 0) & near, F.concat(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(lines, F.array(fresh)))

    folded = runs.select("book_id", "page", F.posexplode(F.aggregate("runs", F.array().cast(line_type), step)).alias("line_no", "l")).withColumn("o", F.array_sort("l.runs"))
    return folded.select("book_id", "page", "line_no", "l.x", "l.y", (F.col("l.x1") - F.col("l.x")).alias("w"), "l.h", F.array_join(F.transform("o", lambda r: r["text"]), "").alias("text"), dominant_size(F.col("o")).cast("double").alias("size"), F.col("o").alias("runs"))


def fonts(spans: DataFrame) -> DataFrame:
    """The distinct fonts of each page, in order."""
    return spans.groupBy("page").agg(F.array_sort(F.collect_set("font")).alias("fonts"))


def toggled(chosen: Column, page: Column) -> Column:
    """A selection of pages with ``page`` taken out, or in."""
    return F.array_union(F.array_except(chosen, F.array(page)), F.array_except(F.array(page), chosen))


def all_but(pages: Column, page: Column) -> Column:
    return F.array_except(pages, F.array(page))
