"""Layout regions (text, label, x, y, w, h in parts of the page) to document blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T

#: Label patterns.
FURNITURE = r"header|footer|page[_ -]?number|^number$"
PAGE_NUMBER = r"page[_ -]?number|^number$"
CAPTION = r"caption|vision[_ -]?footnote|(?:figure|chart|image|table)[_ -]?title"
VISION = r"image|figure|chart|photo|seal|stamp"
FORMULA = r"formula|equation"
DOC_TITLE = r"doc[_ -]?title"


def normalise(points: Column, width: Column, height: Column) -> Column:
    """Box of a flat list x0, y0, x1, y1, ... as parts of the page."""
    xs, ys = F.filter(points, lambda v, i: i % 2 == 0), F.filter(points, lambda v, i: i % 2 == 1)
    x, y = F.array_min(xs), F.array_min(ys)
    return F.struct((x / width).alias("x"), (y / height).alias("y"), ((F.array_max(xs) - x) / width).alias("w"), ((F.array_max(ys) - y) / height).alias("h"))


def telling(text: Column, label: Column) -> Column:
    """Regions worth keeping: with text, or of something to be looked at."""
    return (T.strip(F.coalesce(text, F.lit(""))) != "") | F.coalesce(F.lower(label).rlike(VISION), F.lit(False))


def crop_rect(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Pixel rectangle inside the page, or null if a side is under two pixels."""
    left, top = F.greatest(F.lit(0), T.round_half_up(x * width)), F.greatest(F.lit(0), T.round_half_up(y * height))
    right, bottom = F.least(width, T.round_half_up((x + w) * width)), F.least(height, T.round_half_up((y + h) * height))
    wide, high = right - left, bottom - top
    return F.when((wide >= 2) & (high >= 2), F.struct(left.cast("int").alias("left"), top.cast("int").alias("top"), wide.cast("int").alias("width"), high.cast("int").alias("height")))


def finite(*values: Column) -> Column:
    total = sum(values[1:], values[0])
    return total.isNotNull() & ~F.isnan(total) & (F.abs(total) < float("inf"))


def prepared(regions: DataFrame) -> DataFrame:
    """Finite regions with their lower-case label, trimmed text and table grid."""
    kept = regions.where(finite(*(F.col(c).cast("double") for c in "xywh")))
    kept = kept.withColumns({"low": F.lower("label"), "raw": T.strip(F.col("text"))})
    tabular = F.col("low").rlike("table") & ~F.col("low").rlike(CAPTION) & (F.col("raw") != "")
    return kept.withColumn("rows", F.when(tabular, T.table_rows(F.col("raw")))).withColumn("bad_table", tabular & F.col("rows").isNull())


def is_figure() -> Column:
    """On ``prepared`` rows: a content-sized vision region without text, or a table no grid can hold."""
    sized = (F.col("w") >= 0.02) & (F.col("h") >= 0.02) & (F.col("w") * F.col("h") < 0.9)
    seen = ~F.col("low").rlike(FURNITURE) & ~F.col("low").rlike(CAPTION) & F.col("low").rlike(VISION) & (F.col("raw") == "")
    return sized & (F.col("bad_table") | seen)


def to_blocks(regions: DataFrame) -> DataFrame:
    """type, level, role, text, tex, ordered, items, rows, file of every region that carries content."""
    rows = prepared(regions)
    low, raw = F.col("low"), F.col("raw")
    letters = F.regexp_replace(raw, r"[^\p{L}]", "")
    caps = (low == "text") & (T.utf16_length(raw) <= 80) & (letters != "") & (letters == F.upper(letters))
    items = F.when(low.rlike("list"), F.transform(T.list_items(raw), T.prose))
    role = F.when(low.rlike(PAGE_NUMBER), "page-number").when(low.rlike("footer"), "running-footer").otherwise("running-header")
    text = T.prose(F.col("text"))
    table = low.rlike("table") & ~low.rlike(CAPTION)
    kinds = (
        F.when(low.rlike(FURNITURE), F.when(text != "", "furniture"))
        .when(is_figure(), "image")
        .when(raw == "", None)
        .when(low.rlike(FORMULA), "formula")
        .when(table, F.when(F.col("rows").isNotNull(), "table").otherwise("table-source"))
        .when(F.size(items) > 0, "list")
        .when(low.rlike(CAPTION), "caption")
        .when(low.rlike(DOC_TITLE), "h1")
        .when(low.rlike("title") | caps, "h2")
        .when(low.rlike("footnote"), "footnote-source")
        .otherwise("text")
    )
    out = rows.withColumns({"kind": kinds, "items": items, "prose": F.when(kinds.isin("furniture"), text).otherwise(T.prose(raw))}).where("kind is not null")
    k = F.col("kind")
    return out.withColumns({
        "type": F.when(k.isin("h1", "h2"), "heading").when(k.isin("image", "formula", "table", "list"), k).otherwise("text"),
        "level": F.when(k == "h1", 1).when(k == "h2", 2),
        "role": F.when(k == "furniture", role).when(k.isin("caption", "table-source", "footnote-source"), k),
        "text": F.when(~k.isin("image", "formula", "table", "list"), F.col("prose")),
        "tex": F.when(k == "formula", T.tex_body(raw)),
        "ordered": F.when(k == "list", T.list_ordered(raw)),
        "items": F.when(k == "list", F.col("items")),
        "rows": F.when(k == "table", F.col("rows")),
        "file": F.when(k == "image", T.crop_name(F.col("page"), F.col("x"), F.col("y"), F.col("w"), F.col("h"))),
    }).select("book_id", "page", "pos", "type", "level", "role", "text", "tex", "ordered", "items", "rows", "file", "x", "y", "w", "h")


def bind_captions(blocks: DataFrame) -> DataFrame:
    """A caption touching the figure after or before it becomes the figure's caption.

    A caption takes the figure to its right if that touches, else the one to its left
    unless the caption on that figure's other side has taken it.
    """
    w = Window.partitionBy("book_id", "page").orderBy(F.asc_nulls_last("pos"))
    box = F.struct("type", "role", "x", "y", "w", "h")
    rows = blocks.withColumn("box", box)
    for name, k in (("n1", 1), ("p1", -1), ("p2", -2)):
        rows = rows.withColumn(name, F.lead("box", k).over(w) if k > 0 else F.lag("box", -k).over(w))

    def touches(c: Column, f: Column) -> Column:
        overlap = F.least(c["x"] + c["w"], f["x"] + f["w"]) - F.greatest(c["x"], f["x"])
        gap = F.greatest(f["y"] - (c["y"] + c["h"]), c["y"] - (f["y"] + f["h"]))
        return F.coalesce((c["type"] == "text") & (c["role"] == "caption") & (f["type"] == "image") & (overlap >= c["w"] * 0.5) & (gap < 0.05), F.lit(False))

    me = F.col("box")
    right = touches(me, F.col("n1"))
    left = ~right & touches(me, F.col("p1")) & ~touches(F.col("p2"), F.col("p1"))
    rows = rows.withColumns({"to_right": right, "to_left": left})
    from_left, from_right = F.lag("to_right").over(w), F.lead("to_left").over(w)
    rows = rows.withColumn("caption", F.when(from_left, F.lag("text").over(w)).when(from_right, F.lead("text").over(w)))
    return rows.where(~F.col("to_right") & ~F.col("to_left")).drop("box", "n1", "p1", "p2", "to_right", "to_left")
