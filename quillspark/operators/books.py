"""Whole books: order, ids, page breaks, contents, references, checks, edits.

Blocks have book_id, pos (walk order), type, level, role, text, id, page, pages, caption,
file, image, rows, tex, ordered. Order is data: windows run by (book_id, pos).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T

#: Fixed values.
DEMOTED = ("running-header", "running-footer", "page-number", "artifact")
DIM = (*DEMOTED, "footnote-source", "table-source")
NO_CAPTION, NO_GRID = "(image, no caption)", "kept as a picture — no grid parsed"
COMMON_KEYS = ("type", "id", "role", "page", "pages", "language", "annotations")
OWN_KEYS = {
    "heading": ("level", "text"), "text": ("text",), "quote": ("text", "attribution"), "image": ("file", "caption", "alt"),
    "table": ("rows", "image", "caption", "scanned"), "formula": ("display", "tex", "image", "number", "note"), "list": ("ordered", "items"),
}


def _order():
    return Window.partitionBy("book_id").orderBy("pos")


def demoted(role: Column) -> Column:
    return F.coalesce(role.isin(*DEMOTED), F.lit(False))


def dim(role: Column) -> Column:
    """Roles that an editor shows dimmed: the demoted ones, and sources of notes and tables."""
    return F.coalesce(role.isin(*DIM), F.lit(False))


def first_page(blocks: DataFrame) -> Column:
    """A block's page, or the first of the pages it spans; null without either."""
    return F.coalesce(F.col("page"), F.get("pages", F.lit(0))["page"]) if "pages" in blocks.columns else F.col("page")


def ordered(blocks: DataFrame, arrival: str = "arrival") -> DataFrame:
    """pos by first page (none: 0), then arrival."""
    w = Window.partitionBy("book_id").orderBy("__first", arrival)
    return blocks.withColumn("__first", F.coalesce(first_page(blocks), F.lit(0))).withColumn("pos", F.row_number().over(w) - 1).drop("__first")


def unique_ids(blocks: DataFrame, make=T.slug) -> DataFrame:
    """The first free of s, s-2, s-3, ... for each heading, against all ids before it.

    The n-th heading of a slug gets s-n, unless a heading's own slug looks like that; only
    books with such a slug need a fold over their headings.
    """
    heads = blocks.where("type = 'heading'").select("book_id", "pos", make(F.col("text")).alias("slug"))
    stem = heads.select("book_id", F.regexp_extract("slug", r"^(.+)-[0-9]+$", 1).alias("slug")).where("slug <> ''")
    odd = stem.join(heads.select("book_id", "slug"), ["book_id", "slug"], "left_semi").select("book_id").distinct()
    n = F.row_number().over(Window.partitionBy("book_id", "slug").orderBy("pos"))
    plain = heads.join(odd, "book_id", "left_anti").withColumn("n", n).select("book_id", F.col("pos").cast("long").alias("pos"), F.when(F.col("n") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), F.col("n").cast("string"))).alias("id"))
    per = heads.join(odd, "book_id", "left_semi").groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("pos", "slug"))).alias("h"))
    kind = "struct<used:array<string>,out:array<struct<pos:bigint,id:string>>>"
    start = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast("array<struct<pos:bigint,id:string>>").alias("out")).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        tries = F.concat(F.array(x["slug"]), F.transform(F.sequence(F.lit(2), F.size(acc["used"]) + 2), lambda i: F.concat(x["slug"], F.lit("-"), i.cast("string"))))
        free = F.get(F.array_except(tries, acc["used"]), F.lit(0))
        return F.struct(F.concat(acc["used"], F.array(free)).alias("used"), F.concat(acc["out"], F.array(F.struct(x["pos"].cast("bigint").alias("pos"), free.alias("id")))).alias("out"))

    folded = per.select("book_id", F.explode(F.aggregate("h", start, step)["out"]).alias("o")).select("book_id", "o.pos", "o.id")
    return plain.unionByName(folded)


def place_images(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """For each image the last block (by position) whose first page is not after it.

    Position needn't follow the page, so: the largest position per page, its running
    maximum over pages, and an as-of look-up by a union and a carried value.
    """
    paged = blocks.select("book_id", first_page(blocks).alias("page"), "pos").where("page is not null")
    per_page = paged.groupBy("book_id", "page").agg(F.max("pos").alias("after"))
    both = per_page.select("book_id", "page", F.lit(0).alias("side"), "after", F.lit(None).cast("long").alias("image_id")).unionByName(images.select("book_id", "page", F.lit(1).alias("side"), F.lit(None).cast("long").alias("after"), F.col("image_id").cast("long").alias("image_id")))
    w = Window.partitionBy("book_id").orderBy("page", "side", "image_id").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("after", F.max("after").over(w)).where("side = 1").select("book_id", "image_id", "page", F.coalesce("after", F.lit(-1)).alias("after"))


def page_breaks(spans: DataFrame) -> DataFrame:
    """The first place of every page, in order (spans: book_id, pos, span_no, page, at)."""
    w = Window.partitionBy("book_id", "page").orderBy("pos", "span_no")
    return spans.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def carry_page(blocks: DataFrame) -> DataFrame:
    """``blocks`` with the page last begun at or before each."""
    w = _order().rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("current_page", F.last("break_page", ignorenulls=True).over(w))


def contents_tree(blocks: DataFrame) -> DataFrame:
    """Headings to level 3 with their parent: the nearest earlier heading of a smaller level that is still open."""
    heads = blocks.where("type = 'heading' and level <= 3 and id is not null").where(~demoted(F.col("role")))
    w = _order().rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.max(F.when(F.col("level") == k, F.col("pos"))).over(w) for k in (1, 2)}
    parent = F.when(F.col("level") == 2, last[1]).when(F.col("level") == 3, F.greatest(last[1], last[2]))
    return heads.select("book_id", "pos", "level", "id", "text", parent.alias("parent_pos"))


def duplicate_ids(ids: DataFrame) -> DataFrame:
    """Every repeat of an id in walk order."""
    w = Window.partitionBy("book_id", "id").orderBy("pos")
    return ids.where("id is not null").withColumn("n", F.row_number().over(w)).where("n > 1").select("book_id", "pos", "id")


def id_universe(blocks: DataFrame, footnotes: DataFrame) -> DataFrame:
    return blocks.where("id is not null").select("book_id", "id").union(footnotes.select("book_id", "id")).distinct()


def dangling(links: DataFrame, universe: DataFrame, footnotes: DataFrame) -> DataFrame:
    """Links (book_id, pos, kind, target) that lead nowhere."""
    inner = links.where("kind = 'link'").join(universe.withColumnRenamed("id", "target"), ["book_id", "target"], "left_anti")
    notes = links.where("kind = 'noteref'").join(footnotes.select("book_id", F.col("id").alias("target")), ["book_id", "target"], "left_anti")
    return inner.unionByName(notes).select("book_id", "pos", "kind", "target")


def referenced_assets(books: DataFrame, blocks: DataFrame) -> DataFrame:
    cover = books.select("book_id", F.col("cover").alias("path"))
    fields = blocks.select("book_id", F.explode(F.array("file", "image")).alias("path"))
    return cover.union(fields).where("path is not null").distinct()


def missing_assets(wanted: DataFrame, assets: DataFrame) -> DataFrame:
    return wanted.join(assets.select("book_id", "path"), ["book_id", "path"], "left_anti")


def drop_refused(blocks: DataFrame, assets: DataFrame) -> DataFrame:
    """``blocks`` without images whose bytes nobody wrote."""
    known = assets.select("book_id", F.col("path").alias("file"), F.lit(True).alias("known")).distinct()
    return blocks.join(known, ["book_id", "file"], "left").where((F.col("type") != "image") | F.col("known").isNotNull()).drop("known")


def annotation_issues(rows: DataFrame) -> DataFrame:
    """Annotations (text, start, end, matches) whose offsets select something else."""
    got = F.substring("text", F.col("start") + 1, F.greatest(F.col("end") - F.col("start"), F.lit(0)))
    return rows.withColumn("selected", got).where(F.col("selected") != F.col("matches"))


def schema_issues(raw: DataFrame) -> DataFrame:
    """Checks of a block's own JSON (columns book_id, pos, json): unknown keys, types, ranges, page spans."""
    keys = F.json_object_keys("json")
    kind = F.get_json_object("json", "$.type")
    allowed = F.lit(None).cast("array<string>")
    for name, own in OWN_KEYS.items():
        allowed = F.when(kind == name, F.array(*map(F.lit, (*COMMON_KEYS, *own)))).otherwise(allowed)
    level = F.get_json_object("json", "$.level").try_cast("double")
    page = F.get_json_object("json", "$.page").try_cast("double")
    spans = F.from_json(F.get_json_object("json", "$.pages"), "array<struct<page:int,at:int>>")
    ident = F.get_json_object("json", "$.id")
    tests = [
        (kind.isNull() | ~kind.isin(*OWN_KEYS), F.lit("type")),
        (kind.isin(*OWN_KEYS) & (F.size(F.array_except(keys, allowed)) > 0), F.concat(F.lit("unknown:"), F.array_join(F.array_sort(F.array_except(keys, allowed)), ","))),
        ((kind == "heading") & ~F.coalesce(level.between(1, 6) & (level == F.floor(level)), F.lit(False)), F.lit("level")),
        (kind.isin("heading", "text", "quote") & ~F.array_contains(keys, "text"), F.lit("text")),
        ((kind == "image") & ~F.array_contains(keys, "file"), F.lit("file")),
        (F.array_contains(keys, "page") & ~F.coalesce((page >= 1) & (page == F.floor(page)), F.lit(False)), F.lit("page")),
        (ident.isNotNull() & ~T.id_valid(ident), F.lit("id")),
        (F.array_contains(keys, "page") & F.array_contains(keys, "pages"), F.lit("page-or-pages")),
        (spans.isNotNull() & (F.size(spans) < 2), F.lit("pages-short")),
        (spans.isNotNull() & F.get(spans, F.lit(0))["at"].isNotNull(), F.lit("pages-first-at")),
        (spans.isNotNull() & F.exists(F.transform(spans, lambda s, i: (i > 0) & s["at"].isNull()), lambda x: x), F.lit("pages-at")),
    ]
    found = F.filter(F.array(*(F.when(F.coalesce(test, F.lit(False)), name) for test, name in tests)), lambda x: x.isNotNull())
    return raw.select("book_id", "pos", F.explode(found).alias("issue"))


def describe(kind: Column, level: Column, role: Column, text: Column, caption: Column, rows: Column, tex: Column, n_items: Column) -> Column:
    """What a block is, and the text that stands for it."""
    name = F.when(kind == "heading", F.concat(F.lit("h"), level.cast("string"))).when(kind == "text", F.coalesce(role, F.lit("paragraph"))).when(kind == "image", "figure").otherwise(kind)
    grid = F.concat(F.size(rows).cast("string"), F.lit(" × "), F.coalesce(F.size(F.get(rows, F.lit(0))), F.lit(0)).cast("string"), F.lit(" cells"))
    shown = (
        F.when(kind == "image", F.coalesce(caption, F.lit(NO_CAPTION)))
        .when(kind == "table", F.when(rows.isNotNull(), grid).otherwise(NO_GRID))
        .when(kind == "formula", F.coalesce(tex, F.lit("(image)")))
        .when(kind == "list", F.concat(n_items.cast("string"), F.lit(" items")))
        .otherwise(text)
    )
    return F.struct(name.alias("kind"), shown.alias("text"))


def editable_text(kind: Column, text: Column, caption: Column, tex: Column) -> Column:
    return F.when(kind.isin("heading", "text", "quote"), text).when(kind == "formula", tex).when(kind == "image", F.coalesce(caption, F.lit("")))


def write_back(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """``blocks`` with edited texts (book_id, pos, edited) where ``editable_text`` took them; a blank caption goes."""
    new, kind = F.col("edited"), F.col("type")
    rows = blocks.join(edits.select("book_id", "pos", "edited"), ["book_id", "pos"], "left")
    changed = {
        "text": F.when(new.isNotNull() & kind.isin("heading", "text", "quote"), new).otherwise(F.col("text")),
        "tex": F.when(new.isNotNull() & (kind == "formula"), new).otherwise(F.col("tex")),
        "caption": F.when(new.isNotNull() & (kind == "image"), F.when(T.strip(new) != "", new)).otherwise(F.col("caption")),
    }
    return rows.select(*(changed.get(c, F.col(c)).alias(c) for c in blocks.columns))


def remove(blocks: DataFrame, gone: Column) -> DataFrame:
    """``blocks`` without the marked ones, positions closed up."""
    return blocks.where(~F.coalesce(gone, F.lit(False))).withColumn("pos", (F.row_number().over(_order()) - 1).cast(blocks.schema["pos"].dataType))


def replace(blocks: DataFrame, others: DataFrame) -> DataFrame:
    """``blocks`` with those of ``others`` (same columns) at their positions."""
    return blocks.join(others.select("book_id", "pos"), ["book_id", "pos"], "left_anti").select(*blocks.columns).unionByName(others.select(*blocks.columns))


def move(blocks: DataFrame, moved: Column, down: bool = True) -> DataFrame:
    """``blocks`` with each marked block swapped with its neighbour (marks never touch)."""
    rows = blocks.withColumn("mark", moved)
    here, there = (F.lead, F.lag) if down else (F.lag, F.lead)
    pos = F.when(F.col("mark") & here("pos").over(_order()).isNotNull(), here("pos").over(_order())).when(there("mark").over(_order()), there("pos").over(_order())).otherwise(F.col("pos"))
    return rows.withColumn("new_pos", pos).drop("mark")


def recent(documents: DataFrame, keep: int = 3, order: str = "inserted") -> DataFrame:
    """The last inserted documents; reading does not refresh."""
    return documents.orderBy(F.desc(order)).limit(keep)


def image_dedup(images: DataFrame) -> DataFrame:
    return images.dropDuplicates(["book_id", "hash", "page"]).withColumn("file", F.concat(F.lit("assets/img-"), "hash", F.lit(".png")))


def request_checks(rows: DataFrame) -> DataFrame:
    """Shape of a request: uuid, page, scale, asset name, pages."""
    uuid = F.col("id").rlike(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-8][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}\z")
    return rows.withColumns({"id_ok": uuid, "page_ok": F.coalesce((F.col("page") >= 1) & (F.col("page") == F.floor("page")), F.lit(False)), "scale_ok": F.coalesce(F.col("scale").between(0.2, 3), F.lit(False)), "file_ok": F.col("file").rlike(r"^[A-Za-z0-9._-]+\z"), "pages_ok": F.coalesce((F.size("pages") > 0) & F.forall("pages", lambda p: p >= 1), F.lit(False))})


def stats(blocks: DataFrame) -> DataFrame:
    """Blocks, headings and characters of each book."""
    return blocks.groupBy("book_id").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("type") == "heading").alias("n_headings"), F.sum(F.char_length("text")).alias("n_chars"))


def image_order(images: DataFrame) -> DataFrame:
    """``images`` with their place in their book: by page, then from the top."""
    return images.withColumn("place", F.rank().over(Window.partitionBy("book_id").orderBy("page", "y")).cast("long"))
