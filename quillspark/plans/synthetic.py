"""Document-like inputs made from the driver tables, the same way in Spark and in SQL.

The tables hold no geometry, fonts or regions, so they are derived with integer rules:
``documents`` are pages, those of one source and a range of ``BOOK_IDS`` ids are a book, with
planted running heads, page numbers, italic lines and hyphens at line ends; ``lineitem`` gives layout regions and boxes; ``conversations`` give blocks.
Where a rule is plain SQL, one string serves both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .catalog import table

#: A book's pages come from so many neighbouring ids at most, whatever the input.
BOOK_IDS = 400

LINES_SQL = f"""
pg AS (SELECT coalesce(source, 'none') || '-' || CAST(doc_id // {BOOK_IDS} AS VARCHAR) AS book_id, doc_id, CAST(row_number() OVER (PARTITION BY coalesce(source, 'none'), doc_id // {BOOK_IDS} ORDER BY doc_id) AS INTEGER) AS page, (doc_id % 10) / 10.0 AS image_coverage, coalesce(text, '') AS text FROM documents),
sp AS (SELECT *, list_concat(['Running Head'], string_split(text, chr(10)), [CAST(page + 100 AS VARCHAR)]) AS s FROM pg),
l0 AS (SELECT book_id, page, CAST(unnest(generate_series(0, len(s) - 1)) AS INTEGER) AS line_no, unnest(s) AS text FROM sp),
l1 AS (SELECT book_id, page, line_no, CASE WHEN line_no % 11 = 3 AND text <> '' THEN text || '-' ELSE text END AS text, line_no % 5 IN (2, 3) AS italic FROM l0),
ln AS (SELECT book_id, page, line_no, text, italic, 41.0 + (CASE WHEN line_no % 7 = 0 THEN 12 ELSE 0 END) AS x, 4.0 + 12 * line_no AS y, 5.0 * length(text) AS w, 10.0 AS h, CASE WHEN line_no = 1 THEN 20.0 ELSE 10.0 END AS size FROM l1),
lp AS (SELECT pg.book_id, pg.page, 612.0 AS width, 4.0 + 12 * (len(sp.s) - 1) + 30 AS height, pg.image_coverage FROM pg JOIN sp USING (book_id, page))
"""


def pages_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").selectExpr(f"concat(coalesce(source, 'none'), '-', doc_id div {BOOK_IDS}) as book_id", "doc_id", "coalesce(text, '') as text")
    rows = rows.withColumn("page", F.row_number().over(Window.partitionBy("book_id").orderBy("doc_id")))
    return rows.withColumns({"image_coverage": (F.col("doc_id") % 10) / 10.0, "s": F.concat(F.array(F.lit("Running Head")), F.split("text", "\n"), F.array((F.col("page") + 100).cast("string")))})


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_with_text(spark, sf_dir).select("book_id", "page", F.lit(612.0).alias("width"), (4.0 + 12 * (F.size("s") - 1) + 30).alias("height"), "image_coverage")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one run each."""
    rows = pages_with_text(spark, sf_dir).select("book_id", "page", F.posexplode("s").alias("line_no", "text"))
    n = F.col("line_no")
    rows = rows.withColumn("text", F.when((n % 11 == 3) & (F.col("text") != ""), F.concat("text", F.lit("-"))).otherwise(F.col("text")))
    rows = rows.withColumns({"x": 41.0 + F.when(n % 7 == 0, 12).otherwise(0), "y": 4.0 + 12 * n, "w": 5.0 * F.char_length("text"), "h": F.lit(10.0), "size": F.when(n == 1, 20.0).otherwise(10.0)})
    return rows.withColumn("runs", F.array(F.struct("text", (n % 5).isin(2, 3).alias("italic"), F.lit(False).alias("bold"), "size")))


BLOCKS = """conv_id AS book_id, turn AS pos,
CASE turn % 6 WHEN 0 THEN 'heading' WHEN 1 THEN 'text' WHEN 2 THEN 'image' WHEN 3 THEN 'heading' WHEN 4 THEN 'quote' ELSE 'formula' END AS type,
CAST(1 + (turn * 5 + conv_id) % 4 AS INT) AS level,
CASE WHEN turn % 6 = 1 AND conv_id % 5 = 0 THEN 'running-header' WHEN turn % 6 = 1 AND conv_id % 5 = 1 THEN 'caption' END AS role,
coalesce(text, '') AS text,
CASE WHEN turn % 3 = 0 THEN concat('id-', CAST((turn + conv_id) % 2 AS STRING)) END AS id,
CAST(1 + floor(turn / 2) AS INT) AS page,
CASE WHEN turn % 6 = 2 THEN concat('assets/a', CAST(conv_id % 10 AS STRING), '.png') END AS file"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(*_split(BLOCKS))


BLOCKS_SQL = f"bl AS (SELECT {BLOCKS} FROM conversations)"

IMAGES = "l_orderkey % 40 AS book_id, CAST(1 + l_linenumber AS INT) AS page, l_orderkey AS image_id, CAST(l_quantity * 2 AS DOUBLE) AS w, CAST(l_suppkey % 60 AS DOUBLE) AS h, CAST(l_partkey % 700 AS DOUBLE) AS y, concat('h', CAST(l_partkey % 9 AS STRING)) AS hash"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*_split(IMAGES))


LABELS = ["text", "doc_title", "paragraph_title", "header", "footer", "page_number", "image", "figure_title", "table", "formula", "list", "footnote"]
TEXTS = ["plain words", "", "ALL CAPS", r"$ \tau $ costs $5", "| a | b |\n|---|---|\n| 1 | 2 |", "<table><tr><td>x<td>y</tr><tr><td>z</table>", "1. one\n2. two", r"\[ x^2 \]", "17"]


def _pick(items: list[str], index: str) -> str:
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n") + "'"
    return "CASE " + index + " " + " ".join(f"WHEN {i} THEN {quote(s)}" for i, s in enumerate(items)) + " END"


REGIONS = f"l_orderkey % 50 AS book_id, l_orderkey AS page, l_linenumber AS pos, l_partkey % 12 AS label_no, l_suppkey % 9 AS text_no, CAST(l_linenumber % 3 AS DOUBLE) / 10 AS x, CAST(l_linenumber AS DOUBLE) / 10 AS y, CAST(0.5 AS DOUBLE) AS w, CAST(1 + l_partkey % 9 AS DOUBLE) / 100 AS h"


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey")
    rows = table(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(first)).where("k = 1").selectExpr(*_split(REGIONS))
    return rows.withColumns({"label": F.expr(_pick(LABELS, "label_no")), "text": F.expr(_pick(TEXTS, "text_no"))})


REGIONS_SQL = f"rg AS (SELECT {REGIONS} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS k FROM lineitem) WHERE k = 1)"


def _split(projection: str) -> list[str]:
    """Columns of a projection: commas outside brackets and quotes."""
    out, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(projection):
        if c == "'":
            quoted = not quoted
        elif not quoted and c in "()":
            depth += 1 if c == "(" else -1
        elif c == "," and not depth and not quoted:
            out.append(projection[start:i])
            start = i + 1
    return [*out, projection[start:]]
