"""Queries of job events, web pages and written books."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import epub, xhtml
from ..streaming import jobs as J
from . import synthetic as S
from .catalog import query, table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), "event_id", "ts", F.col("event_type").alias("type"), "value")


@query("job_latest", "SELECT user_id AS job, arg_max(event_type, (ts, event_id)) AS type, max(ts) AS ts, count(*) AS n_events FROM events GROUP BY user_id")
def job_latest(spark, sf_dir):
    return J.latest(_events(spark, sf_dir))


@query("warm_sessions", "WITH e AS (SELECT user_id AS job, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY job ORDER BY ts) AS k FROM e) SELECT job, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY job, k")
def warm_sessions(spark, sf_dir):
    return J.sessions(_events(spark, sf_dir))


@query("job_eta", "SELECT event_id, CASE WHEN event_id % 7 > 0 THEN CAST(value * 100 / (event_id % 7) * (9 - event_id % 7) AS DOUBLE) ELSE greatest(0.0, 5000.0 - value * 100) END AS eta FROM events")
def job_eta(spark, sf_dir):
    done = F.col("event_id") % 7
    return _events(spark, sf_dir).select("event_id", J.eta(done, F.lit(9), F.col("value") * 100, F.lit(5000.0)).alias("eta"))


@query("frame_reassembly", "WITH w AS (SELECT conv_id AS channel, string_agg(concat(coalesce(text, ''), CASE WHEN turn % 2 = 1 THEN chr(10) ELSE '' END), '' ORDER BY turn) AS a FROM conversations GROUP BY conv_id), l AS (SELECT channel, string_split(a, chr(10)) AS s FROM w), u AS (SELECT channel, unnest(generate_series(0, len(s) - 2)) AS line_no, unnest(s[1:len(s) - 1]) AS line FROM l WHERE len(s) > 1) SELECT channel, CAST(line_no AS INT) AS line_no, line FROM u WHERE line <> ''")
def frame_reassembly(spark, sf_dir):
    chunks = table(spark, sf_dir, "conversations").selectExpr("conv_id AS channel", "turn AS seq", "concat(coalesce(text, ''), CASE WHEN turn % 2 = 1 THEN '\\n' ELSE '' END) AS data")
    return J.frames(chunks)


@query("reply_match", "SELECT a.event_id AS id, a.ts AS asked, b.ts AS answered FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.event_id % 2 = 0")
def reply_match(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    asked = e.where("event_id % 2 = 0").select(F.col("event_id").alias("id"), F.col("ts").alias("asked"))
    return J.replies(asked, e.select((F.col("event_id") - 1).alias("id"), F.col("ts").alias("answered")))


@query("html_blocks")
def html_blocks(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "html").mapInPandas(xhtml.blocks_of("page_id"), "page_id long, " + xhtml.SCHEMA)


@query("html_inline")
def html_inline(spark, sf_dir):
    return html_blocks(spark, sf_dir).where("type in ('text', 'heading', 'quote')").select("page_id", "pos", "text")


@query("render_xhtml", f"""WITH {S.BLOCKS_SQL} SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY pos) - 1 AS INT) AS pos, type, CASE WHEN type = 'heading' THEN level END AS level, CASE WHEN type IN ('heading', 'text', 'quote') THEN trim(regexp_replace(concat('t ', text), '[ \t\n\r\f\v]+', ' ', 'g'), ' ') END AS text,
file, CASE WHEN type = 'formula' THEN concat('x_', CAST(pos AS VARCHAR)) END AS tex, page FROM bl""")
def render_xhtml(spark, sf_dir):
    """Every book written as EPUB with its images and read back: all its blocks and texts survive."""
    blocks = S.blocks(spark, sf_dir)
    worded, kind = F.col("type").isin("heading", "text", "quote"), F.col("type")
    own = F.struct("type", F.when(kind == "heading", F.col("level")).alias("level"), F.when(worded, F.concat(F.lit("t "), T.escape_dialect(F.col("text")))).alias("text"), "file", F.when(kind == "formula", F.concat(F.lit("x_"), F.col("pos").cast("string"))).alias("tex"), "page")
    books = blocks.groupBy("book_id").agg(F.to_json(F.struct(F.lit("B").alias("title"), F.lit("en").alias("language"), F.transform(F.array_sort(F.collect_list(F.struct("pos", own.alias("b")))), lambda x: x["b"]).alias("content"))).alias("json"))
    assets = blocks.where("file is not null").select("book_id", F.col("file").alias("path"), F.encode("file", "UTF-8").alias("content")).distinct()
    files = epub.write_books(books, assets).select(F.col("book_id").cast("string").alias("path"), F.col("epub").alias("content"))
    found = F.from_json(F.get_json_object("json", "$.content"), "array<struct<type:string,level:int,text:string,file:string,tex:string,page:int>>")
    back = epub.read_books(files).select(F.col("path").cast("long").alias("book_id"), F.posexplode(found).alias("pos", "b")).select("book_id", "pos", "b.*")
    return back.withColumn("text", T.unescape_dialect(F.col("text")))
