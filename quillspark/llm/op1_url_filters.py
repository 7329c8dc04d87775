"""URL filters: a temporal list join.

Dated list entries (add or remove a pattern of a list) become validity intervals; a
capture is judged by the entries that were active when it was fetched. A pattern is a
domain, which covers its subdomains, or a host with a path prefix that ends in '/'.

Each capture has a few keys: its host, the host's parent domains, and its path
prefixes. Keys meet patterns by equality, so the as-of condition is checked only
where the pattern already fits. Intervals are gathered per pattern before the join
(one row a pattern), so the join never multiplies captures, and Spark may broadcast
the list side if its size allows or split a host that a third of all captures share.
Only DataFrame functions run.

A capture is judged by its URL and time, so repeated captures are looked up once and
keep a row each. Verdict columns whose name a capture has get underscores behind theirs.
Null or empty URLs, URLs without a host and captures without a time match nothing and
pass. Repeated entries count once; of entries of one moment a removal wins. Entries with null pattern, time or action are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .durable import free_name


def host(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; null if there is none."""
    found = F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.lower(F.regexp_replace(found, r"\.+$", "")), F.lit(""))


def path(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*(/[^?#]*)", 1)


def keys(host_: Column, path_: Column) -> Column:
    """Host, parent domains, and host with every path prefix, as strings to look up."""
    parts = F.split(host_, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    steps = F.split(path_, "/")
    depth = F.size(steps) - 1
    prefixes = F.when(depth >= 1, F.transform(F.sequence(F.lit(1), depth), lambda i: F.concat(host_, F.array_join(F.slice(steps, 1, i), "/"), F.lit("/"))))
    return F.when(host_.isNotNull(), F.array_distinct(F.concat(domains, F.coalesce(prefixes, F.array().cast("array<string>")))))


def intervals(entries: DataFrame) -> DataFrame:
    """list, pattern, action ('add' or 'remove'), at -> list, pattern, since, until (null: still active)."""
    clean = entries.select("list", F.lower(F.trim("pattern")).alias("pattern"), (F.lower("action") == "add").alias("on"), "at").where("pattern is not null and pattern <> '' and at is not null and on is not null")
    moments = clean.groupBy("list", "pattern", "at").agg(F.min("on").alias("on"))
    w = Window.partitionBy("list", "pattern").orderBy("at")
    turns = moments.withColumn("before", F.lag("on").over(w)).where("before is null and on or before <> on")
    return turns.withColumn("until", F.lead("at").over(w)).where("on").select("list", "pattern", F.col("at").alias("since"), "until")


VERDICT = ("host", "n_active", "active_pattern", "active_lists", "blocked")


def evaluate(captures: DataFrame, entries: DataFrame, *, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """``captures`` with ``VERDICT``: host, n_active, active_pattern (the longest), active_lists and blocked."""
    listed = intervals(entries).groupBy("pattern").agg(F.collect_list(F.struct("list", "since", "until")).alias("spans"))
    asked = captures.select(F.col(url).alias("__url"), F.col(at).alias("__at")).where("__url is not null and __at is not null").distinct()
    looked = asked.withColumn("pattern", F.explode(keys(host(F.col("__url")), path(F.col("__url")))))
    active = looked.join(listed, "pattern").withColumn("spans", F.filter("spans", lambda s: (s["since"] <= F.col("__at")) & (s["until"].isNull() | (s["until"] > F.col("__at"))))).where(F.size("spans") > 0)
    found = active.groupBy("__url", "__at").agg(
        F.sum(F.size("spans")).cast("long").alias("__n"),
        F.max(F.struct(F.length("pattern").alias("n"), F.col("pattern").alias("p"))).alias("__best"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("spans", lambda s: s["list"]))))).alias("__lists"),
    )
    own, names = captures.columns, [free_name(captures.columns, c) for c in VERDICT]
    joined = captures.join(found, (captures[url] == found["__url"]) & (captures[at] == found["__at"]), "left")
    told = (host(captures[url]), F.coalesce("__n", F.lit(0).cast("long")), F.col("__best.p"), F.array_join("__lists", ","), F.coalesce(F.col("__n") > 0, F.lit(False)))
    return joined.select(*(captures[c] for c in own), *(v.alias(c) for v, c in zip(told, names, strict=True)))


def kept(captures: DataFrame, entries: DataFrame, **names) -> DataFrame:
    """The captures that pass, with their own columns."""
    return evaluate(captures, entries, **names).where(~F.col(free_name(captures.columns, "blocked"))).select(*captures.columns)


def demo_captures(pages: DataFrame) -> DataFrame:
    """``pages`` hold no fetch times; each page gets a day of 2024 from its id."""
    return pages.select("page_id", "url", F.expr("cast(date_add(date'2024-01-01', cast(pmod(page_id * 37, 366) as int)) as timestamp)").alias("fetched_at"))


def demo_entries(pages: DataFrame) -> DataFrame:
    """``pages`` hold no lists either; two lists are dated from hashes of the hosts and first folders that occur."""
    seen = pages.select(host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).where("host is not null")
    domains = seen.select("host", F.lit("spam").alias("list")).distinct().withColumnRenamed("host", "pattern")
    folders = seen.select(F.concat("host", F.regexp_extract("path", r"^(/[^/]+/)", 1)).alias("pattern"), F.lit("legal").alias("list")).where("pattern like '%/'").distinct()
    c = F.conv(F.substring(F.md5(F.encode("pattern", "UTF-8")), 1, 7), 16, 10).cast("long")
    hashed = domains.union(folders).withColumn("c", c).where("c % 3 <> 0")
    steps = F.array(*(F.struct(F.lit(a).alias("action"), d.cast("int").alias("day"), ok.alias("ok")) for a, d, ok in (("add", F.col("c") % 200, F.lit(True)), ("remove", F.col("c") % 200 + 30 + F.col("c") % 50, F.col("c") % 2 == 0), ("add", F.col("c") % 200 + 120, F.col("c") % 5 == 0))))
    dated = hashed.select("list", "pattern", F.explode(steps).alias("s")).where("s.ok")
    return dated.select("list", "pattern", "s.action", F.expr("cast(date_add(date'2024-01-01', s.day) as timestamp)").alias("at"))


def report(pages: DataFrame) -> DataFrame:
    """The verdict on every page."""
    out = evaluate(demo_captures(pages), demo_entries(pages))
    return out.select("page_id", "host", "n_active", "active_pattern", "active_lists", "blocked")


SQL = r"""
WITH cap AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS TIMESTAMP) AS fetched_at,
         nullif(lower(regexp_replace(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)', 1), '\.+$', '')), '') AS host,
         regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages),
pat AS (
  SELECT DISTINCT 'spam' AS list, host AS pattern FROM cap WHERE host IS NOT NULL
  UNION SELECT DISTINCT 'legal', host || regexp_extract(path, '^(/[^/]+/)', 1) FROM cap WHERE host IS NOT NULL AND regexp_extract(path, '^(/[^/]+/)', 1) <> ''),
crc AS (SELECT list, pattern, CAST('0x' || substr(md5(pattern), 1, 7) AS BIGINT) AS c FROM pat),
ent AS (
  SELECT list, pattern, true AS act, c % 200 AS day FROM crc WHERE c % 3 <> 0
  UNION ALL SELECT list, pattern, false, c % 200 + 30 + c % 50 FROM crc WHERE c % 3 <> 0 AND c % 2 = 0
  UNION ALL SELECT list, pattern, true, c % 200 + 120 FROM crc WHERE c % 3 <> 0 AND c % 5 = 0),
mom AS (SELECT list, pattern, CAST(DATE '2024-01-01' + CAST(day AS INTEGER) AS TIMESTAMP) AS tm, bool_and(act) AS act FROM ent GROUP BY ALL),
turn AS (SELECT *, lag(act) OVER w AS before FROM mom WINDOW w AS (PARTITION BY list, pattern ORDER BY tm)),
span AS (SELECT list, pattern, act, tm AS since, lead(tm) OVER (PARTITION BY list, pattern ORDER BY tm) AS until FROM turn WHERE (before IS NULL AND act) OR before <> act),
parts AS (SELECT page_id, fetched_at, host, string_split(host, '.') AS p, string_split(path, '/') AS s FROM cap WHERE host IS NOT NULL),
look AS (
  SELECT page_id, fetched_at, array_to_string(p[i:], '.') AS pattern FROM parts, unnest(generate_series(1, len(p))) AS u(i)
  UNION SELECT page_id, fetched_at, host || array_to_string(s[1:i], '/') || '/' FROM parts, unnest(generate_series(1, len(s) - 1)) AS u(i)),
hit AS (SELECT page_id, list, look.pattern FROM look JOIN span ON look.pattern = span.pattern AND act AND since <= fetched_at AND (until IS NULL OR until > fetched_at)),
agg AS (SELECT page_id, count(*) AS n, max({'n': length(pattern), 'p': pattern}).p AS best, array_to_string(list_sort(list(DISTINCT list)), ',') AS lists FROM hit GROUP BY page_id)
SELECT page_id, host, CAST(coalesce(n, 0) AS BIGINT) AS n_active, best AS active_pattern, lists AS active_lists, coalesce(n, 0) > 0 AS blocked FROM cap LEFT JOIN agg USING (page_id)
"""
