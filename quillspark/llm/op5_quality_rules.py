"""Quality rules by distribution divergence.

Of each document the characters are counted by class and the words by whether they
are one of its language's commonest. Summed over all documents of a language these
counts are its reference. A document whose histogram is far from the reference, by
Jensen-Shannon distance (base 2, from 0 to 1), is not kept; distances are only judged
on documents long enough for them to mean something. Counting rules come first.

One pass reads the texts and leaves a narrow table of counts per document; references
and verdicts come from that table, references are one row a language. Only DataFrame
functions run; a text never leaves its row, so nothing is shuffled but counts.

Null and empty texts have no words and fail. A language that is null or has no list of
common words is judged by character classes alone. Equal rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .durable import keep

WINDOW = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30
#: Guards: below these a distance isn't judged.
GUARD_CHARS, GUARD_WORDS = 200, 60
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.28, 0.28
#: Function words of each language.
COMMON = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une"],
}
_BLANK = r"[\x20\x09-\x0D]+"
_CLASSES = {"upper": r"\p{Lu}", "digit": r"[0-9]", "blank": r"[\x20\x09-\x0D]", "stop": r"[.,;:!?'\"()\-]"}


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """How many words lie in windows that occur twice or more."""

    def spread(windows: Column) -> Column:
        def places(pairs: Column) -> Column:
            near = lambda x, k: (F.get(pairs, k - 1)["h"] == x["h"]) | (F.get(pairs, k + 1)["h"] == x["h"])
            at = F.array_sort(F.transform(F.filter(pairs, lambda x, k: F.coalesce(near(x, k), (F.get(pairs, k + 1)["h"] == x["h"]), (F.get(pairs, k - 1)["h"] == x["h"]), F.lit(False))), lambda x: x["i"]))
            start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
            return F.aggregate(at, start, lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["n"] + (i + WINDOW - F.greatest(i, acc["end"]))).cast("long").alias("n")), lambda acc: acc["n"])

        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), _let(pairs, places)).otherwise(F.lit(0).cast("long"))

    def rolled(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))

    windows = _let(F.transform(words, lambda w: F.xxhash64(w)), rolled)
    return F.when(F.size(words) >= WINDOW, _let(windows, spread)).otherwise(F.lit(0).cast("long"))


def counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The narrow table: base counts, character classes and common words of each document."""
    lists = F.create_map(*(x for k, v in COMMON.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    lined = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    cut = own.withColumns({"words": F.array_remove(F.split("text", _BLANK), ""), "lines": lined, "low": F.split(F.lower("text"), _BLANK), "common": F.try_element_at(lists, F.col("lang"))})
    one = cut.select(
        "doc_id", "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length("text").cast("long").alias("n_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        *(F.regexp_count("text", F.lit(p)).cast("long").alias(k) for k, p in _CLASSES.items()),
        F.array(*((F.size("low") - F.size(F.array_remove("low", F.get("common", k)))).cast("long") for k in range(10))).alias("common"),
    )
    classes = F.array("upper", "digit", "blank", "stop", "n_symbols", F.col("n_chars") - F.col("upper") - F.col("digit") - F.col("blank") - F.col("stop") - F.col("n_symbols"))
    listed = F.col("lang").isin(*COMMON)
    hits = F.aggregate("common", F.lit(0).cast("long"), lambda a, x: a + x)
    return one.select("doc_id", "lang", "n_words", "n_chars", (F.col("n_chars") - F.col("blank")).alias("word_chars"), "n_symbols", "n_dup_lines", "n_repeat_words", classes.alias("classes"), F.when(listed, F.concat("common", F.array(F.col("n_words") - hits))).alias("common"))


def references(table: DataFrame) -> DataFrame:
    """One row a language: summed classes and common words."""
    total = lambda column, n: F.array(*(F.sum(F.get(column, k)).cast("double") for k in range(n)))
    return table.groupBy(F.coalesce("lang", F.lit("")).alias("ref_lang")).agg(total("classes", 6).alias("ref_classes"), total("common", 11).alias("ref_common"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts; null if either is empty."""
    whole = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def of(x: Column, y: Column) -> Column:
        m = (x + y) / 2
        return (term(x, m) + term(y, m)) / 2

    a, b = whole(p), whole(q)
    parts = F.zip_with(p, q, lambda x, y: of(x.cast("double") / a, y / b))
    return F.when((a > 0) & (b > 0), F.sqrt(F.greatest(F.lit(0.0), whole(parts))))


def judge(docs: DataFrame, **names) -> DataFrame:
    """Counts, both distances and the verdict of each document."""
    table = keep(counts(docs, **names))
    known = references(table)
    joined = table.withColumn("ref_lang", F.coalesce("lang", F.lit(""))).join(known, "ref_lang", "left")
    far = joined.withColumns({"char_distance": distance(F.col("classes"), F.col("ref_classes")), "word_distance": F.when(F.col("common").isNotNull(), distance(F.col("common"), F.col("ref_common")))})
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    odd_chars = (F.col("n_chars") >= GUARD_CHARS) & (F.col("char_distance") > MAX_CHAR_DISTANCE)
    odd_words = (F.col("n_words") >= GUARD_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE)
    return far.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance", base.alias("base_failed"), (~base & ~F.coalesce(odd_chars, F.lit(False)) & ~F.coalesce(odd_words, F.lit(False))).alias("kept"))


def report(docs: DataFrame) -> DataFrame:
    return judge(docs).drop("char_distance", "word_distance")


def _sql() -> str:
    common = "\n".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in sorted(COMMON.items()))
    classes = ", ".join(f"len(regexp_extract_all(t, '{p}'))" for p in (r"\p{Lu}", r"[0-9]", r"[\x20\x09-\x0D]", r"[.,;:!?''\"()\-]", r"[#*$%&|<>]"))
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
      regexp_extract_all(lower(t), '[^\x20\x09-\x0D]+') AS lw, CASE lang {common} END AS c FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM w, unnest(generate_series(1, len(w) - 7)) AS u(i) WHERE len(w) >= 8),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM win JOIN (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1) USING (doc_id, g)) GROUP BY doc_id),
n AS (SELECT doc_id, lang, len(w) AS n_words, length(t) AS n_chars, len(l) - len(list_distinct(l)) AS dup, [{classes}] AS k5,
      CASE WHEN c IS NOT NULL THEN list_transform(c, lambda x: len(list_filter(lw, lambda y: y = x))) END AS k10 FROM w),
m AS (SELECT *, list_concat(k5, [n_chars - CAST(list_sum(k5) AS BIGINT)]) AS classes, CASE WHEN k10 IS NOT NULL THEN list_concat(k10, [n_words - CAST(list_sum(k10) AS BIGINT)]) END AS common FROM n),
cell AS (SELECT doc_id, coalesce(lang, '') AS lang, 'c' AS kind, unnest(generate_series(1, 6)) AS i, unnest(classes) AS x FROM m
         UNION ALL SELECT doc_id, coalesce(lang, ''), 'w', unnest(generate_series(1, 11)), unnest(common) FROM m WHERE common IS NOT NULL),
ref AS (SELECT lang, kind, i, sum(x) / sum(sum(x)) OVER (PARTITION BY lang, kind) AS q FROM cell GROUP BY lang, kind, i),
own AS (SELECT doc_id, lang, kind, i, x / nullif(sum(x) OVER (PARTITION BY doc_id, kind), 0) AS p FROM cell),
far AS (SELECT doc_id, kind, sqrt(greatest(0.0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS j
        FROM own JOIN ref USING (lang, kind, i) WHERE p IS NOT NULL AND q IS NOT NULL GROUP BY doc_id, kind),
f AS (SELECT m.*, coalesce(rep.n, 0) AS n_rep, fc.j AS jc, fw.j AS jw FROM m LEFT JOIN rep USING (doc_id) LEFT JOIN far fc ON fc.doc_id = m.doc_id AND fc.kind = 'c' LEFT JOIN far fw ON fw.doc_id = m.doc_id AND fw.kind = 'w'),
v AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_rep > {REPEAT_PERCENT} * n_words AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_chars - k5[3] AS BIGINT) AS word_chars, CAST(k5[5] AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines, CAST(n_rep AS BIGINT) AS n_repeat_words,
       base_failed, NOT base_failed AND NOT coalesce(n_chars >= {GUARD_CHARS} AND jc > {MAX_CHAR_DISTANCE}, false) AND NOT coalesce(n_words >= {GUARD_WORDS} AND jw > {MAX_WORD_DISTANCE}, false) AS kept
FROM v
"""


SQL = _sql()
