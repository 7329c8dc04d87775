"""Scalar text functions as Column expressions; nothing here runs Python on rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Blanks as the document model means them: ASCII, no-break and other Unicode spaces, BOM.
BLANK = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SPECIALS = r"[\\*$\[\]^]"
#: Fixed values.
NAMED_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
MEDIA_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "svg": "image/svg+xml", "css": "text/css"}
VOWELS = "aeiouyàáâäåèéêëìíîïòóôöùúûüæøœ"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def utf16_length(s: Column) -> Column:
    """Length in UTF-16 units, where the model counts those and not code points."""
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")


def strip(s: Column) -> Column:
    return F.regexp_replace(s, f"^[{BLANK}]+|[{BLANK}]+$", "")


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def escape_dialect(s: Column) -> Column:
    return F.regexp_replace(s, SPECIALS, r"\\$0")


def unescape_dialect(s: Column) -> Column:
    """Undoes ``escape_dialect``."""
    return F.regexp_replace(s, r"\\(" + SPECIALS + ")", "$1")


def collapse(s: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(s, f"[{BLANK}]*[\\r\\n]+[{BLANK}]*", " "), f"[{BLANK}]+", " "))


def line_text(s: Column) -> Column:
    return strip(F.regexp_replace(s, f"[{BLANK}]+", " "))


def furniture_key(s: Column) -> Column:
    return F.lower(F.regexp_replace(line_text(s), "[0-9]+", "#"))


def all_caps(s: Column) -> Column:
    return s.rlike(r"\p{Lu}") & ~s.rlike(r"\p{Ll}")


def running_head(s: Column) -> Column:
    return all_caps(s) & s.rlike("[0-9]")


def odd_token(raw: Column) -> Column:
    """Whether a token with a letter looks like damage of recognition."""
    def judge(t: Column) -> Column:
        n = F.char_length(t)
        strange = F.char_length(F.regexp_replace(t, r"[\p{L}\p{N}'’\-]", ""))
        return (
            F.when(t == "", False)
            .when(t.contains("�"), True)
            .when(t.rlike(r"\p{L}[0-9]|[0-9]\p{L}"), True)
            .when((n > 3) & t.rlike(r"^\p{IsLatin}+$") & ~F.lower(t).rlike(f"[{VOWELS}]"), True)
            .otherwise(strange / F.greatest(n, F.lit(1)) > 0.3)
        )

    return let(F.regexp_replace(raw, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""), judge)


def garble_score(s: Column) -> Column:
    """The share of letter-bearing tokens that look damaged; 0 without any.

    Tokens of letters with a vowel among them never do: one pass takes those out, so only
    what is left is judged token by token.
    """
    edge = rf"[^\p{{L}}\p{{N}}{BLANK}]*+"
    sound = rf"(?<![^{BLANK}]){edge}(?=[\p{{L}}'’\-]*(?iu:[{VOWELS}]))[\p{{L}}'’\-]++{edge}(?![^{BLANK}])"
    rest = F.filter(F.split(F.regexp_replace(s, sound, ""), f"[{BLANK}]+"), lambda t: t.rlike(r"\p{L}"))
    total = F.regexp_count(s, F.lit(rf"[^{BLANK}\p{{L}}]*+\p{{L}}[^{BLANK}]*+"))
    return F.when(total > 0, F.size(F.filter(rest, odd_token)) / total).otherwise(0.0)


def verdict(coverage: Column, chars: Column, garble: Column) -> Column:
    sparse = F.when(coverage > 0.3, "scanned").otherwise("no-text")
    return F.when(coverage > 0.8, "scanned").when(chars < 20, sparse).when(garble > 0.4, "scanned").otherwise("native")


def visible_chars(s: Column) -> Column:
    return F.char_length(F.regexp_replace(s, f"[{BLANK}]+", ""))


def italic(font: Column) -> Column:
    return font.rlike(r"(?i)italic|oblique|-it\b|-ital\b")


def bold(font: Column) -> Column:
    return font.rlike(r"(?i)bold|black|heavy|-bd\b|semib")


def slug(s: Column) -> Column:
    """ASCII kebab ids (a heading of other letters still gets an id that validates)."""
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), 1, 40), "^-+|-+$", ""), F.lit("")), F.lit("section"))


def sanitize_id(s: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("x"))


def id_valid(s: Column) -> Column:
    return s.rlike(r"^[a-z0-9]+(-[a-z0-9]+)*\z")


def tex_body(s: Column) -> Column:
    inner = F.regexp_extract(s, r"(?s)^(?:\$\$?|\\\[|\\\()(.*?)(?:\$\$?|\\\]|\\\))\z", 1)
    wrapped = s.rlike(r"(?s)^(?:\$\$?|\\\[|\\\()(.*?)(?:\$\$?|\\\]|\\\))\z")
    return F.when(wrapped, strip(inner)).otherwise(s)


def tex_span(s: Column) -> Column:
    odd = F.char_length(F.regexp_extract(s, r"(\\*)\z", 1)) % 2 == 1
    return (s != "") & ~odd & (s.rlike(r"[\\^_{}]") | (utf16_length(s) <= 3))


def prose(s: Column) -> Column:
    """Escaped text in which spans between dollars that look like TeX stay math.

    The pieces between dollars are folded from left to right: ``open`` holds what a
    dollar has opened and no closing dollar has settled yet.
    """
    def fold(parts: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(None).cast("string").alias("open"))
        last = F.size(parts) - 1

        def step(acc: Column, x: Column) -> Column:
            body = strip(acc["open"])
            return (
                F.when(x["i"] == 0, F.struct(escape_dialect(x["p"]).alias("out"), F.lit(None).cast("string").alias("open")))
                .when(acc["open"].isNull(), F.struct(acc["out"].alias("out"), x["p"].alias("open")))
                .when(tex_span(body), F.struct(F.concat(acc["out"], F.lit("$"), body, F.lit("$"), escape_dialect(x["p"])).alias("out"), F.lit(None).cast("string").alias("open")))
                .otherwise(F.struct(F.concat(acc["out"], F.lit("\\$"), escape_dialect(acc["open"])).alias("out"), x["p"].alias("open")))
            )

        done = lambda acc: F.when(acc["open"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.lit("\\$"), escape_dialect(acc["open"])))
        return F.aggregate(F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i"), (i == last).alias("last"))), start, step, done)

    return let(F.split(collapse(s), r"\$"), fold)


def code_point(n: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(n.cast("int")), 8, "0")), "UTF-32")


def decode_entities(s: Column) -> Column:
    """Decimal, hexadecimal and the named entities; unknown ones stay."""
    def one(part: Column) -> Column:
        body = F.regexp_extract(part, r"^&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z]+);", 1)
        rest = F.substring(part, F.char_length(body) + 3, F.char_length(part))
        hexed = F.lower(F.substring(body, 2, 1)) == "x"
        digits = F.when(hexed, F.conv(F.substring(body, 3, 12), 16, 10)).otherwise(F.substring(body, 2, 12)).try_cast("long")
        named = F.lit(None).cast("string")
        for k, v in NAMED_ENTITIES.items():
            named = F.when(F.lower(body) == k, v).otherwise(named)
        sound = digits.between(1, 0x10FFFF) & ~digits.between(0xD800, 0xDFFF)
        value = F.when(body.startswith("#"), F.when(sound, code_point(F.when(sound, digits).otherwise(65)))).otherwise(named)
        return F.when((body != "") & value.isNotNull(), F.concat(value, rest)).otherwise(part)

    return F.array_join(F.transform(F.split(s, "(?=&)"), one), "")


def trimmed_lines(s: Column) -> Column:
    return F.filter(F.transform(F.split(s, r"\r\n?|\n"), strip), lambda x: x != "")


def markdown_table(s: Column) -> Column:
    """Pipe rows as a grid; null if there is none or rows differ in width."""
    def grid(lines: Column) -> Column:
        cells = F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|"), prose))
        rows = F.filter(cells, lambda r: ~F.forall(r, lambda c: c.rlike("^:?-{3,}:?$")))
        fit = lambda r: F.when((F.size(lines) >= 2) & F.exists(lines, lambda x: x.contains("|")) & (F.size(r) > 0) & F.forall(r, lambda x: F.size(x) == F.size(F.get(r, F.lit(0)))), r)
        return let(rows, fit)

    return let(trimmed_lines(s), grid)


def html_table(s: Column) -> Column:
    """Rows of an HTML table, short rows padded; null for spans, no table or no text."""
    spans = s.rlike(r"(?i)\b(?:colspan|rowspan)\s*=\s*[\"']?\s*(?:[2-9]|[0-9][0-9])")
    rows = F.regexp_extract_all(s, F.lit(r"(?is)<tr\b[^>]*>(.*?)(?:</tr\s*>|\z)"), F.lit(1))
    cell = lambda c: prose(decode_entities(F.regexp_replace(c, "<[^>]*>", " ")))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)(?=</t[dh]\s*>|<t[dh]\b|</tr\s*>|\z)"), F.lit(1)), cell))

    def pad(grid: Column) -> Column:
        width = F.array_max(F.transform(grid, F.size))
        full = F.transform(grid, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
        return F.when((F.size(grid) > 0) & (width > 0) & F.exists(grid, lambda r: F.exists(r, lambda c: c != "")), full)

    return F.when(s.rlike(r"(?i)<table[\s>]") & ~spans, let(cells, pad))


def table_rows(s: Column) -> Column:
    return F.coalesce(html_table(s), markdown_table(s))


def list_items(s: Column) -> Column:
    return F.filter(F.transform(F.split(s, r"\n+"), lambda x: strip(F.regexp_replace(x, r"^\s*(?:[-*•]|[0-9]+[.)])\s*", ""))), lambda x: x != "")


def list_ordered(s: Column) -> Column:
    return s.rlike(r"^\s*[0-9]+[.)]")


def crop_name(page: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    box = F.concat_ws(",", *(F.format_string("%.4f", c.cast("double")) for c in (x, y, w, h)))
    return F.concat(F.lit("assets/fig-"), page.cast("string"), F.lit("-"), F.substring(F.sha1(F.concat(page.cast("string"), F.lit("|"), box)), 1, 12), F.lit(".png"))


def escape_xml(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def media_type(path: Column) -> Column:
    """Null where no type is known."""
    ext = F.lower(F.element_at(F.split(path, r"\."), -1))
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in MEDIA_TYPES.items() for x in kv)), ext)


def normalize_src(s: Column) -> Column:
    return F.regexp_replace(s, r"^(?:\.\.?/)+", "")


def download_name(name: Column, extension: str) -> Column:
    return F.concat(F.regexp_replace(name, r"\.[^.]+$", ""), F.lit("." + extension))


def format_bytes(n: Column) -> Column:
    power = sum(((n >= 1024**k).cast("int") for k in range(2, 5)), (n >= 1024).cast("int"))
    value = n / F.pow(F.lit(1024.0), power)
    unit = F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB"))), power + 1)
    tenths = round_half_up(value * 10) / 10
    shown = F.when((value < 10) & (power > 1), F.format_string("%.1f", tenths)).otherwise(round_half_up(value).cast("string"))
    return F.when(n <= 0, "0 B").otherwise(F.concat(shown, F.lit(" "), unit))


def format_duration(ms: Column) -> Column:
    seconds = round_half_up(ms / 1000)
    minutes = round_half_up(seconds / 60)
    hours = F.floor(minutes / 60)
    rest = round_half_up((minutes - hours * 60) / 5) * 5
    return (
        F.when(ms < 1000, "under a second")
        .when(seconds < 10, F.concat(F.format_string("%.1f", round_half_up(ms / 100) / 10), F.lit(" sec")))
        .when(seconds < 60, F.concat(seconds.cast("string"), F.lit(" sec")))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min")))
        .when(rest == 0, F.concat(hours.cast("string"), F.lit(" h")))
        .when(rest == 60, F.concat((hours + 1).cast("string"), F.lit(" h")))
        .otherwise(F.concat(hours.cast("string"), F.lit(" h "), rest.cast("string"), F.lit(" min")))
    )


def format_clock(ms: Column) -> Column:
    total = F.greatest(F.lit(0), round_half_up(ms / 1000))
    h, m, s = F.floor(total / 3600), F.floor(total / 60) % 60, total % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(ms.isNull(), None).when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(s))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(s)))


def sniff_kind(name: Column, head: Column) -> Column:
    """By the first bytes (two are enough) and the name."""
    first = F.substring(head, 1, 2)
    return F.when(F.octet_length(head) == 0, "empty").when(F.hex(first) == "504B", "epub").when((F.hex(F.substring(head, 1, 1)) == "7B") | F.lower(name).endswith(".json"), "book").otherwise("pdf")


def page_spec_strict(spec: Column) -> Column:
    """Sorted distinct pages, or null if any part is malformed, starts at 0, descends or is too long."""
    parts = F.transform(F.split(spec, ","), strip)
    first = lambda p: F.regexp_extract(p, "^([0-9]{1,9})(?:-([0-9]{1,9}))?$", 1)
    second = lambda p: F.regexp_extract(p, "^([0-9]{1,9})(?:-([0-9]{1,9}))?$", 2)
    bounds = F.transform(parts, lambda p: F.struct(first(p).try_cast("int").alias("a"), F.coalesce(second(p).try_cast("int"), first(p).try_cast("int")).alias("b")))
    sound = F.forall(bounds, lambda r: r["a"].isNotNull() & (r["a"] >= 1) & (r["b"] >= r["a"]) & (r["b"] - r["a"] <= 10_000))
    pages = F.flatten(F.transform(bounds, lambda r: F.when(r["b"] >= r["a"], F.sequence(r["a"], r["b"])).otherwise(F.array().cast("array<int>"))))
    return F.when(sound, F.array_sort(F.array_distinct(pages)))


def page_spec_lenient(spec: Column, most: Column) -> Column:
    """Pages named by the sound parts, clamped to 1..most; all else is skipped."""
    pattern = f"^[{BLANK}]*([0-9]{{1,9}})[{BLANK}]*(?:-[{BLANK}]*([0-9]{{1,9}})[{BLANK}]*)?$"
    bounds = F.transform(F.filter(F.split(spec, ","), lambda p: p.rlike(pattern)), lambda p: F.struct(F.greatest(F.lit(1), F.regexp_extract(p, pattern, 1).cast("int")).alias("a"), F.least(most, F.coalesce(F.regexp_extract(p, pattern, 2).try_cast("int"), F.regexp_extract(p, pattern, 1).cast("int"))).alias("b")))
    pages = F.flatten(F.transform(bounds, lambda r: F.when(r["b"] >= r["a"], F.sequence(r["a"], r["b"])).otherwise(F.array().cast("array<int>"))))
    return F.array_sort(F.array_distinct(pages))
