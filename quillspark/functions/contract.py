"""What a book may hold: shapes by table, and the checks across a whole book.

``issues`` first holds a book against ``SHAPES``; only a book of right shape is checked
further: ids, inline syntax, references and annotations. It never raises.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .inline import InlineError, parse

Check = Callable[[object, tuple], Iterator[tuple[tuple, str]]]
_IDENT = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")


def _is(kind: type | tuple, name: str, fits: Callable = lambda v: True) -> Check:
    def check(value, path):
        if not isinstance(value, kind) or isinstance(value, bool) and kind is not bool or not fits(value):
            yield path, f"expected {name}"

    return check


def _whole(least: int, most: float = float("inf")) -> Check:
    ok = lambda v: float(v).is_integer() and least <= v <= most
    return _is((int, float), f"an integer from {least}" + (f" to {most}" if most < float("inf") else ""), ok)


def _list(item: Check) -> Check:
    def check(value, path):
        if not isinstance(value, list):
            yield path, "expected a list"
            return
        for i, v in enumerate(value):
            yield from item(v, (*path, i))

    return check


def _or_null(check: Check) -> Check:
    return lambda value, path: iter(()) if value is None else check(value, path)


def _record(fields: dict[str, Check]) -> Check:
    """Fields by name; those whose name ends in '?' may be missing; no others."""
    known = {k.rstrip("?"): v for k, v in fields.items()}
    needed = {k for k in fields if not k.endswith("?")}

    def check(value, path):
        if not isinstance(value, dict):
            yield path, "expected an object"
            return
        for k in sorted(set(value) - set(known)):
            yield (*path, k), "unknown key"
        for k in sorted(needed - set(value)):
            yield (*path, k), "missing"
        for k in value:
            if k in known:
                yield from known[k](value[k], (*path, k))

    return check


def _spans(value, path):
    yield from _list(_record({"page": _whole(1), "at?": _whole(1)}))(value, path)
    if isinstance(value, list) and all(isinstance(s, dict) for s in value):
        if len(value) < 2:
            yield path, "fewer than two pages"
        for i, s in enumerate(value):
            if ("at" in s) != (i > 0):
                yield (*path, i, "at"), "only entries after the first have an offset"


_text, _flag = _is(str, "a string"), _is(bool, "true or false")
_word = _is(str, "a string that isn't empty", bool)
_name = _is(str, "an id of lower-case words joined by hyphens", _IDENT.fullmatch)
_note_mark = {"start": _whole(0), "end": _whole(1), "matches": _word, "language?": _text, "style?": _is(str, "small-caps", lambda v: v == "small-caps")}
_any_block: Check = lambda value, path: _block(value, path)
_common = {"type": _text, "id?": _name, "role?": _text, "page?": _whole(1), "pages?": _spans, "language?": _text, "annotations?": _list(_record(_note_mark))}
#: The kinds of blocks and their fields.
SHAPES = {
    "heading": {"level": _whole(1, 6), "text": _text},
    "text": {"text": _text},
    "quote": {"text": _text, "attribution?": _text},
    "image": {"file": _text, "caption?": _text, "alt?": _text},
    "table": {"rows": _or_null(_list(_list(_text))), "image?": _text, "caption?": _text, "scanned?": _flag},
    "formula": {"display": _flag, "tex": _or_null(_text), "image?": _text, "number?": _text, "note?": _text},
    "list": {"ordered": _flag, "items": _list(_list(_any_block))},
}
_shape = {kind: _record(_common | fields) for kind, fields in SHAPES.items()}


def _block(value, path):
    kind = value.get("type") if isinstance(value, dict) else None
    if not isinstance(kind, str) or kind not in _shape:
        yield (*path, "type"), "unknown type of block"
        return
    yield from _shape[kind](value, path)
    if "page" in value and "pages" in value:
        yield (*path, "pages"), "a block has a page or pages, not both"


def _notes(value, path):
    if not isinstance(value, dict):
        yield path, "expected an object"
        return
    for k, note in value.items():
        yield from _name(k, (*path, k))
        yield from _record({"label": _word, "blocks": _list(_block)})(note, (*path, k))


_book = _record({"title": _word, "author?": _text, "language": _is(str, "a language", lambda v: len(v) > 1), "cover?": _text, "content": _list(_block), "footnotes?": _notes})


def walk(book: dict) -> Iterator[tuple[tuple, dict]]:
    """(path, block) of every block, those of list items and footnotes too, outer ones first."""

    def below(blocks, path):
        for i, b in enumerate(blocks):
            yield (*path, i), b
            if b["type"] == "list":
                for k, item in enumerate(b["items"]):
                    yield from below(item, (*path, i, "items", k))

    yield from below(book["content"], ("content",))
    for name, note in (book.get("footnotes") or {}).items():
        yield from below(note["blocks"], ("footnotes", name, "blocks"))


def _nodes(nodes: list[dict]) -> Iterator[dict]:
    for n in nodes:
        yield n
        yield from _nodes(n.get("children", []))


def _sources(b: dict) -> Iterator[tuple[tuple, str]]:
    yield from (((k,), b[k]) for k in ("text", "caption") if b.get(k) is not None)
    yield from ((("rows", r, c), cell) for r, row in enumerate(b.get("rows") or ()) for c, cell in enumerate(row))


def issues(book: object) -> list[tuple[tuple, str]]:
    """(path, what is wrong) of a book as read from JSON."""
    if found := list(_book(book, ())):
        return found
    notes = book.get("footnotes") or {}
    seen: set[str] = set()
    named = [*(((*p, "id"), b["id"]) for p, b in walk(book) if "id" in b), *((("footnotes", k), k) for k in notes)]
    for path, name in named:
        if name in seen:
            found.append((path, f"id {name} is used twice"))
        seen.add(name)
    for path, b in walk(book):
        for field, source in _sources(b):
            try:
                nodes = list(_nodes(parse(source)))
            except InlineError as e:
                found.append(((*path, *field), str(e)))
                continue
            for n in nodes:
                if n["kind"] == "noteref" and n["id"] not in notes:
                    found.append(((*path, *field), f"no footnote {n['id']}"))
                if n["kind"] == "link" and n["target_kind"] == "internal" and n["target"] not in seen:
                    found.append(((*path, *field), f"no place {n['target']}"))
        for i, a in enumerate(b.get("annotations", ())):
            if b.get("text", "")[a["start"] : a["end"]] != a["matches"]:
                found.append(((*path, "annotations", i), "the offsets select another text"))
    return found


def book_issues(books: DataFrame) -> DataFrame:
    """(book_id, json) -> book_id, path, issue; a book of no JSON has one issue."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["book_id"], pdf["json"], strict=True):
                try:
                    found = issues(json.loads(text))
                except (ValueError, TypeError) as e:
                    found = [((), f"no JSON: {e}")]
                rows += [(key, "/".join(map(str, path)), what) for path, what in found]
            yield pd.DataFrame(rows, columns=["book_id", "path", "issue"])

    return books.select("book_id", "json").mapInPandas(run, "book_id long, path string, issue string")


def book_blocks(books: DataFrame) -> DataFrame:
    """(book_id, json) -> book_id, n (walk order), path, type, json of every block; broken books have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["book_id"], pdf["json"], strict=True):
                try:
                    rows += [(key, n, "/".join(map(str, path)), b["type"], json.dumps(b, ensure_ascii=False)) for n, (path, b) in enumerate(walk(json.loads(text)))]
                except (ValueError, TypeError, KeyError, AttributeError):
                    continue
            yield pd.DataFrame(rows, columns=["book_id", "n", "path", "type", "json"])

    return books.select("book_id", "json").mapInPandas(run, "book_id long, n int, path string, type string, json string")
