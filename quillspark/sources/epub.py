"""EPUB 3 writer and reader, a book at a time; a book that fails is a row with its error."""

from __future__ import annotations

import hashlib
import io
import json
import posixpath
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape as _esc

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.inline import InlineError, escape, parse, plain, render
from ..functions.text import MEDIA_TYPES
from ..operators.books import DEMOTED
from . import xhtml

_STAMP = (2000, 1, 1, 0, 0, 0)
_HEAD = '<?xml version="1.0" encoding="utf-8"?>\n'


def _x(s: str) -> str:
    return _esc(s, {'"': "&quot;", "'": "&apos;"})


def _break(page: int) -> str:
    return f'<span epub:type="pagebreak" id="page-{page}" role="doc-pagebreak" aria-label="{page}"/>'


class _Writer:
    """Nodes as markup, with page breaks where the source's code points reach their offsets.

    A break inside a marker, a link's target or an atom stands before the whole construct;
    one between the two characters of an escape, before the character.
    """

    def __init__(self, labels: dict[str, str], breaks: list[tuple[int, int]]):
        self.labels, self.due, self.out = labels, sorted(breaks), []

    def _settle(self, before: int) -> None:
        while self.due and self.due[0][0] < before:
            self.out.append(_break(self.due.pop(0)[1]))

    def nodes(self, nodes: list[dict], pos: int) -> int:
        for n in nodes:
            end = pos + len(render([n]))
            self._settle(pos + 1)
            getattr(self, "_" + n["kind"])(n, pos, end)
            pos = end
        return pos

    def whole(self, nodes: list[dict]) -> str:
        self._settle(self.nodes(nodes, 0) + (1 << 60))
        return "".join(self.out)

    def _text(self, n: dict, pos: int, end: int) -> None:
        for c in n["text"]:
            width = len(escape(c))
            self._settle(pos + width)
            self.out.append(_x(c))
            pos += width

    def _marked(self, n: dict, pos: int, end: int, lead: int, tag: str, close: str) -> None:
        inner = sum(len(render([k])) for k in n["children"])
        first, last = pos + lead, pos + lead + inner
        inside = [d for d in self.due if first <= d[0] <= last]
        self.due, later = [d for d in self.due if d[0] < end and d not in inside], [d for d in self.due if d[0] >= end and d not in inside]
        self._settle(end)
        self.out.append(tag)
        self.due = inside
        self.nodes(n["children"], first)
        self._settle(last + 1)
        self.out.append(close)
        self.due = later

    def _em(self, n, pos, end):
        self._marked(n, pos, end, 1, "<em>", "</em>")

    def _strong(self, n, pos, end):
        self._marked(n, pos, end, 2, "<strong>", "</strong>")

    def _link(self, n, pos, end):
        href = ("#" if n["target_kind"] == "internal" else "") + n["target"]
        self._marked(n, pos, end, 1, f'<a href="{_x(href)}">', "</a>")

    def _math(self, n, pos, end):  # no typesetter here: the source, as text and as annotation
        self._settle(end)
        self.out.append(f'<math xmlns="http://www.w3.org/1998/Math/MathML"><semantics><mtext>{_x(n["tex"])}</mtext><annotation encoding="application/x-tex">{_x(n["tex"])}</annotation></semantics></math>')

    def _noteref(self, n, pos, end):
        self._settle(end)
        self.out.append(f'<a epub:type="noteref" href="#{n["id"]}"><sup>{_x(self.labels.get(n["id"], "?"))}</sup></a>')


def inline_html(nodes: list[dict], labels: dict[str, str] | None = None, breaks: list[tuple[int, int]] | None = None) -> str:
    """``breaks``: (offset, page) of page breaks inside."""
    return _Writer(labels or {}, breaks or []).whole(nodes)


def _text(source: str, labels: dict[str, str], breaks: list[tuple[int, int]] | None = None, annotations: list[dict] | None = None) -> str:
    """A text with its page breaks, or in spans by its annotations; none of those may cut a construct."""
    if not annotations:
        return inline_html(parse(source), labels, breaks)
    marks = sorted(annotations, key=lambda x: x["start"])
    cuts, out = [0, *(x for m in marks for x in (m["start"], m["end"])), len(source)], []
    for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        try:
            part = inline_html(parse(source[a:z]), labels)
        except InlineError as e:
            raise ValueError(f"an annotation cuts an inline construct between {a} and {z}: {e}") from e
        if k % 2:
            m = marks[k // 2]
            tongue = f' xml:lang="{_x(m["language"])}" lang="{_x(m["language"])}"' if m.get("language") else ""
            style = ' class="small-caps"' if m.get("style") == "small-caps" else ""
            part = f"<span{tongue}{style}>{part}</span>"
        out.append(part)
    return "".join(out)


def _attributes(b: dict, extra: str = "") -> str:
    classes = " ".join(filter(None, (extra, f"role-{b['role']}" if b.get("role") else "")))
    parts = [f'id="{b["id"]}"' if b.get("id") else "", f'class="{classes}"' if classes else "", "hidden=\"hidden\"" if b.get("role") in DEMOTED else "", f'xml:lang="{_x(b["language"])}"' if b.get("language") else ""]
    return "".join(" " + p for p in parts if p)


def block_html(b: dict, labels: dict[str, str] | None = None, breaks: list[tuple[int, int]] | None = None) -> str:
    """One block, with the page breaks (offset, page) inside its text; a table or formula without grid or TeX needs its image."""
    labels, kind = labels or {}, b["type"]
    a = _attributes(b, "formula" if kind == "formula" else "")
    image = lambda path, alt="": f'<img src="{_x(path)}" alt="{_x(alt)}"/>'
    caption = f"<figcaption>{_text(b['caption'], labels)}</figcaption>" if b.get("caption") else ""
    if kind == "heading":
        return f"<h{b['level']}{a}>{_text(b['text'], labels, breaks, b.get('annotations'))}</h{b['level']}>"
    if kind == "text":
        return f"<p{a}>{_text(b['text'], labels, breaks, b.get('annotations'))}</p>"
    if kind == "quote":
        said = f"<footer>{_text(b['attribution'], labels)}</footer>" if b.get("attribution") else ""
        return f"<blockquote{a}><p>{_text(b['text'], labels, breaks, b.get('annotations'))}</p>{said}</blockquote>"
    if kind == "image":
        return f"<figure{a}>{image(b['file'], b.get('alt') or '')}{caption}</figure>"
    if kind == "list":
        tag = "ol" if b.get("ordered") else "ul"
        item = lambda i: f"<li>{''.join(block_html(x, labels) for x in i) if isinstance(i, list) else _text(i, labels)}</li>"
        return f"<{tag}{a}>{''.join(map(item, b['items']))}</{tag}>"
    if kind == "table" and b.get("rows"):
        rows = "".join(f"<tr>{''.join(f'<td>{_text(c, labels)}</td>' for c in r)}</tr>" for r in b["rows"])
        title = f"<caption>{_text(b['caption'], labels)}</caption>" if b.get("caption") else ""
        return f"<table{a}>{title}{rows}</table>"
    beside = "".join(f'<span class="formula-{k}">{_text(b[k], labels)}</span>' for k in ("number", "note") if b.get(k))
    if kind == "formula" and b.get("tex"):
        return f"<div{a}>{inline_html([{'kind': 'math', 'tex': b['tex']}])}{beside}</div>"
    if b.get("image"):
        return f"<figure{a}>{image(b['image'])}{caption}{beside}</figure>"
    raise ValueError(f"{kind} has neither content nor image")


def contents(blocks: list[dict]) -> list[dict]:
    """Nested headings: each under the nearest earlier one of a smaller level."""
    top: list[dict] = []
    path: list[dict] = []
    for b in blocks:
        if b["type"] == "heading" and b["level"] <= 3 and b.get("id") and b.get("role") not in DEMOTED:
            entry = {"href": f"text.xhtml#{b['id']}", "label": plain(b["text"]), "level": b["level"], "children": []}
            while path and path[-1]["level"] >= entry["level"]:
                path.pop()
            (path[-1]["children"] if path else top).append(entry)
            path.append(entry)
    return top


def _nav(entries: list[dict]) -> str:
    return "<ol>" + "".join(f'<li><a href="{e["href"]}">{_x(e["label"])}</a>{_nav(e["children"]) if e["children"] else ""}</li>' for e in entries) + "</ol>"


def assets_of(book: dict) -> list[str]:
    found = [book.get("cover"), *(b.get(k) for b in book["content"] for k in ("file", "image"))]
    return list(dict.fromkeys(f for f in found if f))


def write(book: dict, assets: dict[str, bytes]) -> bytes:
    """The same bytes for the same book, mimetype first and stored."""
    wanted = assets_of(book)
    if lacking := [p for p in wanted if p not in assets]:
        raise ValueError(f"missing assets: {', '.join(lacking)}")
    labels = {k: n["label"] for k, n in book.get("footnotes", {}).items()}
    seen: set[int] = set()
    parts, breaks = [], []
    for b in book["content"]:
        spans = [(0, b["page"])] if b.get("page") else [(x.get("at") or 0, x["page"]) for x in b.get("pages") or ()]
        fresh = [(at, page) for at, page in spans if page not in seen and not seen.add(page)]
        breaks += [page for _, page in fresh]
        parts += [_break(page) for at, page in fresh if not at]
        parts.append(block_html(b, labels, [x for x in fresh if x[0]]))
    notes = "".join(f'<aside epub:type="footnote" id="{k}"><sup>{_x(n["label"])}</sup>{"".join(block_html(b, labels) for b in n["blocks"])}</aside>' for k, n in book.get("footnotes", {}).items())
    page = lambda title, body: f'{_HEAD}<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" xml:lang="{_x(book["language"])}"><head><title>{_x(title)}</title></head><body>{body}</body></html>'
    toc = contents(book["content"]) or [{"href": "text.xhtml", "label": book["title"], "children": []}]
    pages = f'<nav epub:type="page-list" hidden="hidden"><ol>{"".join(f"<li><a href=\"text.xhtml#page-{p}\">{p}</a></li>" for p in breaks)}</ol></nav>' if breaks else ""
    types = {p: MEDIA_TYPES[p.rpartition(".")[2].lower()] for p in wanted}
    cover = lambda p: ' properties="cover-image"' if p == book.get("cover") else ""
    items = "".join(f'<item id="a{i}" href="{_x(p)}" media-type="{types[p]}"{cover(p)}/>' for i, p in enumerate(wanted))
    name = "urn:sha256:" + hashlib.sha256(json.dumps(book, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    author = f"<dc:creator>{_x(book['author'])}</dc:creator>" if book.get("author") else ""
    opf = f'{_HEAD}<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{name}</dc:identifier><dc:title>{_x(book["title"])}</dc:title>{author}<dc:language>{_x(book["language"])}</dc:language><meta property="dcterms:modified">2000-01-01T00:00:00Z</meta></metadata><manifest><item id="nav" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/><item id="text" href="text.xhtml" media-type="application/xhtml+xml"/>{items}</manifest><spine><itemref idref="text"/></spine></package>'
    files = {"META-INF/container.xml": f'{_HEAD}<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>', "OEBPS/content.opf": opf, "OEBPS/nav.xhtml": page("Contents", f'<nav epub:type="toc">{_nav(toc)}</nav>{pages}'), "OEBPS/text.xhtml": page(book["title"], "".join(parts) + (f'<section epub:type="footnotes">{notes}</section>' if notes else ""))}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype", _STAMP), b"application/epub+zip", zipfile.ZIP_STORED)
        for name, data in [*files.items(), *((f"OEBPS/{p}", assets[p]) for p in wanted)]:
            z.writestr(zipfile.ZipInfo(name, _STAMP), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def read(data: bytes) -> tuple[dict, dict[str, bytes], list[str]]:
    """(book, assets, warnings); documents are read in spine order."""
    warn: list[str] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        local = lambda e: e.tag.rpartition("}")[2]
        container = ET.fromstring(z.read("META-INF/container.xml"))
        opf_path = next(e.attrib["full-path"] for e in container.iter() if local(e) == "rootfile")
        opf, base = ET.fromstring(z.read(opf_path)), posixpath.dirname(opf_path)
        meta = {local(e): (e.text or "").strip() for e in reversed(list(opf.iter())) if local(e) in ("title", "creator", "language")}
        items = {e.attrib["id"]: e.attrib for e in opf.iter() if local(e) == "item"}
        bodies: list[tuple[str, xhtml.Node]] = []
        for ref in (e for e in opf.iter() if local(e) == "itemref"):
            item = items.get(ref.attrib.get("idref", ""))
            path = posixpath.normpath(posixpath.join(base, item["href"])) if item else ""
            if path not in names:
                warn.append(f"missing document {path}")
                continue
            root = xhtml.tree(z.read(path).decode("utf-8", "replace"))
            bodies.append((path, next(root.find("body"), root)))
        xhtml.settle_ids(bodies)
        content, notes, assets, page = [], {}, {}, None
        for _, body in bodies:
            for aside in list(body.find("aside")):
                if "footnote" in aside.attrs.get("epub:type", ""):
                    label = next((s.words().strip() for s in aside.find("sup")), "?")
                    aside.kids = [k for k in aside.kids if not (isinstance(k, xhtml.Node) and k.tag == "sup")]
                    notes[aside.attrs.get("id", f"note-{len(notes) + 1}")] = {"label": label or "?", "blocks": [_clean(b) for b in xhtml._read(aside, warn)]}
            _without(body, lambda n: n.tag == "section" and "footnotes" in n.attrs.get("epub:type", ""))
            page = xhtml.settle_pages(body, page)
            content += [_clean(b) for b in xhtml._read(body, warn)]
        cover = next((i["href"] for i in items.values() if "cover-image" in i.get("properties", "").split()), None)
        for path in [*(b.get("file") for b in content), cover]:
            full = posixpath.normpath(posixpath.join(base, path)) if path else ""
            if full in names:
                assets[path] = z.read(full)
            elif path:
                warn.append(f"missing asset {path}")
    ids = {b["id"] for b in content if b.get("id")} | set(notes)
    for b in [*content, *(b for n in notes.values() for b in n["blocks"])]:
        for k in ("text", "caption"):
            if b.get(k):
                b[k] = _unlink(b[k], ids, warn)
        if b["type"] == "list":
            b["items"] = [[{"type": "text", "text": _unlink(i, ids, warn)}] for i in b["items"]]
        if b.get("rows"):
            b["rows"] = [[_unlink(c, ids, warn) for c in r] for r in b["rows"]]
    book = {"title": meta.get("title") or "Untitled", "language": meta.get("language") or "en", "content": content, "footnotes": notes}
    book |= {"author": meta["creator"]} if meta.get("creator") else {}
    return book | ({"cover": cover} if cover in assets else {}), assets, warn


def _clean(b: dict) -> dict:
    return {k: v for k, v in b.items() if v is not None}


def _without(node: xhtml.Node, gone) -> None:
    node.kids = [k for k in node.kids if isinstance(k, str) or not gone(k)]
    for k in node.kids:
        if isinstance(k, xhtml.Node):
            _without(k, gone)


def _unlink(text: str, ids: set[str], warn: list[str]) -> str:
    """Links that lead nowhere become their text."""
    def walk(nodes: list[dict]) -> list[dict]:
        out = []
        for n in nodes:
            if "children" in n:
                n = n | {"children": walk(n["children"])}
            if n["kind"] == "link" and n["target_kind"] == "internal" and n["target"] not in ids:
                warn.append(f"link to nowhere: {n['target']}")
                out += n["children"]
            else:
                out.append(n)
        return out

    try:
        return render(walk(parse(text)))
    except InlineError:
        return text


def write_books(books: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """(book_id, json) and (book_id, path, content) -> book_id, epub, error.

    One book and its assets are in a task at a time; a book that can't be written has a null epub.
    """

    def one(text: str, files: dict[str, bytes]) -> tuple[bytes | None, str | None]:
        try:
            return write(json.loads(text), files), None
        except (ValueError, KeyError, TypeError) as e:
            return None, str(e)

    schema = "book_id long, epub binary, error string"
    if assets is None:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                done = [one(j, {}) for j in pdf["json"]]
                yield pd.DataFrame({"book_id": pdf["book_id"], "epub": [d[0] for d in done], "error": [d[1] for d in done]})

        return books.select("book_id", "json").mapInPandas(run, schema)

    def pair(book: pd.DataFrame, files: pd.DataFrame) -> pd.DataFrame:
        done = [one(j, dict(zip(files["path"], files["content"], strict=True))) for j in book["json"]]
        return pd.DataFrame({"book_id": book["book_id"], "epub": [d[0] for d in done], "error": [d[1] for d in done]}, columns=["book_id", "epub", "error"])

    files = assets.select(F.col("book_id").alias("book_id"), "path", "content")  # may come from the same plan as the books
    return books.select("book_id", "json").groupBy("book_id").cogroup(files.groupBy("book_id")).applyInPandas(pair, schema)


def read_books(files: DataFrame) -> DataFrame:
    """(path, content) as Spark's binaryFile gives them -> path, json, n_assets, warnings, assets (path, content)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    book, assets, warn = read(content)
                    rows.append((path, json.dumps(book, ensure_ascii=False), len(assets), warn, [{"path": k, "content": v} for k, v in assets.items()]))
                except (zipfile.BadZipFile, KeyError, StopIteration, ET.ParseError) as e:
                    rows.append((path, None, 0, [f"unreadable: {e}"], []))
            yield pd.DataFrame(rows, columns=["path", "json", "n_assets", "warnings", "assets"])

    return files.select("path", "content").mapInPandas(run, "path string, json string, n_assets int, warnings array<string>, assets array<struct<path:string,content:binary>>")
