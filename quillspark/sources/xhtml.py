"""XHTML and loose HTML to document blocks, with a forgiving tree builder."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote

import pandas as pd

from ..functions.inline import IDENT, InlineError, escape, parse

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SKIP = frozenset(("script", "style", "head", "template", "nav", "noscript"))
_BLOCK = frozenset("address article aside blockquote body div dd dl dt figure figcaption footer form h1 h2 h3 h4 h5 h6 header hr html li main ol p pre section table tbody td tfoot th thead tr ul".split())
_CLOSES = {"li": ("li",), "p": ("p",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
_EM, _STRONG = ("em", "i"), ("strong", "b")
SCHEMA = "pos int, type string, level int, role string, id string, text string, ordered boolean, items array<string>, rows array<array<string>>, file string, caption string, alt string, tex string"


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []

    def find(self, *tags: str) -> Iterator[Node]:
        for k in self.kids:
            if isinstance(k, Node):
                if k.tag in tags:
                    yield k
                else:
                    yield from k.find(*tags)

    def words(self) -> str:
        return "".join(k if isinstance(k, str) else k.words() for k in self.kids)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("root", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        tag = tag.rpartition(":")[2]
        if tag in _BLOCK:  # a paragraph ends where a block begins; items end at the next item
            for name in (*_CLOSES.get(tag, ()), "p"):
                self._shut(name, stop=("ul", "ol", "table", "blockquote", "div") if name != "p" else ("td", "th", "li", "blockquote", "div", "section", "article", "aside", "body"))
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].kids.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._shut(tag.rpartition(":")[2], stop=("root",))

    def _shut(self, tag, stop):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in stop:
                return

    def handle_data(self, data):
        self.open[-1].kids.append(data)


def settle_ids(bodies: list[tuple[str, Node]]) -> None:
    """Gives every id of some documents (path, body) a clean one of its own, and points links at them.

    The first node of a raw id in a document has it; a link may name another document.
    """
    known: dict[tuple[str, str], str] = {}
    used: set[str] = set()

    def every(node: Node) -> Iterator[Node]:
        yield node
        for k in node.kids:
            if isinstance(k, Node):
                yield from every(k)

    for path, body in bodies:
        for n in every(body):
            raw = n.attrs.get("id")
            if not raw:
                continue
            if (path, raw) not in known:
                stem = clean = re.sub(r"[^a-z0-9]+", "-", raw.lower()).strip("-") or "x"
                k = 2
                while clean in used:
                    clean, k = f"{stem}-{k}", k + 1
                used.add(clean)
                known[path, raw] = clean
                n.attrs["id"] = clean
            else:
                del n.attrs["id"]
    for path, body in bodies:
        for n in every(body):
            href = n.attrs.get("href", "") if n.tag == "a" else ""
            file, mark, part = href.partition("#")
            if mark and "://" not in file:
                target = posixpath.normpath(posixpath.join(posixpath.dirname(path), unquote(file))) if file else path
                n.attrs["href"] = "#" + known.get((target, unquote(part)), part)


def settle_pages(node: Node, page: int | None) -> int | None:
    """Marks every node with the page last begun before it; returns the page at its end."""
    for k in node.kids:
        if isinstance(k, str):
            continue
        if "pagebreak" in k.attrs.get("epub:type", "") or k.attrs.get("role") == "doc-pagebreak":
            shown = (k.attrs.get("aria-label") or k.attrs.get("title") or k.words()).strip()
            page = int(shown) if shown.isdigit() and int(shown) else page
        if page:
            k.attrs["_page"] = str(page)
        page = settle_pages(k, page)
    return page


def tree(html: str) -> Node:
    t = _Tree()
    t.feed(html)
    t.close()
    return t.root


def inline(node: Node, warn: list[str] | None = None) -> str:
    """A node's content as dialect text."""
    text = "".join(_inline(node, warn if warn is not None else [], ()))
    text = re.sub(r"\s+", " ", text).strip()
    return text


def _inline(node: Node, warn: list[str], within: tuple[str, ...]) -> Iterator[str]:
    for k in node.kids:
        if isinstance(k, str):
            yield escape(re.sub(r"\s+", " ", k))
            continue
        if k.tag in _SKIP:
            continue
        if k.tag == "br":
            yield " "
        elif k.tag in (*_EM, *_STRONG):
            kind = "em" if k.tag in _EM else "strong"
            inner = "".join(_inline(k, warn, (*within, kind)))
            core = inner.strip()
            if kind in within or not core or "*" in re.sub(r"\\\*", "", core):
                yield inner  # no nesting of like marks, nothing to mark
            else:
                mark = "*" if kind == "em" else "**"
                yield inner[: len(inner) - len(inner.lstrip())] + mark + core + mark + inner[len(inner.rstrip()) :]
        elif k.tag == "math":
            note = next((a.words().strip() for a in k.find("annotation") if "tex" in a.attrs.get("encoding", "")), "")
            yield f"${note}$" if note else escape(k.words())
        elif k.tag == "a" and "link" not in within:
            inner, href = "".join(_inline(k, warn, (*within, "link"))), k.attrs.get("href", "")
            target = href if re.fullmatch(r"https?://\S+", href) and ")" not in href else None
            if href.startswith("#") and IDENT.fullmatch(href[1:]):
                target = href
                if "noteref" in k.attrs.get("epub:type", ""):
                    yield f"[^{href[1:]}]"
                    continue
            if target and inner.strip():
                yield f"[{inner}]({target})"
            else:
                if href:
                    warn.append(f"link dropped: {href}")
                yield inner
        elif k.tag == "img":
            warn.append("inline image dropped")
        else:
            yield from _inline(k, warn, within)


def _sound(text: str, node: Node) -> str:
    try:
        parse(text)
        return text
    except InlineError:
        return escape(re.sub(r"\s+", " ", node.words()).strip())


def _dialect(node: Node, warn: list[str]) -> str:
    return _sound(inline(node, warn), node)


def blocks(html: str, warn: list[str] | None = None) -> Iterator[dict]:
    """Blocks in reading order; containers are read in place."""
    root = tree(html)
    body = next(root.find("body"), root)
    yield from _read(body, warn if warn is not None else [])


def _ident(node: Node) -> dict:
    name = re.sub(r"[^a-z0-9]+", "-", node.attrs.get("id", "").lower()).strip("-")
    return {"id": name} if name else {}


def _page(node: Node) -> dict:
    return {"page": int(node.attrs["_page"])} if "_page" in node.attrs else {}


def _role(node: Node) -> dict:
    found = re.search(r"\brole-([a-z-]+)", node.attrs.get("class", ""))
    return {"role": found[1]} if found else {}


def _read(node: Node, warn: list[str]) -> Iterator[dict]:
    loose: list = []

    def flush() -> Iterator[dict]:
        if loose:
            part = Node("p", {})
            part.kids = list(loose)
            loose.clear()
            if text := _dialect(part, warn):
                first = next((k for k in part.kids if isinstance(k, Node)), part)
                yield {"type": "text", "text": text} | _page(first)

    for k in node.kids:
        if isinstance(k, str) or k.tag not in _BLOCK | _SKIP | {"img", "hr"}:
            loose.append(k)
            continue
        yield from flush()
        own = _ident(k) | _role(k) | _page(k)
        if k.tag in _SKIP:
            continue
        if re.fullmatch("h[1-6]", k.tag):
            if text := _dialect(k, warn):
                yield {"type": "heading", "level": int(k.tag[1]), "text": text} | own
        elif k.tag in ("p", "pre"):
            if text := _dialect(k, warn):
                yield {"type": "text", "text": text} | own
        elif k.tag == "hr":
            yield {"type": "text", "text": r"\*\*\*", "role": "separator"} | _page(k)
        elif k.tag == "blockquote":
            said = next((f for f in k.kids if isinstance(f, Node) and f.tag == "footer"), None)
            k.kids = [x for x in k.kids if x is not said]
            if text := _dialect(k, warn):
                by = _dialect(said, warn) if said else ""
                yield {"type": "quote", "text": text} | own | ({"attribution": by} if by else {})
        elif k.tag == "img":
            yield {"type": "image", "file": k.attrs.get("src", ""), "alt": k.attrs.get("alt") or None} | own
        elif k.tag == "figure" and (img := next(k.find("img"), None)):
            caption = next(k.find("figcaption"), None)
            yield {"type": "image", "file": img.attrs.get("src", ""), "alt": img.attrs.get("alt") or None, "caption": _dialect(caption, warn) if caption else None} | own
        elif k.tag == "table":
            rows = [[_dialect(c, warn) for c in r.kids if isinstance(c, Node) and c.tag in ("td", "th")] for r in k.find("tr")]
            spans = any(int(c.attrs.get(a, "1") or 1) > 1 for c in k.find("td", "th") for a in ("colspan", "rowspan") if c.attrs.get(a, "1").isdigit())
            wide = max(map(len, rows), default=0)
            if wide:
                title = next((_dialect(c, warn) for c in k.kids if isinstance(c, Node) and c.tag == "caption"), "")
                yield {"type": "table", "rows": None if spans else [r + [""] * (wide - len(r)) for r in rows]} | own | ({"caption": title} if title else {})
        elif k.tag in ("ul", "ol"):
            items = [_dialect(i, warn) for i in k.kids if isinstance(i, Node) and i.tag == "li"]
            if items:
                yield {"type": "list", "ordered": k.tag == "ol", "items": items} | own
        elif k.tag == "div" and "formula" in k.attrs.get("class", ""):
            note = next((a.words().strip() for a in k.find("annotation")), "")
            beside = {x: _dialect(n, warn) for n in k.find("span") for x in ("number", "note") if f"formula-{x}" in n.attrs.get("class", "")}
            yield {"type": "formula", "tex": note or None} | own | beside
        else:
            first = True
            for b in _read(k, warn):
                yield (own | b) if first and "id" in own else _page(k) | b
                first = False
    yield from flush()


def blocks_of(key: str):
    """For ``mapInPandas`` over (key, html): block rows of every page."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["pos", "type", "level", "role", "id", "text", "ordered", "items", "rows", "file", "caption", "alt", "tex"]
        for pdf in batches:
            rows = [{key: k, "pos": i} | b for k, html in zip(pdf[key], pdf["html"], strict=True) for i, b in enumerate(blocks(html or ""))]
            out = pd.DataFrame([{c: r.get(c) for c in (key, *names)} for r in rows], columns=[key, *names]).astype({"pos": "int32", "level": "Int32", "ordered": "boolean"})
            yield out.astype(object).where(out.notna(), None)

    return run
