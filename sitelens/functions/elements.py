"""Flat elements of an HTML page, the one thing that is read by a function in Python; all else is columns.

A page becomes a list of elements in document order and a list of its pieces of text. An element knows its
parent and the pieces between its tags, so its text, its place and its surroundings are plain expressions.
Each page is read in one pass: no element looks at its siblings or at the rest of the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from html.entities import html5

import pyarrow as pa
import pyarrow.compute as pc

#: Elements without content, and those whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements whose text nobody sees.
UNSEEN = frozenset("script style noscript template".split())
#: Elements that end an open paragraph, and those that a paragraph cannot be ended across.
_BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
_AROUND = ("table", "td", "th", "button", "body")
#: Elements that end an open one of their kind, and the lists and tables that shield those outside.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table")}
_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'=<>`]++)))?+")
_CLOSED = re.compile(r"(?:\A|[\s\"'])/\Z")
_SPACE = re.compile(r"\s+")
_REFERENCE = re.compile(r"&(#\d+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")
_CLOSERS = {tag: re.compile(rf"</{tag}\b[^>]*+>", re.I) for tag in RAW}
#: Characters of an element's source that are kept, white space collapsed; one more says that there are more.
SOURCE = 301
#: Steps of an element's place that are kept, itself included.
STEPS = 6
_QUOTED = frozenset("h1 h2 h3 h4 h5 h6 img a".split())


def terminated(text: str) -> str:
    """``text`` with the character references that end in a semicolon read, and others as they stand."""
    return _REFERENCE.sub(lambda m: html.unescape(m[0]) if m[1][0] == "#" or m[1] + ";" in html5 else m[0], text)


class Page:
    """The elements and texts of one page, as lists of equal length; ``unescape`` reads the references in texts."""

    def __init__(self, page: str, unescape: Callable[[str], str] = html.unescape) -> None:
        self.page = page
        self.unescape = unescape
        self.tags: list[str] = []
        self.attrs: list[dict[str, str]] = []
        self.parents: list[int] = []
        self.nth: list[int] = []
        self.starts: list[int] = []
        self.stops: list[int] = []
        self.first_text: list[int] = []
        self.last_text: list[int] = []
        self.in_head: list[bool] = []
        self.texts: list[tuple[str, bool]] = []
        self.alike: dict[tuple[int, str], int] = {}
        self._stack: list[int] = []
        self._open: dict[str, list[int]] = {}  # depths of the open elements of a tag
        self._read()

    def _depth(self, *tags: str) -> int:
        """Depth of the innermost open element with one of these tags, or -1."""
        return max((self._open[t][-1] for t in tags if self._open.get(t)), default=-1)

    def _end(self, depth: int, stop: int) -> None:
        """Close all open elements from ``depth`` on."""
        while len(self._stack) > depth:
            number = self._stack.pop()
            self._open[self.tags[number]].pop()
            self.stops[number], self.last_text[number] = stop, len(self.texts)

    def _begin(self, tag: str, attrs: dict[str, str], start: int, stop: int) -> int:
        number, parent = len(self.tags), self._stack[-1] if self._stack else -1
        self.tags.append(tag)
        self.attrs.append(attrs)
        self.parents.append(parent)
        self.alike[parent, tag] = self.alike.get((parent, tag), 0) + 1
        self.nth.append(self.alike[parent, tag])
        self.starts.append(start)
        self.stops.append(stop)
        self.first_text.append(len(self.texts))
        self.last_text.append(len(self.texts))
        self.in_head.append(bool(self._open.get("head")))
        return number

    def _say(self, text: str, raw: str = "") -> None:
        if text:
            hidden = raw in UNSEEN or any(self._open.get(t) for t in ("noscript", "template"))
            self.texts.append((text, not hidden))

    def _read(self) -> None:
        page, at = self.page, 0
        last_end = page.rfind(">")
        while True:
            found = _MARK.search(page, at) if at <= last_end else None
            stop = found.start() if found else page.find("<!--", at)
            self._say(self.unescape(page[at : stop if stop >= 0 else len(page)]))
            if not found:
                return self._end(0, len(page))
            at = found.end()
            tag = (found[2] or found[5] or "").lower()
            if not tag:
                continue
            if found[1] or found[4]:
                depth = self._depth(tag)
                if depth >= 0:
                    self._end(depth + 1, found.start())
                    self._end(depth, at)
                continue
            if tag in _BLOCKS and self._depth("p") > self._depth(*_AROUND):
                self._end(self._depth("p"), found.start())
            if tag in _ENDS:
                inside = self._depth(*_STOPS[tag])
                own = [self._open[t] for t in _ENDS[tag] if self._open.get(t)]
                # the outermost that the list or table does not shield, so that a row ends its cells
                first = min((depths[-1] for depths in own if depths[-1] > inside), default=-1)
                if first >= 0:
                    self._end(first, found.start())
            if tag == "body":
                self._end(1 if self._stack and self.tags[self._stack[0]] == "html" else 0, found.start())
            source = found[3] or found[6] or ""
            attrs: dict[str, str] = {}
            for name, a, b, c in _ATTRIBUTE.findall(source):
                attrs.setdefault(name.lower(), html.unescape(a or b or c))
            number = self._begin(tag, attrs, found.start(), at)
            if tag in RAW:
                end = _CLOSERS[tag].search(page, at, last_end + 1)
                inner = page[at : end.start() if end else len(page)]
                self._say(self.unescape(inner) if tag in ("title", "textarea") else inner, tag)
                at = self.stops[number] = end.end() if end else len(page)
                self.last_text[number] = len(self.texts)
            elif tag not in VOID and not _CLOSED.search(source):
                self._open.setdefault(tag, []).append(len(self._stack))
                self._stack.append(number)

    def text(self, number: int) -> str:
        return "".join(t for t, _ in self.texts[self.first_text[number] : self.last_text[number]])

    def up(self, number: int, most: int = STEPS) -> list[int]:
        out: list[int] = []
        while number >= 0 and len(out) < most:
            out.append(number)
            number = self.parents[number]
        return out

    def sources(self) -> dict[int, str]:
        """Source of the elements that findings point at, white space collapsed and cut."""
        out = {}
        for n, tag in enumerate(self.tags):
            if tag in _QUOTED:
                start, stop, size = self.starts[n], self.stops[n], 2 * SOURCE
                flat = _SPACE.sub(" ", self.page[start : min(stop, start + size)])
                while len(flat) <= SOURCE and start + size < stop:  # much white space: twice as far, so no page is gone through whole for an element
                    size *= 2
                    flat = _SPACE.sub(" ", self.page[start : min(stop, start + size)])
                out[n] = flat[:SOURCE].strip()
        return out


def read(pages: pa.Array, unescape: Callable[[str], str] = html.unescape) -> pa.Array:
    """Struct (elements, texts) of each page; null and empty pages have none."""
    element, text = [list(arrow_type()[k].type.value_type) for k in (0, 1)]
    rows: dict[str, list] = {f.name: [] for f in element}
    texts: list[tuple[str, bool]] = []
    counts, text_counts = [0], [0]
    for raw in pages.to_pylist():
        page = Page(raw or "", unescape)
        source = page.sources()
        rows["tag"] += page.tags
        rows["parent"] += page.parents
        rows["up"] += map(page.up, range(len(page.tags)))
        rows["nth"] += page.nth
        rows["alike"] += [page.alike[p, t] for p, t in zip(page.parents, page.tags)]
        rows["first_text"] += page.first_text
        rows["n_texts"] += [b - a for a, b in zip(page.first_text, page.last_text)]
        rows["in_head"] += page.in_head
        rows["attrs"] += [list(a.items()) for a in page.attrs]
        rows["source"] += [source.get(n) for n in range(len(page.tags))]
        texts += page.texts
        counts.append(len(rows["tag"]))
        text_counts.append(len(texts))
    elements = pa.StructArray.from_arrays([pa.array(rows[f.name], f.type) for f in element], fields=element)
    said = pa.StructArray.from_arrays([pa.array([t for t, _ in texts], pa.string()), pa.array([s for _, s in texts], pa.bool_())], fields=text)
    lists = [pa.ListArray.from_arrays(pa.array(n, pa.int32()), values) for n, values in ((counts, elements), (text_counts, said))]
    return pa.StructArray.from_arrays(lists, fields=list(arrow_type()))


#: The same as a type of Spark.
PAGE = (
    "struct<els: array<struct<tag: string, parent: int, up: array<int>, nth: int, alike: int, first_text: int, n_texts: int, in_head: boolean,"
    " attrs: map<string, string>, source: string>>, texts: array<struct<text: string, seen: boolean>>>"
)


def arrow_type() -> pa.StructType:
    kinds = {"tag": pa.string(), "parent": pa.int32(), "up": pa.list_(pa.int32()), "nth": pa.int32(), "alike": pa.int32(), "first_text": pa.int32(), "n_texts": pa.int32(), "in_head": pa.bool_(), "attrs": pa.map_(pa.string(), pa.string()), "source": pa.string()}
    return pa.struct([("els", pa.list_(pa.struct(list(kinds.items())))), ("texts", pa.list_(pa.struct([("text", pa.string()), ("seen", pa.bool_())])))])


def pieces(batch: pa.RecordBatch, rows: int = 64, chars: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch whose last column is html, a few rows and about a million characters at a time: unfolded, a page is many times as large."""
    sizes = pc.fill_null(pc.binary_length(batch.columns[-1]), 0).to_pylist()
    at = held = 0
    for n, size in enumerate(sizes):
        if n > at and (n - at == rows or held + size > chars):
            yield batch.slice(at, n - at)
            at, held = n, 0
        held += size
    if at < len(sizes):
        yield batch.slice(at)


def batches(rows: Iterator[pa.RecordBatch], unescape: Callable[[str], str] = html.unescape) -> Iterator[pa.RecordBatch]:
    """Each batch with its elements and texts in column ``page`` in place of its last column, the html."""
    for batch in rows:
        for part in pieces(batch):
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], read(part.columns[-1], unescape)], [*part.schema.names[:-1], "page"])
