"""Pages -> element arrays.

One narrow pass turns the HTML of a page into ``nodes``: the elements in document order and the
page text.  Everything that reads pages afterwards is a Column expression on that struct
(``operators/pages.py``): no Python, no shuffle.  A row is as large as its page, so the work
splits by page whatever the distribution of hosts or sources is.

``nodes.list`` holds the elements: ``id`` is the position, ``last`` the position of the last
element inside, ``up`` the position of its parent and ``depth`` the number of its ancestors, ``cls`` the
classes between blanks.  An element lies in another if its ``id`` is above the other's and at most its ``last``,
so a page takes room for its elements however deep they are nested.  ``nodes.text`` is the concatenated text, ``nodes.spaced`` the same with a blank
between text pieces; ``t0..t1`` and ``s0..s1`` are the element's share of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


NODE = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("last", T.IntegerType()),
    T.StructField("up", T.IntegerType()), T.StructField("depth", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("cls", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("t0", T.IntegerType()), T.StructField("t1", T.IntegerType()),
    T.StructField("s0", T.IntegerType()), T.StructField("s1", T.IntegerType()),
])
NODES = T.StructType([
    T.StructField("list", T.ArrayType(NODE)),
    T.StructField("text", T.StringType()),
    T.StructField("spaced", T.StringType()),
])

_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_HEAD = frozenset("title meta link script style base noscript template".split())
_CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr "
    "main nav ol p pre section table ul".split()
)
# an opening tag ends an open one of these, unless a container lies between
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

#: Text and the tag after it, in the plain spelling of most pages: quoted attribute values, comments without dashes.
_ATTRIBUTES = r"""(?:[ \t\n]+[a-zA-Z][-a-zA-Z0-9_:]*(?:=(?:"[^"]*"|'[^']*'))?)*"""
_PLAIN = re.compile(
    rf"""([^<]*)<(?:/([a-zA-Z][a-zA-Z0-9]*)>|([a-zA-Z][a-zA-Z0-9]*)({_ATTRIBUTES})[ \t\n]*/?>"""
    r"""|(!--)[^->]*-->|![dD][oO][cC][tT][yY][pP][eE][^>]*>)""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z][-a-zA-Z0-9_:]*)(?:=(?:"([^"]*)"|'([^']*)'))?""")
#: What stands in these isn't markup, at least for some versions of the standard parser.
_OPAQUE = frozenset((
    *HTMLParser.CDATA_CONTENT_ELEMENTS, *getattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS", ()),
    "iframe", "noembed", "noframes", "noscript", "plaintext", "xmp"))


class _Nodes(HTMLParser):
    """Collects the elements of one page; html, head and body always exist."""

    def __init__(self, with_scripts: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.with_scripts = with_scripts
        self.tags: list[str] = []
        self.attrs: list[list[tuple[str, str]]] = []
        self.up: list[int | None] = []
        self.depth: list[int] = []
        self.last: list[int] = []
        self.t0: list[int] = []
        self.t1: list[int] = []
        self.s0: list[int] = []
        self.s1: list[int] = []
        self.pieces: list[str] = []
        self.length = 0
        self.spaced = 0
        self.open: list[int] = []
        self.places: dict[str, list[int]] = {}  # depths at which a tag is open, below html and head or body
        self.merge = False
        self.body = False
        self._push("html", [])
        self._push("head", [])

    def feed(self, data: str) -> None:
        """Plain markup is taken from one pattern; from the first other piece on the standard parser goes on."""
        at, match = 0, _PLAIN.match
        while m := match(data, at):
            text, end, start, attrs, comment = m.groups()
            if start is not None:
                start = start.lower()
                if start in _OPAQUE:
                    break
            if text:
                self.handle_data(unescape(text) if "&" in text else text)
            if start is not None:
                self.handle_starttag(start, [
                    (k.lower(), unescape(a or b)) for k, a, b in _ATTRIBUTE.findall(attrs)] if attrs else ())
            elif end is not None:
                self.handle_endtag(end.lower())
            elif comment:
                self.handle_comment(comment)
            at = m.end()
        if at < len(data):
            super().feed(data[at:])

    def updatepos(self, i: int, j: int) -> int:
        """Lines and columns are not asked for, so they aren't counted."""
        return j

    def _add(self, tag: str, attrs: list) -> int:
        node = len(self.tags)
        self.tags.append(tag)
        self.attrs.append(attrs)
        self.up.append(self.open[-1] if self.open else None)
        self.depth.append(len(self.open))
        self.last.append(node)
        self.t0.append(self.length)
        self.t1.append(self.length)
        self.s0.append(self.spaced)
        self.s1.append(self.spaced)
        return node

    def _push(self, tag: str, attrs: list) -> None:
        if len(self.open) > 1:
            self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(self._add(tag, attrs))

    def _pop_to(self, depth: int) -> None:
        end = len(self.tags) - 1
        for node in self.open[depth:]:
            self.last[node] = end
            self.t1[node] = self.length
            self.s1[node] = self.spaced
        for node in self.open[max(depth, 2):]:
            self.places[self.tags[node]].pop()
        del self.open[depth:]

    def _deepest(self, tags: Iterable[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _need_body(self, attrs: list | None = None) -> None:
        if not self.body:
            self._pop_to(1)
            self._push("body", attrs or [])
            self.body = True

    def _close(self, tags: set | frozenset, stop: set | frozenset) -> None:
        depth = self._deepest(tags)
        if depth >= 0 and depth > self._deepest(stop - tags):
            self._pop_to(depth)

    def handle_starttag(self, tag, attrs):
        self.merge = False
        pairs, seen = [], set()
        for key, value in attrs:
            if key not in seen:
                seen.add(key)
                pairs.append((key, value or ""))
        if tag in ("html", "head"):
            return
        if tag == "body":
            self._need_body(pairs)
            return
        if not self.body and tag not in _HEAD:
            self._need_body()
        if tag in _CLOSES_P:
            self._close({"p"}, {"button", "td", "th", "table"})
        if tag in _SIBLINGS:
            self._close(*_SIBLINGS[tag])
        if tag in _VOID:
            self._add(tag, pairs)
        else:
            self._push(tag, pairs)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.merge = False
        if tag in ("html", "body", "head"):
            if tag == "head" and not self.body:
                self._pop_to(2)
            return
        depth = self._deepest([tag])
        if depth > 0:
            self._pop_to(depth)

    def handle_data(self, data):
        in_head_element = not self.body and len(self.open) > 2
        if not self.body and not in_head_element:
            if not data.strip():
                return
            self._need_body()
        if not self.with_scripts and self.tags[self.open[-1]] in ("script", "style"):
            return
        if self.merge:
            self.pieces[-1] += data
        else:
            self.spaced += 1 if self.pieces else 0
            self.pieces.append(data)
            self.merge = True
        self.length += len(data)
        self.spaced += len(data)

    def handle_comment(self, data):
        self.merge = False

    def finish(self) -> None:
        self.close()
        self._need_body()
        self._pop_to(0)


def _parse(html: str, with_scripts: bool) -> _Nodes:
    page = _Nodes(with_scripts)
    page.feed(html)
    page.finish()
    return page


def _ints(values: Iterable[int | None]) -> pa.Array:
    return pa.array(values, pa.int32())


def _node_arrays(pages: Iterable[str | None], with_scripts: bool) -> pa.StructArray:
    offsets, attr_offsets, texts, spaced = [0], [0], [], []
    ids, last, up, depth, tags, classes, keys, values = [], [], [], [], [], [], [], []
    t0, t1, s0, s1 = [], [], [], []
    for html in pages:
        page = _parse(html or "", with_scripts)
        ids.extend(range(len(page.tags)))
        for whole, own in ((last, page.last), (up, page.up), (depth, page.depth), (tags, page.tags),
                           (t0, page.t0), (t1, page.t1), (s0, page.s0), (s1, page.s1)):
            whole.extend(own)
        for pairs in page.attrs:
            cls = ""
            for key, value in pairs:
                keys.append(key)
                values.append(value)
                if key == "class":
                    cls = f" {' '.join(value.split())} "
            classes.append(cls)
            attr_offsets.append(len(keys))
        offsets.append(len(ids))
        texts.append("".join(page.pieces))
        spaced.append(" ".join(page.pieces))
    attrs = pa.MapArray.from_arrays(
        _ints(attr_offsets), pa.array(keys, pa.string()), pa.array(values, pa.string()))
    elements = pa.StructArray.from_arrays(
        [_ints(ids), _ints(last), _ints(up), _ints(depth),
         pa.array(tags, pa.string()), pa.array(classes, pa.string()), attrs,
         _ints(t0), _ints(t1), _ints(s0), _ints(s1)],
        names=NODE.fieldNames())
    return pa.StructArray.from_arrays(
        [pa.ListArray.from_arrays(_ints(offsets), elements), pa.array(texts, pa.string()), pa.array(spaced, pa.string())],
        names=NODES.fieldNames())


def page_nodes(pages: DataFrame, html: str = "html", keep: list[str] | None = None,
               keep_html: bool = False, with_scripts: bool = True) -> DataFrame:
    """``keep`` columns plus ``nodes``; the HTML itself travels back only on request."""
    keep = list(keep if keep is not None else [c for c in pages.columns if c != html])
    if keep_html and html not in keep:
        keep.append(html)
    wanted = pages.select(*keep, F.col(html).alias("__html"))
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("nodes", NODES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # small slices keep the arrays of a batch well below Arrow's 2 GB offsets
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                nodes = _node_arrays(part.column("__html").to_pylist(), with_scripts)
                columns = [part.column(c) for c in keep] + [nodes]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "nodes"])

    return wanted.mapInArrow(run, schema)
