"""EXT-01: raw pages to a node table, the only per-row step of page extraction.

``node(page_id, pre, last, parent, path, tag, attrs, text)``: ``pre`` numbers nodes in
document order, ``last`` is the last number of the subtree (the pre/size tree encoding known
from relational XPath work), ``path`` holds the ancestors from the root down. Text nodes are
rows with tag ``#text``.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

NODE_SCHEMA = (
    "page_id string, pre int, last int, parent int, path array<int>, tag string, "
    "attrs map<string,string>, text string"
)

_ARROW = pa.schema([
    ("page_id", pa.string()), ("pre", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()),
    ("path", pa.list_(pa.int32())), ("tag", pa.string()),
    ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()),
])

# Fixed values of the HTML standard: elements without content, and implied end tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
_SAME_LEVEL = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
_P_SCOPE = frozenset("table td th caption button object".split())
_NO_TEXT = frozenset("html head ul ol dl table tbody thead tfoot tr select colgroup".split())


class _Builder(HTMLParser):
    """Appends one row per node of one page; open elements live on a stack."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.stack: list[int] = []

    def _add(self, tag: str, attrs, text) -> int:
        pre = len(self.rows)
        parent = self.stack[-1] if self.stack else -1
        self.rows.append([pre, pre, parent, list(self.stack), tag, attrs, text])
        return pre

    def _pop_to(self, depth: int) -> None:
        end = len(self.rows) - 1
        for pre in self.stack[depth:]:
            self.rows[pre][1] = end
        del self.stack[depth:]

    def _close_nearest(self, tags, stop) -> None:
        for depth in range(len(self.stack) - 1, -1, -1):
            tag = self.rows[self.stack[depth]][4]
            if tag in tags:
                return self._pop_to(depth)
            if tag in stop:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES_P:
            self._close_nearest({"p"}, _P_SCOPE)
        if tag in _SAME_LEVEL:
            self._close_nearest(*_SAME_LEVEL[tag])
        # The first of repeated attributes counts.
        pairs = {}
        for key, value in attrs:
            pairs.setdefault(key, value or "")
        pre = self._add(tag, list(pairs.items()), None)
        if tag not in VOID:
            self.stack.append(pre)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag not in VOID:
            self._close_nearest({tag}, ())

    def handle_data(self, data):
        parent = self.rows[self.stack[-1]][4] if self.stack else "html"
        if parent in _NO_TEXT and not data.strip():
            return
        top = self.stack[-1] if self.stack else -1
        if self.rows and self.rows[-1][4] == "#text" and self.rows[-1][2] == top:
            self.rows[-1][6] += data
        else:
            self._add("#text", [], data)


def _parse(html: str) -> list[list]:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    builder._pop_to(0)
    return builder.rows


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for page_id, html in zip(ids, batch.column(1).to_pylist()):
            rows = _parse(html or "")
            if not rows:
                continue
            cols = list(zip(*rows))
            arrays = [pa.array([page_id] * len(rows), pa.string())] + [
                pa.array(col, field.type) for col, field in zip(cols, list(_ARROW)[1:])
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def parse_nodes(pages: DataFrame, page_id: str = "page_id", html: str = "html", buckets: int | None = None) -> DataFrame:
    """Node rows of every page, hashed once by page so that later steps need no shuffle.

    With ``buckets`` the pages are dealt out by page before they are parsed: they are smaller than
    their nodes. Spark does not know of that layout, so the nodes are for a table of these buckets.
    """
    raw = pages.select(F.col(page_id).cast("string").alias("page_id"), F.col(html).alias("html"))
    if buckets:
        return raw.repartition(buckets, "page_id").mapInArrow(_batches, NODE_SCHEMA)
    return raw.mapInArrow(_batches, NODE_SCHEMA).repartition("page_id")
