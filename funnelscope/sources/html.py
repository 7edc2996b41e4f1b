"""HTML captures to ordered page elements: the one job that runs Python per row.

``page_tokenize`` is a partition-parallel ``mapInArrow``: no shuffle, Arrow batches in and out.
Everything after it (titles, links, forms, ...) is built-in array functions in ``operators.features``.
"""

from __future__ import annotations

import html.entities
import json
import sys
from collections import Counter
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, types as T

# Ship this module's code with the tasks, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of HTML itself.
VOID_TAGS = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link "
    "menuitem meta nextid param source spacer track wbr".split()
)
KEPT_TAGS = frozenset("a button form h1 h2 input meta select textarea title".split())
KEPT_ATTRS = ("name", "id", "placeholder", "type", "required", "content", "itemtype")
TEXT_TAGS = frozenset("a button h1 h2 title".split())
HIDDEN_TAGS = frozenset("script style noscript svg template".split())
# Text directly inside these never counts as the text of an enclosing element.
SILENT_TAGS = frozenset("script style template rt rp".split())

ELEMENT_TYPE = T.StructType([
    T.StructField("ord", T.IntegerType()),        # position of the start tag among kept elements
    T.StructField("last", T.IntegerType()),       # position of the last kept element inside it
    T.StructField("tag", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("href", T.StringType()),
    T.StructField("href_abs", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
])
PAGE_FIELDS = [
    T.StructField("elements", T.ArrayType(ELEMENT_TYPE)),
    T.StructField("ld_types", T.ArrayType(T.StringType())),
    T.StructField("text", T.StringType()),
    T.StructField("parse_error", T.StringType()),
]
_ARROW_ELEMENT = pa.struct([
    ("ord", pa.int32()), ("last", pa.int32()), ("tag", pa.string()), ("text", pa.string()),
    ("href", pa.string()), ("href_abs", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())),
])
_ARROW_PAGE = [pa.list_(_ARROW_ELEMENT), pa.list_(pa.string()), pa.string(), pa.string()]
ROWS_PER_OUTPUT_BATCH = 256


class _PageReader(HTMLParser):
    """One pass over a page; an end tag closes back to its nearest open match, strays are ignored."""

    def __init__(self, base_url: str):
        super().__init__(convert_charrefs=False)
        self.base_url = base_url
        self.kept: list[dict] = []
        self.heard: list[str] = []      # text pieces that count for enclosing elements
        self.visible: list[str] = []    # text pieces that count for the page
        self.ld_types: dict[str, None] = {}
        self._open: list[tuple[str, dict | None, int]] = []
        self._open_count: Counter = Counter()
        self._pending: list[str] = []
        self._silent = self._hidden = 0     # how many open elements silence or hide text

    def updatepos(self, i, j):
        return j    # line numbers are not used

    def handle_data(self, data):
        self._pending.append(data)

    def handle_charref(self, name):
        self._pending.append(unescape(f"&#{name};"))

    def handle_entityref(self, name):
        self._pending.append(html.entities.html5.get(name + ";", "&" + name))

    def handle_comment(self, data):
        self._end_text()

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data):
        self._end_text()
        if data.upper().startswith("CDATA["):
            self._pending.append(data[len("CDATA["):])
            self._end_text()

    def handle_starttag(self, tag, attrs):
        self._start(tag, attrs, closed=tag in VOID_TAGS)

    def handle_startendtag(self, tag, attrs):
        self._start(tag, attrs, closed=True)

    def handle_endtag(self, tag):
        self._end_text()
        if self._open_count[tag]:
            while self._close_top() != tag:
                pass

    def finish(self):
        self.close()
        self._end_text()
        while self._open:
            self._close_top()

    def _start(self, tag, attrs, closed):
        self._end_text()
        attrs = {k: v if v is not None else "" for k, v in attrs}
        element = None
        if tag in KEPT_TAGS or "itemtype" in attrs:
            href = attrs.get("href") if tag in ("a", "button") else None
            element = {
                "ord": len(self.kept) + 1, "last": len(self.kept) + 1, "tag": tag, "text": "", "href": href,
                "href_abs": urljoin(self.base_url, href) if href is not None else None,
                "attrs": [(k, attrs[k]) for k in KEPT_ATTRS if k in attrs],
            }
            self.kept.append(element)
        elif tag == "script" and attrs.get("type") == "application/ld+json":
            element = {"tag": "json"}
        if not closed:
            self._open.append((tag, element, len(self.heard)))
            self._open_count[tag] += 1
            self._silent += tag in SILENT_TAGS
            self._hidden += tag in HIDDEN_TAGS

    def _close_top(self):
        tag, element, first_piece = self._open.pop()
        self._open_count[tag] -= 1
        self._silent -= tag in SILENT_TAGS
        self._hidden -= tag in HIDDEN_TAGS
        if element and "ord" in element:
            element["last"] = len(self.kept)
            if tag in TEXT_TAGS:
                glue = "" if tag == "title" else " "
                element["text"] = glue.join(self.heard[first_piece:])
        return tag

    def _end_text(self):
        if not self._pending:
            return
        piece = "".join(self._pending)
        self._pending = []
        top = self._open[-1][1] if self._open else None
        if top and top["tag"] == "json":
            self._read_json(piece)
        piece = piece.strip()
        if not piece or self._silent:
            return
        self.heard.append(piece)
        if not self._hidden:
            self.visible.append(piece)

    def _read_json(self, source):
        try:
            todo = [json.loads(source)]
        except json.JSONDecodeError:
            return
        while todo:
            node = todo.pop()
            if isinstance(node, dict):
                named = node.get("@type")
                for name in named if isinstance(named, list) else [named]:
                    if isinstance(name, str):
                        self.ld_types[name] = None
                todo.extend(node.values())
            elif isinstance(node, list):
                todo.extend(node)


def read_page(source: str | None, base_url: str | None) -> tuple:
    """(elements, ld_types, text, parse_error) of one page; nulls when there is nothing to read."""
    if source is None:
        return None, None, None, None
    try:
        reader = _PageReader(base_url or "")
        reader.feed(source)
        reader.finish()
        text = " ".join(" ".join(reader.visible).split())
        return reader.kept, list(reader.ld_types), text, None
    except Exception as e:  # a malformed page is a value, never a failed task
        return None, None, None, f"{type(e).__name__}: {e}"


def page_tokenize(captures: DataFrame, html_col: str = "html", base_col: str = "final_url") -> DataFrame:
    """Replace the HTML column by ``elements``, ``ld_types``, ``text`` and ``parse_error``.

    Filter and select columns before this call: nothing can be pushed through it.
    """
    kept_fields = [f for f in captures.schema.fields if f.name != html_col]
    schema = T.StructType(kept_fields + PAGE_FIELDS)
    kept_names = [f.name for f in kept_fields]
    names = kept_names + [f.name for f in PAGE_FIELDS]

    def read(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_PER_OUTPUT_BATCH):
                batch = whole.slice(start, ROWS_PER_OUTPUT_BATCH)
                pages = [read_page(source, base) for source, base in
                         zip(batch.column(html_col).to_pylist(), batch.column(base_col).to_pylist())]
                columns = [batch.column(n) for n in kept_names]
                columns += [pa.array([p[i] for p in pages], t) for i, t in enumerate(_ARROW_PAGE)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return captures.mapInArrow(read, schema)
