"""Web pages to rows: one per element (``parse_elements``), and the flat, ordered node table of each page's accessibility tree (``parse_pages``).

A page is parsed once, iteratively, inside a task. Every element becomes a row with its place in the page (``pos`` to ``last`` spans all
below it), its attributes, the beginning of what it says and where it stands in the source. What an element is called, which fields
have labels and what the page's rules count is worked out from these rows by joins and windows (``operators.names``), not here.

Headings, paragraphs, links with a target, images, lists with their items, tables with rows and cells, and sectioning elements become nodes; other elements are
transparent; a section without nodes of its own is left out. The document node carries what rules ask of the whole page.

A page that can't be parsed yields its document node alone, with ``props['status'] = 'failed'``; null html is an empty page. Elements deeper
than ``MOST_DEPTH`` become children of the element at that depth, as in browsers; so time and rows are in proportion to the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import names, styles
from .staging import staged

NODES = (
    "doc_id long, node_id string, parent_id string, node_type string, dfs_pos int, bfs_pos int, depth int, sibling_pos int, path array<string>, content_kind string, "
    "text string, level int, ordered boolean, marker string, cell_type string, header_scope string, row_span int, col_span int, is_decorative boolean, alt_text string, "
    "target string, page int, language string, source_format string, props map<string,string>"
)
_STRINGS = ("node_id", "parent_id", "node_type", "content_kind", "text", "marker", "cell_type", "header_scope", "alt_text", "target", "language", "source_format")
_INTS = ("dfs_pos", "bfs_pos", "depth", "sibling_pos", "level", "row_span", "col_span", "page")
_ORDER = [c.split()[0] for c in re.sub(r"<[^>]*>", "", NODES).split(", ")]

#: Elements whose own text is a block: what an image may be near to.
TEXT_BLOCKS = set("p h1 h2 h3 h4 h5 h6 li td th dt dd figcaption blockquote pre caption".split())
#: Elements by what becomes of them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = set("script style template noscript head svg math".split())
SECTIONS = set("section article main nav aside header footer".split())
HEADINGS = {f"h{i}": i for i in range(1, 7)}
ENDS_P = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
           "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
CONTROLS = set("input select textarea".split())
#: Nested elements are kept to this depth, characters of what an element says, and of what is written near an image.
MOST_DEPTH, MOST_SAID, MOST_NEAR = 256, 200, 200
# Identifiers of form fields and the purposes they name.
AUTOCOMPLETE = {
    "email": "email", "emailaddress": "email", "emailaddr": "email", "mail": "email", "mailaddress": "email", "useremail": "email",
    "firstname": "given-name", "givenname": "given-name", "fname": "given-name", "forename": "given-name",
    "lastname": "family-name", "familyname": "family-name", "surname": "family-name", "lname": "family-name",
    "fullname": "name", "yourname": "name", "name": "name",
    "phone": "tel", "phonenumber": "tel", "telephone": "tel", "telephonenumber": "tel", "tel": "tel", "mobile": "tel", "mobilenumber": "tel", "mobilephone": "tel",
    "cellphone": "tel", "cell": "tel",
    "streetaddress": "street-address", "street": "street-address", "address": "street-address", "address1": "address-line1", "addressline1": "address-line1",
    "address2": "address-line2", "addressline2": "address-line2", "postalcode": "postal-code", "zipcode": "postal-code", "postcode": "postal-code", "zip": "postal-code",
    "country": "country-name", "countryname": "country-name",
    "organization": "organization", "organisation": "organization", "organizationname": "organization", "company": "organization", "companyname": "organization",
    "employer": "organization", "birthday": "bday", "dateofbirth": "bday", "dob": "bday", "bday": "bday", "username": "username", "userid": "username",
}
# Words put around a purpose; field types that can have one; words of fields for other people's data.
AFFIXES = ("user", "contact", "billing", "shipping", "home", "work", "your", "my", "customer", "input", "field", "txt", "text", "the")
PURPOSE_TYPES = ("text", "tel", "email", "")
THIRD_PARTY = (
    "recipient", "friend", "colleague", "referral", "refer", "guest", "invitee", "emergency", "nextofkin", "beneficiary", "dependent", "spouse", "parent", "child",
    "employee", "candidate", "patient", "client", "student", "member", "sender", "to", "cc", "bcc",
)


class Element:
    """An element with the places of its start tag (start, body), its end tag (close, stop) in the source, and its place in the page (pos, last)."""

    __slots__ = ("tag", "attrs", "children", "parent", "start", "body", "close", "stop", "pos", "last", "row")

    def __init__(self, tag: str, attrs: dict, parent: Element | None, start: int = 0, body: int = 0):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.start, self.body, self.close, self.stop, self.pos, self.last, self.row = start, body, None, None, 0, 0, None

    def text(self, skip: frozenset = frozenset()) -> str:
        out, todo = [], [self]
        while todo:
            e = todo.pop()
            if isinstance(e, str):
                out.append(e)
            elif e.tag not in SKIPPED and e.tag not in skip:
                if e.tag == "br":
                    out.append(" ")
                todo.extend(reversed(e.children))
        return " ".join("".join(out).split())

    def walk(self) -> Iterator[Element]:
        todo = [self]
        while todo:
            e = todo.pop()
            yield e
            todo.extend(c for c in reversed(e.children) if not isinstance(c, str))


class _Builder(HTMLParser):
    """A recovering tree: implied ends of paragraphs, items, rows, cells, links and headings; an end tag that closes nothing is ignored."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.page = page
        self.lines = [0, *(m.end() for m in re.finditer("\n", page))]
        self.root = Element("#root", {}, None)
        self.open = [self.root]
        self.count: dict[str, int] = {}

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _end(self, k: int, close: int, stop: int) -> None:
        """The open elements from the k-th on end: the k-th with its own end tag, if it has one, the others before it."""
        for i in range(len(self.open) - 1, k - 1, -1):
            e = self.open[i]
            e.close, e.stop = close, stop if i == k else close
            self.count[e.tag] -= 1
        del self.open[k:]

    def _close(self, tags: set, until: set) -> None:
        at = self._at()
        while any(self.count.get(t) for t in tags):
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag in tags:
                    self._end(k, at, at)
                    break
                if self.open[k].tag in until:
                    return
            else:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._close({"p"}, {"table", "td", "th", "li"})
        if tag in HEADINGS:
            self._close(set(HEADINGS), {"table", "td", "th", "li", "section", "article", "div"})
        if tag == "a":
            self._close({"a"}, {"table", "td", "th"})
        if tag in IMPLIED:
            self._close(IMPLIED[tag], SCOPE[tag])
        start = self._at()
        e = Element(tag, {k: v if v is not None else "" for k, v in attrs}, self.open[-1], start, start + len(self.get_starttag_text() or ""))
        self.open[-1].children.append(e)
        if tag in VOID or len(self.open) > MOST_DEPTH:
            e.close = e.stop = e.body
        else:
            self.open.append(e)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and self.open[-1].start == self._at():
            self._end(len(self.open) - 1, self.open[-1].body, self.open[-1].body)

    def handle_endtag(self, tag):
        if not self.count.get(tag):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                at = self._at()
                stop = self.page.find(">", at) + 1
                return self._end(k, at, stop or len(self.page))

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def finished(self) -> Element:
        self.feed(self.page)
        self.close()
        self._end(1, len(self.page), len(self.page))
        self.root.close = self.root.stop = len(self.page)
        return self.root


def tree_of(page: str) -> Element:
    return _Builder(page).finished()


def purpose(e: Element) -> str | None:
    """The autocomplete purpose that a field's own type, name or id gives away; never for passwords or other people's data."""
    kind = e.attrs.get("type", "text").lower()
    if e.tag != "input" or kind not in PURPOSE_TYPES:
        return None
    names = [e.attrs.get(k, "") for k in ("name", "id")]
    parts = {p.lower() for n in names for p in re.split(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])", n)}
    if parts & set(THIRD_PARTY):
        return None
    if kind in ("email", "tel"):
        return kind
    for n in names:
        word = re.sub(r"[^a-z0-9]", "", n.lower())
        while word and word not in AUTOCOMPLETE:
            bare = next((x for a in AFFIXES for x in (word.removeprefix(a), word.removesuffix(a)) if x and x != word), None)
            if bare is None:
                break
            word = bare
        if word in AUTOCOMPLETE:
            return AUTOCOMPLETE[word]
    return None


def _entered(e: Element) -> str:
    """What an element that has just been entered says, if it is a block of text: three words or more."""
    if e.tag not in TEXT_BLOCKS:
        return ""
    said = e.text(frozenset(("ul", "ol", "table")))
    return said if said.count(" ") >= 2 else ""


def _figure_caption(e: Element) -> str:
    """The caption of the figure that an image stands in."""
    for up in (e.parent, e.parent.parent if e.parent else None):
        if up is not None and up.tag == "figure":
            return next((t for t in (c.text() for c in up.children if not isinstance(c, str) and c.tag == "figcaption") if t), "")
    return ""


def page_nodes(doc_id, page: str | None) -> tuple[list[dict], Element | None]:
    """The node rows of one page in reading order (depth first), and its tree; each element of the tree holds its node's row."""
    rows: list[dict] = []

    def add(parent: dict | None, kind: str, **values) -> dict:
        node = {"doc_id": doc_id, "node_id": f"n{len(rows)}", "node_type": kind, "parent_id": parent["node_id"] if parent else None, "depth": parent["depth"] + 1 if parent else 0,
                "path": [*parent["path"], f"n{len(rows)}"] if parent else ["n0"], "sibling_pos": 0, "kids": 0,
                "source_format": "html", "content_kind": "text" if values.get("text") is not None else "none", "props": {}, **values}
        if parent:
            parent["kids"] += 1
        rows.append(node)
        return node

    try:
        root = tree_of(page or "")
    except Exception as error:  # a page that fails must not fail the corpus
        add(None, "document", props={"status": "failed", "note": type(error).__name__})
        return _finish(rows), None
    first = {}
    for e in root.walk():
        first.setdefault(e.tag, e)
    lang = first["html"].attrs.get("lang") or first["html"].attrs.get("xml:lang") if "html" in first else None
    title = " ".join("".join(c for c in first["title"].children if isinstance(c, str)).split()) if "title" in first else None
    document = root.row = add(None, "document", language=lang or None, props={"status": "ok"} | ({"title": title} if title is not None else {}))
    near = ""  # the last text of three words or more before this place
    todo: list[tuple[Element, dict]] = [(root, document)]
    while todo:
        e, parent = todo.pop()
        node, inner = None, parent
        if e.tag in SKIPPED or e.tag == "title":
            continue
        if e.tag in HEADINGS:
            node = add(parent, "heading", text=e.text(), level=HEADINGS[e.tag])
        elif e.tag == "p":
            if said := e.text():
                node = add(parent, "paragraph", text=said)
        elif e.tag == "a" and "href" in e.attrs:
            node = add(parent, "link", text=e.text(), target=e.attrs["href"])
        elif e.tag == "img":
            decorative = e.attrs.get("alt") == "" or e.attrs.get("role") in ("presentation", "none") or e.attrs.get("aria-hidden") == "true"
            named = _figure_caption(e) or e.attrs.get("title", "").strip() or near
            node = add(parent, "image", is_decorative=decorative, alt_text=None if decorative else e.attrs.get("alt"), target=e.attrs.get("src"),
                       props={k: v for k, v in (("title", e.attrs.get("title")), ("caption", named[:MOST_NEAR])) if v})
        elif e.tag in ("ul", "ol"):
            node = add(parent, "list", ordered=e.tag == "ol", marker="decimal" if e.tag == "ol" else "bullet")
        elif e.tag == "li":
            if parent["node_type"] == "list":
                node = add(parent, "list_item", text=e.text(frozenset(("ul", "ol"))))
        elif e.tag == "table":
            caption = next((c.text() for c in e.children if not isinstance(c, str) and c.tag == "caption"), "")
            node = add(parent, "table", props={k: v for k, v in (("caption", caption), ("role", e.attrs.get("role", ""))) if v})
        elif e.tag == "tr" and parent["node_type"] == "table":
            node = add(parent, "table_row")
        elif e.tag in ("td", "th") and parent["node_type"] == "table_row":
            scope = {"row": "row", "rowgroup": "row"}.get(e.attrs.get("scope", "").lower(), "column") if e.tag == "th" else None
            node = add(parent, "table_cell", text=e.text(frozenset(("table",))), cell_type="header" if e.tag == "th" else "data", header_scope=scope, row_span=1, col_span=1)
        elif e.tag in SECTIONS:
            node = add(parent, "section", props={"tag": e.tag})
        near = _entered(e) or near
        e.row = node or e.row
        inner = node or parent
        todo += [(c, inner) for c in reversed(e.children) if not isinstance(c, str)]
    return _finish(rows), root


def _finish(rows: list[dict]) -> list[dict]:
    """Leave out sections without nodes of their own, then number what stays."""
    gone = {r["node_id"] for r in rows if r["node_type"] == "section" and not r["kids"]}
    while gone:
        rows = [r for r in rows if r["node_id"] not in gone]
        full = {r["parent_id"] for r in rows}
        gone = {r["node_id"] for r in rows if r["node_type"] == "section" and r["node_id"] not in full}
    seen: dict = {}
    for i, r in enumerate(rows):
        r["dfs_pos"] = i
        r["sibling_pos"] = seen.get(r["parent_id"], 0)
        seen[r["parent_id"]] = r["sibling_pos"] + 1
    for i, r in enumerate(sorted(rows, key=lambda x: (x["depth"], x["dfs_pos"]))):
        r["bfs_pos"] = i
    return rows


def _spans(root: Element) -> tuple[str, dict[int, tuple[int, int]], list[tuple[Element, int, bool, int | None]], list[tuple[int, int, str]]]:
    """The page's visible text, each element's part of it by pos; the elements in order with their parent's pos, whether they are hidden and the cell they are in; the texts
    beside form controls and in coloured parts, as (pos, parent's pos, text). Numbers elements and texts in page order."""
    parts, size, spans, order, texts = [], 0, {}, [], []
    number = 0
    todo: list[tuple] = [("in", root, 0, False, None, True, False)]
    while todo:
        step, e, up, hidden, cell, shown, styled = todo.pop()
        if step == "text":
            number += 1
            texts.append((number, up, e))
            if shown:
                parts.append(e)
                size += len(e)
        elif step == "out":
            e.last = number
            spans[e.pos] = (spans[e.pos][0], size)
        else:
            if e is not root:
                number += 1
            e.pos = number
            hidden = hidden or e.attrs.get("aria-hidden", "").strip().lower() == "true"
            shown = shown and e.tag not in SKIPPED and e.tag != "title"
            if e.tag == "br" and shown:
                parts.append(" ")
                size += 1
            spans[e.pos] = (size, size)
            order.append((e, up, hidden, cell))
            styled = styled or "color" in e.attrs.get("style", "").lower()
            beside = styled or any(not isinstance(c, str) and c.tag in CONTROLS for c in e.children)
            cell = e.pos if e.tag in ("td", "th") else None if e.tag == "table" else cell
            todo.append(("out", e, up, hidden, cell, shown, styled))
            for c in reversed(e.children):
                if not isinstance(c, str):
                    todo.append(("in", c, e.pos, hidden, cell, shown, styled))
                elif beside or shown:
                    todo.append(("text", c, e.pos if beside else -1, hidden, cell, shown, styled))
    return "".join(parts), spans, order, [t for t in texts if t[1] >= 0]


def page_elements(doc_id, page: str | None) -> list[dict]:
    """The element rows of one page, those that became nodes with their node; texts only beside form controls and in coloured parts."""
    rows, root = page_nodes(doc_id, page)
    if root is None:
        return [{"doc_id": doc_id, "pos": 0, "last": 0, "tag": "#root", "attrs": {}, "node": rows[0]}]
    text, spans, order, texts = _spans(root)
    alive = {id(r) for r in rows}
    out = []
    for e, up, hidden, cell in order:
        a, b = spans[e.pos]
        label = e.attrs.get("aria-label", "")
        said = " ".join(text[a:b].split()) if b - a <= 4 * max(MOST_SAID, len(label)) else None
        row = {"doc_id": doc_id, "pos": e.pos, "last": e.last, "parent": up if e is not root else None, "tag": e.tag, "attrs": e.attrs, "said": said, "said_chars": b - a, "hidden": hidden, "cell": cell,
               "purpose": purpose(e), "start": e.start, "body": e.body, "close": e.close, "stop": e.stop, "node": e.row if e.row is not None and id(e.row) in alive else None}
        if e.tag in ("td", "th") and b - a <= 4 * MOST_SAID:
            row["bare"] = e.text(frozenset(CONTROLS))
        out.append(row)
    out += [{"doc_id": doc_id, "pos": pos, "last": pos, "parent": up, "tag": "#text", "attrs": {}, "said": t if len(t) <= 4 * MOST_SAID else None, "said_chars": len(t), "hidden": False} for pos, up, t in texts]
    return out


_KINDS = {c: pa.string() for c in _STRINGS} | {c: pa.int32() for c in _INTS} | {c: pa.bool_() for c in ("ordered", "is_decorative")} | {
    "doc_id": pa.int64(), "path": pa.list_(pa.string()), "props": pa.map_(pa.string(), pa.string())}
_NODE = pa.struct([pa.field(c, _KINDS[c]) for c in _ORDER if c != "doc_id"])
_ELEMENT = {"doc_id": pa.int64(), "pos": pa.int32(), "last": pa.int32(), "parent": pa.int32(), "tag": pa.string(), "attrs": pa.map_(pa.string(), pa.string()), "said": pa.string(), "said_chars": pa.int32(),
            "bare": pa.string(), "hidden": pa.bool_(), "cell": pa.int32(), "purpose": pa.string(), "start": pa.int32(), "body": pa.int32(), "close": pa.int32(), "stop": pa.int32(), "node": _NODE}
ELEMENTS = ("doc_id long, pos int, last int, parent int, tag string, attrs map<string,string>, said string, said_chars int, bare string, hidden boolean, cell int, purpose string, start int, body int, close int, stop int, "
            f"node struct<{', '.join(c for c in NODES.split(', ') if not c.startswith('doc_id')).replace(' ', ':').replace(',:', ',')}>")


def parse_elements(pages: DataFrame, doc_id: str = "page_id", page: str = "html") -> DataFrame:
    """The element rows of all pages. Filter pages before this, and read the result once or write it."""

    def value(row: dict, c: str):
        if c == "attrs":
            return list(row["attrs"].items())
        if c == "node" and row.get("node") is not None:
            return {k: list(row["node"]["props"].items()) if k == "props" else row["node"].get(k) for k in _ORDER if k != "doc_id"}
        return row.get(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 50):
                part = batch.slice(s, 50)
                rows = [r for i, p in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for r in page_elements(i, p)]
                yield pa.RecordBatch.from_arrays([pa.array([value(r, c) for r in rows], t) for c, t in _ELEMENT.items()], list(_ELEMENT))

    rows = pages.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(page).cast("string").alias("html"))
    width = pages.sparkSession.sparkContext.defaultParallelism
    # a few files would leave the parsing, by far the dearest step, to a few tasks; many are never shuffled
    return (rows.repartition(width) if len(pages.inputFiles()) < width else rows).mapInArrow(run, ELEMENTS)


def element_nodes(elements: DataFrame) -> DataFrame:
    """The node table of written element rows: the nodes as parsed, the document nodes with what the page's rules count, links with a mark if they have no name."""
    nodes = elements.filter("node is not null").select("doc_id", "node.*")
    more = names.node_properties(elements)
    if not elements.filter(styles.declaration("color").isNotNull()).isEmpty():  # else there is no colour to inherit
        more = more.unionByName(styles.style_properties(elements)).groupBy("doc_id", "node_id").agg(F.map_from_entries(F.flatten(F.collect_list(F.map_entries("_more")))).alias("_more"))
    none = F.create_map().cast("map<string,string>")
    props = F.map_concat(F.coalesce("props", none), F.coalesce("_more", none))
    return nodes.join(more, ["doc_id", "node_id"], "left").withColumn("props", props).select(*_ORDER)


def parse_pages(pages: DataFrame, doc_id: str = "page_id", page: str = "html") -> DataFrame:
    """The node table of all pages, written, as its element rows are: rules read it many times, and its own plan is long. Filter pages before this."""
    return staged(element_nodes(staged(parse_elements(pages, doc_id, page), "elements")), "nodes")
