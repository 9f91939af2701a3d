"""The one Python stage: HTML text to flat element records (H01, H02, H04, inputs of H06-H09).

It tokenises and matches what nests. Every decision (what is a form, which words make a field
personal, where the consent text is) is taken later in Catalyst, on ``t0``/``t1`` offsets into the
page text and on ranges: one ordered sweep over the records gives each element the range of records
(``n0``..``n1``), fields (``f0``..``f1``) and submit controls (``s0``..``s1``) inside it, and each
field the text offsets of its labels. So a page with n elements costs n, not n squared, and has no
limit on their number.
"""

from __future__ import annotations

import sys
from bisect import bisect_right
from html.parser import HTMLParser
from itertools import islice
from urllib.parse import urljoin

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sitelens.functions.urls import NON_PAGE_PREFIXES

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(("script", "style", "template", "rt", "rp"))
CONTAINERS = frozenset(("div", "section", "aside", "article"))
CONTROLS = frozenset(("input", "textarea", "select"))
NOT_A_FIELD = frozenset(("hidden", "submit", "button", "image", "reset"))
KEPT = CONTAINERS | CONTROLS | {"form", "button", "a", "label"}
ATTRS = ("type", "id", "for", "name", "placeholder", "aria-label", "title", "value", "alt", "href", "class",
         "role", "aria-checked", "aria-required")

NODES = (
    "array<struct<pos: int, last: int, tag: string, rank: int, type: string, id: string, label_for: string, "
    "name: string, placeholder: string, aria_label: string, title: string, value: string, alt: string, "
    "href: string, class: string, role: string, aria_checked: string, aria_required: string, checked: boolean, "
    "required: boolean, t0: int, t1: int, html: string, area: array<struct<pos: int, t0: int, t1: int>>, "
    "n0: int, n1: int, f0: int, f1: int, s0: int, s1: int, area_n1: int, mixed: boolean, "
    "linked: struct<t0: int, t1: int>, around: struct<t0: int, t1: int>>>"
)
ANCHORS = "array<struct<href: string, url: string, text: string, title: string, has_href: boolean>>"
PARSED = (
    f"struct<title: string, text: string, doc_text: string, anchors: {ANCHORS}, script_srcs: array<string>, "
    f"iframe_srcs: array<string>, external_resources: array<string>, nodes: {NODES}>"
)
MODALS = f"array<struct<text: string, nodes: {NODES}>>"


def absolute(base: str, href: str) -> str:
    href = href.strip()
    if not href or href.startswith(NON_PAGE_PREFIXES):
        return ""
    try:
        return urljoin(base, href)
    except ValueError:
        return ""


class _Element:
    __slots__ = ("pos", "last", "tag", "attrs", "p0", "p1", "h0", "h1", "kids", "parent", "rank", "holds")

    def __init__(self, pos, tag, attrs, parent, p0, h0):
        self.pos, self.last, self.tag, self.attrs, self.parent = pos, pos, tag, attrs, parent
        self.p0, self.p1, self.h0, self.h1 = p0, p0, h0, h0
        self.kids, self.rank, self.holds = [], -1, False


class _Page(HTMLParser):
    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.source = source
        self.lines = [0]
        at = source.find("\n")
        while at >= 0:
            self.lines.append(at + 1)
            at = source.find("\n", at + 1)
        self.pieces, self.hidden, self.buffer = [], [], []
        self.kept, self.by_tag = [], {"script": [], "iframe": [], "resource": [], "a": []}
        self.count = self.containers = self.silent = self.noscript = 0
        self.controls = False
        self.title = None
        self.open = [_Element(0, "", {}, None, 0, 0)]
        self.open_count = {}
        self.feed(source)
        self.close()
        self._flush()
        while len(self.open) > 1:
            self._pop(len(source))

    def _offset(self):
        line, col = self.getpos()
        return self.lines[line - 1] + col

    def _flush(self):
        if not self.buffer:
            return
        words = "".join(self.buffer).split()
        self.buffer = []
        if words and not self.silent:
            piece = " ".join(words)
            if self.title is None and self.open[-1].tag == "title":
                self.title = piece
            self.pieces.append(piece)
            self.hidden.append(self.noscript > 0)

    def handle_data(self, data):
        self.buffer.append(data)

    def handle_comment(self, data):
        self._flush()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def parse_html_declaration(self, i):
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # an unknown marked section such as <![x y[: read it as a comment
            return self.parse_bogus_comment(i)

    def handle_starttag(self, tag, attrs):
        self._flush()
        self.count += 1
        parent = self.open[-1]
        values = {}
        for k, v in attrs:
            values.setdefault(k, "" if v is None else v)
        el = _Element(self.count, tag, values, parent, len(self.pieces), self._offset())
        parent.kids.append(el)
        if tag in KEPT or values.get("role") == "checkbox":
            self.kept.append(el)
        if tag in CONTAINERS:
            el.rank = self.containers
            self.containers += 1
        if tag in CONTROLS:
            self.controls = True
            for up in reversed(self.open):
                if up.holds:
                    break
                up.holds = True
        if tag == "a":
            self.by_tag["a"].append(el)
        if tag in ("script", "iframe") and values.get("src"):
            self.by_tag[tag].append(values["src"])
        if tag in ("img", "link", "script"):
            target = values.get("src") or values.get("href")
            if target:
                self.by_tag["resource"].append(target)
        self.open.append(el)
        self.open_count[tag] = self.open_count.get(tag, 0) + 1
        self.silent += tag in SILENT
        self.noscript += tag == "noscript"
        if tag in VOID:
            self._pop(el.h0 + len(self.get_starttag_text() or ""))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._pop(self._offset() + len(self.get_starttag_text() or ""))

    def handle_endtag(self, tag):
        self._flush()
        if not self.open_count.get(tag):
            return
        end = self.source.find(">", self._offset()) + 1
        while self._pop(end) != tag:
            pass

    def _pop(self, end):
        self._flush()
        el = self.open.pop()
        el.last, el.p1, el.h1 = self.count, len(self.pieces), end
        self.open_count[el.tag] -= 1
        self.silent -= el.tag in SILENT
        self.noscript -= el.tag == "noscript"
        return el.tag

    # ---- records -----------------------------------------------------------------
    def offsets(self):
        starts, ends, at = [], [], 0
        for p in self.pieces:
            starts.append(at)
            ends.append(at + len(p))
            at += len(p) + 1
        return lambda el: (starts[el.p0], ends[el.p1 - 1]) if el.p1 > el.p0 else (0, 0)

    def nodes(self, span):
        if not self.controls:
            return []
        kept = [el for el in self.kept if el.tag not in CONTAINERS or el.holds or el.attrs.get("role") == "checkbox"]
        at = {"node": [el.pos for el in kept], "field": [el.pos for el in kept if _is_field(el)],
              "submit": [el.pos for el in kept if _is_submit(el)], "form": [el.pos for el in kept if el.tag == "form"]}
        named = {}
        for el in kept:
            if el.tag == "label":
                named.setdefault(el.attrs.get("for", ""), span(el))
        out, labels, form_last = [], [], -1

        def inside(kind, el):
            return bisect_right(at[kind], el.pos), bisect_right(at[kind], el.last)

        for el in kept:
            while labels and labels[-1].last < el.pos:
                labels.pop()
            rec = {a.replace("-", "_"): el.attrs.get(a, "") for a in ATTRS if a != "for"}
            t0, t1 = span(el)
            scope = el.tag == "form" or el.tag in CONTAINERS
            roots = [el] + self._following(el) if scope else []
            (n0, n1), (f0, f1), (s0, s1), (g0, g1) = (inside(kind, el) for kind in at)
            id_ = el.attrs.get("id", "").strip()
            rec.update(
                pos=el.pos, last=el.last, tag=el.tag, rank=el.rank, label_for=el.attrs.get("for", ""), t0=t0, t1=t1,
                checked="checked" in el.attrs, required=_truthy(el.attrs, "required"),
                html=self.source[el.h0:min(el.h1, el.h0 + 900)] if scope or el.tag in CONTROLS else "",
                area=[{"pos": r.pos, "t0": a, "t1": b} for r in roots for a, b in [span(r)]],
                n0=n0, n1=n1, f0=f0, f1=f1, s0=s0, s1=s1, mixed=g1 > g0 or el.pos <= form_last,
                area_n1=bisect_right(at["node"], max((r.last for r in roots), default=el.last)),
                linked=_offsets(named.get(id_) if id_ else None), around=_offsets(span(labels[-1]) if labels else None),
            )
            out.append(rec)
            if el.tag == "label":
                labels.append(el)
            if el.tag == "form":
                form_last = max(form_last, el.last)
        return out

    @staticmethod
    def _following(el):
        kids = el.parent.kids
        at = bisect_right(kids, el.pos, key=lambda k: k.pos)
        return kids[at:at + 3]


def _kind(el):
    return el.attrs.get("type", "").strip().lower()


def _is_field(el):
    return el.tag in ("textarea", "select") or (el.tag == "input" and _kind(el) not in NOT_A_FIELD)


def _is_submit(el):
    if el.tag == "a":
        return any(word in el.attrs.get("class", "").lower() for word in ("btn", "button", "submit"))
    return (el.tag == "button" and _kind(el) != "reset") or (el.tag == "input" and _kind(el) in ("submit", "button", "image"))


def _offsets(span):
    return None if span is None else {"t0": span[0], "t1": span[1]}


def _truthy(attrs, name):
    return name in attrs and attrs[name].strip().lower() in ("", name, "true", "required", "checked")


def parse_page(html: str, base: str) -> dict:
    page = _Page(html)
    text = " ".join(page.pieces)
    span = page.offsets()

    def cut(el):
        a, b = span(el)
        return text[a:b]

    def resolved(values, keep_raw):
        urls = ((absolute(base, v), v) for v in values)
        return list(dict.fromkeys(u or v for u, v in urls if u or keep_raw))

    return {
        "title": page.title or "",
        "text": text,
        "doc_text": " ".join(p for p, h in zip(page.pieces, page.hidden) if not h) if any(page.hidden) else None,
        "anchors": [
            {"href": a.attrs.get("href", "").strip(), "url": absolute(base, a.attrs.get("href", "")),
             "text": cut(a), "title": a.attrs.get("title", "").strip(), "has_href": "href" in a.attrs}
            for a in page.by_tag["a"]
        ],
        "script_srcs": resolved(page.by_tag["script"], True),
        "iframe_srcs": resolved(page.by_tag["iframe"], True),
        "external_resources": resolved(page.by_tag["resource"], False),
        "nodes": page.nodes(span),
    }


def _arrow_type(ddl):
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(ddl))


#: parsed rows that a task holds as Python objects at a time; the rest of a batch is Arrow data
ROWS = 64


def arrow_rows(rows, kind: pa.DataType) -> pa.Array:
    """Rows of an iterator as one array, built in parts: Python objects take many times the room."""
    rows = iter(rows)
    parts = [pa.array([], kind)]
    while part := list(islice(rows, ROWS)):
        parts.append(pa.array(part, kind))
    return pa.concat_arrays(parts)


def parse_udfs():
    """(page parser, modal parser) as Arrow-batched functions."""
    page_type, modal_type = _arrow_type(PARSED), _arrow_type(MODALS)

    @F.arrow_udf(PARSED)
    def pages(html: pa.Array, base: pa.Array) -> pa.Array:
        return arrow_rows((parse_page(h.as_py() or "", b.as_py() or "") for h, b in zip(html, base)), page_type)

    @F.arrow_udf(MODALS)
    def modals(htmls: pa.Array) -> pa.Array:
        return arrow_rows(([{k: d[k] for k in ("text", "nodes")} for d in (parse_page(h or "", "") for h in hs.as_py() or [])]
                           for hs in htmls), modal_type)

    return pages, modals
