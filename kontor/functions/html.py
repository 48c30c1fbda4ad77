"""One-pass HTML reader used inside the Spark tasks.

It only turns markup into typed lists; every decision about the content is made by DataFrame expressions.
A new block element closes an open paragraph, as in HTML5.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_SILENT = {"script", "style", "noscript", "template"}
_ENDS_PARAGRAPH = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2",
                   "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_SIBLING_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
                 "th": {"td", "th"}, "option": {"option"}}
_KEPT = {"title", "h1", "h2", "a", "p", "li", "div", "dt", "dd", "td", "th"}
_PHONE = re.compile(r"(?:\+|00)?\d[\d\s/().-]{5,}\d")


def _squeeze(text: str) -> str:
    return " ".join(text.split())


def _label(text: str) -> str:
    return _squeeze(text).strip(" \t:;|")


class _Node:
    __slots__ = ("tag", "attrs", "hidden", "texts", "extra")

    def __init__(self, tag, attrs, hidden, keep):
        self.tag, self.attrs, self.hidden = tag, attrs, hidden
        self.texts = [] if keep else None
        self.extra = {}

    def text(self) -> str:
        return " ".join(self.texts or ())


class PageReader(HTMLParser):
    """Collects the typed parts of one page."""

    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.open, self.script = url, [], None
        self.title = self.meta_description = None
        self.headings, self.links, self.paragraphs, self.blocks = [], [], [], []
        self.visible, self.lines, self.hours, self.jsonld = [], [], [], []
        self.has_form = False
        self.terms, self.cells = [], []

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        if tag in _ENDS_PARAGRAPH and any(n.tag == "p" for n in self.open):
            self._close("p")
        for ended in _SIBLING_ENDS.get(tag, ()):
            if self.open and any(n.tag == ended for n in self.open) and self._near(ended):
                self._close(ended)
        if tag == "meta" and self.meta_description is None and attrs.get("name", "").lower() == "description":
            self.meta_description = _squeeze(attrs.get("content", ""))
        if tag == "form":
            self.has_form = True
        style = attrs.get("style", "")
        concealed = ("hidden" in attrs or attrs.get("aria-hidden") == "true"
                     or "display:none" in style or "display: none" in style)
        parent_hidden = bool(self.open) and self.open[-1].hidden
        item = attrs.get("itemprop")
        keep = tag in _KEPT or item is not None
        node = _Node(tag, attrs, parent_hidden or concealed or tag in _SILENT, keep)
        if tag in ("a", "p"):
            node.extra["slot"] = len(self.links if tag == "a" else self.paragraphs)
            (self.links if tag == "a" else self.paragraphs).append(None)
        if tag in _VOID:
            self._finish(node)
            return
        if tag == "script":
            self.script = [] if attrs.get("type") == "application/ld+json" else None
        self.open.append(node)

    def _near(self, tag) -> bool:
        """Is the element open inside the current list, table or definition list?"""
        for node in reversed(self.open):
            if node.tag == tag:
                return True
            if node.tag in ("ul", "ol", "dl", "table"):
                return False
        return False

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if any(n.tag == tag for n in self.open):
            self._close(tag)

    def _close(self, tag):
        while self.open:
            node = self.open.pop()
            self._finish(node)
            if node.tag == tag:
                return

    def handle_data(self, data):
        inside = self.open[-1].tag if self.open else ""
        if inside == "script" and self.script is not None:
            self.script.append(data)
        text = data.strip()
        silent = any(n.tag in _SILENT for n in self.open)
        if not text or silent:
            return
        hidden = bool(self.open) and self.open[-1].hidden
        if not hidden:
            self.visible.append(text)
        if not any(n.tag == "nav" for n in self.open):
            self.lines.extend(x for x in map(_label, text.splitlines()) if x)
        for node in self.open:
            if node.texts is not None:
                node.texts.append(text)

    def _finish(self, node):
        tag, attrs = node.tag, node.attrs
        text = node.text()
        if tag == "title" and self.title is None:
            self.title = text
        elif tag in ("h1", "h2"):
            self.headings.append(_squeeze(text))
        elif tag == "a" and "href" in attrs:
            self.links[node.extra["slot"]] = (joined(self.url, attrs["href"]), attrs["href"], text, node.hidden)
        elif tag == "script" and self.script is not None:
            self._read_json("".join(self.script))
            self.script = None
        if tag == "p" and not node.hidden:
            self.paragraphs[node.extra["slot"]] = _squeeze(text)
        if tag in ("p", "li", "div") and not any(n.tag == "nav" for n in self.open):
            self.blocks.append(_label(text))
        elif tag == "dt":
            self.terms.append(_label(text))
        elif tag == "dd" and self.terms:
            self.cells.append((self.terms.pop(), _label(text)))
            self.terms.clear()
        elif tag in ("td", "th"):
            row = next((n for n in reversed(self.open) if n.tag == "tr"), None)
            if row is not None:
                row.extra.setdefault("cells", []).append(_label(text))
        elif tag == "tr" and len(node.extra.get("cells", ())) >= 2:
            first, *rest = node.extra["cells"]
            self.cells.append((first, _label(" ".join(rest))))
        self._microdata(node, attrs.get("content") or text)

    def _microdata(self, node, value):
        item = node.attrs.get("itemprop")
        if item == "openingHours" and value:
            self.hours.append(value)
        elif item in ("dayOfWeek", "opens", "closes"):
            owner = next((n for n in reversed(self.open)
                          if "OpeningHoursSpecification" in n.attrs.get("itemtype", "")), None)
            if owner is not None:
                owner.extra.setdefault(item, []).append(value)
        if "OpeningHoursSpecification" in node.attrs.get("itemtype", ""):
            opens, closes = node.extra.get("opens", [""])[0], node.extra.get("closes", [""])[0]
            if opens and closes:
                self.hours.extend(f"{day}: {opens}–{closes}" for day in node.extra.get("dayOfWeek", ()))

    def _read_json(self, payload):
        try:
            pending = [json.loads(payload or "{}")]
        except ValueError:
            return
        while pending:
            value = pending.pop(0)
            if isinstance(value, dict):
                self.jsonld.append(_json_node(value))
                pending[:0] = list(value.values())
            elif isinstance(value, list):
                pending[:0] = value

    def result(self) -> dict:
        while self.open:
            self._finish(self.open.pop())
        pairs = list(self.cells)
        for block in self.blocks:
            label, colon, value = block.partition(":")
            if block.count(":") == 1 and len(block) <= 400 and len(label) <= 80 and value.strip():
                pairs.append((_label(label), _label(value)))
        visible = _squeeze(" ".join(self.visible))
        phones = [{"value": m.group(), "context": visible[max(0, m.start() - 40):m.end() + 40]} for m in _PHONE.finditer(visible)]
        return {
            "title": self.title or "", "meta_description": self.meta_description or "", "headings": self.headings,
            "links": [dict(zip(("url", "href", "text", "hidden"), link)) for link in self.links if link],
            "jsonld": self.jsonld, "microdata_hours": self.hours, "visible_text": visible,
            "paragraphs": [p for p in self.paragraphs if p], "has_form": self.has_form, "phones": phones,
            "pairs": [{"label": a, "value": b} for a, b in dict.fromkeys(pairs)], "lines": self.lines,
        }


def joined(base: str, href: str) -> str:
    try:
        return urljoin(base, href)
    except ValueError:
        return ""


def _listed(value) -> list:
    return value if isinstance(value, list) else [value]


def _json_node(node: dict) -> dict:
    text = lambda key: str(node.get(key) or "")
    specs = [{"days": [str(d) for d in _listed(s.get("dayOfWeek", []))], "opens": str(s.get("opens", "")),
              "closes": str(s.get("closes", ""))}
             for s in _listed(node.get("openingHoursSpecification") or []) if isinstance(s, dict)]
    return {
        "types": [str(t) for t in _listed(node.get("@type")) if t], "telephone": text("telephone"),
        "street": text("streetAddress"), "zipcode": text("postalCode"), "city": text("addressLocality"),
        "country": text("addressCountry"), "opening_hours": [str(v) for v in _listed(node.get("openingHours") or [])],
        "specs": specs,
    }


def read_page(url: str, html: str) -> dict:
    reader = PageReader(url)
    reader.feed(html or "")
    reader.close()
    return reader.result()
