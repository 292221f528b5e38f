"""One parse of a page: its elements with the text between their ends, from which all its parts are read.

Tags are read in order onto a stack of open elements. Void elements hold nothing, some start tags end what they cannot stand in (a list
item ends the item before it, a block ends a paragraph), and an end tag ends everything opened inside its element, but for blocks inside
inline elements, which stay open. An element's text is a run of the page's pieces of text, so no nodes are copied.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRINGS, _MAP = T.ArrayType(T.StringType()), T.MapType(T.StringType(), T.StringType())
PARTS = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("title", "text", "footer", "header")],
        *[T.StructField(n, _STRINGS) for n in ("mailto", "hrefs", "images", "json_ld")],
        T.StructField("meta", _MAP),
        T.StructField("microdata", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("properties", _MAP)]))),
    ]
)
FOOTER_CHARS, HEADER_CHARS, TITLE_CHARS, META_CHARS = 5000, 2000, 500, 1000

# How HTML's elements nest.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre search section summary table ul".split())
_STRUCTURE = _BLOCKS | frozenset("body html head li dd dt td th tr thead tbody tfoot caption colgroup option optgroup button".split())
#: start tag -> (open elements that it ends, elements beyond which it does not look)
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, set()),
    **{t: ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}) for t in ("thead", "tbody", "tfoot")},
}
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_HIDDEN = frozenset("script style noscript".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'<]++|"[^"]*+"|'[^']*+'|["'])*+)>|<[!?/][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WHITE = re.compile(r"[ \t\n\x0b\f\r]+")
_NAMED = re.compile(r"(?i)class|item")
_READ = frozenset("a img meta script".split())


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(text):
        value = double or single or bare
        out.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return out


class Page:
    """The parsed page: ``texts`` in order, and ``elements`` in order, as [tag, attributes, first text, text after the last, element after the last inside]."""

    def __init__(self, html: str):
        self.texts: list[str] = []
        self.shown: list[bool] = []
        self.elements: list[list] = []
        self._open: list[list] = []
        self._hidden = 0
        at, size = 0, len(html)
        while at < size:
            token = _TOKEN.search(html, at)
            self._text(html[at : token.start() if token else size])
            if token is None:
                break
            at = token.end()
            slash, tag, attributes = token.group(1, 2, 3)
            if tag is None:
                continue
            tag = tag.lower()
            if slash:
                self._close(tag)
                continue
            self._start(tag, attributes)
            if tag in _RAW:
                closing = re.compile(rf"(?i)</{tag}(?=[\s/>]|\Z)").search(html, at)
                end = closing.start() if closing else size
                self._text(html[at:end], raw=tag not in ("title", "textarea"))
                at = end
        while self._open:
            self._end(self._open.pop())

    def _text(self, text: str, raw: bool = False) -> None:
        if text:
            self.texts.append(text if raw or "&" not in text else unescape(text))
            self.shown.append(not self._hidden)

    def _end(self, element: list) -> None:
        element[3:] = len(self.texts), len(self.elements)
        self._hidden -= element[0] in _HIDDEN

    def _start(self, tag: str, attributes: str) -> None:
        ends, beyond = _ENDS.get(tag, ({"p"}, {"button"}) if tag in _BLOCKS else (None, None))
        if ends:
            for k in range(len(self._open) - 1, -1, -1):
                if self._open[k][0] in ends:
                    for x in reversed(self._open[k:]):
                        self._end(x)
                    del self._open[k:]
                    break
                if self._open[k][0] in beyond:
                    break
        read = tag in _READ or _NAMED.search(attributes)
        element = [tag, _attributes(attributes) if read else {}, len(self.texts), len(self.texts), len(self.elements) + 1]
        self.elements.append(element)
        if tag not in _VOID:
            self._open.append(element)
            self._hidden += tag in _HIDDEN

    def _close(self, tag: str) -> None:
        k = next((k for k in range(len(self._open) - 1, -1, -1) if self._open[k][0] == tag), None)
        if k is None:
            return
        if tag not in _STRUCTURE and any(x[0] in _STRUCTURE for x in self._open[k + 1 :]):
            self._end(self._open.pop(k))
            return
        for x in reversed(self._open[k:]):
            self._end(x)
        del self._open[k:]

    def visible(self, element: list | None = None) -> str:
        """The text of an element, or of the page, but for scripts and styles: pieces set apart, white space as one space."""
        a, b = (0, len(self.texts)) if element is None else element[2:4]
        return _WHITE.sub(" ", " ".join([t for t, s in zip(self.texts[a:b], self.shown[a:b], strict=True) if s])).strip()

    def section(self, tag: str) -> str:
        """Text of the first such element; without one, of the first whose class holds the name."""
        named = next((x for x in self.elements if x[0] == tag), None)
        found = named or next((x for x in self.elements if tag in x[1].get("class", "").lower()), None)
        return self.visible(found) if found else ""

    def microdata(self) -> Iterator[dict]:
        """Each typed element with the properties of the elements inside it: content, else href, else text; the last of a name counts."""
        for n, item in enumerate(self.elements):
            if "itemtype" not in item[1]:
                continue
            properties = {}
            for x in self.elements[n + 1 : item[4]]:
                name = x[1].get("itemprop")
                value = name and (x[1].get("content") or x[1].get("href") or "".join(t.strip() for t in self.texts[x[2] : x[3]]))
                if value:
                    properties[name] = value
            yield {"type": item[1]["itemtype"], "properties": properties}


def read(html: str | None) -> tuple:
    """The values of ``PARTS``. A null or blank page has empty parts."""
    page = Page(html or "")
    title, meta, mailto, hrefs, images, blocks = None, {}, [], [], [], []
    for x in page.elements:
        tag, a = x[0], x[1]
        if tag == "a" and "href" in a:
            href = a["href"].strip()
            hrefs.append(href)
            if href[:7].lower() == "mailto:":
                address = href[7:].split("?")[0].strip().lower()
                if "@" in address:
                    mailto.append(address)
        elif tag == "img" and a.get("src", "").strip():
            images.append(a["src"].strip())
        elif tag == "meta":
            key, content = (a.get("name") or a.get("property") or "").lower(), a.get("content", "")
            if key and content:
                meta[key] = content[:META_CHARS]
        elif tag == "script" and a.get("type", "").strip().lower() == "application/ld+json":
            blocks.append("".join(page.texts[x[2] : x[3]]))
        elif tag == "title" and title is None:
            title = "".join(page.texts[x[2] : x[3]]).strip()[:TITLE_CHARS]
    return title or "", page.visible(), page.section("footer")[:FOOTER_CHARS], page.section("header")[:HEADER_CHARS], mailto, hrefs, images, blocks, meta, list(page.microdata())


@F.pandas_udf(PARTS)
def _parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for pages in batches:
        yield pd.DataFrame([read(p) for p in pages], columns=PARTS.names)


def parts(html: Column) -> Column:
    """The parts of a page. Spark parses a page once however many of its parts a projection names."""
    return _parse(html)
