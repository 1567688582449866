"""Trees of web pages: elements and the blocks of text in them, from whatever markup."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

# Elements without content, and elements whose content is not text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript iframe object svg math canvas title head".split())
# Elements that stand in the flow of a line.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp"
    " small span strike strong sub sup time tt u var wbr img".split()
)
# Elements that an opening tag closes where they are still open (fixed values: optional end tags).
BLOCKS = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr main menu nav ol p pre section table ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}}
CLOSES |= {"th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tr", "td", "th"}, "body": {"head"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}}
HOLDS |= {"th": {"table", "tr"}, "tbody": {"table"}, "option": {"select"}}


@dataclass
class Page:
    """Nodes in the order of the page: parents come first. A node has a tag (``#text`` for
    a block of text), its attributes, the text directly in it and how much of it is in links."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    attributes: list[dict] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.open: list[tuple[str, int]] = []
        self.counts: Counter[str] = Counter()
        self.silent = self.links = 0
        self.words: list[str] = []
        self.in_links = 0
        self._node("#page", -1, {})

    def updatepos(self, i, j):
        """Nobody asks for line numbers."""
        return j

    def _node(self, tag, parent, attributes, text="", linked=0):
        page = self.page
        page.tag.append(tag)
        page.parent.append(parent)
        page.attributes.append(attributes)
        page.text.append(text)
        page.linked.append(linked)
        return len(page.tag) - 1

    def _top(self):
        for tag, node in reversed(self.open):
            if node >= 0:
                return node
        return 0

    def flush(self):
        """The text since the last block begins or ends is one block."""
        text = " ".join("".join(self.words).split())
        if text:
            self._node("#text", self._top(), {}, text, min(self.in_links, len(text)))
        self.words, self.in_links = [], 0

    def _pop(self, k):
        """Close all from place ``k`` on."""
        for tag, node in self.open[k:]:
            self.silent -= tag in SILENT
            self.links -= tag == "a"
            self.counts[tag] -= 1
        del self.open[k:]

    def _push(self, tag, node):
        self.open.append((tag, node))
        self.counts[tag] += 1

    def _close(self, tags, barrier=frozenset()):
        if not any(self.counts[t] for t in tags):
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in tags:
                self._pop(k)
            elif self.open[k][0] in barrier:
                return

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag in ("br", "hr"):
                self.words.append(" ")
            return
        if tag not in INLINE:
            self.flush()
        if tag in BLOCKS:
            self._close({"head"})
            self._close({"p"}, {"table", "td", "th", "li", "button", "object", "template"})
        if tag in CLOSES:
            self._close(CLOSES[tag], HOLDS.get(tag, frozenset()))
        if tag in INLINE:
            self.links += tag == "a"
            self._push(tag, -1)
            return
        self.silent += tag in SILENT
        attributes = {k: v or "" for k, v in attrs}
        self._push(tag, self._node(tag, self._top(), attributes))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.counts[tag]:
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                if tag not in INLINE or any(node >= 0 for _, node in self.open[k:]):
                    self.flush()
                self._pop(k)
                return
            # An inline end does not close blocks around it.
            if tag in INLINE and self.open[k][1] >= 0:
                return

    def handle_data(self, data):
        if not self.silent:
            self.words.append(data)
            if self.links:
                self.in_links += len(data)


def read_page(html: str) -> Page:
    """The tree of a page. Node 0 stands for the page itself."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader.flush()
    return reader.page
