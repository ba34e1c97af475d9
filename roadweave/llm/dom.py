"""Pages as trees: block-level elements and the blocks of text between their tags, in page order."""

from __future__ import annotations

import re
from html import unescape

#: Fixed values of HTML: elements that do not break a line, elements without content, elements whose content is no markup.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big blink cite code data del dfn em font i ins kbd label mark nobr output q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var".split()
)
VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
#: Elements whose text is never part of a page's body text.
UNSEEN = frozenset("head script style noscript template textarea title select option optgroup button iframe object svg canvas audio video noembed noframes datalist map applet".split())
#: Which open elements a start tag ends, and which ones bound the search for them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "tr"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in RAW}
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_PUNCT = ".,;:!?。，、！？"


def attribute_tokens(attributes: str) -> list[str]:
    """Words of class, id, role and itemprop, lower-case and split at case and marks, and ``hidden`` where an element is."""
    out: list[str] = []
    for name, a, b, c in _ATTR.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("hidden", "aria-hidden"):
            out += ["hidden"] if value.lower() != "false" else []
        elif name == "style":
            out += ["hidden"] if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) else []
        else:
            out += [w.lower() for w in _WORD.findall(value)]
    return out


class Page:
    """Nodes in page order: elements (tag, attributes) and blocks of text (tag ''), with parent and subtree's end.

    Text that no block-level tag parts is one block: its character references
    are decoded, white space becomes one space, and empty ones are left out.
    """

    def __init__(self, html: str):
        self.tag, self.attributes, self.parent, self.end, self.depth = ["html"], [""], [-1], [0], [0]
        #: Of blocks of text: the text and how many characters stand in links.
        self.text: dict[int, str] = {}
        self.linked: dict[int, int] = {}
        self._open, self._counts = [0], {"html": 1}
        self._pieces: list[str] = []
        self._in_links = 0
        self._link: int | None = None  # how many elements were open when the present link began
        self._unseen: list[str] = []
        self._read(html)

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            m = _TAG.search(html, at)
            stop = m.start() if m else n
            if stop > at and not self._unseen:
                self._pieces.append(html[at:stop])
                if self._link is not None:
                    self._in_links += stop - at
            if not m:
                break
            at = m.end()
            closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            name = name.lower()
            if closing:
                self._close(name)
                continue
            self._start(name, attributes)
            if name in RAW and name != "plaintext":
                found = _RAW_END[name].search(html, at)
                at = found.end() if found else n
                self._close(name)
        self._flush()
        while self._open:
            self.end[self._open.pop()] = len(self.tag)

    def _flush(self) -> None:
        if self._pieces:
            text = "".join(self._pieces)
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                self._add("", "")
                self.end[-1] = len(self.tag)
                self.text[len(self.tag) - 1], self.linked[len(self.tag) - 1] = text, min(self._in_links, len(text))
        self._pieces, self._in_links = [], 0

    def _add(self, tag: str, attributes: str) -> None:
        self.tag.append(tag)
        self.attributes.append(attributes)
        self.parent.append(self._open[-1])
        self.depth.append(len(self._open))
        self.end.append(0)

    def _start(self, name: str, attributes: str) -> None:
        if self._unseen == ["head"] and name not in VOID and name not in UNSEEN:
            self._unseen = []  # a head that nothing closes
        if self._unseen or name in UNSEEN:
            if name not in VOID and not attributes.endswith("/") and (name in UNSEEN or name in _BLOCKS):
                self._unseen.append(name)
                self._pieces.append(" ")
            return
        if name == "br" or name in VOID and name != "hr":
            self._pieces.append(" " if name in ("br", "img", "input", "embed") else "")
            return
        if name in INLINE or name not in _BLOCKS and "-" not in name:
            if name == "a":
                self._link = len(self._open)
            return
        self._flush()
        if name in ("html", "body"):
            if name in self._counts:  # of a page's second one only the content counts
                return
        top = self.tag[self._open[-1]]
        if top == "p" or top in HEADINGS and name in HEADINGS:
            self._pop(1)
        if name in ENDS:
            ended, bounds = ENDS[name]
            for k in range(len(self._open) - 1, 0, -1):
                tag = self.tag[self._open[k]]
                if tag in ended:
                    self._pop(len(self._open) - k)
                    if name not in ("tr", "tbody", "tfoot", "thead"):
                        break
                elif tag in bounds:
                    break
        if name == "hr":
            return
        self._add(name, attributes)
        if not (attributes.endswith("/") and "-" in name):
            self._open.append(len(self.tag) - 1)
            self._counts[name] = self._counts.get(name, 0) + 1
        else:
            self.end[-1] = len(self.tag)

    def _close(self, name: str) -> None:
        if self._unseen:
            if name in self._unseen:
                while self._unseen.pop() != name:
                    pass
                return
            if not self._counts.get(name) or name in ("html", "body"):
                return
            self._unseen = []  # the element around it ends: whatever it left open ends too
        if name == "a":
            self._link = None
        if name == "p" and not self._counts.get("p") or name == "br":
            self._flush() if name == "p" else self._pieces.append(" ")
            return
        if name in ("html", "body") or not self._counts.get(name):
            return
        self._flush()
        k = len(self._open) - 1
        while self.tag[self._open[k]] != name:
            k -= 1
        self._pop(len(self._open) - k)

    def _pop(self, n: int) -> None:
        self._flush()
        for _ in range(n):
            node = self._open.pop()
            self.end[node] = len(self.tag)
            self._counts[self.tag[node]] -= 1
        if self._link is not None and len(self._open) < self._link:
            self._link = None


#: Fixed values of HTML: elements that break a line.
_BLOCKS = frozenset(
    "html body address article aside blockquote caption center colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li listing main menu nav ol p picture plaintext pre search section summary table tbody td tfoot th thead tr ul".split()
)


def punctuation(text: str) -> int:
    return sum(map(text.count, _PUNCT))
