"""Web pages as trees of block elements and runs of text.

Elements that only mark up words are folded into the run of text around them, except those whose names hint at a part of
the page (an inline advert, say), which are nodes of their own. Missing end tags are put where HTML puts
them for paragraphs, list items and cells; an end tag without a start tag is left out. Nothing is ever dropped but
markup, comments and elements whose text is no text of the page (scripts, styles, controls and so on).
"""

from __future__ import annotations

import html as entities
import re
from array import array
from functools import lru_cache

#: Elements by kind. All others mark up words.
GROUPS = {
    "body": ("body",),
    "article": ("article",),
    "main": ("main",),
    "section": ("section", "hgroup", "details", "center", "search", "dialog"),
    "div": ("div",),
    "p": ("p", "summary", "address"),
    "heading": ("h1", "h2", "h3", "h4", "h5", "h6"),
    "list": ("ul", "ol", "dl", "dir"),
    "item": ("li", "dd", "dt"),
    "table": ("table", "tbody", "thead", "tfoot", "caption", "tr"),
    "cell": ("td", "th"),
    "quote": ("blockquote", "pre"),
    "figure": ("figure", "figcaption"),
    "nav": ("nav", "menu"),
    "header": ("header",),
    "footer": ("footer",),
    "aside": ("aside",),
    "form": ("form", "fieldset", "legend"),
    "rule": ("hr",),
}
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
SILENT = ("noscript", "template", "svg", "math", "select", "button", "object", "canvas", "audio", "video", "datalist", "map")
VOID = ("area", "base", "br", "col", "embed", "frame", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
#: What an element's start ends: these, up to one of those.
ENDS = {
    **dict.fromkeys(GROUPS["item"], (GROUPS["item"], GROUPS["list"] + GROUPS["nav"] + GROUPS["cell"])),
    **dict.fromkeys(GROUPS["cell"], (GROUPS["cell"], ("tr", "table"))),
    "tr": (("tr",), ("table",)),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (("tbody", "thead", "tfoot", "caption"), ("table",))),
    **dict.fromkeys(GROUPS["heading"], (GROUPS["heading"], GROUPS["cell"] + GROUPS["div"] + GROUPS["section"] + GROUPS["article"])),
}
#: Words in class, id and role that hint at a part of a page.
HINTS = {
    "content": "article content contents post entry main story text body articlebody prose hentry copy",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toolbar tabs pagination pager submenu skip",
    "advert": "ad ads adv advert advertisement advertising adsense sponsor sponsored sponsors promo promotion banner outbrain taboola",
    "comment": "comment comments commentlist reply replies disqus discussion respond feedback reviews thread",
    "side": "sidebar side aside related recommended recommendations widget widgets complementary rail trending popular more",
    "frame": "header footer foot masthead copyright legal colophon contentinfo top bottom credits site",
    "notice": "cookie cookies consent notice popup modal newsletter subscribe subscription alert gdpr privacy overlay paywall toast message",
    "share": "share sharing social tags tag meta byline author bio print follow",
    "form": "form login signin signup search searchbox register contact",
    "hidden": "hidden invisible",
}

GROUP_NAMES = ("root", *GROUPS, "inline")
HINT_NAMES = tuple(HINTS)
_GROUP = {tag: GROUP_NAMES.index(group) for group, tags in GROUPS.items() for tag in tags}
_HINT = {word: 1 << k for k, words in enumerate(HINTS.values()) for word in words.split()}
_INLINE = GROUP_NAMES.index("inline")
_SILENT, _VOID = frozenset(SILENT), frozenset(VOID)
_P_KEEPS = frozenset(("body", *GROUPS["table"], *GROUPS["cell"]))
_P_STOPS = frozenset(("table", "caption", *GROUPS["cell"]))
_TAG = re.compile(
    r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)([^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*+)*+|[^>]*)>)""", re.S
)
_NAMED = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
_STOPS = re.compile(r"[.,;:!?]")
_WORD = re.compile(r"\S+")


@lru_cache(1 << 12)
def hints_of(attributes: str) -> int:
    """What an element's names hint at, as bits."""
    found = 0
    for name, value in _NAMED.findall(attributes):
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and "true" in value) or (name == "style" and re.search(r"display\s*:\s*none", value)):
            found |= _HINT["hidden"]
        elif name in ("class", "id", "role"):
            for word in _WORDS.findall(value):
                found |= _HINT.get(word.lower(), 0)
    return found


class Page:
    """Nodes in page order, so a parent comes before its children; node 0 is above all others."""

    def __init__(self, source: str):
        self.parent, self.group, self.hints = array("i", [-1]), array("i", [0]), array("i", [0])
        #: Of runs of text: characters, those of them in links, words, stops, whether it ends with a stop, and its block.
        self.runs: list[tuple[int, int, int, int, int, int, int]] = []
        self.texts: list[str] = []
        self._block, self._links, self._silent = 0, 0, 0
        self._held: list[str] = []
        self._held_links = 0
        self._stack: list[tuple[str, int]] = [("", 0)]  # names, and the nodes that text below them belongs to
        self._read(source)
        self._flush()

    def _read(self, source: str) -> None:
        at, search = 0, _TAG.search
        while (found := search(source, at)) is not None:
            if found.start() > at:
                self._text(source[at : found.start()])
            at = found.end()
            end, name, attributes = found.groups()
            if not name:
                continue
            name = name.lower()
            if end:
                self._end(name)
            elif name in _RAW_END:
                stop = _RAW_END[name].search(source, at)
                at = stop.end() if stop else len(source)
            else:
                self._start(name, attributes)
        if at < len(source):
            self._text(source[at:])

    def _text(self, data: str) -> None:
        if self._silent:
            return
        if "&" in data:
            data = entities.unescape(data)
        self._held.append(data)
        if self._links:
            self._held_links += len("".join(data.split()))

    def _node(self, group: int, hints: int) -> int:
        self.parent.append(self._stack[-1][1])
        self.group.append(group)
        self.hints.append(hints)
        return len(self.parent) - 1

    def _flush(self, new_block: bool = True) -> None:
        """End a run of text. White space alone waits for what follows in its block."""
        if self._held:
            text = "".join(self._held)
            words = _WORD.findall(text)
            if words:
                node = self._node(_INLINE, 0)
                chars = sum(map(len, words))
                stops = len(_STOPS.findall(text))
                self.runs.append((node, chars, min(self._held_links, chars), len(words), stops, int(words[-1][-1] in ".!?:;…»”\""), self._block))
                self.texts.append(text)
            if words or new_block:
                self._held, self._held_links = [], 0
        self._block += new_block

    def _pop_to(self, depth: int) -> None:
        while len(self._stack) > depth:
            name, node = self._stack.pop()
            if name == "a":
                self._links -= 1
            elif name in _SILENT:
                self._silent -= 1

    def _close(self, names, stops) -> None:
        """End the innermost of ``names``, unless one of ``stops`` lies between."""
        for depth in range(len(self._stack) - 1, 0, -1):
            name = self._stack[depth][0]
            if name in names:
                self._flush()
                return self._pop_to(depth)
            if name in stops:
                return

    def _start(self, name: str, attributes: str) -> None:
        group = _GROUP.get(name)
        if name in ("html", "head") or self._silent and name not in _SILENT:
            return
        if group is None:
            if name == "br":
                self._text(" ")
            if name in _VOID:
                return
            hints = hints_of(attributes) if attributes else 0
            node = self._stack[-1][1]
            if hints and not self._silent:
                self._flush(new_block=False)
                node = self._node(_INLINE, hints)
            self._stack.append((name, node))
            self._links += name == "a"
            self._silent += name in _SILENT
            return
        if name not in _P_KEEPS:
            self._close(("p",), _P_STOPS)
        if name in ENDS:
            self._close(*ENDS[name])
        self._flush()
        node = self._node(group, hints_of(attributes) if attributes else 0)
        if name not in _VOID:
            self._stack.append((name, node))

    def _end(self, name: str) -> None:
        if name == "p" and not self._silent and all(n != "p" for n, _ in self._stack):
            return self._flush()
        block = name in _GROUP
        if name in ("body", "html", "head") or self._silent and name not in _SILENT:
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            one, node = self._stack[depth]
            if one == name:
                if block:
                    self._flush()
                elif node != self._stack[depth - 1][1]:
                    self._flush(new_block=False)
                return self._pop_to(depth)
            if not block and one in _GROUP:
                return  # words marked up across blocks

    def text(self, kept) -> str:
        """Runs of ``kept`` (by number), white space made single, one block a line."""
        blocks: dict[int, list[str]] = {}
        for k in kept:
            blocks.setdefault(self.runs[k][6], []).append(self.texts[k])
        return "\n".join(" ".join("".join(parts).split()) for parts in blocks.values())
