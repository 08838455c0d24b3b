"""From HTML source to blocks of text with their place in the page: a lenient parser in one pass."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import xxhash

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page, up to their end tag.
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: An element that a start tag closes if it is open, and the ancestors that it doesn't reach beyond.
_CLOSES_P = BLOCK - frozenset("body head html option optgroup td th tr tbody thead tfoot caption legend".split())
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
             "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

NOISE_TAGS = frozenset("nav aside footer form button select option fieldset dialog menu head input label".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist status tooltip".split())
#: Words of class and id names that mark what is no content in any name.
NOISE_WORDS = frozenset(
    "navbar navigation menubar breadcrumb breadcrumbs masthead sidebar sidenav advert adverts advertisement advertising adsense adbox adslot sponsored cookie cookies gdpr "
    "popup popover newsletter paywall recommended recommendations recirc outbrain taboola commentlist disqus pagination pager copyright colophon".split()
)
#: Words that do so only where a name holds nothing but them and words of layout.
NOISE_IF_ALONE = frozenset(
    "nav menu topbar banner footer foot aside rail widget widgets ad ads sponsor promo promotion promoted consent notice notices notification notifications alert alerts modal "
    "overlay subscribe subscription signup signin login register share sharing social related comment comments discussion respond reply replies search searchbox toolbar skip hidden".split()
)
LAYOUT_WORDS = frozenset(
    "box block list container wrap wrapper bar slot top left right bottom side main site page section area inner outer unit module item panel row col column group content body "
    "text title link links button buttons icon icons global primary secondary sticky fixed floating mobile desktop user reader wide small large post posts article articles entry story stories "
    "author date meta time name form count thread more also header".split()
)
#: Words beside which "header" is that of a site, not of an article.
HEADER_WORDS = frozenset("header site page global main top bar wrap wrapper container inner sticky fixed primary mobile desktop".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>)")
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Characters of a start tag's attributes below which its element is remembered.
KEPT_SOURCE = 500
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


#: Levels of a page's tree that style nodes are told apart by; below, a node hangs on the last of them.
LEVELS = 24


@dataclass(slots=True)
class Block:
    text: str
    nodes: tuple[int, ...]  # style nodes (tags and classes from the body down) that may be judged, outermost first
    noise: bool  # below an element whose tag, role or name marks it as no content
    scope: str  # "article", "main" or ""
    linked: int  # characters inside links


@dataclass(slots=True)
class Node:
    """An element as the style tree counts it: its style node, how it is made up, how many blocks are right below."""

    node: int
    makeup: int
    kids: int


@dataclass(slots=True)
class _Element:
    tag: str
    style: str
    noise: bool
    scope: str
    plain: bool  # neither it nor an element between it and the scope has a class or id
    block: bool


class _Open:
    """An element on the stack; ``home`` is the block that its text belongs to, itself or one above."""

    __slots__ = ("element", "node", "over", "home", "judged", "made", "kids", "chars")

    def __init__(self, element: _Element, over: _Open | None = None):
        self.element, self.over = element, over and over.home
        self.home = self if element.block or over is None else over.home
        self.made = self.kids = self.chars = self.node = 0
        self.judged: tuple[int, ...] = over.judged if over and over.element.scope == element.scope else ()
        if element.block and over:
            self.node = _child(over.home.node, element.style)
            # in an article only what has names of its own is judged; elsewhere every level is
            if (not element.plain or not element.scope) and len(self.judged) < LEVELS:
                self.judged = (*self.judged, self.node)


def _noisy_name(names: str) -> bool:
    for name in names.split():
        words = {w.lower() for w in _WORD.findall(name) if not w.isdigit()}
        if not words or _WORD.findall(name)[0].lower() in ("has", "no", "with", "without", "is"):
            continue
        if words & NOISE_WORDS or "header" in words and words <= HEADER_WORDS:
            return True
        if words & NOISE_IF_ALONE and words <= NOISE_IF_ALONE | LAYOUT_WORDS:
            return True
    return False


@lru_cache(maxsize=100_000)
def _child(node: int, style: str) -> int:
    """The style node below ``node`` of elements of a style, as a 63-bit number."""
    return xxhash.xxh64_intdigest(f"{node}>{style}") >> 1


def _element(tag: str, source: str, noisy: bool, within: str, plain: bool) -> _Element:
    """A new element below one that is ``noisy``, in the scope ``within`` and ``plain``; long sources aren't kept."""
    return (_known_element if len(source) < KEPT_SOURCE else _new_element)(tag, source, noisy, within, plain)


def _new_element(tag: str, source: str, noisy: bool, within: str, plain: bool) -> _Element:
    attrs = {}
    if source and not source.isspace():
        for m in _ATTR.finditer(source):
            attrs.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    role = attrs.get("role", "").lower()
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
    scope = within
    if tag == "article" or role == "article" or "articleBody" in attrs.get("itemprop", ""):
        scope = "article"
    elif not scope and (tag == "main" or role == "main"):
        scope = "main"
    noise = noisy or (
        tag in NOISE_TAGS
        or tag == "header" and scope != "article"
        or role in NOISE_ROLES
        or "hidden" in attrs
        or attrs.get("aria-hidden", "").lower() == "true"
        or bool(_HIDDEN.search(attrs.get("style", "")))
        or tag not in ("html", "body", "article", "main") and bool(names) and _noisy_name(names)
    )
    style = tag + "".join(f".{c}" for c in sorted(set(attrs.get("class", "").split())))
    plain = plain if within == scope else True
    return _Element(tag, style, noise, scope, plain and (not names or tag in ("html", "body", "article", "main")), tag in BLOCK and tag not in ("html", "body"))


_known_element = lru_cache(maxsize=20_000)(_new_element)


def parsed(html: str) -> tuple[list[Block], list[Node]]:
    """The text blocks of a page in order, and its elements. Inline elements and ``br`` don't end a block; white space
    becomes one space; character references are decoded; unclosed and stray tags are borne as browsers do."""
    out: list[Block] = []
    nodes: list[Node] = []
    stack: list[_Open] = []
    buffer: list[str] = []
    linked = 0
    links = 0
    root = _Open(_element("body", "", False, "", True))

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                top = stack[-1] if stack else root
                top.home.chars += len(text)
                out.append(Block(text, top.judged, top.element.noise, top.element.scope, linked))
        linked = 0

    def close(entry: _Open) -> None:
        nodes.append(Node(entry.node, _child(entry.made, str(entry.chars.bit_length())), entry.kids))
        if over := entry.over:
            over.chars += entry.chars
            over.kids += 1
            over.made = _child(over.made, entry.element.style)

    def add(text: str) -> None:
        nonlocal linked
        if text:
            text = unescape(text) if "&" in text else text
            buffer.append(text)
            if links:
                linked += len(text.strip())

    def pop_to(at: int) -> None:
        nonlocal links
        if any(e.element.tag in BLOCK for e in stack[at:]):
            flush()
        while len(stack) > at:
            entry = stack.pop()
            links -= entry.element.tag == "a"
            if entry.element.block:
                close(entry)

    pos, n, lower = 0, len(html), None
    while pos < n:
        at = html.find("<", pos)
        if at < 0:
            add(html[pos:])
            break
        m = _TAG.match(html, at)
        if m is None:  # an opening bracket that starts no tag is text; a tag that never ends hides the rest
            if at + 1 < n and (html[at + 1].isalpha() or html[at + 1] == "/"):
                end = html.find(">", at)
                add(html[pos:at])
                pos = n if end < 0 else end + 1
            else:
                add(html[pos : at + 1])
                pos = at + 1
            continue
        add(html[pos:at])
        if m[1] or m[2]:
            end = html.find("-->", at + 2) if m[1] else html.find(">", at)
            pos = n if end < 0 else end + (3 if m[1] else 1)
            continue
        pos, tag = m.end(), m[4].lower()
        if m[3]:
            if tag == "p" and not any(e.element.tag == "p" for e in stack):
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].element.tag == tag:
                    pop_to(i)
                    break
                if stack[i].element.tag in ("table", "article", "main", "body") and tag not in ("article", "main", "body", "html", "table", "div", "section"):
                    break
            continue
        if tag in RAW:
            if not m[5].endswith("/"):
                lower = lower if lower is not None else html.lower() if html.isascii() else re.sub("[A-Z]+", lambda x: x[0].lower(), html)
                end = lower.find(f"</{tag}", pos)
                end = html.find(">", end) if end >= 0 else -1
                pos = n if end < 0 else end + 1
            if tag in ("svg", "iframe", "video", "audio", "canvas", "object"):
                buffer.append(" ")
            continue
        if tag == "br" or tag in VOID and tag not in BLOCK:
            if tag == "br":
                buffer.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag in _CLOSES_P:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].element.tag == "p":
                        pop_to(i)
                        break
                    if stack[i].element.tag in ("td", "th", "table", "article", "div", "li", "button"):
                        break
            if tag in _SIBLINGS:
                own, bound = _SIBLINGS[tag]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].element.tag in bound:
                        break
                    if stack[i].element.tag in own:
                        pop_to(i)
                        break
            if tag == "hr":
                continue
        over = stack[-1] if stack else root
        above = over.element
        stack.append(_Open(_element(tag, m[5], above.noise, above.scope, above.plain), over))
        links += tag == "a"
    pop_to(0)
    flush()
    close(root)
    return out, nodes


def blocks_of(html: str) -> list[Block]:
    return parsed(html)[0]
