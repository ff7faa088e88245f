"""Leaf blocks of a page: the runs of text between block-level tags, with the elements around them."""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

#: Elements of lines of text; any other element begins and ends blocks.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input kbd mark meter nobr output picture progress q rp rt ruby s samp small source span strike strong sub sup time track tt u var wbr".split())
VOID = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
#: A new element of this kind ends an open one, unless one of the others stands between.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}
#: Elements whose content is no text of the page.
_SILENT = "script|style|template|textarea|title|iframe|noembed|noframes|xmp|svg|math"
_ATTRIBUTES = r"""(?>[^>"'=]+|=\s*"[^"]*"|=\s*'[^']*'|[="'])*+(?:>|\Z)"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({_SILENT})(?=[\s/>]){_ATTRIBUTES}.*?(?:</\1(?=[\s/>])[^>]*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-z][^\s/>]*)({_ATTRIBUTES})", re.S | re.I)
_NAMES = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style|data-gold)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements around a block that its features tell of, the innermost.
DEPTH = 24

#: An element: its tag, and the words in its class, id and role.
Element = tuple[str, tuple[str, ...]]


class Block(NamedTuple):
    text: str
    path: tuple[Element, ...]
    parent: int
    grandparent: int
    link_chars: int
    gold: bool


class _Open(NamedTuple):
    tag: str
    path: tuple[Element, ...]
    number: int
    gold: bool


def _named(attributes: str) -> tuple[tuple[str, ...], bool]:
    """Words of the names in a tag's attributes, and whether a made page marks it as main text."""
    words, gold = [], False
    for name, value in _NAMES.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "data-gold":
            gold = True
        elif name in ("class", "id", "role"):
            words += [w.lower() for w in _WORD.findall(value)]
        elif name != "style" and value.lower() != "false" or "display:none" in value.replace(" ", "").lower():
            words.append("hidden")
    return tuple(dict.fromkeys(words)), gold


def leaf_blocks(page: str) -> list[Block]:
    """The blocks with text, in page order; references are decoded, white space is one space, scripts and styles are left out.

    Ends that nothing began are passed over, unclosed elements end with those around them. Time grows with the page's length.
    """
    found: list[Block] = []
    stack = [_Open("", (), 0, False)]
    is_open: Counter[str] = Counter()
    pieces: list[str] = []
    link, link_chars, numbers, at = 0, 0, 0, 0  # link: depth at which an open link began

    def add(text: str) -> None:
        nonlocal link_chars
        text = html.unescape(text) if "&" in text else text
        pieces.append(text)
        if link:
            link_chars += len(text.strip())

    def flush() -> None:
        nonlocal link_chars
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                top = stack[-1]
                found.append(Block(text, top.path, top.number, stack[-2].number if len(stack) > 1 else 0, link_chars, top.gold))
            pieces.clear()
        link_chars = 0

    def end() -> None:
        nonlocal link
        is_open[stack.pop().tag] -= 1
        if link > len(stack):
            link = 0

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[3] and m[3].lower()
        if not tag:
            continue
        closes = bool(m[2])
        if tag in INLINE:
            if tag == "a":
                link = 0 if closes else len(stack)
            elif tag == "br":
                pieces.append(" ")
            continue
        flush()
        if closes:
            if is_open[tag]:
                while stack[-1].tag != tag:
                    end()
                end()
            elif tag == "p":
                continue
            continue
        if stack[-1].tag == "p":
            end()
        if tag in _ENDS and any(is_open[x] for x in _ENDS[tag][0]):
            ended, within = _ENDS[tag]
            depth = len(stack) - 1
            while depth and stack[depth].tag not in ended and stack[depth].tag not in within:
                depth -= 1
            if stack[depth].tag in ended:
                while len(stack) > depth:
                    end()
                if tag == "tr" and stack[-1].tag == "tr":
                    end()
        if tag in VOID or m[4].endswith("/>") and tag not in ("div", "p", "section", "article", "li", "td"):
            continue
        numbers += 1
        names, gold = _named(m[4])
        top = stack[-1]
        stack.append(_Open(tag, (*top.path, (tag, names))[-DEPTH:], numbers, gold or top.gold))
        is_open[tag] += 1
    if at < len(page):
        add(page[at:])
    flush()
    return found
