"""Blocks of text of an HTML page, with the little of the tree around them that the operators need. Made for broken markup: nothing has to be closed."""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

_DROP = re.compile(r"<!--.*?-->|<(script|style|noscript|template|title|head)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_HEAD = re.compile(r"\A.*?<body\b[^>]*>", re.S | re.I)
_TOKEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>|([^<]+)|<")
_ROLE = re.compile(r"role\s*=\s*[\"']?(\w+)|\bhref\s*=", re.I)
_CLASS = re.compile(r"\bclass\s*=\s*[\"']?([\w -]+)", re.I)
BLOCK = frozenset("address article aside blockquote body br button caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr legend li main nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Tags that end an open element of the same kind when their end tag is missing.
_SELF = frozenset("p li dt dd td th tr option".split())
VOID = frozenset("br hr img input meta link wbr col".split())


class Block(NamedTuple):
    text: str
    tag: str  # of the innermost block element
    links: int  # characters of the text within links
    path: tuple[int, ...]  # numbers of the open block elements, from the outside
    areas: frozenset  # tags and roles around it that tell an area: nav, header, footer, aside, main, article, dialog
    klass: str  # class of the innermost element


_AREAS = frozenset("nav header footer aside main article form dialog navigation banner contentinfo complementary search".split())

_NOWHERE: frozenset = frozenset()


def blocks(html: str | None, around: bool = True) -> list[Block]:
    """The blocks of text in order; white space is folded, entities are decoded, scripts, styles and the head are left out. Empty for null. Without ``around`` path, areas and class stay empty."""
    if not html:
        return []
    body = _DROP.sub(" ", html)
    if (m := _HEAD.match(body)) is not None:
        body = body[m.end() :]
    out: list[Block] = []
    stack: list[tuple[str, int, str, str]] = [("body", 0, "", "")]  # tag, number, area, class
    number, links, depth_a = 0, 0, 0
    parts: list[str] = []

    def flush() -> None:
        nonlocal links
        text = "".join(parts)
        parts.clear()
        if "&" in text:
            text = unescape(text)
        text = " ".join(text.split())
        if text and not around:
            out.append(Block(text, stack[-1][0], min(links, len(text)), (), _NOWHERE, ""))
        elif text:
            out.append(Block(text, stack[-1][0], min(links, len(text)), tuple(s[1] for s in stack), frozenset(s[2] for s in stack if s[2]), stack[-1][3]))
        links = 0

    for close, tag, rest, text in _TOKEN.findall(body):
        if text:
            parts.append(text)
            if depth_a:
                links += len(text.strip())
            continue
        if not tag:
            parts.append("<")
            continue
        tag = tag.lower()
        if tag == "a":
            depth_a = 0 if close else 1
            continue
        if tag not in BLOCK:
            continue
        if parts:
            flush()
        depth_a = 0
        if close:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif tag not in VOID:
            if tag in _SELF:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                    if stack[k][0] not in _SELF and stack[k][0] not in ("ul", "ol") or tag in ("p",) and stack[k][0] in ("td", "li"):
                        break
            elif stack[-1][0] == "p":
                stack.pop()
            number += 1
            area = tag if tag in _AREAS else ""
            klass = ""
            if rest and around:
                if (r := _ROLE.search(rest)) and r[1] and r[1].lower() in _AREAS:
                    area = r[1].lower()
                if c := _CLASS.search(rest):
                    klass = c[1]
            stack.append((tag, number, area, klass))
    if parts:
        flush()
    return out
