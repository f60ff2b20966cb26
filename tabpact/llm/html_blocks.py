"""HTML pages as sequences of leaf blocks.

A block is the text between two tags that part blocks, with the tags (and their class and id words) around it. Markup, comments,
scripts, styles and other elements whose content is no text of the page are left out. Malformed pages give blocks as well: an
element that is not closed ends with the one around it, a paragraph ends where the next block begins, and a tag cut off at the page's end is no text.
An element within ``DEEPEST`` others is none of the path; its text belongs to the innermost of those.
A head ends with its first text or element of the body. Of the elements left out only those in ``RAW`` reach to the page's end if they are not closed; of others the tag alone goes.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# Kinds of elements of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template svg iframe object canvas audio video title textarea select datalist button".split())
RAW = set("script style textarea title".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math semantics annotation mrow mi mo mn ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded mphantom menclose merror mmultiscripts mprescripts "
    "mtable mtr mtd".split()
)
#: As with browsers, the depth of a page has a limit; without one, a page of open elements would cost the square of its length.
DEEPEST = 256
CLOSES_SAME = set("li dt dd tr td th p option".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\s+[^\s=>\"']+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+))?)*\s*/?)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Block:
    """``path``: per open element its tag and the words of its class, id and role, outermost first. ``linked``: characters within links."""

    path: tuple[tuple[str, ...], ...]
    text: str
    linked: int


def _element(tag: str, attributes: str) -> tuple[str, ...]:
    names = [w for m in _NAMES.finditer(attributes) for w in _WORDS.findall("".join(x or "" for x in m.groups()).lower())] if attributes else []
    return (tag, *names)


def _ends(page: str, tag: str) -> dict[int, int]:
    """Where each closed element of a kind ends, by where it begins."""
    ends: dict[int, int] = {}
    begun: list[int] = []
    # Behind the last ">" no tag ends, so no search runs on to the page's end in vain.
    for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])([^>]*)>", re.I).finditer(page, 0, page.rfind(">") + 1):
        if not m[1]:
            if not m[2].endswith("/"):
                begun.append(m.start())
        elif begun:
            ends[begun.pop()] = m.end()
    return ends


def blocks_of(page: str | None) -> list[Block]:
    """The blocks of a page that have text, in page order."""
    page = page or ""
    found: list[Block] = []
    stack: list[tuple[str, ...]] = []
    path: tuple[tuple[str, ...], ...] | None = ()
    deeper = 0
    text: list[str] = []
    ends: dict[str, dict[int, int]] = {}
    linked = in_links = 0
    at = 0

    def flush() -> None:
        nonlocal linked, path
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                if path is None:
                    path = tuple(stack)
                found.append(Block(path, joined, linked))
            text.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked, path
        plain = html.unescape(raw) if "&" in raw else raw
        if stack and stack[-1][0] == "head" and plain.strip():
            stack.pop()
            path = None
        text.append(plain)
        if in_links:
            linked += len(plain.strip())

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:  # an end
            if tag not in INLINE:
                flush()
            if deeper:
                deeper -= 1
                continue
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    del stack[depth:]
                    path = None
                    break
        elif tag in HIDDEN:
            if tag not in ("button", "noscript"):
                flush()
            if not (m[3] or m[6] or "").endswith("/"):
                if tag in RAW:
                    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                    at = end.end() if end else len(page)
                else:
                    if tag not in ends:
                        ends[tag] = _ends(page, tag)
                    at = ends[tag].get(m.start(), at)
        elif tag == "br" or tag == "wbr":
            text.append(" " if tag == "br" else "")
        elif tag in VOID:
            if tag == "hr":
                flush()
        else:
            if stack and stack[-1][0] == "head":
                stack.pop()
                path = None
            if tag not in INLINE:
                flush()
                same = tag if tag in CLOSES_SAME else "p"
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == same:
                        del stack[depth:]
                        path = None
                        break
                    if stack[depth][0] not in INLINE:
                        break
            if len(stack) >= DEEPEST:
                deeper += 1
            else:
                stack.append(_element(tag, m[3] or m[6] or ""))
                path = None
        in_links = sum(e[0] == "a" for e in stack[-8:])
    add(page[at:])
    flush()
    return found
