"""Leaf blocks of a web page: their tag path, their text, and how much of it is link text."""

from __future__ import annotations

import html as entities
import re
from collections import Counter

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|iframe|textarea)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/)?(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>"
    r"|<[a-zA-Z][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
PARTS = re.compile(r"[A-Za-z]+")
BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
VOID = frozenset("hr input img br meta link".split())
#: Elements whose content is no text of the page, where they end before the element around them does.
SKIPPED = frozenset("noscript template svg object select".split())
SKIPS = re.compile(rf"<(?:{'|'.join(sorted(SKIPPED))})\b", re.IGNORECASE)
#: A start tag of the first kind ends an open element of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "body": {"head", "title"}}


def skipped(tokens: list[re.Match]) -> dict[int, int]:
    """The skipped elements among tokens: where the start tag begins, and where the end tag ends.

    A start tag without an end tag inside the element around it skips nothing; neither does a self-closed svg, nor an
    svg that a block of the page follows before it ends.
    """
    spans: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    held: Counter = Counter()
    for m in tokens:
        tag = (m["tag"] or "").lower()
        if tag in VOID or tag not in BLOCKS and tag not in SKIPPED and tag != "foreignobject":
            continue
        if m["end"]:
            while held[tag]:
                name, at = stack.pop()
                held[name] -= 1
                if name == tag:
                    if tag in SKIPPED:
                        spans[at] = m.end()
                    break
        elif not (tag not in SKIPPED - {"svg"} and m["attrs"].endswith("/")):
            if tag in BLOCKS and tag != "title" and stack and stack[-1][0] == "svg":
                held[stack.pop()[0]] -= 1
            stack.append((tag, m.start()))
            held[tag] += 1
    return spans


def leaf_blocks(page: str) -> list[tuple[tuple[str, ...], str, float]]:
    """(tag path with class and id words, text, share of link characters) of each block that has text, in order."""
    out: list[tuple[tuple[str, ...], str, float]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    at, links, linked = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            raw = "".join(pieces)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                path = tuple(x for _, names in stack for x in names)
                out.append((path, text, min(1.0, linked / len(text))))
            pieces.clear()
        linked = 0

    tokens = TOKEN.finditer(page)
    spans: dict[int, int] = {}
    if SKIPS.search(page):
        tokens = list(tokens)
        spans = skipped(tokens)
    for m in tokens:
        if m.start() < at:
            continue
        if m.start() > at:
            piece = page[at : m.start()]
            pieces.append(piece)
            if links:
                linked += len(piece)
        at = spans.get(m.start(), m.end())
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            links = 0 if m["end"] else 1
        if tag not in BLOCKS:
            if tag in VOID:
                pieces.append(" ")
            continue
        flush()
        if m["end"]:
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        if stack and stack[-1][0] == "p":
            stack.pop()
        closes = CLOSES.get(tag)
        while closes and stack and stack[-1][0] in closes:
            stack.pop()
        if tag not in VOID and not m["attrs"].endswith("/"):
            words = [w.lower() for a in NAMES.findall(m["attrs"]) for w in PARTS.findall(next(filter(None, a), ""))] if m["attrs"] else []
            stack.append((tag, (f"<{tag}>", *(f".{w}" for w in words))))
    if at < len(page):
        pieces.append(page[at:])
    flush()
    return out
