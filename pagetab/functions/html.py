"""Title, main text, anchors and base of one HTML document.

A small per-document helper for the page-text job: it walks the tags once with
a regular expression and keeps counters, because nested elements are not a
regular language and no SQL expression can match them.
"""

from __future__ import annotations

import re
from html import unescape

_TAG = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))
      | <[!?][^>]*+(?:>|\Z)
      | </([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)
      | </[^>a-zA-Z][^>]*+(?:>|\Z)
      | <([a-zA-Z][^\s/>]*+)((?:[^=>]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)""",
    re.S | re.X,
)
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_ATTRIBUTE_ENTITY = re.compile(r"&(?:\#[0-9]+;?|\#[xX][0-9a-fA-F]+;?|[A-Za-z0-9]+;|[A-Za-z0-9]+(?![A-Za-z0-9=;]))")

# Elements whose text is not page text, whose content is not
# markup, and which may appear before the body starts.
HIDDEN = frozenset(("script", "style", "noscript", "template", "head"))
RAW = frozenset(("script", "style", "iframe", "noembed", "noframes", "xmp"))
RAW_WITH_ENTITIES = frozenset(("title", "textarea"))
HEAD_CONTENT = frozenset(("html", "head", "title", "meta", "link", "base", "script", "style", "noscript", "template"))
VOID = frozenset(
    ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
)

_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW | RAW_WITH_ENTITIES}


def _attribute(text: str, wanted: str) -> str | None:
    for match in _ATTRIBUTE.finditer(text):
        name, double, single, bare = match.groups()
        if name.lower() == wanted:
            value = double or single or bare or ""
            return _ATTRIBUTE_ENTITY.sub(lambda m: unescape(m.group()), value) if "&" in value else value
    return None


def scan_page(html: str) -> tuple[str, str, str | None, list[str]]:
    """(title, main text, base href, anchor hrefs in document order).

    The main text is that of the first ``main`` or ``article`` element, or of
    the whole page when there is neither; text nodes are joined by one space
    and white space is collapsed.
    """
    title = None
    base = None
    hrefs: list[str] = []
    texts: list[str] = []
    stack: list[str] = []
    open_count: dict[str, int] = {}
    hidden = 0
    in_body = False
    root_first = root_last = root_level = None
    piece: list[str] = []
    size, position = len(html), 0

    def end_text(hidden_now: int) -> None:
        if piece:
            if not hidden_now:
                texts.append("".join(piece))
            piece.clear()

    def close_to(level: int) -> int:
        """Pop the stack down to ``level``; returns how many hidden elements were closed."""
        nonlocal root_last
        closed = 0
        while len(stack) > level:
            name = stack.pop()
            open_count[name] -= 1
            closed += name in HIDDEN
        if root_level is not None and root_last is None and len(stack) <= root_level:
            root_last = len(texts)
        return closed

    def close_head() -> int:
        return close_to(stack.index("head")) if open_count.get("head") else 0

    while position < size:
        match = _TAG.search(html, position)
        text = html[position : match.start() if match else size]
        if text:
            text = unescape(text) if "&" in text else text
            if not in_body and text.strip() and (not hidden or stack[-1] == "head"):
                hidden -= close_head()
                in_body = True
            piece.append(text)
        if match is None:
            break
        position = match.end()
        end_text(hidden)
        name = (match[1] or match[2] or "").lower()
        if match[1]:
            if open_count.get(name):
                level = len(stack) - 1
                while stack[level] != name:
                    level -= 1
                hidden -= close_to(level)
        elif match[2] and html[position - 1] == ">":  # a tag cut off by the end of the page is dropped
            if not in_body and not (name in HEAD_CONTENT or (hidden and stack[-1] != "head")):
                hidden -= close_head()
                in_body = True
            if name == "a":
                href = _attribute(match[3], "href")
                if href is not None:
                    hrefs.append(href)
            elif name == "base" and base is None:
                base = _attribute(match[3], "href")
            if name in _RAW_END:
                end = _RAW_END[name].search(html, position)
                content = html[position : end.start() if end else size]
                position = end.start() if end else size
                if name in RAW_WITH_ENTITIES:
                    content = unescape(content)
                if name == "title" and title is None:
                    title = content
                if name not in HIDDEN and not hidden and (name != "title" or in_body):
                    texts.append(content)
            elif name not in VOID:
                if root_first is None and name in ("main", "article"):
                    root_first, root_level = len(texts), len(stack)
                stack.append(name)
                open_count[name] = open_count.get(name, 0) + 1
                hidden += name in HIDDEN
    end_text(hidden)
    chosen = texts if root_first is None else texts[root_first:root_last]
    return " ".join((title or "").split()), " ".join(" ".join(chosen).split()), base, hrefs
